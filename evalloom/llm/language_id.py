"""Language identification of mixed-language text.

Script ranges narrow each word's candidate languages to those that write it; per-word scores of
character n-grams rate the candidates; Viterbi with a penalty for every switch labels spans of words.

The model is counted from a bounded sample of labelled texts, about ``per_language`` documents of each
language, drawn by a hash of their ids: for every language a table of fixed size with the logarithms
of n-gram shares, and the share of its letters in every script.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.tokens import Words, grams, parts
from evalloom.session import ship_package

# First code points of the ranges of letters of common scripts (Unicode blocks).
SCRIPTS = ("other", "latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "kana", "han", "hangul")
RANGES = (
    (0x41, 0x24F, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x590, 0x5FF, "hebrew"),
    (0x600, 0x6FF, "arabic"), (0x750, 0x77F, "arabic"), (0x900, 0x97F, "devanagari"), (0xE00, 0xE7F, "thai"),
    (0x1E00, 0x1EFF, "latin"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)

UNKNOWN = "und"
TABLE = 1 << 16
GRAMS = (2, 3, 5)
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[bytes]:
    """Runs of letters, lower-cased."""
    return [w.encode() for w in _LETTERS.findall(text.lower())]


def scripts_of(words: list[bytes]) -> np.ndarray:
    """Script of each word's first letter, by number."""
    first = np.array([ord(w.decode()[0]) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    for lo, hi, name in RANGES:
        out[(first >= lo) & (first <= hi)] = SCRIPTS.index(name)
    return out


def _slots(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, n in enumerate(GRAMS):
        keys, first = grams(words, n)
        yield i * TABLE + (keys % np.uint64(TABLE)).astype(np.int64), first


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of the texts' n-grams, then of their words by script."""
    out = np.zeros(len(GRAMS) * TABLE + len(SCRIPTS))
    words = Words([words_of(t) for t in texts])
    if words.distinct:
        for slot, first in _slots(words.distinct):
            times = np.repeat(words.counts, np.diff(np.append(first, len(slot))))
            out[: len(GRAMS) * TABLE] += np.bincount(slot, times, len(GRAMS) * TABLE)
        out[len(GRAMS) * TABLE :] += np.bincount(scripts_of(words.distinct), words.counts, len(SCRIPTS))
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # language x n-gram slot
    writes: np.ndarray  # language x script: is the script one of the language's?
    switch: float
    floor: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Score of every language for every word: 0 for the best one, at least ``floor`` for others."""
        out = np.zeros((len(words), len(self.languages)))
        for slot, first in _slots(words):
            sizes = np.diff(np.append(first, len(slot)))
            for k in range(len(self.languages)):
                out[:, k] += np.add.reduceat(self.logs[k][slot], first) / np.sqrt(sizes)
        allowed = self.writes[:, scripts_of(words)].T
        allowed |= ~allowed.any(axis=1, keepdims=True)
        out[~allowed] = -np.inf
        return np.maximum(out - out.max(axis=1, keepdims=True), self.floor)

    def label(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[list[bytes]]]:
        """Language number and scores of every word of each text, and the words."""
        split = [words_of(t) for t in texts]
        words = Words(split)
        scores = self.word_scores(words.distinct) if words.distinct else np.zeros((0, len(self.languages)))
        each = [scores[row] for row in words.rows()]
        return viterbi(each, self.switch), each, split


def _plain(score: np.ndarray, switch: float) -> int | None:
    """The language of a text whose best path has no switch, where that is easily seen.

    Let no stretch of words on which another language is better gain as much as one switch costs. A path
    with m switches then loses unless all of its m + 1 stretches are off the best language; such a path
    gains at most what the best other language of every word does, summed over the text. If each stretch
    gains less than half a switch, that sum need not be taken.
    """
    best = int(score.sum(axis=0).argmax())
    gain = np.cumsum(score - score[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    most = (gain - low).max()
    if most < switch / 2:
        return best
    if most >= switch:
        return None
    others = score.copy()
    others[:, best] = -np.inf
    return best if others.max(axis=1).sum() - score[:, best].sum() < switch else None


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best paths of many texts at once: step by step over the words, all long enough texts together."""
    out: list[np.ndarray | None] = [None] * len(scores)
    mixed = []
    for i, s in enumerate(scores):
        one = _plain(s, switch) if len(s) else 0
        if one is None:
            mixed.append(i)
        else:
            out[i] = np.full(len(s), one, np.int16)
    if not mixed:
        return out
    mixed.sort(key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in mixed])
    flat = np.concatenate([scores[i] for i in mixed])
    begin = np.cumsum(sizes) - sizes
    total = flat[begin].copy()
    stay = np.zeros(flat.shape, bool)  # keeps the language of the word before
    come = np.zeros(len(flat), np.int16)  # else comes from the best one
    for t in range(1, sizes[0]):
        n = int(np.searchsorted(-sizes, -t, "left"))
        at = begin[:n] + t
        best = total[:n].argmax(axis=1)
        moved = total[np.arange(n), best][:, None] - switch
        stay[at] = total[:n] >= moved
        come[at] = best
        total[:n] = np.maximum(total[:n], moved) + flat[at]
    state = total.argmax(axis=1)
    path = np.zeros(len(flat), np.int16)
    for t in range(sizes[0] - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -t, "left"))
        at = begin[:n] + t
        path[at] = state[:n]
        state[:n] = np.where(stay[at, state[:n]], state[:n], come[at])
    for i, a, n in zip(mixed, begin.tolist(), sizes.tolist(), strict=True):
        out[i] = path[a : a + n]
    return out


def fit_languages(
    docs: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 2_000, switch: float = 12.0, floor: float = -6.0, slices: int = 6, max_languages: int = 256,
) -> LanguageModel:
    """Count the model on about ``per_language`` whole texts of each language under ``fold``, a
    condition on ``id``: one text for each drawn id, the one with the smallest hash, so that repeated rows keep the
    bound. Rows without text or language are left out. Of more than ``max_languages`` languages the most
    frequent are learned (of equally frequent ones the first by name): tables of all of them go to every worker."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(fold).filter("text is not null and lang is not null")
    counted = rows.groupBy("lang").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    share = {r["lang"]: min(1.0, per_language / max(1, r["n"])) for r in counted}
    languages = tuple(sorted(share))
    if not languages:
        return LanguageModel((), np.zeros((0, len(GRAMS) * TABLE)), np.zeros((0, len(SCRIPTS)), bool), switch, floor)
    drawn = F.lit(False)
    for lang, p in share.items():
        drawn = drawn | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(p * (1 << 30))))
    one = rows.filter(drawn).groupBy("lang", "id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = one.select("text", "lang").repartition(slices)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for a in range(0, len(langs), 512):
                texts = [t.decode() for t in next(parts(batch.slice(a, 512), "text"))]
                for lang in set(langs[a : a + 512]):
                    of = gram_counts([t for t, x in zip(texts, langs[a:], strict=False) if x == lang])
                    total[lang] = total.get(lang, 0) + of
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([total[x].tobytes() for x in names], pa.binary())], ["lang", "counts"])

    counts = {lang: np.zeros(len(GRAMS) * TABLE + len(SCRIPTS)) for lang in languages}
    for row in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():  # a fixed number of tables
        counts[row[0]] += np.frombuffer(row[1])
    logs, writes = [], []
    for lang in languages:
        grams_, script = np.split(counts[lang], [len(GRAMS) * TABLE])
        per = grams_.reshape(len(GRAMS), TABLE) + 0.2
        logs.append(np.log(per / per.sum(axis=1, keepdims=True)).ravel())
        writes.append(script > 0.02 * max(1.0, script.sum()))
    return LanguageModel(languages, np.array(logs, np.float32), np.array(writes), switch, floor)


_RESULT = "struct<lang_pred: string, score: double, spans: array<struct<lang: string, start: int, stop: int>>>"


def language_column(model: LanguageModel, text: Column, spark) -> Column:
    """Prediction, score and spans (in words of letters) of a text column."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x fixed table

    @F.pandas_udf(_RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = []
            for a in range(0, len(batch), 512):
                rows += _predict(m, [t or "" for t in batch.iloc[a : a + 512]])
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])

    return predict(text)


def _predict(m: LanguageModel, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
    if not m.languages:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    out = []
    for path, score, words in zip(*m.label(texts), strict=True):
        if not len(path):
            out.append((UNKNOWN, 0.0, []))
            continue
        letters = np.fromiter((len(w.decode()) for w in words), np.float64, len(words))
        share = np.bincount(path, letters, len(m.languages)) / letters.sum()
        best = int(share.argmax())
        odds = np.exp(np.clip(score.sum(axis=0) - score.sum(axis=0)[best], -50, 50))
        cut = np.flatnonzero(np.diff(path)) + 1
        spans = [
            {"lang": m.languages[path[a]], "start": int(a), "stop": int(b)}
            for a, b in zip(np.append(0, cut), np.append(cut, len(path)), strict=True)
        ]
        out.append((m.languages[best], round(float(share[best] * (1 / odds.sum() if len(cut) == 0 else 1)), 9), spans))
    return out


def language_id(docs: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2_000) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row.

    ``lang_pred`` is the language of most letters on the best path, ``score`` their share (times the
    language's posterior where the path has no switch). A text that is null or without a letter is
    ``und`` with score 0; so are all where nothing can be learned. Other columns are ignored. More
    than 256 different languages to learn from are an error.
    """
    model = fit_languages(docs, fold, id_col, text_col, lang_col, per_language)
    found = docs.select(F.col(id_col).alias("doc_id"), language_column(model, F.col(text_col), docs.sparkSession).alias("r"))
    return found.select("doc_id", "r.lang_pred", "r.score", "r.spans")
