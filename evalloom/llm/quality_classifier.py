"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word's index vector is the mean of the sparse ternary vectors of its three-byte strings; these follow
from a hash by rule and are not stored. Its context vector is the sum of the index vectors of its
neighbours in the training texts, kept in a table of fixed size. A document is the mean of its words'
index and context vectors, the mean index vector of its distinct words, and six numbers on its length
and repetition. The network is trained with numpy on the driver from a bounded sample of labelled
documents, and its temperature is fitted on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import mix
from evalloom.llm.tokens import Words, grams, parts
from evalloom.session import checkpoint, ship_package

DIM, CONTEXTS, GRAM_TABLE = 48, 1 << 13, 1 << 13
N_FEATURES = 3 * DIM + 6


def _index_table() -> np.ndarray:
    """Ternary vectors with four non-zeros for each hash value, by rule."""
    table = np.zeros((GRAM_TABLE, DIM), np.float32)
    h = mix(np.arange(1, GRAM_TABLE + 1, dtype=np.uint64))
    for i in range(4):
        at = (h >> np.uint64(12 * i)) % np.uint64(DIM)
        sign = np.where((h >> np.uint64(50 + i)) & np.uint64(1), 1.0, -1.0)
        table[np.arange(GRAM_TABLE), at.astype(int)] += sign
    return table


_INDEX = _index_table()


def index_vectors(words: list[bytes]) -> np.ndarray:
    out = np.zeros((len(words), DIM), np.float32)
    for a in range(0, len(words), 20_000):
        some = words[a : a + 20_000]
        keys, first = grams(some, 3)
        total = np.add.reduceat(_INDEX[(keys % np.uint64(GRAM_TABLE)).astype(np.int64)], first)
        out[a : a + len(some)] = total / np.diff(np.append(first, len(keys)))[:, None]
    return out


def _slot(words: Words) -> np.ndarray:
    return (words.keys % np.uint64(CONTEXTS)).astype(np.int64)


def context_sums(texts: list[bytes], reach: int = 2) -> np.ndarray:
    """Index vectors of the neighbours within ``reach`` words, summed by the word's slot."""
    words = Words([t.split() for t in texts])
    vectors, slot = index_vectors(words.distinct), _slot(words)
    out = np.zeros((CONTEXTS, DIM), np.float32)
    for row in words.rows():
        v = vectors[row]
        for d in range(1, min(reach, len(row) - 1) + 1):
            np.add.at(out, slot[row[d:]], v[:-d])
            np.add.at(out, slot[row[:-d]], v[d:])
    return out


def features(texts: list[bytes], contexts: np.ndarray) -> np.ndarray:
    """One row per text; a text without words is all zeros."""
    words = Words([t.split() for t in texts])
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    if not words.distinct:
        return out
    vectors = np.hstack([index_vectors(words.distinct), contexts[_slot(words)]])
    sizes = np.fromiter(map(len, words.distinct), np.float64, len(words.distinct))
    for i, row in enumerate(words.rows()):
        if len(row):
            kinds, times = np.unique(row, return_counts=True)
            out[i, : 2 * DIM] = vectors[row].mean(axis=0)
            out[i, 2 * DIM : 3 * DIM] = vectors[kinds, :DIM].mean(axis=0)
            lines = texts[i].split(b"\n")
            again = times.max() / len(row) if len(row) > 1 else 0
            same = (row[1:] == row[:-1]).mean() if len(row) > 1 else 0
            out[i, 3 * DIM :] = (
                np.log1p(len(row)) / 10, len(kinds) / len(row), sizes[row].mean() / 10,
                len(set(lines)) / len(lines), again, same,
            )
    return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Row by row the same, whatever the batch: sums run in double precision, rounded to 9 digits."""
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30))), 9)


def constant(share: float) -> Network:
    zero = np.zeros((N_FEATURES, 1))
    return Network(np.zeros(N_FEATURES), np.ones(N_FEATURES), zero, np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 7) -> Network:
    """Adam on the log loss; every fifth row is held back for the temperature."""
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return constant((y.sum() + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    held = np.arange(len(y)) % 5 == 4
    fit, target = x[~held], y[~held]
    mean, scale = fit.mean(axis=0), 1 / (fit.std(axis=0) + 1e-3)
    z = (fit - mean) * scale
    p = [rng.normal(0, (2 / N_FEATURES) ** 0.5, (N_FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(z), 128):
            rows = order[a : a + 128]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - target[rows]) / len(rows)
            back = np.outer(d, p[2]) * (h > 0)
            step += 1
            for i, g in enumerate((z[rows].T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits, truth = net.logits(x[held]), y[held]
    losses = {t: np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / t).mean() for t in np.geomspace(0.25, 8, 41)}
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(min(losses, key=losses.get)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled texts, the first in the order of a hash of their ids; of several rows
    with one id the least text."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().filter(fold)
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The ids are at most ``bound`` rows of two numbers.
    found = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return found.orderBy(F.xxhash64("id"), "id").select("text", "label")


class QualityClassifier:
    """A fitted model; ``scores`` is a column of scores of a text column."""

    def __init__(self, contexts: np.ndarray, network: Network):
        self.contexts, self.network = contexts, network

    def scores(self, text: Column, spark) -> Column:
        ship_package(spark)
        model = spark.sparkContext.broadcast((self.contexts, self.network))  # fixed size: CONTEXTS x DIM numbers

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            contexts, network = model.value
            for batch in batches:
                out = []
                for a in range(0, len(batch), 512):
                    texts = [(t or "").encode() for t in batch.iloc[a : a + 512]]
                    out.append(network.score(features(texts, contexts)))
                yield pd.Series(np.concatenate(out) if out else np.zeros(0))

        return score(text)


def fit_quality(
    docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = 8_000, slices: int = 12
) -> QualityClassifier:
    """Fit on at most ``bound`` labelled documents, whole texts. ``fold`` is a condition on ``id``.

    Two passes over the sample: contexts, then features. A labelled id without a document is left
    out; of several labels for an id the smallest counts. With fewer than 20 labelled documents, or
    only one label, the model is the labels' share.
    """
    ship_package(docs.sparkSession)
    sample = checkpoint(_sample(docs, labels, id_col, text_col, label_col, fold, bound).coalesce(slices))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CONTEXTS, DIM), np.float32)
        for batch in batches:
            for texts in parts(batch, "text"):
                total += context_sums(texts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = np.zeros((CONTEXTS, DIM), np.float64)
    for row in sample.select("text").mapInArrow(contexts, "total binary").toLocalIterator():
        total += np.frombuffer(row[0], np.float32).reshape(CONTEXTS, DIM)
    table = (total / (np.linalg.norm(total, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, shared.value) for t in parts(batch, "text")]
            if x:
                flat = [r.tobytes() for r in np.vstack(x)]
                yield pa.RecordBatch.from_arrays([pa.array(flat, pa.binary()), batch["label"]], ["x", "label"])

    found = sample.mapInArrow(rows, "x binary, label int").collect()
    x = np.array([np.frombuffer(r[0], np.float32) for r in found]).reshape(-1, N_FEATURES)
    y = np.array([r[1] for r in found], np.int64)
    order = np.lexsort((y, *x.T[:3]))  # the rows' order must not depend on tasks
    order = order[np.random.default_rng(11).permutation(len(order))]
    return QualityClassifier(table, train(x[order], y[order]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, bound: int = 8_000
) -> DataFrame:
    """``doc_id, score, predicted`` of every row, from its text alone.

    The score of a null or empty text is what the network makes of a document without words. Repeated
    rows get equal scores; other columns are ignored.
    """
    model = fit_quality(docs, labels, fold, id_col, text_col, bound=bound)
    out = docs.select(F.col(id_col).alias("doc_id"), model.scores(F.col(text_col), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
