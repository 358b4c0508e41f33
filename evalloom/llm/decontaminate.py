"""Benchmark decontamination by latent semantic retrieval.

Word weights come from document frequencies over all documents, counted in a table of fixed size. The
TF-IDF matrix of the benchmark's passages is factored by a distributed randomised SVD. Every passage
of every document, overlapping runs of words, is projected into the latent space and compared by
cosine with all benchmark items. Two exact searches stand beside it, which no word's frequency and no
item's length weakens: for runs of up to three words that an item and a text share, and for the most
telling word of an item. Passages near an item are checked by the longest common subsequence
of words, and for paraphrases also for the item's answer: one of its most telling words must be there,
and the words that are there must carry two fifths of the item's weight.

Each document is judged where it is read. Only the weights, the factors and the items go to the
workers: their size depends on the tables' fixed sizes and on the items in a block, which is bounded;
a larger benchmark takes further blocks over the same rows. Items are cut into passages like documents. The rank follows
them: they are factored in groups of bounded size, each to full rank, so a copy's cosine shrinks neither with the size of
the benchmark nor with the length of an item. Of items much shorter than a passage the exact searches find
the copies that it misses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import Distinct, hashes, mix, rolled
from evalloom.llm.tokens import parts
from evalloom.session import ship_package

SLOTS = 1 << 16
CHUNK = 1 << 12
FLOOR = 0.1  # weight of a word that every document holds
RUN = 3  # words
DENSE = 512
BOUNDS = 8
SLACK = 1e-3  # of a cosine, for rounding
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters and digits; all bytes of non-ASCII characters count as letters."""
    return text.lower().translate(_PLAIN).split()


def slots_of(words: list[bytes]) -> np.ndarray:
    return (hashes(words) % np.uint64(SLOTS)).astype(np.int64)


def document_frequency(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each slot's words occur, over whole texts of all rows.

    Workers add their batches up before the shuffle and send the table in chunks, so the sum of each
    chunk is one small task and the driver gets one table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for texts in parts(batch, "text"):
                n += len(texts)
                split = [words_of(t) for t in texts]
                row = np.repeat(np.arange(len(split)), [len(w) for w in split])
                slot = slots_of([w for words in split for w in words])
                held = row * SLOTS + slot
                held.sort()
                total += np.bincount(held[np.flatnonzero(np.diff(held, prepend=-1))] % SLOTS, minlength=SLOTS)
        chunks = list(range(0, SLOTS, CHUNK))
        bodies = [total[a : a + CHUNK].tobytes() for a in chunks]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*chunks, -1], pa.int32()), pa.array([*bodies, np.array([n]).tobytes()], pa.binary())], ["chunk", "body"]
        )

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in group["body"])
        return pa.table({"chunk": group["chunk"].slice(0, 1), "body": pa.array([total.tobytes()], pa.binary())})

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "chunk int, body binary")
    found = {r[0]: np.frombuffer(r[1], np.int64) for r in counted.groupBy("chunk").applyInArrow(add, "chunk int, body binary").collect()}
    if not found:
        return 0, np.zeros(SLOTS, np.int64)
    return int(found.pop(-1)[0]), np.concatenate([found[a] for a in sorted(found)])


def _rows(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of unit length: row numbers, slots and values."""
    split = [slots_of(words_of(t)) for t in texts]
    row = np.repeat(np.arange(len(split)), [len(x) for x in split])
    found = Distinct((row * SLOTS + np.concatenate(split)).astype(np.uint64)) if len(row) else None
    if found is None:
        return row, row, np.zeros(0)
    keys = found.keys.astype(np.int64)
    row, slot = keys // SLOTS, keys % SLOTS
    value = (1 + np.log(found.counts)) * idf[slot]
    norm = np.sqrt(np.bincount(row, value**2, len(texts)))
    return row, slot, value / np.maximum(norm, 1e-9)[row]


Basis = tuple[np.ndarray, np.ndarray]


def _basis_rows(basis: Basis | None, slots: np.ndarray, rank: int) -> np.ndarray:
    """Rows of a basis (sorted slots, their rows) for some slots, zeros where it has none. Without a basis random signs
    by rule; only the rows that are asked for are ever made."""
    if basis is None:
        at = (slots.astype(np.uint64) + np.uint64(1))[:, None] * np.uint64(rank + 1) + np.arange(rank, dtype=np.uint64)
        return np.where(mix(at) & np.uint64(1), 1.0, -1.0)
    out = np.zeros((len(slots), rank))
    if len(basis[0]):
        at = np.minimum(np.searchsorted(basis[0], slots), len(basis[0]) - 1)
        found = basis[0][at] == slots
        out[found] = basis[1][at[found]]
    return out


def _project(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, basis: Basis | None, rank: int) -> tuple[np.ndarray, Distinct]:
    """A @ basis for sparse rows, and the distinct slots of A."""
    found = Distinct(rows[1].astype(np.uint64))
    right = _basis_rows(basis, found.keys.astype(np.int64), rank)
    out = np.zeros((n, rank))
    np.add.at(out, rows[0], rows[2][:, None] * right[found.place])
    return out, found


def randomised_svd(items: DataFrame, text_col: str, idf: np.ndarray, rank: int, power: int = 1, slices: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of the TF-IDF rows: (slots that occur, slots x rank).

    A pass multiplies every row with the present basis and adds up A.T @ (A @ basis) by slot; between
    passes the basis is made orthogonal. The starting basis is a random sign for each slot and column,
    by rule, so it needs no memory of its own. The result has at most SLOTS rows.
    """
    spark = items.sparkSession
    rows = items.select(F.col(text_col).alias("text")).repartition(slices)

    def pass_over(basis: Basis | None) -> Basis:
        shared = spark.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for texts in parts(batch, "text"):
                    a = _rows(texts, idf)
                    y, found = _project(a, len(texts), shared.value, rank)
                    back = np.zeros((len(found.keys), rank))
                    np.add.at(back, found.place, a[2][:, None] * y[a[0]])
                    for slot, v in zip(found.keys.tolist(), back, strict=True):
                        total[slot] = total.get(slot, 0) + v
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slot", "body"]
            )

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()) for x in group["body"])
            return pa.table({"slot": group["slot"].slice(0, 1), "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        summed = rows.mapInArrow(multiply, "slot int, body binary").groupBy("slot").applyInArrow(add, "slot int, body binary")
        found = sorted((r[0], r[1]) for r in summed.toLocalIterator())
        slots = np.array([s for s, _ in found], np.int64)
        return slots, np.array([np.frombuffer(b, np.float32) for _, b in found]).reshape(-1, rank)

    basis = None
    for _ in range(power + 1):
        slots, product = pass_over(basis)
        if not len(slots):
            return slots, product
        q, r = np.linalg.qr(product.astype(np.float64))
        keep = np.abs(np.diag(r)) > 1e-6 * max(1e-12, np.abs(np.diag(r)).max())
        full = np.zeros((len(slots), rank), np.float32)
        full[:, : q.shape[1]] = q * keep
        basis = (slots, full)
    return basis


@dataclass(frozen=True)
class Item:
    item_id: int
    words: list[bytes]
    answer: frozenset[bytes]
    telling: tuple[bytes, ...]
    weights: tuple[float, ...] = ()


def run_length(size: int, copy: float) -> tuple[int, int]:
    """Words in a run, and how many of an item's runs any copy keeps whole: each word that a copy may
    lack or replace breaks at most as many runs as a run has words."""
    lost = size - math.ceil(copy * size - 1e-9)
    for n in range(min(RUN, size), 0, -1):
        kept = size - n + 1 - n * lost
        if kept > 0:
            return n, kept
    return 1, 1


class Index:
    """Where each key occurs: (item, place in the item) by 64-bit key."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, at: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.bounds = np.append(first, len(keys))
        self.item, self.at = item[order], at[order]
        bits = min(24, max(16, 4 + len(self.keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[self.keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among ``keys``, item, place in the item) of every match."""
        near = np.flatnonzero(self.some[keys >> self.shift])
        key = np.searchsorted(self.keys, keys[near])
        same = self.keys[np.minimum(key, len(self.keys) - 1)] == keys[near]
        near, key = near[same], key[same]
        n = self.bounds[key + 1] - self.bounds[key]
        at = np.arange(n.sum()) + np.repeat(self.bounds[key] - (np.cumsum(n) - n), n)
        return np.repeat(near, n), self.item[at], self.at[at]


def _runs(keys: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on."""
    return mix(rolled(keys, n)[: max(0, len(keys) - n + 1)])


def _index(entries: list[tuple[np.ndarray, int, np.ndarray]]) -> Index:
    keys, item, at = zip(*entries, strict=True)
    return Index(np.concatenate(keys), np.repeat(np.array(item), [len(k) for k in keys]), np.concatenate(at))


class Exact:
    """Runs of words and telling words of one block of items, by hash. An item of up to ``stride`` words has one telling
    word more than a paraphrase may lack, so each holds one of them, however it is spread."""

    def __init__(self, items: list[Item], copy: float):
        runs: dict[int, list] = {}
        telling = []
        self.sizes = np.array([len(i.words) for i in items], np.int64)
        self.kept = np.zeros(len(items), np.int64)
        for k, item in enumerate(items):
            n, self.kept[k] = run_length(len(item.words), copy)
            keys = hashes(item.words)
            mine = _runs(keys, n)
            runs.setdefault(n, []).append((mine, k, np.arange(len(mine))))
            at = np.flatnonzero(np.isin(keys, hashes(list(item.telling))))
            telling.append((keys[at], k, at))
        self.runs = {n: _index(x) for n, x in sorted(runs.items())}
        self.telling = _index(telling)

    def find(self, keys: np.ndarray, text: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word at which the item would begin, item), from the hash, text and place of every word."""
        out = []
        for n, index in self.runs.items():
            if len(keys) < n:
                continue
            pos, item, at = index.find(_runs(keys, n))
            inside = text[pos] == text[pos + n - 1]
            pos, item, at = pos[inside], item[inside], at[inside]
            out.append([x[self._enough(text[pos], item, within[pos] - at, at)] for x in (text[pos], within[pos] - at, item)])
        pos, item, at = self.telling.find(keys)
        out.append([text[pos], within[pos] - at, item])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _enough(self, text: np.ndarray, item: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which runs have enough others of their item near them: in a stretch as long as the item or in the two together
        with one of its neighbours."""
        if not len(text):
            return np.zeros(0, bool)
        size = self.sizes[item]
        stretch = (begin + size) // size
        pair = np.unique(text * len(self.sizes) + item, return_inverse=True)[1]
        key, group = np.unique(pair * (stretch.max() + 2) + stretch, return_inverse=True)
        n = np.bincount(np.unique(group * size.max() + at) // size.max(), minlength=len(key))
        total = n.copy()
        next_to = np.flatnonzero(np.diff(key) == 1)
        total[next_to] += n[next_to + 1]
        before = np.zeros(len(key), np.int64)
        before[next_to + 1] = n[next_to]
        return np.maximum(total, n + before)[group] >= self.kept[item]


def passages(size: int, length: int, stride: int) -> list[int]:
    """First words of an item's passages of ``length`` words; the last one ends with the item."""
    return [*range(0, max(1, size - length), stride), *([size - length] if size > length else [])]


class Factors:
    """Factors of some passages of items, as many as there are passages, their places in them and their items."""

    def __init__(self, idf: np.ndarray, slots: np.ndarray, factors: np.ndarray, item: list[int], texts: list[bytes]):
        self.item = np.array(item)
        a = _rows(texts, idf)
        latent, _ = _project(a, len(texts), (slots, factors), factors.shape[1])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        order = np.argsort(idf[slots], kind="stable")  # words of most documents first
        self.place = np.full(SLOTS, -1, np.int32)
        self.place[slots[order]] = np.arange(len(slots))
        self.weighted = (factors[order] * idf[slots[order]][:, None]).astype(np.float32)
        # The most that a word adds to the projection on any passage of a bundle, for some bundles; last, a word without factors.
        each = self.weighted @ self.latent.T
        cuts = np.arange(0, len(texts), -(-len(texts) // BOUNDS))
        self.most = [np.append(x, 0) for x in np.maximum.reduceat(each, cuts, axis=1).T.astype(np.float64)]

    def near(self, block: np.ndarray, slot: np.ndarray, same: list[np.ndarray], norm: np.ndarray, cosine: float) -> np.ndarray:
        """(first block, item) of the passages whose latent cosine with one of the item's reaches ``cosine``. ``same[k - 1]``
        are the blocks whose text goes on for ``k`` more. Passages that cannot reach it by their words' bounds are not projected."""
        place, may = self.place[slot], np.zeros(len(norm), bool)
        for most in self.most:
            bound = np.bincount(block, most[place], len(norm))
            total = bound.copy()
            for k, at in enumerate(same, 1):
                total[at] += bound[at + k]
            may |= total >= (cosine - SLACK) * norm
        first, used = np.flatnonzero(may), may.copy()
        following = [at[may[at]] for at in same]
        for k, at in enumerate(following, 1):
            used[at + k] = True
        mine, number, row = used[block], np.cumsum(used) - 1, np.cumsum(may) - 1
        sums = self.sums(number[block[mine]], slot[mine], used.sum())
        total = sums[number[first]]
        for k, at in enumerate(following, 1):
            total[row[at]] += sums[number[at + k]]
        found = np.argwhere(total @ self.latent.T / norm[first, None] >= cosine)
        return np.column_stack([first[found[:, 0]], self.item[found[:, 1]]])

    def sums(self, block: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Sum of the weighted factors of each block's words, some blocks at a time: by a product with the counts for the
        words of most documents, row by row for others."""
        out = np.zeros((n, self.weighted.shape[1]), np.float32)
        dense = min(DENSE, len(self.weighted))
        if not dense:
            return out
        cuts = np.searchsorted(block, np.arange(0, n + 1024, 1024))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            of, at, part = block[a:b] - i * 1024, self.place[slot[a:b]], out[i * 1024 : (i + 1) * 1024]
            often = (at >= 0) & (at < dense)
            counts = np.bincount(of[often] * dense + at[often], minlength=len(part) * dense)
            part += counts.reshape(len(part), dense).astype(np.float32) @ self.weighted[:dense]
            rest = np.flatnonzero(at >= dense)
            if len(rest):
                first = np.flatnonzero(np.diff(of[rest], prepend=-1))
                part[of[rest[first]]] += np.add.reduceat(self.weighted[at[rest]], first, axis=0)
        return out

    def vector(self, slots: np.ndarray, times: np.ndarray) -> np.ndarray:
        ok = self.place[slots] >= 0
        return (1 + np.log(times[ok])) @ self.weighted[self.place[slots[ok]]]


class Lexicon:
    """Weights, factors and one block of items, as the workers use them."""

    def __init__(self, idf: np.ndarray, groups: list[Factors], items: list[Item], params: Params):
        self.idf, self.groups, self.items, self.p = idf.astype(np.float32), groups, items, params
        self.exact = Exact(items, params.copy)

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, float, float, int]]]:
        """For every text (item, cosine, common part, first word) of the items that it holds.

        Texts are cut into blocks of ``stride`` words; a passage is a run of blocks, so its latent
        vector is the sum of theirs. Repeated words count each time here, which only lets more
        passages through; the cosine that is reported dampens them.
        """
        split = [words_of(t) for t in texts]
        out: list[list[tuple[int, float, float, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        at = 0
        while at < len(split):  # some 30,000 words at a time
            stop, n = at, 0
            while stop < len(split) and (stop == at or n + len(split[stop]) <= 30_000):
                n += len(split[stop])
                stop += 1
            for i, found in self._candidates(split[at:stop]):
                out[at + i] = self._checked(split[at + i], found)
            at = stop
        return out

    def _candidates(self, split: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(text, its (first word, item) pairs) of passages near an item."""
        p = self.p
        sizes = np.array([len(w) for w in split], np.int64)
        n_blocks = -(-sizes // p.stride)
        begin = np.cumsum(n_blocks) - n_blocks
        keys = hashes([w for words in split for w in words])
        if not len(keys):
            return
        slot = (keys % np.uint64(SLOTS)).astype(np.int64)
        within = np.arange(len(slot)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        block = np.repeat(begin, sizes) + within // p.stride
        full = np.bincount(block, self.idf[slot].astype(np.float64) ** 2, n_blocks.sum())
        text = np.repeat(np.arange(len(split)), n_blocks)
        same = [np.flatnonzero(text[k:] == text[:-k]) for k in range(1, p.passage // p.stride)]
        norm = full.copy()
        for k, at in enumerate(same, 1):
            norm[at] += full[at + k]
        norm = np.sqrt(np.maximum(norm, 1e-9))
        near = [group.near(block, slot, same, norm, p.cosine) for group in self.groups]
        of, first, item = self.exact.find(keys, np.repeat(np.arange(len(split)), sizes), within)
        first = np.maximum(first, 0) // p.stride
        near = np.unique(np.concatenate([*near, np.column_stack([begin[of] + first, item])]), axis=0)
        bounds = np.searchsorted(text[near[:, 0]], np.arange(len(split) + 1))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            mine = near[bounds[i] : bounds[i + 1]]
            yield i, [((b - begin[i]).item() * p.stride, k) for b, k in zip(mine[:, 0], mine[:, 1].tolist(), strict=True)]

    def _checked(self, words: list[bytes], found: list[tuple[int, int]]) -> list[tuple[int, float, float, int]]:
        p, best = self.p, {}
        for a, k in found:
            item = self.items[k]
            region = words[max(0, a - len(item.words)) : a + p.passage + len(item.words)]
            held = set(region)
            there = [w in held for w in item.words]
            if sum(there) < p.paraphrase * len(item.words):
                continue  # not even out of order
            common = lcs(item.words, region) / len(item.words)
            if common >= p.copy or (common >= p.paraphrase and self._answered(item, held, there)):
                cosine = self.cosine(words[a : a + p.passage], k)
                if k not in best or (common, cosine) > (best[k][1], best[k][0]):
                    best[k] = (cosine, common, a)
        return [(self.items[k].item_id, *v) for k, v in sorted(best.items())]

    def _answered(self, item: Item, held: set[bytes], there: list[bool]) -> bool:
        return not item.answer.isdisjoint(held) and sum(compress(item.weights, there)) >= self.p.weight * sum(item.weights)

    def cosine(self, words: list[bytes], k: int) -> float:
        """Latent cosine of a passage with the nearest of an item's."""
        slots, times = np.unique(slots_of(words), return_counts=True)
        value = (1 + np.log(times)) * self.idf[slots]
        best = max((group.latent[group.item == k] @ group.vector(slots, times)).max() for group in self.groups if k in group.item)
        return float(best / max(1e-9, float(np.sqrt((value**2).sum()))))


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, one addition of bit vectors per word of ``b``."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & masks.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Params:
    """Passages of ``passage`` words every ``stride`` words (a divisor of it); ``cosine`` to become a candidate; the share
    of an item's words that must follow in order, for a copy and, with its answer, for a paraphrase; the share of the
    item's weight that a paraphrase's words must carry. The answer is one of the ``answer_words`` most telling words, or
    of one in ``answer_share`` words of a long item.
    Passages of items, cut as those of documents, are factored ``rank`` at a time, to full rank; a block holds up to ``block_items`` items, or as many as fill
    ``block_groups`` such groups."""

    passage: int = 48
    stride: int = 24
    cosine: float = 0.3
    copy: float = 0.8
    paraphrase: float = 0.6
    weight: float = 0.4
    answer_words: int = 3
    answer_share: int = 10
    rank: int = 256
    block_items: int = 20_000
    block_groups: int = 8


class Decontaminator:
    def __init__(self, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", params: Params | None = None):
        self.spark, self.params = docs.sparkSession, params or Params()
        ship_package(self.spark)
        items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
        self.items = items.filter("item_id is not null and text is not null").dropDuplicates(["item_id", "text"])
        n, self.df = document_frequency(docs, text_col)
        # Every word counts: a leak may stand in most documents.
        self.idf = np.log((n + 1) / (self.df + 1)) + FLOOR

    def _blocks(self) -> Iterator[Lexicon]:
        """Blocks of items in the order of their ids; one block at a time is on the driver."""
        p, block, cut = self.params, [], []
        for row in self.items.orderBy("item_id", "text").toLocalIterator():
            words = words_of(row["text"].encode())
            if not words:
                continue
            slot = dict(zip(words, slots_of(words).tolist(), strict=True))
            # A word that no document holds tells nothing: no leak has it.
            order = sorted((w for w, at in slot.items() if self.df[at]), key=lambda w: (-self.idf[slot[w]], w))
            lost = len(words) - math.ceil(p.paraphrase * len(words) - 1e-9) if len(words) <= p.stride else 0
            cut += [(len(block), b" ".join(words[a : a + p.passage])) for a in passages(len(words), p.passage, p.stride)]
            weights = tuple(float(self.idf[slot[w]]) for w in words)
            answer = order[: max(p.answer_words, math.ceil(len(words) / p.answer_share))]
            block.append(Item(row["item_id"], words, frozenset(answer), tuple(order[: lost + 1]), weights))
            if len(block) == p.block_items or len(cut) >= p.block_groups * p.rank:
                yield Lexicon(self.idf, self._groups(cut), block, p)
                block, cut = [], []
        if block:
            yield Lexicon(self.idf, self._groups(cut), block, p)

    def _groups(self, cut: list[tuple[int, bytes]]) -> list[Factors]:
        """Factors of passages (item, text), each group to full rank."""
        out, n = [], -(-len(cut) // self.params.rank)
        for i in range(n):
            item, texts = zip(*cut[i * len(cut) // n : (i + 1) * len(cut) // n], strict=True)
            rows = self.spark.createDataFrame([(bytearray(t),) for t in texts], "text binary")
            out.append(Factors(self.idf, *randomised_svd(rows, "text", self.idf, len(texts)), list(item), list(texts)))
        return out

    def leaks(self, text: Column) -> Column:
        """Array of the leaks in a text column: item, cosine, common share and first word."""
        columns = [self._column(text, lexicon) for lexicon in self._blocks()]
        if not columns:
            return F.array().cast(_LEAKS)
        return columns[0] if len(columns) == 1 else F.flatten(F.array(*columns))

    def _column(self, text: Column, lexicon: Lexicon) -> Column:
        shared = self.spark.sparkContext.broadcast(lexicon)

        @F.pandas_udf(_LEAKS)
        def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            names = ("item_id", "cosine", "common", "at_word")
            for batch in batches:
                found = []
                for a in range(0, len(batch), 512):
                    found += shared.value.leaks([(t or "").encode() for t in batch.iloc[a : a + 512]])
                yield pd.Series([[dict(zip(names, x, strict=True)) for x in row] for row in found], dtype=object)

        return leaks(text)


_LEAKS = "array<struct<item_id: long, cosine: double, common: double, at_word: int>>"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", params: Params | None = None
) -> DataFrame:
    """``doc_id, item_id, cosine, common, at_word``: one row for each benchmark item that a document
    holds, as a copy or a paraphrase, with its best passage's first word.

    Documents and items without words (null or empty texts) match nothing; nor does an item without
    an id. Items that repeat an id and text count once, repeated documents are each reported.
    Other columns are ignored.
    """
    found = Decontaminator(docs, benchmark, text_col, item_id, item_text, params)
    rows = docs.select(F.col(id_col).alias("doc_id"), found.leaks(F.col(text_col)).alias("leaks"))
    return rows.select("doc_id", F.inline("leaks")).withColumns({c: F.round(c, 6) for c in ("cosine", "common")})
