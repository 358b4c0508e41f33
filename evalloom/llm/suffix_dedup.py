"""Suffix-array dedup of bytes, by the common-prefix interval tree of an enhanced suffix array.

A window of ``window`` bytes is filed under its minimiser, the ``seed``-byte string in it with the
smallest hash (the leftmost of equal ones), so equal windows meet under one minimiser. Consecutive
windows with one minimiser form a *piece*. Pieces whose minimiser occurs once in the corpus cannot
repeat; a first exchange of hashes drops them. It also finds the *hot* minimisers, round which too many
different pieces lie; their windows are filed under the two smallest hashes instead. Where a second
exchange finds such a pair still hot, as both lie in the fixed part of a template, its windows are filed
one by one under the hash of all their bytes: a key that only equal windows share.

The distinct remaining pieces of a bucket make a shard with one enhanced suffix array: the suffixes
that share ``window`` bytes with another one in order, the common-prefix lengths of neighbours, scanned
with a stack into the interval tree. Every interval whose occurrences differ in the byte to the left is
a repeat that is maximal in its shard, and tells the windows it covers the smallest document that holds
them. An equal piece in several documents is a leaf of the tree with several occurrences. A piece's
first byte counts as different from every other: what lies before it belongs to another piece.

``repeat_groups`` goes on from the shards' repeats to those of whole texts: repeats whose occurrences lie
alike and overlap are one, and each is lengthened on both sides, in the texts, for as long as all its
occurrences agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from evalloom.llm.blocks import NO_ID, Answers, Blocks, Distinct, Texts, answer, mix, pack, power, read_bits, repeated, runs, slices, unpack
from evalloom.session import checkpoint

PIECE_KEYS = 1 << 17
#: Different pieces round one minimiser beyond which it is hot.
HOT_PIECES = 1 << 15
#: Levels of the exchanges: minimisers, pieces, and pairs of minimisers where some are hot.
ASK, PIECES, SPLIT = 0, 1, 2

_CHUNK = 1 << 16
_PLACE = np.uint64((1 << 17) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@dataclass
class Pieces:
    """Runs of windows with one minimiser: first window, number of windows, hash of the minimiser, a sum
    over the piece's strings by which unlike pieces are told apart when they are counted, and where the
    minimiser stands."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    sign: np.ndarray
    at: np.ndarray

    @property
    def columns(self) -> tuple[np.ndarray, ...]:
        return self.start, self.count, self.key, self.sign, self.at

    def where(self, mask: np.ndarray) -> Pieces:
        return Pieces(*(x[mask] for x in self.columns))

    @staticmethod
    def joined(parts: list[Pieces]) -> Pieces:
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64)
        return Pieces(*(np.concatenate([np.zeros(0, kind), *(p.columns[i] for p in parts)]) for i, kind in enumerate(kinds)))


class Bytes:
    """All bytes of a block in one array, with each row's bounds."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = b"".join(texts)
        self.array = np.frombuffer(self.data, np.uint8)

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def pieces(self, window: int, seed: int) -> Pieces:
        whole = np.ones(len(self.array), bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            whole[max(a, b - window + 1) : b] = False
        parts = [self._chunk(a, min(a + _CHUNK, len(whole)), whole, window, seed) for a in range(0, len(whole), _CHUNK)]
        found = Pieces.joined([p for p in parts if len(p.start)])
        # Chunks are no borders of pieces: what lies on both sides of one is put together.
        again = np.append(False, (found.at[1:] == found.at[:-1]) & (found.start[1:] == found.start[:-1] + found.count[:-1]))[: len(found.start)]
        begin = np.flatnonzero(~again)
        count = np.add.reduceat(found.count, begin) if len(begin) else found.count
        return Pieces(found.start[begin], count, found.key[begin], found.sign[begin], found.at[begin])

    def split(self, pieces: Pieces, window: int, seed: int) -> Pieces:
        """Pieces of the same windows, filed under the smallest hash and the smallest other one."""
        parts = []
        for a, n, key in zip(pieces.start.tolist(), pieces.count.tolist(), pieces.key.tolist(), strict=True):
            grams = _rolled_bytes(self.array[a : a + n + window - 1], seed) & ~_PLACE
            shown = np.where(mix(grams) == np.uint64(key), ~np.uint64(0), grams) & ~_PLACE
            low = _sliding_min(shown | np.arange(len(shown), dtype=np.uint64), window - seed + 1)
            first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            both = mix(np.uint64(key) ^ mix(low[first] & ~_PLACE))
            place = (low[first] & _PLACE).astype(np.int64) + a
            sums = np.append(np.uint64(0), np.cumsum(mix(grams)))
            stop = np.append(first[1:], n)
            parts.append(Pieces(first + a, stop - first, both, sums[stop + window - seed] - sums[first], place))
        return Pieces.joined(parts)

    def windows(self, pieces: Pieces, window: int) -> Pieces:
        """A piece for each window, filed under the hash of the whole window."""
        parts = []
        for a, n in zip(pieces.start.tolist(), pieces.count.tolist(), strict=True):
            key = mix(mix(_rolled_bytes(self.array[a : a + n + window - 1], window)) ^ np.uint64(window))
            at = np.arange(a, a + n)
            parts.append(Pieces(at, np.ones(n, np.int64), key, key, at))
        return Pieces.joined(parts)

    def _chunk(self, a: int, b: int, whole: np.ndarray, window: int, seed: int) -> Pieces:
        """Pieces of the windows that start in [a, b). The high bits of the hash are what is compared;
        the low ones give way to the place, so that the leftmost of equal hashes is the least."""
        packed = _rolled_bytes(self.array[a : b + window - 1], seed)
        packed &= ~_PLACE
        packed |= np.arange(len(packed), dtype=np.uint64)
        low = _sliding_min(packed, window - seed + 1)
        ok = whole[a : a + len(low)]
        new = ok.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            return Pieces.joined([])
        # A piece ends where the next one or a run of windows that are not whole begins.
        stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
        sums = np.append(np.uint64(0), np.cumsum(mix(packed & ~_PLACE)))
        sign = sums[stop + window - seed] - sums[first]
        place = (low[first] & _PLACE).astype(np.int64) + a
        return Pieces(first + a, stop - first, mix(low[first] & ~_PLACE), sign, place)  # minima are small: spread them


def _rolled_bytes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ``length``-byte strings, by doubling."""
    out, have, cur, span = None, 0, _BYTE[data], 1
    while True:
        if length & span:
            n = max(0, len(data) - have - span + 1)
            out = cur if out is None else out[:n] * power(span) + cur[have : have + n]
            have += span
        if have == length:
            return out
        cur = cur[: max(0, len(cur) - span)] * power(span) + cur[span:]
        span *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` numbers from every place on, where there are so many."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: max(0, len(x) - span)], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def _ask_minimisers(pieces: Pieces, key_bits: int, bucket_bits: int) -> Iterator[tuple[int, bytes]]:
    """Distinct minimisers; with each, how many pieces lie round it, unlike ones, and a sum over those."""
    keys = pieces.key >> np.uint64(64 - key_bits)
    found = Distinct(keys)
    unlike = Distinct(mix(keys) ^ pieces.sign)
    signs = np.zeros(len(found.keys), np.uint64)
    number = np.zeros(len(found.keys), np.int64)
    at = found.place[unlike.first]
    np.add.at(signs, at, mix(pieces.sign[unlike.first]))
    np.add.at(number, at, 1)
    low = np.uint64((1 << (key_bits - bucket_bits)) - 1)
    for bucket, part in slices(found.keys, key_bits, bucket_bits):
        counts = np.minimum(number[part], (1 << 16) - 1).astype("<u2")
        yield bucket, pack(found.keys[part] & low) + (signs[part] >> np.uint64(48)).astype("<u2").tobytes() + counts.tobytes()


def _minimisers(hot_pieces: int):
    """Two bits for every minimiser: whether another block has it, and whether it is hot. Blocks that
    hold the same pieces round it, as those of copies do, count once."""

    def apply(blocks: list[int], bodies: list[bytes]) -> list[bytes]:
        parts, signs, counts = [], [], []
        for body in bodies:
            keys, at = unpack(body)
            parts.append(keys)
            signs.append(np.frombuffer(body, "<u2", len(keys), at))
            counts.append(np.frombuffer(body, "<u2", len(keys), at + 2 * len(keys)).astype(np.int64))
        keys, sign, count = np.concatenate(parts), np.concatenate(signs), np.concatenate(counts)
        shared = repeated(keys)
        hot = np.zeros(len(keys), bool)
        several = np.flatnonzero(shared | (count > hot_pieces))
        order = several[np.lexsort((sign[several], keys[several]))]
        if len(order):
            new_key = np.append(True, keys[order[1:]] != keys[order[:-1]])
            new = new_key | np.append(True, sign[order[1:]] != sign[order[:-1]])
            begin = np.flatnonzero(new_key)
            total = np.add.reduceat(np.where(new, count[order], 0), begin)
            hot[order] = np.repeat(total > hot_pieces, np.diff(np.append(begin, len(order))))
        out, at = [], 0
        for k in parts:
            out.append(np.packbits(shared[at : at + len(k)]).tobytes() + np.packbits(hot[at : at + len(k)]).tobytes())
            at += len(k)
        return out

    return apply


class Candidates:
    """Pieces of a block whose minimiser occurs more than once, and the distinct ones among them.

    Rows come in the order of their ids, so a piece's first row has the smallest id in the block.
    """

    def __init__(self, data: Bytes, told: Answers, shape: Shape):
        pieces = data.pieces(shape.window, shape.seed)
        found = Distinct(pieces.key >> np.uint64(64 - shape.key_bits))
        sizes = [s.stop - s.start for _, s in slices(found.keys, shape.key_bits, shape.ask_bits)]
        shared, hot = read_bits(told.of(ASK), sizes, 2)
        keep = (shared | (found.counts > 1))[found.place]
        hot = hot[found.place]
        self.dense = data.split(pieces.where(keep & hot), shape.window, shape.seed)
        pieces = Pieces.joined([pieces.where(keep & ~hot), *self._spread(data, told, shape)])
        by_place = np.argsort(pieces.start, kind="stable")
        self.start, self.count = pieces.start[by_place], pieces.count[by_place]
        self.keys = pieces.key[by_place]
        bucket = (self.keys >> np.uint64(64 - shape.piece_bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entries: dict[bytes, int] = {}
        place = np.empty(len(order), np.int64)
        first, stops = [], (self.start + self.count + shape.window - 1).tolist()
        starts, at_bucket, before = self.start.tolist(), bucket.tolist(), -1
        texts: list[bytes] = []
        for i in order.tolist():
            if at_bucket[i] != before:
                entries, before = {}, at_bucket[i]
            text = data.data[starts[i] : stops[i]]
            at = entries.setdefault(text, len(first))
            if at == len(first):
                first.append(i)
                texts.append(text)
            place[i] = at
        self.place, self.texts = place, texts
        self.first = np.array(first, np.int64)
        self.bucket = bucket[self.first] if first else np.zeros(0, np.int64)

    def _spread(self, data: Bytes, told: Answers, shape: Shape) -> list[Pieces]:
        """Pieces filed under two hashes, as far as a second exchange has not found those hot, too."""
        if not told.of(SPLIT):
            return [self.dense]
        found = Distinct(self.dense.key >> np.uint64(64 - shape.key_bits))
        sizes = [s.stop - s.start for _, s in slices(found.keys, shape.key_bits, shape.ask_bits)]
        shared, hot = read_bits(told.of(SPLIT), sizes, 2)
        keep, hot = (shared | (found.counts > 1))[found.place], hot[found.place]
        return [self.dense.where(keep & ~hot), data.windows(self.dense.where(keep & hot), shape.window)]

    def parts(self) -> Iterator[tuple[int, slice]]:
        return runs(self.bucket)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(data: bytes) -> bytes:
    return _PACK.compress(data)


def _unpack(body: bytes) -> bytes:
    return _UNPACK.decompress(body)


def _pack_entries(ids: np.ndarray, texts: list[bytes]) -> bytes:
    sizes = np.array([len(t) for t in texts], "<u2")
    head = np.array([len(texts)], "<u4").tobytes()
    return _pack(head + ids.astype("<i8").tobytes() + sizes.tobytes() + b"".join(texts))


def _unpack_entries(body: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = _unpack(body)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ids = np.frombuffer(raw, "<i8", n, 4)
    ends = (4 + 10 * n + np.cumsum(np.frombuffer(raw, "<u2", n, 4 + 8 * n), dtype=np.int64)).tolist()
    at, texts = 4 + 10 * n, []
    for end in ends:
        texts.append(raw[at:end])
        at = end
    return ids, texts


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of two or more neighbours with a common prefix;
    ``lcp[i]`` is the prefix that the sorted strings i - 1 and i share (none before the first).

    The stack holds the open intervals by growing length; a neighbour with a shorter common prefix
    closes the longer ones.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        length = lcp[i] if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > length:
            long, left = stack.pop()
            yield long, left, i - 1
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, left))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


@dataclass(frozen=True)
class Repeat:
    """A maximal repeat: its length, and the piece and offset of all its occurrences."""

    length: int
    occurrences: list[tuple[int, int]]


def maximal_repeats(pieces: list[bytes], window: int) -> Iterator[Repeat]:
    """Maximal repeats of ``window`` bytes or more in distinct pieces: one suffix array over those
    suffixes that share so many bytes with another, and its interval tree."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    counts = np.maximum(sizes - window + 1, 0)
    base = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[piece] + offset
    if not len(at):
        return
    keys = _rolled_bytes(data, window)[at]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(begin, len(order)))
    # The byte to the left of each suffix; a piece's first suffix differs from all others.
    left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1 - piece)
    lefts = left[order]
    diverse = (sizes > 1) & (np.minimum.reduceat(lefts, begin) != np.maximum.reduceat(lefts, begin))
    suffixes = sorted((pieces[piece[i]][offset[i] :], i) for i in order[np.repeat(diverse, sizes)].tolist())
    lcp = [0, *(_common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False))]
    array = [i for _, i in suffixes]
    for length, lo, hi in lcp_intervals(lcp):
        if length >= window:
            members = array[lo : hi + 1]
            if (left[members] != left[members[0]]).any():
                yield Repeat(length, [(int(piece[i]), int(offset[i])) for i in members])


def _owners(window: int):
    """For every window of every entry: does a document with a smaller id hold it?"""

    def apply(blocks: list[int], bodies: list[bytes]) -> list[bytes]:
        parts = [_unpack_entries(x) for x in bodies]
        index: dict[bytes, int] = {}
        place = [np.array([index.setdefault(t, len(index)) for t in texts], np.int64) for _, texts in parts]
        pieces = list(index)
        least = np.full(len(pieces), np.iinfo(np.int64).max)
        for (ids, _), p in zip(parts, place, strict=True):
            np.minimum.at(least, p, ids)
        counts = np.array([len(p) - window + 1 for p in pieces], np.int64)
        begin = np.cumsum(counts) - counts
        owner = np.repeat(least, counts)
        for repeat in maximal_repeats(pieces, window):
            smallest = min(least[p] for p, _ in repeat.occurrences)
            for p, off in repeat.occurrences:
                a = begin[p] + off
                part = owner[a : a + repeat.length - window + 1]
                np.minimum(part, smallest, out=part)
        out = []
        for (ids, _), p in zip(parts, place, strict=True):
            n = counts[p]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.packbits(owner[np.repeat(begin[p], n) + within] < np.repeat(ids, n)).tobytes())
        return out

    return apply


@dataclass(frozen=True)
class Shape:
    """Lengths of windows and minimisers, and how the hash space is cut."""

    window: int
    seed: int
    key_bits: int
    ask_bits: int
    piece_bits: int


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: int, stop: int>>, kept binary"
GROUPS = "name long, length int, key long, tie long, start int"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _first_exchange(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int, block_bytes: int, hot_pieces: int):
    blocks = Blocks(docs, id_col, text_col, block_bytes, 2 / (window - seed + 2))
    key_bits = min(64, blocks.bits + 12)
    shape = Shape(window, seed, key_bits, min(key_bits - 1, blocks.bucket_bits()), min(key_bits - 1, blocks.bucket_bits(PIECE_KEYS)))

    def ask(texts: Texts) -> Iterator[tuple[int, bytes]]:
        return _ask_minimisers(Bytes(texts.texts).pieces(window, seed), shape.key_bits, shape.ask_bits)

    def ask_pairs(texts: Texts, told: Answers) -> Iterator[tuple[int, bytes]]:
        # The second half of a body says which minimisers are hot; mostly none is, and the texts are left alone.
        if not any(any(body[len(body) // 2 :]) for body in told.of(ASK)):
            return iter(())
        return _ask_minimisers(Candidates(Bytes(texts.texts), told, shape).dense, shape.key_bits, shape.ask_bits)

    told = answer(blocks.ask(ask), ASK, _minimisers(hot_pieces))
    return blocks, shape, told.unionAll(answer(blocks.ask_with(told, ask_pairs), SPLIT, _minimisers(hot_pieces)))


def suffix_array_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 16, block_bytes: int = 2 << 20, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """Remove every byte of a text (as UTF-8) under a ``window``-byte string that also starts in a row
    with a smaller id. Strings lie within one row, and are judged on the input alone.

    Returns ``doc_id, n_bytes, n_removed, spans`` (maximal removed runs, in bytes) and ``kept`` (the
    other bytes). Null, empty and shorter texts lose nothing. Rows with one id do not remove each
    other's bytes; null ids are one id before all others. Other columns are ignored.
    """
    blocks, shape, answers = _first_exchange(docs, id_col, text_col, window, seed, block_bytes, hot_pieces)

    def candidates(texts: Texts, told: Answers) -> tuple[Bytes, Candidates]:
        data = Bytes(texts.texts)
        return data, Candidates(data, told, shape)

    def ask_pieces(texts: Texts, told: Answers) -> Iterator[tuple[int, bytes]]:
        data, found = candidates(texts, told)
        ids = texts.keys[data.row(found.start[found.first])] if len(found.first) else np.zeros(0, np.int64)
        for bucket, part in found.parts():
            yield bucket, _pack_entries(ids[part], found.texts[part])

    def finish(texts: Texts, told: Answers) -> pa.Table:
        data, found = candidates(texts, told)
        ids = texts.keys[data.row(found.start)] if len(found.start) else np.zeros(0, np.int64)
        size = np.array([len(t) - window + 1 for t in found.texts], np.int64)
        bits = read_bits(told.of(PIECES), [int(size[part].sum()) for _, part in found.parts()], 1)[0]
        begin = np.cumsum(size) - size
        later = ids > ids[found.first][found.place] if len(ids) else np.zeros(0, bool)
        cover = np.zeros(len(data.array) + 1, np.int32)
        n = found.count
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        marked = np.repeat(later, n) | bits[np.repeat(begin[found.place], n) + within] if len(ids) else np.zeros(0, bool)
        at = (np.repeat(found.start, n) + within)[marked]
        cover[at] += 1
        cover[at + window] -= 1
        removed = np.cumsum(cover[:-1]) > 0
        rows = list(zip(data.starts.tolist(), data.ends.tolist(), strict=True))
        masks = [removed[a:b] for a, b in rows]
        edges = [np.flatnonzero(np.diff(m.astype(np.int8), prepend=0, append=0)) for m in masks]
        return pa.table(
            {
                "doc_id": texts.ids,
                "n_bytes": pa.array([b - a for a, b in rows], pa.int64()),
                "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
                "spans": pa.array([[{"start": int(s), "stop": int(e)} for s, e in zip(x[::2], x[1::2], strict=True)] for x in edges], _SPANS),
                "kept": pa.array([data.array[a:b][~m].tobytes() for (a, b), m in zip(rows, masks, strict=True)], pa.binary()),
            }
        )

    answers = answers.unionAll(answer(blocks.ask_with(answers, ask_pieces), PIECES, _owners(window)))
    return blocks.finish(answers, finish, RESULT)


def _shard_repeats(blocks: Blocks, answers: DataFrame, shape: Shape) -> DataFrame:
    """Every occurrence of every repeat that is maximal in its shard."""

    def ask_pieces(texts: Texts, told: Answers) -> Iterator[tuple[int, bytes]]:
        """Every occurrence of every piece: its row and place there, and the distinct pieces."""
        data = Bytes(texts.texts)
        found = Candidates(data, told, shape)
        row = data.row(found.start)
        order = np.argsort(found.place, kind="stable")
        ends = np.searchsorted(found.place[order], np.arange(len(found.texts)), "right")
        for bucket, part in found.parts():
            mine = order[(ends[part.start - 1] if part.start else 0) : ends[part.stop - 1]]
            rows = row[mine]
            where = np.stack([found.place[mine] - part.start, texts.keys[rows], texts.ties[rows].astype(np.int64), found.start[mine] - data.starts[rows]])
            pieces = _pack_entries(np.zeros(part.stop - part.start, np.int64), found.texts[part])
            yield bucket, len(pieces).to_bytes(4, "little") + pieces + _pack(where.astype("<i8").tobytes())

    def groups(group: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        where = []
        for body in group["body"].to_pylist():
            n = int.from_bytes(body[:4], "little")
            _, texts = _unpack_entries(body[4 : 4 + n])
            place = np.array([index.setdefault(t, len(index)) for t in texts], np.int64)
            own = np.frombuffer(_unpack(body[4 + n :]), "<i8").reshape(4, -1).copy()
            own[0] = place[own[0]]
            where.append(own)
        pieces = list(index)
        at = np.concatenate(where, axis=1)
        at = at[:, np.argsort(at[0], kind="stable")]
        begin = np.searchsorted(at[0], np.arange(len(pieces) + 1))
        # A piece that stands in several places is a leaf with several occurrences.
        leaves = (Repeat(len(p), [(i, 0)]) for i, p in enumerate(pieces) if begin[i + 1] - begin[i] > 1)
        seen: set[int] = set()
        parts = []
        for repeat in [*maximal_repeats(pieces, shape.window), *leaves]:
            piece, off = repeat.occurrences[0]
            name = xxhash.xxh3_64_intdigest(pieces[piece][off : off + repeat.length]) - (1 << 63)
            if name in seen:
                continue
            seen.add(name)
            for piece, off in repeat.occurrences:
                found = at[1:, begin[piece] : begin[piece + 1]]
                fixed = np.array([[name], [repeat.length], [off]]).repeat(found.shape[1], 1)
                parts.append(np.concatenate([fixed[:2], found[:2], found[2:] + fixed[2:]]))
        columns = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("name", "length", "key", "tie", "start"), columns, kinds, strict=True)})

    return blocks.ask_with(answers, ask_pieces).groupBy("bucket").applyInArrow(groups, GROUPS)


@F.pandas_udf(IntegerType())
def _agree(a: pd.Series, b: pd.Series, backwards: pd.Series) -> pd.Series:
    """How many bytes two strings have in common at their ends, or at their beginnings."""
    return pd.Series([_common(x[::-1], y[::-1]) if back else _common(x, y) for x, y, back in zip(a, b, backwards, strict=True)], dtype="int32")


def _shape_of(rows: DataFrame, name: str) -> DataFrame:
    """Repeats by name with their first occurrence, and a fingerprint of how the others lie to it."""
    first = rows.groupBy(name).agg(F.min(F.struct("key", "tie", "start")).alias("o"), F.count("*").alias("n"))
    lies = rows.join(first, name).groupBy(name).agg(
        F.sum(F.xxhash64("key", "tie", F.col("start") - F.col("o.start")).cast("decimal(38,0)")).alias("lies"), F.first("length").alias("length")
    )
    return first.join(lies, name)


def _lengthened(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Occurrences (name, length, key, tie, start) of repeats, each as long as all its occurrences agree."""
    done, reach = None, 64
    while True:
        near = rows.join(texts, ["key", "tie"]).select(
            *rows.columns,
            F.expr(f"substring(text, greatest(start + 1 - {reach}, 1), least(start, {reach}))").alias("before"),
            F.expr(f"substring(text, start + length + 1, {reach})").alias("after"),
        )
        at = F.struct("key", "tie", "start")
        model = near.groupBy("name").agg(F.min_by("before", at).alias("model_before"), F.min_by("after", at).alias("model_after"))
        agreed = near.join(model, "name").groupBy("name").agg(
            F.min(_agree("before", "model_before", F.lit(True))).alias("more_before"),
            F.min(_agree("after", "model_after", F.lit(False))).alias("more_after"),
        )
        grown = checkpoint(
            rows.join(agreed, "name").select(
                "name", (F.col("length") + F.col("more_before") + F.col("more_after")).alias("length"), "key", "tie",
                (F.col("start") - F.col("more_before")).alias("start"), F.greatest("more_before", "more_after").alias("more"),
            )
        )
        closed = grown.filter(F.col("more") < reach).drop("more")
        done = closed if done is None else done.unionAll(closed)
        rows = grown.filter(F.col("more") == reach).drop("more")
        if rows.isEmpty():
            return done
        reach *= 8


def repeat_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 16, block_bytes: int = 2 << 20, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """Maximal repeats of ``window`` bytes or more with all their occurrences: (repeat, length, doc_id,
    start in bytes), a row for each occurrence; ``repeat`` names the group.

    Every string of ``window`` bytes that occurs more than once is in a group whose occurrences are
    those of the string, lengthened on both sides for as long as they agree; groups of longer strings
    are given where a shard shows them. A repeat is not given if each of its strings of that length
    also occurs without it. Null, empty and shorter texts have none; a null id is returned as null.
    Rows that repeat id and text count as one.
    """
    blocks, shape, answers = _first_exchange(docs, id_col, text_col, window, seed, block_bytes, hot_pieces)
    rows = checkpoint(_shard_repeats(blocks, answers, shape).distinct())
    # Repeats whose occurrences lie alike and overlap are parts of one.
    alike = Window.partitionBy("o.key", "o.tie", "n", "lies").orderBy("o.start")
    end = F.col("o.start") + F.col("length")
    shapes = _shape_of(rows, "name").withColumn("reached", F.max(end).over(alike.rowsBetween(Window.unboundedPreceding, -1)))
    shapes = shapes.withColumn("run", F.sum((F.col("reached").isNull() | (F.col("o.start") > F.col("reached"))).cast("int")).over(alike))
    joined = shapes.groupBy("o.key", "o.tie", "n", "lies", "run").agg(
        F.min_by("name", "o.start").alias("name"), (F.max(end) - F.min("o.start")).cast("int").alias("length")
    ).select("name", "length")
    merged = checkpoint(rows.drop("length").join(joined, "name").select(*rows.columns))
    texts = blocks.frame.select("key", F.shiftrightunsigned("tie", 32).alias("tie"), "text").dropDuplicates(["key", "tie"])
    whole = checkpoint(_lengthened(merged, texts))
    one = _shape_of(whole, "name").groupBy("o", "n", "lies", "length").agg(F.min("name").alias("name")).select("name")
    key = F.when(F.col("key") != NO_ID, F.col("key"))
    return whole.join(one, "name").select(F.col("name").alias("repeat"), "length", key.alias("doc_id"), "start")
