"""Exact removal of repeated windows: substring dedup over words, and line dedup.

Substring dedup goes by level-wise doubling. Windows of ``seed`` words are looked up in the whole
corpus; only where a window and its successor are both repeated is the window of twice that length
looked up, and so on to ``window`` words or until no candidates survive. Line dedup is one level of
three lines. A lookup is the block exchange of ``blocks``; the corpus text is dealt to blocks once.

Windows at a level below the last are told apart by so many bits that fewer than one in 4,000 is taken
for repeated wrongly, which costs a candidate and no error. The last level, which decides, has two
hashes of twice the bits of the number of windows together (up to 96): all windows of a corpus of 100 TB
hold a wrong pair with a chance of about one in 500, a smaller corpus with less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from evalloom.llm.blocks import (
    Answers, Blocks, Distinct, Texts, answer, checks, earlier_elsewhere, hashes, mix, read_bits, rolled, send,
    send_first, shared_elsewhere, slices,
)


class Units:
    """Hashes of all units of a block in one row, with each row's bounds."""

    def __init__(self, texts: list[bytes], split: Callable[[bytes], list[bytes]]):
        each = [hashes(split(t)) for t in texts]
        sizes = np.array([len(h) for h in each], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.hash = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.end = np.repeat(self.ends, sizes)
        self.row = np.repeat(np.arange(len(texts)), sizes)

    def starts_of(self, length: int) -> np.ndarray:
        """Whether a window of this length starts at the unit and ends in its row."""
        return np.arange(len(self.hash)) + length <= self.end


class Levels:
    """Which windows a block has at each level, as far as the answers reach.

    At a level below the last a window counts as repeated if it stands twice in the block or in another
    one; at the last, a window is later if the block or an earlier row elsewhere has it before."""

    def __init__(self, units: Units, texts: Texts, lengths: list[int], key_bits: list[int], bucket_bits: int, told: Answers | None):
        self.units, self.asking = units, None
        self.later = np.zeros(0, np.int64)
        repeated = None
        for level, length in enumerate(lengths):
            ok = units.starts_of(length)
            if repeated is not None:
                ahead = np.zeros_like(repeated)
                step = lengths[level - 1]
                ahead[: max(0, len(ahead) - step)] = repeated[step:]
                ok &= repeated & ahead
            at = np.flatnonzero(ok)
            last = level + 1 == len(lengths)
            keys = mix(rolled(units.hash, length)[at]) >> np.uint64(64 - key_bits[level])
            check = checks(units.hash, length)[at] if last else None
            found = Distinct(keys, check)
            if told is None or level > max(told.bodies, default=-1):
                if last:
                    self.asking = send_first(found, check, units.row[at], texts, key_bits[level], bucket_bits)
                else:
                    self.asking = send(found.keys, key_bits[level], bucket_bits)
                return
            sizes = [s.stop - s.start for _, s in slices(found.keys, key_bits[level], bucket_bits)]
            elsewhere = read_bits(told.of(level), sizes, 1)[0]
            if not last:
                repeated = np.zeros(len(units.hash), bool)
                repeated[at] = (elsewhere | (found.counts > 1))[found.place]
                continue
            first = np.zeros(len(at), bool)
            first[found.first] = True
            self.later = at[elsewhere[found.place] | ~first]

    def removed(self, length: int) -> np.ndarray:
        """Units under windows that also start earlier."""
        cover = np.zeros(len(self.units.hash) + 1, np.int32)
        cover[self.later] += 1
        cover[self.later + length] -= 1
        return np.cumsum(cover[:-1]) > 0


def _spans(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
RESULT = "doc_id long, n_units long, n_removed long, spans array<struct<start: int, stop: int>>, kept_text string"


def _dedup(
    docs: DataFrame, id_col: str, text_col: str, split: Callable[[bytes], list[bytes]],
    join: Callable[[bytes, list[bytes], np.ndarray], bytes], lengths: list[int], per_byte: float, block_bytes: int, carry: bool = False,
) -> DataFrame:
    blocks = Blocks(docs, id_col, text_col, block_bytes, per_byte, carry)
    n_bits, bucket_bits = blocks.bits, blocks.bucket_bits()
    key_bits = [min(64, n_bits + 12)] * (len(lengths) - 1) + [min(64, max(n_bits + 12, 2 * n_bits - 22))]
    bucket = [shared_elsewhere] * (len(lengths) - 1) + [earlier_elsewhere]

    def ask(texts: Texts, told: Answers | None = None) -> Iterator[tuple[int, bytes]]:
        return Levels(Units(texts.texts, split), texts, lengths, key_bits, bucket_bits, told).asking or iter(())

    answers = answer(blocks.ask(ask), 0, bucket[0])
    for level in range(1, len(lengths)):
        answers = answers.unionAll(answer(blocks.ask_with(answers, ask), level, bucket[level]))

    def finish(texts: Texts, told: Answers) -> pa.Table:
        units = Units(texts.texts, split)
        for level in range(len(lengths)):  # a level that no window reached has no answers
            told.bodies.setdefault(level, [])
        removed = Levels(units, texts, lengths, key_bits, bucket_bits, told).removed(lengths[-1])
        masks = [removed[a:b] for a, b in zip(units.starts, units.ends, strict=True)]
        out = pa.table(
            {
                "doc_id": texts.ids,
                "n_units": pa.array(units.ends - units.starts, pa.int64()),
                "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
                "spans": pa.array([_spans(m) for m in masks], _SPANS),
                "kept_text": pa.array([join(t, split(t), m) for t, m in zip(texts.texts, masks, strict=True)], pa.binary()).cast(pa.string()),
            }
        )
        if carry:
            out = out.append_column("row", texts.rows)
        return out if texts.copies is None else _with_copies(out, texts, units)

    def _with_copies(out: pa.Table, texts: Texts, units: Units) -> pa.Table:
        """The first of equal rows is judged like any other; all windows of the others started earlier."""
        sizes = units.ends - units.starts
        again = np.flatnonzero(texts.copies > 1)
        masks = [np.full(sizes[i], sizes[i] >= lengths[-1]) for i in again.tolist()]
        later = {
            "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
            "spans": pa.array([_spans(m) for m in masks], _SPANS),
            "kept_text": pa.array([join(texts.texts[i], split(texts.texts[i]), m) for i, m in zip(again.tolist(), masks, strict=True)], pa.binary()).cast(pa.string()),
            "copies": pa.array(texts.copies[again] - 1, pa.int64()),
        }
        first = out.append_column("copies", pa.array(np.ones(out.num_rows, np.int64)))
        rest = first.take(again)
        rest = pa.table({c: later[c] if c in later else rest[c] for c in first.column_names})
        return pa.concat_tables([first, rest])

    schema = StructType.fromDDL(RESULT)
    return blocks.finish(answers, finish, StructType([*schema.fields, blocks.row_field]) if carry else schema)


def _join_words(text: bytes, words: list[bytes], removed: np.ndarray) -> bytes:
    return b" ".join(compress(words, (~removed).tolist()))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, seed: int = 10, block_bytes: int = 4 << 20
) -> DataFrame:
    """Remove every word under a window of ``window`` words that also starts earlier.

    Earlier is in a row with a smaller id, or before in the same row; what is removed depends on the
    input alone. Words are runs of characters other than space and \\t to \\r. Returns ``doc_id,
    n_units`` (words), ``n_removed, spans`` (removed runs, in words) and ``kept_text`` (the other
    words, joined by single spaces).

    Null or empty texts and those shorter than a window lose nothing. Rows with the same id count as
    documents that follow each other in the order of a hash of their texts, so of repeated rows one stays;
    null ids are one id before all others. Other columns are ignored.
    """
    if window % seed or (window // seed) & (window // seed - 1):
        raise ValueError("window must be seed times a power of two")
    lengths = [seed]
    while lengths[-1] < window:
        lengths.append(2 * lengths[-1])
    return _dedup(docs, id_col, text_col, bytes.split, _join_words, lengths, 1 / 6, block_bytes)


def _lines(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if not x.isspace() and x]


def _join_lines(text: bytes, lines: list[bytes], removed: np.ndarray) -> bytes:
    if not removed.any():
        return text
    out, at, drop = [], 0, False
    for line in text.split(b"\n"):
        if line and not line.isspace():
            drop = bool(removed[at])
            at += 1
        if not drop:
            out.append(line)
    return b"\n".join(out)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, block_bytes: int = 4 << 20, carry: bool = False
) -> DataFrame:
    """Remove every line under a window of ``window`` consecutive lines that also starts earlier.

    Lines are what ``\\n`` separates, compared byte by byte; those without a character other than
    white space are no part of a window and go with the line before them. Overlapping windows that
    occurred earlier are merged, and the lines they cover go. Returns ``doc_id, n_units`` (lines
    with content), ``n_removed, spans`` (removed runs, in such lines) and ``kept_text``.

    Null or empty texts and those of fewer lines lose nothing; null ids and repeated ids are as in
    ``substring_dedup``. Other columns are ignored; with ``carry`` each input row is returned whole as
    the struct ``row``.
    """
    return _dedup(docs, id_col, text_col, _lines, _join_lines, [window], 1 / 60, block_bytes, carry)
