"""Distinct words of a batch of texts, and their character n-grams, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from evalloom.llm.blocks import Distinct, hashes, mix, rolled


class Words:
    """All words of some texts: the distinct ones, the place of every word and each text's bounds."""

    def __init__(self, split: list[list[bytes]]):
        flat = [w for words in split for w in words]
        sizes = np.array([len(x) for x in split], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        found = Distinct(hashes(flat))
        self.place, self.keys, self.counts = found.place, found.keys, found.counts
        self.distinct = [flat[i] for i in found.first.tolist()]

    def rows(self) -> Iterator[np.ndarray]:
        """Places of each text's words."""
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            yield self.place[a:b]


def grams(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``length``-byte strings of each word between two spaces, and where each word's begin.

    Every word has at least one: shorter words with their spaces count as one string.
    """
    data = np.frombuffer(b" " + b"  ".join(words) + b" " * (length + 1), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    counts = np.maximum(sizes - length + 1, 1)
    begin = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(begin - first, counts)
    return mix(rolled(data.astype(np.uint64) + np.uint64(1), length)[at]), first


def parts(batch: pa.RecordBatch, column: str, rows: int = 512) -> Iterator[list[bytes]]:
    """A batch's texts as bytes, some rows at a time; null is empty."""
    for start in range(0, batch.num_rows, rows):
        texts = batch[column].slice(start, rows).cast(pa.binary()).to_pylist()
        yield [t or b"" for t in texts]
