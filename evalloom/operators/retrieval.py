"""Retrieval and leakage over text corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalloom.functions.text import LEAKAGE_NGRAM, MIN_SHORT_INPUT, occurs_as_word, word_count, words
from evalloom.session import checkpoint, ship_package, spread

#: Queries that one pass over the texts looks for; more take further passes.
PASS_QUERIES = 1_000
#: Bits of a Bloom filter at most (64 MB), its functions, and the tasks that make it.
FILTER_BITS = 1 << 29
FILTER_FUNCTIONS = 4
FILTER_TASKS = 16


def _passes(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows of a small side, some at a time: only one pass's rows are on the driver."""
    block = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def bm25_top(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int = 7, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query.

    Queries are taken in blocks. Each text is cut down to the block's terms where it is read; document
    frequencies are one small aggregate. Documents are then scored batch by batch against the whole
    block, each task hands on its k best per query, and the best of these are the result: neither a
    frequent term nor a query has a task of its own, and nothing of the size queries x documents is made.
    """
    ship_package(docs.sparkSession)
    asked = queries.select(F.col(query).alias("q"), F.array_distinct(words(F.col(text))).alias("t")).filter("size(t) > 0")
    found = [_bm25_block(docs, rows, doc, text, k, k1, b, queries.schema[query].dataType.simpleString()) for rows in _passes(asked.orderBy("q"), PASS_QUERIES)]
    if not found:
        found = [asked.select("q", F.lit(None).cast(docs.schema[doc].dataType).alias("d"), F.lit(0.0).alias("score")).limit(0)]
    best = found[0]
    for more in found[1:]:
        best = best.unionAll(more)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))
    best = best.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias(query), F.col("d").alias(doc), "score", "rank")


def _bm25_block(docs: DataFrame, rows: list, doc: str, text: str, k: int, k1: float, b: float, query_type: str) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for r in rows for t in r["t"]})
    place = {t: i for i, t in enumerate(terms)}
    of = np.zeros((len(terms), len(rows)), bool)
    for j, r in enumerate(rows):
        of[[place[t] for t in r["t"]], j] = True

    # Bound to a lambda variable, the words are found once. Terms are words, so they need no quoting.
    asked = ", ".join(f"'{t}'" for t in terms)
    cut = F.expr(f"get(transform(array(v), x -> struct(size(x) AS len, filter(x, t -> t IN ({asked})) AS w)), 0)")
    read = spread(docs.select(doc, text)).select(F.col(doc).alias("d"), words(F.col(text)).alias("v"))
    hits = checkpoint(read.select("d", cut.alias("c")).select("d", "c.len", "c.w"))
    n, mean = hits.agg(F.count("*"), F.avg("len")).first()
    seen = hits.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").count()
    df = np.zeros(len(terms))
    for r in seen.toLocalIterator():  # at most one row for each term of the block
        df[place[r["t"]]] = r["count"]
    shared = spark.sparkContext.broadcast((place, np.log(1 + (n - df + 0.5) / (df + 0.5)), of, [r["q"] for r in rows]))
    doc_type = hits.schema["d"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, idf, asked, names = shared.value
        best: dict[int, list[tuple[float, object]]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                _best_of(part, where, idf, asked, k, k1, b, mean, best)
        flat = [(names[j], d, -s) for j, kept in best.items() for s, d in kept]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*flat, strict=True)) or [()] * 3, types, strict=True)], ["q", "d", "score"])

    schema = StructType.fromDDL(f"q {query_type}, d {doc_type}, score double")
    types = [f.type for f in to_arrow_schema(schema)]
    return hits.filter("size(w) > 0").mapInArrow(score, schema)


def _best_of(part: pa.RecordBatch, where: dict, idf: np.ndarray, asked: np.ndarray, k: int, k1: float, b: float, mean: float, best: dict) -> None:
    """Merge the scores of some documents into the k best of each query, kept as (-score, document)."""
    found = part["w"].to_pylist()
    row = np.repeat(np.arange(len(found)), [len(w) for w in found])
    at = np.fromiter((where[t] for w in found for t in w), np.int64, len(row))
    key, tf = np.unique(row * len(idf) + at, return_counts=True)
    row, at = key // len(idf), key % len(idf)
    length = part["len"].to_numpy(zero_copy_only=False)[row]
    weight = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
    used, column = np.unique(at, return_inverse=True)
    dense = np.zeros((len(found), len(used)))
    dense[row, column] = weight
    score = np.round(dense @ asked[used].astype(np.float64), 6)
    ids = part["d"].to_pylist()
    top = np.argpartition(-score, k - 1, axis=0)[:k] if len(ids) > k else None
    for j in np.flatnonzero(score.any(axis=0)).tolist():
        least = score[top[:, j], j].min() if top is not None else 0.0
        near = np.flatnonzero((score[:, j] >= least) & (score[:, j] > 0))
        best[j] = sorted([*best.get(j, []), *((-score[i, j].item(), ids[i]) for i in near.tolist())])[:k]


def _place(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    """Which bit of a filter of ``bits`` bits, a power of two, function ``i`` gives each hash."""
    u = h.view(np.uint64)
    return ((u & np.uint64(0xFFFFFFFF)) + np.uint64(i) * ((u >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def _passing(h: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter lets through; what one function refuses the next ones do not see."""
    left = np.arange(len(h))
    for i in range(FILTER_FUNCTIONS):
        at = _place(h[left], i, len(bloom) * 8)
        left = left[(bloom[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
    return left


def bloom_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits (as bytes) of a Bloom filter over a column of longs: about ten for each value, at most ``FILTER_BITS``, beyond which it lets
    more values through and loses none. Tasks set bits, and their filters are merged level by level."""
    n = max(1, hashes.count())
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (10 * n).bit_length()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits, bool)
        for batch in batches:
            h = batch[0].to_numpy(zero_copy_only=False)
            for i in range(FILTER_FUNCTIONS):
                on[_place(h, i, bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(on).tobytes()], pa.binary())], ["f"])

    def both(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()

    parts = hashes.select(column).coalesce(FILTER_TASKS).mapInArrow(partial, "f binary").rdd.map(lambda r: bytes(r[0]))
    return np.frombuffer(parts.treeReduce(both), np.uint8)


def leaked_ngrams(held_out: DataFrame, cases: DataFrame, case: str, text: str, n: int = LEAKAGE_NGRAM, most: int = 2) -> DataFrame:
    """(ngram, owners): n-grams of the held-out texts that stand in 1 to ``most`` cases; more is boilerplate.

    The cases are read once, whatever the number of held-out n-grams: where a text is read, its windows' hashes are tested against a
    Bloom filter of the held-out ones; only windows that pass become strings, and these are joined exactly.
    """
    ship_package(cases.sparkSession)
    new = _windows(held_out.select(words(F.col(text)).alias("w")), n).select("ngram").distinct()
    new = checkpoint(new.withColumn("h", F.xxhash64(F.split("ngram", " "))))
    shared = cases.sparkSession.sparkContext.broadcast(bloom_filter(new, "h"))
    read = spread(cases.select(F.col(case).alias("c"), F.col(text).alias("x"))).select("c", words(F.col("x")).alias("w"))
    # Bound to a lambda variable, the words are found once; a generator's row is made once, whatever is done with its fields.
    long = F.filter(F.array("w"), lambda v: F.size(v) >= n)
    hashed = F.transform(long, lambda v: F.struct(v.alias("w"), F.transform(F.sequence(F.lit(0), F.size(v) - n), lambda i: F.xxhash64(F.slice(v, i + 1, F.lit(n)))).alias("h")))
    windows = read.select("c", F.inline(hashed))
    kind = windows.schema["c"].dataType.simpleString()
    arrow = to_arrow_schema(StructType.fromDDL(f"c {kind}, ngram string"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ends = np.cumsum(batch["h"].value_lengths().to_numpy(zero_copy_only=False))
                hit = _passing(batch["h"].flatten().to_numpy(zero_copy_only=False), shared.value)
                row = np.searchsorted(ends, hit, "right")
                starts = ends - np.diff(ends, prepend=0)
                said = {r: batch["w"][r].as_py() for r in np.unique(row).tolist()}
                found = sorted({(r, " ".join(said[r][i : i + n])) for r, i in zip(row.tolist(), (hit - starts[row]).tolist(), strict=True)})
                yield pa.RecordBatch.from_arrays([batch["c"].take(pa.array([r for r, _ in found], pa.int64())), pa.array([g for _, g in found], pa.string())], schema=arrow)

    found = windows.mapInArrow(test, f"c {kind}, ngram string").distinct()
    owned = found.join(new.select("ngram"), "ngram", "left_semi").groupBy("ngram").agg(F.count("*").alias("owners"))
    return owned.filter(F.col("owners") <= most)


def _windows(rows: DataFrame, n: int) -> DataFrame:
    """A row for each n-gram of the words ``w``."""
    # Bound to a lambda variable, the words are found once.
    once = F.expr(f"get(transform(array(w), v -> IF(size(v) >= {n}, transform(sequence(0, size(v) - {n}), i -> array_join(slice(v, i + 1, {n}), ' ')), NULL)), 0)")
    return rows.select(*[c for c in rows.columns if c != "w"], F.explode(F.array_distinct(once)).alias("ngram"))


def short_inputs(inputs: DataFrame, texts: DataFrame, value: str, row: str, text: str) -> DataFrame:
    """(row, value): short inputs that stand in a text as words. An input's first word is joined first, so
    regular expressions run on texts that hold it."""
    v = F.trim(F.col(value))
    small = inputs.select(v.alias("v")).distinct().filter((F.length("v") >= MIN_SHORT_INPUT) & (word_count(F.col("v")) < LEAKAGE_NGRAM))
    small = small.withColumn("t", F.get(words(F.col("v")), F.lit(0))).filter("t is not null")
    held = texts.select(F.col(row), F.col(text).alias("x"), F.explode(F.array_distinct(words(F.col(text)))).alias("t"))
    return held.join(small, "t").filter(occurs_as_word(F.col("x"), F.col("v"))).select(row, F.col("v").alias(value))
