"""N-gram Jaccard join by vertical partitioning.

Shingles have one global order: ascending document frequency, then hash. The order is cut into
fragments (frequency 1, 2-3, 4-7, ...); a document's set falls into one segment per fragment. For each
candidate pair the overlap of every pair of segments is counted separately and summed per pair. The
first fragment, shingles of one document, overlaps with nothing and is only counted.

Candidates come from prefix filtering on the same order: two sets with Jaccard of at least t share one
of their n - ceil(t n) + 1 first shingles. Documents with equal sets form a class and one stands for
all. Within a group that shares a prefix shingle, each document first meets the group's pivot, its
least edited member; only documents that this leaves in different components meet each other. Links
between documents that are already connected do not change a component, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import Answers, Blocks, Distinct, Texts, answer, hashes, mix, pack, rolled, slices, unpack
from evalloom.llm.components import connected_components
from evalloom.session import checkpoint, forget

FRAGMENTS = 8
SETS = "doc_id long, n_shingles long, fp1 long, fp2 long, n_prefix int, n_single int, tokens array<long>, cuts array<int>"
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word ``words``-grams; a shorter text is one shingle."""
    split = [t.lower().split() for t in texts]
    ends = np.cumsum([len(x) for x in split], dtype=np.int64)
    flat = np.concatenate([hashes(x) for x in split]) if split else np.zeros(0, np.uint64)
    long = mix(rolled(flat, words)) if len(flat) else flat
    out = []
    for end, x in zip(ends.tolist(), split, strict=True):
        start = end - len(x)
        if not x:
            out.append(np.zeros(0, np.uint64))
        elif len(x) < words:
            out.append(mix(rolled(flat[start:end], len(x)) + np.uint64(len(x)))[:1])
        else:
            out.append(np.unique(long[start : end - words + 1]))
    return out


def _counts(values: np.ndarray) -> bytes:
    return _PACK.compress(values.astype("<u4").tobytes())


def _read_counts(body: bytes) -> np.ndarray:
    return np.frombuffer(_UNPACK.decompress(body), "<u4")


def _add_up(blocks: list[int], bodies: list[bytes]) -> list[bytes]:
    """Document frequency over all blocks of each block's shingles."""
    keys, counts = [], []
    for body in bodies:
        k, end = unpack(body)
        keys.append(k)
        counts.append(_read_counts(body[end:]))
    found = Distinct(np.concatenate(keys))
    total = np.zeros(len(found.keys), np.int64)
    np.add.at(total, found.place, np.concatenate(counts).astype(np.int64))
    each, out, at = np.minimum(total, (1 << 32) - 1)[found.place], [], 0
    for k in keys:
        out.append(_counts(each[at : at + len(k)]))
        at += len(k)
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def set_table(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block_bytes: int) -> DataFrame:
    """Size and fingerprint of each document's set, and its shingles of frequency 2 or more in the
    global order where one of them is in the prefix."""
    blocks = Blocks(docs, id_col, text_col, block_bytes, 1 / 6)
    key_bits = min(64, blocks.bits + 12)
    bucket_bits = blocks.bucket_bits()
    low = np.uint64((1 << (key_bits - bucket_bits)) - 1)

    def distinct(sets: list[np.ndarray]) -> Distinct:
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return Distinct(flat >> np.uint64(64 - key_bits))

    def ask(texts: Texts) -> Iterator[tuple[int, bytes]]:
        found = distinct(shingle_sets(texts.texts, words))
        for bucket, part in slices(found.keys, key_bits, bucket_bits):
            yield bucket, pack(found.keys[part] & low) + _counts(found.counts[part])

    def finish(texts: Texts, told: Answers) -> pa.Table:
        sets = shingle_sets(texts.texts, words)
        found = distinct(sets)
        bodies = told.of(0)
        total = np.concatenate([_read_counts(x) for x in bodies]) if bodies else np.zeros(0, np.uint32)
        frequency = total[found.place]
        rows, at = [], 0
        for s in sets:
            n = len(s)
            often = frequency[at : at + n]
            at += n
            digest = xxhash.xxh3_128_intdigest(s.tobytes()) if n else 0
            order = np.lexsort((s, often))
            prefix = n - (percent * n + 99) // 100 + 1 if n else 0
            n_single = int((often < 2).sum())
            n_prefix = max(0, min(prefix, n) - n_single)
            tokens = cuts = None
            if n_prefix:
                order = order[n_single:]
                tokens = _signed(s[order])
                level = np.minimum(np.log2(often[order]).astype(np.int64) - 1, FRAGMENTS - 1)
                cuts = np.searchsorted(level, np.arange(FRAGMENTS + 1)).tolist()
            rows.append((n, digest >> 64, digest & ((1 << 64) - 1), n_prefix, n_single, tokens, cuts))
        n, fp1, fp2, n_prefix, n_single, tokens, cuts = zip(*rows, strict=True)
        return pa.table(
            {
                "doc_id": texts.ids,
                "n_shingles": pa.array(n, pa.int64()),
                "fp1": pa.array(np.array(fp1, np.uint64).view(np.int64)),
                "fp2": pa.array(np.array(fp2, np.uint64).view(np.int64)),
                "n_prefix": pa.array(n_prefix, pa.int32()),
                "n_single": pa.array(n_single, pa.int32()),
                "tokens": pa.array(tokens, pa.list_(pa.int64())),
                "cuts": pa.array(cuts, pa.list_(pa.int32())),
            }
        )

    return blocks.finish(answer(blocks.ask(ask), 0, _add_up), finish, SETS)


def _segments(sets: DataFrame, name: str) -> DataFrame:
    """One row per document and non-empty fragment: (name, fragment, segment)."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)),
        lambda f: F.struct(
            f.alias("fragment"),
            F.slice("tokens", F.get("cuts", f) + 1, F.get("cuts", f + 1) - F.get("cuts", f)).alias("segment"),
        ),
    )
    parts = F.filter(parts, lambda p: F.size(p["segment"]) > 0)
    return sets.select(F.col("rep").alias(name), F.inline(parts)).withColumnRenamed("segment", f"{name}_segment")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) whose summed overlaps reach the threshold, with the overlap ``n``."""
    overlap = F.size(F.array_intersect("a_segment", "b_segment")).cast("long")
    partial = (
        pairs.join(_segments(sets, "b"), "b")
        .join(_segments(sets, "a"), ["a", "fragment"])
        .select("a", "b", "na", "nb", overlap.alias("n"))
    )
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))
    return total.filter(100 * F.col("n") >= percent * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b", "na", "nb", "n")


def _room(percent: int) -> Column:
    """Whether the places ix and iy of a common token leave room for enough overlap.

    Every pair of linked sets passes at its first common token: both sets' tokens before it are not
    shared, so the overlap is at most what follows in either set.
    """
    follow = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    return (100 + percent) * follow >= percent * (F.col("nx") + F.col("ny"))


def _pairs(left: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of rows (x, nx, y, ny) of fitting sizes, smaller id first."""
    first = F.col("x") < F.col("y")
    return (
        left.filter((F.col("x") != F.col("y")) & _sizes_fit(F.col("nx"), F.col("ny"), percent))
        .select(
            F.least("x", "y").alias("a"), F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"),
            F.greatest("x", "y").alias("b"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"),
        )
        .distinct()
    )


def _prepared(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(table, classes, sets, prefix): all rows with their sets' fingerprints; the classes of equal sets, each under its smallest id; one
    set for each class that can link; and the places of its prefix tokens in the global order."""
    table = checkpoint(set_table(docs, id_col, text_col, words, percent, block_bytes))
    known = table.filter("doc_id is not null and n_shingles > 0")
    classes = checkpoint(known.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")))
    sets = known.filter("n_prefix > 0").join(
        classes.withColumnRenamed("rep", "doc_id"), ["fp1", "fp2", "doc_id"], "left_semi"
    )
    sets = sets.withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "fp1", "fp2"])
    # Ties for the pivot are broken by id, so that a recomputed task chooses alike.
    edited = (F.least(F.col("n_single"), F.lit((1 << 19) - 1)).cast("long") * F.lit(1 << 43)) + F.pmod("rep", F.lit(1 << 43))
    sets = checkpoint(sets.select("rep", F.col("n_shingles").alias("n"), edited.alias("edited"), "n_single", "n_prefix", "tokens", "cuts"))
    # Tokens of frequency 1 come first in the order, so a token's place counts from their number on.
    prefix = sets.select("rep", "n", "edited", "n_single", F.posexplode(F.slice("tokens", F.lit(1), F.col("n_prefix"))).alias("i", "token"))
    return table, classes, sets, prefix.withColumn("i", F.col("i") + F.col("n_single")).drop("n_single")


def ngram_jaccard_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block_bytes: int = 4 << 20
) -> tuple[DataFrame, DataFrame]:
    """(links, members): every link between classes of documents with equal sets, as (a, b, na, nb, n) with ids of classes, sizes and overlap,
    and (doc_id, class_id) of all documents with a shingle.

    Copies are one class, so they are not paired; different sets are, each pair once, which makes as many rows as there are
    links: use ``ngram_jaccard_join`` where components are enough. Ids are taken to tell documents apart; rows without an id
    have no class. Texts and words are as there.
    """
    table, classes, sets, prefix = _prepared(docs, id_col, text_col, words, percent, block_bytes)
    x = prefix.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), "token")
    y = prefix.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"), "token")
    links = _links(checkpoint(_pairs(x.join(y, "token").filter("x < y").filter(_room(percent)), percent)), sets, percent)
    members = table.filter("doc_id is not null and n_shingles > 0").join(classes, ["fp1", "fp2"])
    return links, members.select("doc_id", F.col("rep").alias("class_id"))


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    pivot_rounds: int = 1,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; components of documents that are linked when
    100 * intersection >= ``percent`` * union of their sets of word ``words``-grams.

    A-Z are lower-cased; words are runs of characters other than space and \\t to \\r. A text of fewer
    words is one shingle. Null and empty texts have no shingle and link with nothing: their component
    is their own id. Rows that repeat an id share the smallest component of the id's rows with such a
    set. A row without an id has no component. Other columns are ignored.
    """
    table, classes, sets, prefix = _prepared(docs, id_col, text_col, words, percent, block_bytes)
    known = table.filter("doc_id is not null and n_shingles > 0")
    links = component = None
    for last in [False] * pivot_rounds + [True]:
        group = prefix if component is None else prefix.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        if component is None:
            group = group.withColumn("component", F.col("rep"))
        open_ = group.groupBy("token").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("rep", "edited").alias("y"),
            F.min_by("n", "edited").alias("ny"), F.min_by("component", "edited").alias("yc"), F.min_by("i", "edited").alias("iy"),
        ).filter("lo < hi")
        mine = group.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("component").alias("xc"), F.col("i").alias("ix"), "token")
        if last:
            pivots = mine.join(open_.select("token"), "token").select(
                F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("xc").alias("yc"), F.col("ix").alias("iy"), "token"
            )
        else:
            pivots = open_.select("token", "y", "ny", "yc", "iy")
        met = mine.join(pivots, "token").filter(F.col("xc") != F.col("yc")).filter(_room(percent))
        pairs = checkpoint(_pairs(met.filter("x < y") if last else met, percent))
        if pairs.isEmpty():
            break
        found = checkpoint(_links(pairs, sets, percent).select("a", "b"))
        forget(pairs)
        if found.isEmpty():
            continue
        links = found if links is None else links.unionAll(found)
        component = connected_components(links, "a", "b").withColumnRenamed("node", "rep")
    whole = known.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2"])
    if component is not None:
        whole = whole.join(component, "rep", "left")
    else:
        whole = whole.withColumn("component", F.lit(None).cast("long"))
    whole = whole.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = table.filter("doc_id is null or n_shingles = 0")
    return whole.unionAll(rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
