"""Candidate search: paired bootstrap, acceptance, Pareto selection, lineage and merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalloom.operators.ordering import rank_within
from evalloom.session import checkpoint, forget, ship_package

#: Cases of one block of a bootstrap, and draws that a task holds at once.
BLOCK_CASES = 1 << 16
#: Members of one block of a set: two blocks make at most the square of it in pairs. Pairs of blocks of one task.
BLOCK_MEMBERS = 1 << 10
PAIRS_OF_TASK = 16
#: Chains that a task follows together; steps between ranges up to which their table is sent to all tasks.
CHAINS_AT_ONCE = 1 << 16
FEW_STEPS = 1 << 16
DRAWS_AT_ONCE = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of a public 32-bit hash, on numbers below 2**32: in SQL it is shifts, products and remainders."""
    low = np.uint64(0xFFFFFFFF)
    h = h ^ (h >> np.uint64(16))
    h = (h * np.uint64(2246822507)) & low
    h = h ^ (h >> np.uint64(13))
    h = (h * np.uint64(3266489909)) & low
    return h ^ (h >> np.uint64(16))


def block_counts(n: int, leaf: int, block: int, resamples: int, seed: int) -> np.ndarray:
    """How many of the ``n`` draws of each resample fall into block ``leaf``: a multinomial split, halved from the root down. Each block
    walks to its own place and meets the same numbers on the way as its neighbours, so nothing is sent between them."""
    lo, hi = 0, -(-n // block)
    counts = np.full(resamples, n, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, whole = mid * block - lo * block, min(hi * block, n) - lo * block
        rng = np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, (lo << 32) + hi]))
        taken = rng.binomial(counts, left / whole)
        counts, lo, hi = (taken, lo, mid) if leaf < mid else (counts - taken, mid, hi)
    return counts


def resampled_sums(gains: np.ndarray, counts: np.ndarray, leaf: int, seed: int) -> np.ndarray:
    """Summed gain of each resample's draws from one block: draw i of resample b is a hash of (seed, block, b, i)."""
    out = np.empty(len(counts))
    step = max(1, DRAWS_AT_ONCE // max(1, int(counts.max(initial=1))))
    base = np.uint64((seed * 3266489917 + leaf * 668265263) & 0xFFFFFFFF)
    for start in range(0, len(counts), step):
        c = counts[start : start + step]
        b = np.repeat(np.arange(len(c)), c)
        i = np.arange(len(b)) - np.repeat(np.cumsum(c) - c, c) + 1
        h = (b + start + 1).astype(np.uint64) * np.uint64(2654435769) + i.astype(np.uint64) * np.uint64(2246822519) + base
        drawn = gains[(_mixed(h & np.uint64(0xFFFFFFFF)) % np.uint64(len(gains))).astype(np.int64)]
        out[start : start + step] = np.bincount(b, weights=drawn, minlength=len(c))
    return out


def bootstrap_gain(gains: DataFrame, key: str, case: str, gain: str, resamples: int = 2000, seed: int = 0, block: int = BLOCK_CASES) -> DataFrame:
    """(key, cases, mean_gain, p_improve): the share of resamples whose summed gain is above 0.

    A key's cases are cut into blocks of bounded size by their rank. How many of a resample's draws fall into a block is a multinomial
    split that each block computes for itself; draws inside a block are hashes, so every retry draws alike. A block makes
    one sum for each resample, and the sums of a key's blocks are added: no key is held in one place, whatever its cases.
    Without any gain other than 0 both numbers are 0.
    """
    ship_package(gains.sparkSession)
    ranked = rank_within(gains.select(F.col(key).alias("k"), F.col(case).alias("c"), F.coalesce(F.col(gain).cast("double"), F.lit(0.0)).alias("g")), "k", ["c"], "_rank", "_size")
    leaf = F.floor((F.col("_rank") - 1) / block).alias("leaf")
    packed = ranked.groupBy("k", leaf).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "g"))), lambda x: x["g"]).alias("g"), F.max("_size").alias("n"))
    kind = packed.schema["k"].dataType.simpleString()
    schema = StructType.fromDDL(f"k {kind}, n long, gained double, moved boolean, up long, sums array<double>")
    names = [f.name for f in to_arrow_schema(schema)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                n, place = row["n"][0].as_py(), row["leaf"][0].as_py()
                g = row["g"].flatten().to_numpy(zero_copy_only=False)
                sums = resampled_sums(g, block_counts(n, place, block, resamples, seed), place, seed)
                alone = n <= block
                found = [row["k"], [n], [float(g.sum())], [bool((g != 0).any())], [int((sums > 0).sum()) if alone else None], [None if alone else sums.tolist()]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(found, to_arrow_schema(schema), strict=True)], names)

    drawn = checkpoint(packed.mapInArrow(draw, schema))
    several = drawn.filter("sums is not null").select("k", F.posexplode("sums").alias("b", "s")).groupBy("k", "b").agg(F.sum("s").alias("s")).groupBy("k").agg(F.count_if(F.col("s") > 0).alias("together"))
    found = drawn.groupBy("k").agg(F.max("n").alias("cases"), (F.sum("gained") / F.max("n")).alias("mean"), F.bool_or("moved").alias("moved"), F.max("up").alias("up"))
    both = found.join(several.withColumnRenamed("k", "same"), F.col("k").eqNullSafe(F.col("same")), "left").drop("same")
    p = F.coalesce("up", "together", F.lit(0)) / F.lit(resamples)
    return both.select(
        F.col("k").alias(key), "cases", F.when(F.col("moved"), F.col("mean")).otherwise(0.0).alias("mean_gain"), F.when(F.col("moved"), p).otherwise(0.0).alias("p_improve"),
    )


def acceptance(val_delta: Column, val_p: Column, train_delta: Column, train_p: Column, least: float, confidence: float) -> Column:
    """Decision on a candidate: by its validation gain, else by a tie there and a sure gain on train."""
    return (
        F.when((val_delta > 0) & (val_delta >= least) & (val_p >= confidence), "accepted")
        .when((val_delta >= 0) & (train_delta > 0) & (train_p >= confidence), "accepted_train_tiebreak")
        .otherwise("selection_below_threshold")
    )


def pareto_frontier(scores: DataFrame, member: str, case: str, score: str) -> DataFrame:
    """Members that no other equals or beats on every case while beating it on one.

    Members are few, cases many: the pair join is on the case and is reduced to one row per pair.
    """
    a = scores.select(F.col(member).alias("m"), case, F.col(score).alias("ms"))
    b = scores.select(F.col(member).alias("o"), case, F.col(score).alias("os"))
    pairs = a.join(b, case).filter("m <> o").groupBy("m", "o").agg(F.bool_and(F.expr("os >= ms")).alias("all"), F.bool_or(F.expr("os > ms")).alias("some"))
    beaten = pairs.filter("all and some").select(F.col("m").alias(member)).distinct()
    return scores.select(member).distinct().join(beaten, member, "left_anti")


def pareto_votes(scores: DataFrame, member: str, case: str, score: str) -> DataFrame:
    """Per member the cases on which it has the best score; cases on which all are equal give no vote."""
    w = Window.partitionBy(case)
    rated = scores.withColumn("hi", F.max(score).over(w)).withColumn("lo", F.min(score).over(w))
    return rated.filter("hi > lo").groupBy(member).agg(F.count_if(F.col(score) == F.col("hi")).alias("votes"))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, a, depth, leaves): the chains of parents of a task's rows (c, p), as far as they stay among its rows. The step out of them has
    ``leaves``. A row without a is told where some c has several rows."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    held = pa.Table.from_batches(rows).combine_chunks()
    parents, coded = held["p"].combine_chunks(), held["c"].combine_chunks().dictionary_encode()
    ids, child = coded.dictionary, coded.indices.to_numpy()
    up = pc.fill_null(pc.index_in(parents, value_set=ids), -1).to_numpy()
    has = parents.is_valid().to_numpy(zero_copy_only=False)
    order = np.argsort(child, kind="stable")
    starts = np.searchsorted(child[order], np.arange(len(ids) + 1))
    several = len(child) > len(ids)
    names = ["c", "a", "depth", "leaves"]
    if several:
        yield pa.RecordBatch.from_arrays([ids.slice(0, 1), pa.nulls(1, ids.type), pa.array([0], pa.int64()), pa.array([True])], names)
    for first in range(0, len(ids), CHAINS_AT_ONCE):
        who = at = np.arange(first, min(first + CHAINS_AT_ONCE, len(ids)))
        depth = 0
        while len(who):
            depth += 1
            n = starts[at + 1] - starts[at]
            edges = order[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            who, edges = np.repeat(who, n)[has[edges]], edges[has[edges]]
            inside = up[edges] >= 0
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), parents.take(pa.array(edges)), pa.array(np.full(len(who), depth)), pa.array(~inside)], names)
            who, at = who[inside], up[edges][inside]
            if several and len(who):
                who, at = np.unique(np.stack([who, at]), axis=1)


def _closed(links: DataFrame) -> DataFrame:
    """(c, a, depth) of all chains of ``links`` (c, a, depth), by doubling: each round joins chains with chains, so a chain of n needs
    log n rounds; the round before is deleted."""
    reach = checkpoint(links)
    size = reach.count()
    while True:
        far = reach.select(F.col("c").alias("a"), F.col("a").alias("top"), F.col("depth").alias("more"))
        longer = reach.join(far, "a").select("c", F.col("top").alias("a"), (F.col("depth") + F.col("more")).alias("depth"))
        new = checkpoint(reach.unionByName(longer).distinct())
        before, size = size, new.count()
        forget(reach)
        if size == before:
            return new
        reach = new


def lineage(candidates: DataFrame, child: str, parent: str, listed: bool = False) -> DataFrame:
    """(child, ancestor, depth) of all chains of parents. ``listed``: a parent that is no child in ``candidates`` (whose first ones have
    a row with a null parent) counts as none.

    Candidates are dealt by ranges of their ids, and a range follows its chains by itself: what is numbered in the order in
    which it came about has its parents close by. Only steps from one range to another are joined, by doubling; of them there are few,
    or at worst as many as candidates. Chains that stay in a range are never shuffled.
    """
    ship_package(candidates.sparkSession)
    rows = candidates.select(F.col(child).alias("c"), F.col(parent).alias("p")).filter("c is not null")
    kind = rows.schema["c"].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(rows.withColumn("p", F.col("p").cast(kind)).repartitionByRange(parts, "c"))  # both passes must see the same ranges
    chains = dealt.mapInArrow(_chains, f"c {kind}, a {kind}, depth long, leaves boolean")
    near = chains.filter("not leaves").drop("leaves")
    out = checkpoint(chains.filter("leaves").drop("leaves"))
    several = not out.filter("a is null").isEmpty()
    out = out.filter("a is not null")
    few = out.count() <= FEW_STEPS

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    met = dealt.select(F.col("c").alias("a")).join(small(out.select("a").distinct()), "a", "left_semi").distinct()
    met = checkpoint(met)
    if listed:
        out = out.join(small(met), "a", "left_semi").select("c", "a", "depth")
    reach = _closed(out.join(small(met.select(F.col("a").alias("c"))), "c", "left_semi").select("c", "a", "depth"))
    far = reach.select(F.col("c").alias("a"), F.col("a").alias("top"), F.col("depth").alias("more"))
    tops = out.unionByName(out.join(far, "a").select("c", F.col("top").alias("a"), (F.col("depth") + F.col("more")).alias("depth"))).distinct()
    tops = checkpoint(tops)
    few = tops.count() <= FEW_STEPS
    passed = small(tops.select(F.col("c").alias("child"), F.col("a").alias("c"), F.col("depth").alias("more")))
    beyond = near.join(passed, "c").select(F.col("child").alias("c"), "a", (F.col("depth") + F.col("more")).alias("depth"))
    found = near.unionByName(tops).unionByName(beyond)
    found = found.distinct() if several else found
    return found.select(F.col("c").alias(child), F.col("a").alias("ancestor"), "depth")


def merge_pairs(pool: DataFrame, member: str, changed: str, tried: DataFrame | Column | None = None, block: int = BLOCK_MEMBERS) -> DataFrame:
    """Pairs (a, b) of members whose sets of changed settings are both non-empty and share nothing.

    Sets are compared, of which there are few, and the members of a set are cut into blocks by their order. Blocks are joined
    and dealt evenly, each pair of blocks is written out where it was dealt to: the result has a row for each pair of members, as the
    search asks, and no such row is shuffled. ``tried`` leaves pairs out: a condition on a and b does so in place, a table (a, b)
    by an anti join.
    """
    of = pool.select(F.col(member).alias("m"), F.array_sort(F.array_distinct(changed)).alias("s")).filter("size(s) > 0 and m is not null")
    ranked = rank_within(of.withColumn("_set", F.sha2(F.to_json("s"), 256)), "_set", ["m"], "_rank")
    blocks = ranked.groupBy("_set", F.floor((F.col("_rank") - 1) / block).alias("block")).agg(F.first("s").alias("s"), F.sort_array(F.collect_list("m")).alias("ms"))
    blocks = checkpoint(blocks.select("_set", "block", "s", "ms", F.element_at("ms", 1).alias("low"), F.element_at("ms", -1).alias("high")))
    # Which blocks meet is settled by their sets and bounds; the members follow by two joins.
    ends = blocks.drop("ms")
    a, b = (ends.select(*[F.col(c).alias(f"{side}_{c}") for c in ends.columns]) for side in "ab")
    meet = checkpoint(a.join(b, ~F.arrays_overlap("a_s", "b_s") & (F.col("a_low") < F.col("b_high"))).select("a__set", "a_block", "b__set", "b_block"))
    tasks = max(meet.sparkSession.sparkContext.defaultParallelism * 4, meet.count() // PAIRS_OF_TASK)
    for side in "ab":
        held = blocks.select(F.col("_set").alias(f"{side}__set"), F.col("block").alias(f"{side}_block"), F.col("ms").alias(f"{side}s"))
        meet = meet.join(held, [f"{side}__set", f"{side}_block"])
    dealt = meet.repartition(tasks, "a__set", "a_block", "b__set", "b_block")
    pairs = dealt.select(F.explode("as").alias("a"), "bs").select("a", F.explode("bs").alias("b")).filter("a < b")
    if isinstance(tried, Column):
        return pairs.filter(~F.coalesce(tried, F.lit(False)))
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def distinct_configs(candidates: DataFrame, config: list[str], order: str) -> DataFrame:
    """First candidate of every configuration."""
    key = F.sha2(F.to_json(F.struct(*config)), 256)
    w = Window.partitionBy("config_hash").orderBy(order)
    return candidates.withColumn("config_hash", key).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
