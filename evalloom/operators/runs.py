"""Runs: progress, summaries and comparison of case results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.scores import run_status

PASS = 100.0


def progress(results: DataFrame, run: str, ok: Column, score: Column) -> DataFrame:
    """Counts, status and both means of every run: over successful cases, and with failed ones as 0."""
    return results.groupBy(run).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, score)).alias("mean_successful"),
        (F.sum(F.when(ok, score).otherwise(0.0)) / F.count("*")).alias("mean_failed_zero"),
    ).withColumn("status", run_status(F.col("total"), F.col("succeeded")))


def weighted_points(results: DataFrame, keys: list[str], earned: Column, possible: Column) -> DataFrame:
    """100 * earned / possible points; null where none were possible."""
    return results.groupBy(*keys).agg((100.0 * F.try_divide(F.sum(earned), F.sum(possible))).alias("weighted_score"))


def timings(visits: DataFrame, step: str, seconds: str) -> DataFrame:
    """Every visit of a step is one observation: mean, median and nearest-rank 95th percentile."""
    return visits.groupBy(step).agg(
        F.count("*").alias("visits"),
        F.avg(seconds).alias("mean_s"),
        F.expr(f"percentile({seconds}, 0.5)").alias("p50_s"),
        F.expr(f"percentile_disc(0.95) within group (order by {seconds})").alias("p95_s"),
    )


def timings_per_case(visits: DataFrame, case: str, step: str, seconds: str, by: list[str] | None = None) -> DataFrame:
    """Visits are summed within a case first; then the mean over cases."""
    keys = [*(by or []), step]
    sums = visits.groupBy(*keys, case).agg(F.sum(seconds).alias("case_s"))
    return sums.groupBy(*keys).agg(F.count("*").alias("cases"), F.avg("case_s").alias("mean_s"))


def case_changes(baseline: DataFrame, candidate: DataFrame, case: str, score: str = "score") -> DataFrame:
    """Cases of both runs with their scores and the gain."""
    b = baseline.select(case, F.col(score).alias("baseline"))
    c = candidate.select(case, F.col(score).alias("candidate"))
    return b.join(c, case).withColumn("delta", F.col("candidate") - F.col("baseline"))


def comparison(changes: DataFrame) -> DataFrame:
    """One row: means, medians, their deltas, and how many cases fell or rose. No case gives zeros."""

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return changes.agg(
        F.count("*").alias("shared"),
        zero(F.avg("baseline")).alias("baseline_mean"),
        zero(F.avg("candidate")).alias("candidate_mean"),
        zero(F.median("baseline")).alias("baseline_median"),
        zero(F.median("candidate")).alias("candidate_median"),
        F.count_if(F.col("delta") < 0).alias("regressions"),
        F.count_if(F.col("delta") > 0).alias("improvements"),
    ).withColumn("mean_delta", F.col("candidate_mean") - F.col("baseline_mean"))


def extremes(changes: DataFrame, case: str, k: int = 5) -> DataFrame:
    """The k largest regressions and improvements."""
    down = changes.filter("delta < 0").orderBy("delta", case).limit(k).withColumn("kind", F.lit("regression"))
    up = changes.filter("delta > 0").orderBy(F.desc("delta"), case).limit(k).withColumn("kind", F.lit("improvement"))
    return down.unionByName(up)


def grouped_deltas(baseline: DataFrame, candidate: DataFrame, name: str, value: str) -> DataFrame:
    """Means per name in either run; a name that a run lacks counts as 0 there."""
    b = baseline.groupBy(name).agg(F.avg(value).alias("baseline"))
    c = candidate.groupBy(name).agg(F.avg(value).alias("candidate"))
    both = b.join(c, name, "full_outer").na.fill(0.0, ["baseline", "candidate"])
    return both.withColumn("delta", F.col("candidate") - F.col("baseline"))


def flips(parent: DataFrame, candidate: DataFrame, case: str, threshold: float = PASS, k: int = 40) -> DataFrame:
    """One row: the first k cases that the candidate newly passes, and newly fails."""
    both = case_changes(parent, candidate, case)
    now, was = F.col("candidate") >= threshold, F.col("baseline") >= threshold

    def first(kind: str, hit: Column) -> DataFrame:
        return both.filter(hit).select(F.lit(kind).alias("kind"), case).orderBy(case).limit(k)

    return first("improved", now & ~was).unionByName(first("regressed", ~now & was))


def identity_compatibility(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both runs' (dimension, fingerprint) rows side by side: same, different, or missing in one."""
    b = baseline.select("dimension", F.col("fingerprint").alias("b"))
    c = candidate.select("dimension", F.col("fingerprint").alias("c"))
    state = (
        F.when(F.col("b").isNull() | F.col("c").isNull(), "missing").when(F.col("b") == F.col("c"), "same").otherwise("different")
    )
    return b.join(c, "dimension", "full_outer").select("dimension", state.alias("state"))
