"""Order-dependent operators that keep working when one task cannot hold the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.session import checkpoint


def global_row_number(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Row numbers from 1 in the order of ``order``, which must be unique.

    The rows are dealt by ranges and numbered inside each; one count per range gives the offsets, so
    no task sees all rows.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = df.repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id())
    dealt = checkpoint(dealt)  # the parts must be those that are counted
    counts = dealt.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row per shuffle partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = dealt.withColumn("_within", within).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_within").cast("long") + F.col("_before")).drop("_part", "_within", "_before")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Fixed-size batches in order: ``batch`` from 0."""
    return global_row_number(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long"))


def rank_within(df: DataFrame, group: str, order: list[str], rank: str = "rank", size: str | None = None) -> DataFrame:
    """``rank`` of every row in its group, from 1 in the order of ``order`` (unique in a group), and the group's
    ``size``. Rows are numbered over all groups and each group's first number is taken off, so that a group of any
    size is spread over tasks; rows with a null group are a group too."""
    numbered = global_row_number(df, [group, *order], "_rn")
    first = numbered.groupBy(F.col(group).alias("_g")).agg(F.min("_rn").alias("_first"), F.count("*").alias("_in_group"))
    both = numbered.join(first, F.col(group).eqNullSafe(F.col("_g")))
    ranked = both.withColumn(rank, F.col("_rn") - F.col("_first") + 1)
    return (ranked.withColumn(size, F.col("_in_group")) if size else ranked).drop("_rn", "_g", "_first", "_in_group")


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """``turn`` of every row in its group; ordering by (turn, group) takes the groups by turns."""
    return rank_within(df, group, [order], "turn")


def latest(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The last row of each key: one aggregation, without sorting any group."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("last")
    return df.groupBy(key).agg(last).select(key, "last.*")


def islands(df: DataFrame, part: str, order: list[str], reset: Column, count: Column) -> DataFrame:
    """Per ``part``: rows under ``count`` since the last row under ``reset`` (that row not included)."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("island", F.sum(reset.cast("int")).over(w)).withColumn("hit", (count & ~reset).cast("long"))
    each = marked.groupBy(part, "island").agg(F.sum("hit").alias("n"))
    return each.groupBy(part).agg(F.max("island").cast("long").alias("resets"), F.max_by("n", "island").alias("since"))


def sequence_violations(df: DataFrame, part: str, seq: str) -> DataFrame:
    """Rows whose sequence number does not exceed the one before it."""
    w = Window.partitionBy(part).orderBy(seq)
    return df.withColumn("before", F.lag(seq).over(w)).filter(F.col(seq) <= F.col("before"))
