"""Groups, splits and samples that leak nothing from one side to the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import stable_hash
from evalloom.operators.ordering import rank_within
from evalloom.session import checkpoint, forget

# Target shares of the splits.
SHARES = {"train": 0.6, "validation": 0.2, "test": 0.2}
SHARES_WITH_REGRESSION = {"train": 0.48, "validation": 0.16, "test": 0.16, "regression": 0.2}


def connected_groups(records: DataFrame, record: str, keys: list[Column]) -> DataFrame:
    """(record, group_name): records that share the value of any key are one group, named by its smallest
    record. Null keys connect nothing.

    A key is reduced to a star first: its records are linked with its smallest one, so a key of very many records
    makes as many links and no pairs, and records without a shared key take no part in the rounds. Each round a record
    takes the smallest label among its neighbours', then that label's own; the round before is deleted.
    """
    tagged = F.array(*[F.when(k.isNotNull(), F.struct(F.lit(i).alias("k"), k.cast("string").alias("v"))) for i, k in enumerate(keys)])
    held = records.select(F.col(record).alias("r"), F.explode(F.array_compact(tagged)).alias("key"))
    held = held.select("r", F.sha2(F.concat_ws(":", "key.k", "key.v"), 256).alias("key"))
    star = held.join(held.groupBy("key").agg(F.min("r").alias("low")), "key").filter("r <> low").select("r", "low").distinct()
    links = checkpoint(star.unionAll(star.select(F.col("low").alias("r"), F.col("r").alias("low"))).distinct())
    labels = old = checkpoint(links.groupBy("r").agg(F.min("low").alias("low")).select("r", F.least("r", "low").alias("label")))
    while True:
        near = links.join(labels.withColumnRenamed("r", "low"), "low").groupBy("r").agg(F.min("label").alias("near"))
        step = labels.join(near, "r").select("r", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("r").alias("low"), F.col("label").alias("lower"))
        new = checkpoint(step.join(up, "low").select("r", F.least("low", "lower").alias("lower"), (F.least("low", "lower") < F.col("label")).alias("moved")))
        forget(old)
        labels, old = new.select("r", F.col("lower").alias("label")), new
        if new.filter("moved").isEmpty():
            break
    forget(links)
    every = records.select(F.col(record).alias("r")).distinct().join(labels, "r", "left")
    return every.select(F.col("r").alias(record), F.coalesce("label", "r").alias("group_name"))


def greedy_split(groups: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(group_name, split) of groups with a ``weight``: in the order of a seeded hash, each group goes to the
    split furthest below its target, ties to the first split.

    The rule is a fold over all groups, so groups, not records, pass through one task: sorted by Spark
    and streamed, with one sum per split as the only state.
    """
    names, targets = list(shares), np.array(list(shares.values()))
    named = groups.select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group_name").cast("string")), 256).alias("h"), "group_name", F.col("weight").cast("double").alias("weight")
    )
    total = named.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))  # one row
    ordered = named.crossJoin(F.broadcast(total)).repartition(1).sortWithinPartitions("h", "group_name", "weight")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(len(names))
        for batch in batches:
            split = []
            for weight, all_ in zip(batch["weight"].to_pylist(), batch["total"].to_pylist(), strict=True):
                at = int((targets * all_ - filled).argmax())
                filled[at] += weight
                split.append(names[at])
            yield pa.RecordBatch.from_arrays([batch["group_name"], pa.array(split, pa.string())], ["group_name", "split"])

    return ordered.mapInArrow(fold, f"group_name {groups.schema['group_name'].dataType.simpleString()}, split string")


def stratified_split(rows: DataFrame, key: str, row: str, dev_fraction: float = 0.2, rare: int = 3, seed: int = 42) -> DataFrame:
    """``split`` dev or test, key by key in a hashed order; keys with at most ``rare`` rows are all test."""
    hashed = rows.withColumn("_hash", stable_hash(F.lit(str(seed)), F.col(row).cast("string")))
    ranked = rank_within(hashed, key, ["_hash", row], "_rank", "_size")
    dev = (F.col("_size") > rare) & (F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_size") * dev_fraction)))
    return ranked.withColumn("split", F.when(dev, "dev").otherwise("test")).drop("_rank", "_hash", "_size")


def stable_sample(rows: DataFrame, row: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the first in a hashed order."""
    return rows.orderBy(stable_hash(F.lit(str(seed)), F.col(row).cast("string")), row).limit(n)


def supporting_rows(rows: DataFrame, part: str, row: str, polarity: str, limit: int) -> DataFrame:
    """Per part the first positive, the first negative and then others by id, ``limit`` in all."""
    in_kind = F.row_number().over(Window.partitionBy(part, polarity).orderBy(row))
    ranked = rows.withColumn("k", in_kind)
    first = F.when((F.col("k") == 1) & (F.col(polarity) == "positive"), 0).when((F.col("k") == 1) & (F.col(polarity) == "negative"), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(part).orderBy(first, row))
    return ranked.withColumn("place", place.cast("long")).filter(F.col("place") <= limit).drop("k")
