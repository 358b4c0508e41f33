"""Sinks: JSON lines, split datasets, append-only ledgers and bundles whose manifest comes last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.sources.records import bundle_inventory


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines with sorted keys; Spark's commit makes them visible at once."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One directory per split and trust tier, so readers of one split touch no other."""
    df.repartition("split", "trust_tier").write.mode("errorifexists").partitionBy("split", "trust_tier").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append to a ledger, with the time in UTC."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    df.withColumn("created_at", stamp).write.mode("append").json(path)


def reserve(spark, path: str, run_id: str) -> None:
    """Claim an output directory for a run; a second claim fails, whoever makes it."""
    spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("errorifexists").json(f"{path}/reservation")


def freeze(inputs: dict[str, DataFrame], settings: str, path: str) -> DataFrame:
    """Settings and the fingerprints of all input tables, stored once: a later call with others fails.

    A table's fingerprint is the sum of its rows' hashes, so it depends on the rows alone, not on their order or files.
    """
    spark = next(iter(inputs.values())).sparkSession
    now = None
    for name, df in sorted(inputs.items()):
        row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(20,0)")
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("hash")).withColumn("name", F.lit(name))
        now = one if now is None else now.unionByName(one)
    now = now.withColumn("settings", F.lit(settings)).select("name", "rows", "hash", "settings")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/frozen")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        now.coalesce(1).write.mode("errorifexists").parquet(f"{path}/frozen")
    stored = spark.read.schema(now.schema).parquet(f"{path}/frozen")
    if not (stored.exceptAll(now).isEmpty() and now.exceptAll(stored).isEmpty()):
        raise ValueError(f"{path} was started with other settings or inputs")
    return stored


def append_calls(calls: DataFrame, path: str) -> None:
    """Append one usage row for each model call: step, cache_key, model, tokens, and what was rejected."""
    append_events(calls.select("step", "cache_key", "model", "input_tokens", "output_tokens", "rejected"), path)


def publish_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write all tables, then the manifest with counts and hashes; readers ask for the manifest first."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")
        files = bundle_inventory(spark, f"{path}/{name}").filter(F.col("name").startswith("part-"))
        manifest = files if manifest is None else manifest.unionByName(files)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")
