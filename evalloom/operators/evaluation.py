"""An evaluation run from cases to bundle, in batches that commit one by one, so that it can be stopped and started again.

A batch of cases is one job that runs the chain and writes the outcomes of all repeats; its directory is marked once Spark has
committed it. A run that goes on joins out the batches that are marked and makes only the others. Inputs are frozen when the run
starts: another dataset or other settings under the same path are refused. The bundle is published when no batch is left.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import reports, run_checks
from evalloom.operators.calls import OUTCOME, Chain, run_chain
from evalloom.operators.flows import SCORERS
from evalloom.operators.ordering import batches
from evalloom.functions import scores
from evalloom.session import checkpoint, forget
from evalloom.sources import bundles
from evalloom.sources.sinks import freeze


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches below ``path`` that are complete."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/batch-*/_SUCCESS")
    marks = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(int(m.getPath().getParent().getName().removeprefix("batch-")) for m in marks or [])


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of all complete batches, with their repeat."""
    done = [f"{path}/outcomes/batch-{b:06d}" for b in committed(spark, f"{path}/outcomes")]
    schema = f"{OUTCOME}, repeat int"
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def scored(cases: DataFrame, found: DataFrame, scorer: str) -> DataFrame:
    """Results by case: the mean score over the repeats, a failed repeat as 0; a case succeeded if one of its repeats did. Outputs and
    timings are those of the first repeat that succeeded, else of the first."""
    score = SCORERS[scorer](scores.final_output(F.col("output_text"), F.col("step_outputs")), F.col("expected"))
    ok = F.col("execution_status") == "succeeded"
    each = found.join(cases.select("case_id", "expected"), "case_id").withColumn("score", F.when(ok, score))
    shown = F.min_by(F.struct("output_text", "step_outputs", "step_timings", "error_name"), F.struct(~ok, "repeat"))
    by_case = each.groupBy("case_id").agg(F.count_if(ok).alias("good"), (F.sum(F.when(ok, F.col("score")).otherwise(0.0)) / F.count("*")).alias("score"), shown.alias("s"))
    status = F.when(F.col("good") > 0, "succeeded").otherwise("failed")
    return by_case.select(
        "case_id", status.alias("execution_status"), F.when(F.col("good") > 0, F.col("score")).otherwise(0.0).alias("composite_score"),
        F.when(F.col("good") == 0, run_checks.exception_category(F.col("s.error_name"))).alias("error_category"),
        F.create_map(F.lit(scorer), F.when(F.col("good") > 0, F.col("score")).otherwise(0.0)).alias("score_breakdown"), "s.output_text", "s.step_outputs", "s.step_timings",
    )


def run_evaluation(
    cases: DataFrame, path: str, run_id: str, chain: Chain, scorer: str, config: dict, dimensions: list[str], variants: dict | None = None,
    batch_size: int = 100_000, repeats: int = 1, most_batches: int | None = None,
) -> bundles.RunBundle | None:
    """The bundle of a run of ``chain`` over ``cases`` (case_id, pos, context, expected), with every case ``repeats`` times.

    Called again with the same inputs and settings it goes on where it stopped, and loads a bundle that stands. With ``most_batches`` it
    stops after so many new ones and gives None, as an interrupted run would. Duplicate or blank case ids are refused.
    """
    spark = cases.sparkSession
    blank, n, distinct = cases.agg(F.count_if(F.coalesce("case_id", F.lit("")) == ""), F.count("*"), F.count_distinct("case_id")).first()
    if blank or distinct < n:
        raise ValueError("case ids must be there and differ")
    settings = json.dumps({"config": config, "scorer": scorer, "repeats": repeats, "batch_size": batch_size, "run_id": run_id}, sort_keys=True)
    freeze({"cases": cases}, settings, path)
    target = f"{path}/bundle"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{bundles.MANIFEST}")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        dealt = checkpoint(batches(cases, ["pos", "case_id"], batch_size))
        done = set(committed(spark, f"{path}/outcomes"))
        left = [b for b in range(-(-n // batch_size)) if b not in done]
        for made, b in enumerate(left):
            if most_batches is not None and made >= most_batches:
                forget(dealt)
                return None
            mine = dealt.filter(F.col("batch") == b).select("case_id", "context").repartition(spark.sparkContext.defaultParallelism)
            rows = None
            for r in range(repeats):
                one = run_chain(mine, chain).withColumn("repeat", F.lit(r))
                rows = one if rows is None else rows.unionByName(one)
            # A batch whose write broke off has no mark and is made again as a whole.
            rows.write.mode("overwrite").parquet(f"{path}/outcomes/batch-{b:06d}")
        forget(dealt)
        results = checkpoint(scored(cases, outcomes(spark, path), scorer))
        told = results.join(cases.select("case_id", "pos"), "case_id").select(
            "case_id", "pos", (F.col("execution_status") == "succeeded").alias("ok"), F.col("composite_score").alias("score"), F.col("score_breakdown").alias("breakdown"),
            F.col("step_timings").alias("timings"), F.lit(None).cast("string").alias("tier"),
        )
        bundles.publish_run(target, run_id, cases.select("case_id", "pos"), results, config, {}, variants or {}, dimensions, reports.summary_lines(told))
        forget(results)
    return bundles.load_run_bundle(spark, target, dimensions)
