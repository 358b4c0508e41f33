"""Live progress of runs from a directory of results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalloom.functions.scores import run_status

RESULT = "run_id string, case_id string, ok boolean, score double, ts timestamp"


def results_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESULT).option("maxFilesPerTrigger", max_files).parquet(path)


def progress(results: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Counts and means of every run, each case once. A case that comes again within the watermark is dropped;
    the state of older cases is released."""
    once = results.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["run_id", "case_id"])
    found = once.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("succeeded"),
        F.avg(F.when(F.col("ok"), F.col("score"))).alias("mean_successful"),
    )
    return found.withColumn("status", run_status(F.col("total"), F.col("succeeded")))


def snapshots(results: DataFrame, path: str, checkpoint_dir: str) -> StreamingQuery:
    """Keep one snapshot table of all runs up to date; a batch that is repeated after a failure overwrites its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream = progress(results).writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir)
    return stream.foreachBatch(write).trigger(availableNow=True).start()


def agent_messages(lines: DataFrame) -> DataFrame:
    """Texts of assistant messages in a stream of agent events as JSON lines; other lines are dropped."""
    event = F.from_json("value", "type string, message struct<content: array<struct<type: string, text: string>>>")
    parsed = lines.select(event.alias("e")).filter("e.type = 'assistant'")
    return parsed.select(F.explode("e.message.content").alias("c")).filter("c.type = 'text'").select("c.text")


EVENT = "run_id string, case_id string, kind string, ok boolean, score double, total_cases long, ts timestamp"
#: What an event changes in its run's counters, and the cases by whose events they changed.
DELTA = "run_id string, case_id string, started long, completed long, succeeded long, score double, refused long, total_cases long, marked boolean, broken boolean"
_CASE = "started boolean, done boolean"


def _status(completed: Column, succeeded: Column, total: Column, marked: Column, broken: Column) -> Column:
    whole = (total > 0) & (succeeded == total) & (completed == total)
    return F.when(broken, "failed").when(marked & whole, "completed").when(marked & (succeeded > 0), "degraded").when(marked, "failed").otherwise("running")


def totals(deltas: DataFrame) -> DataFrame:
    """Counters and state of every run: plain sums of its changes, so that they can be made in parts and added again."""
    counted = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("started", "completed", "succeeded", "score", "refused")]
    found = deltas.groupBy("run_id").agg(*counted, F.max("total_cases").alias("total_cases"), F.bool_or("marked").alias("marked"), F.bool_or("broken").alias("broken"))
    return found.select(
        "run_id", F.col("completed").alias("completed_cases"), F.col("succeeded").alias("successful_cases"), (F.col("completed") - F.col("succeeded")).alias("failed_cases"),
        F.try_divide("score", "succeeded").alias("mean_successful"), (F.col("started") - F.col("completed")).alias("in_flight"), F.col("refused").alias("refused_results"),
        _status(F.col("completed"), F.col("succeeded"), F.col("total_cases"), F.col("marked"), F.col("broken")).alias("status"),
    )


def live(events: DataFrame) -> DataFrame:
    """State of every run from a finished table of events (``EVENT``; kind is start, result, completed or failed).

    A case is in flight from its start until its result. Only its first result counts (of equal times the failed one); others are
    refused and counted. A run is running until it is marked: failed by ``failed``, and by ``completed``, whose ``total_cases`` says how many
    cases there are, as its results say. A run is rows of cases, then sums of these; no list of its cases is made.
    """
    result = F.col("kind") == "result"
    first = F.min(F.when(result, F.struct("ts", "ok", "score"))).alias("first")
    case = events.groupBy("run_id", "case_id").agg(
        F.count_if(result).alias("results"), F.bool_or(F.col("kind") == "start").alias("begun"), first, F.max(F.when(F.col("kind") == "completed", F.col("total_cases"))).alias("total_cases"),
        F.bool_or(F.col("kind") == "completed").alias("marked"), F.bool_or(F.col("kind") == "failed").alias("broken"),
    )
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    good = F.col("first.ok")
    return totals(
        case.select(
            "run_id", "case_id", one(F.col("begun") | (F.col("results") > 0)).alias("started"), one(F.col("results") > 0).alias("completed"), one(good).alias("succeeded"),
            F.when(good, F.col("first.score")).alias("score"), F.greatest(F.col("results") - 1, F.lit(0)).alias("refused"), "total_cases", "marked", "broken",
        )
    )


def _advance(horizon_ms: int):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The changes that new events of one case make; what is kept of a case is whether it began and whether it is done."""
        if state.hasTimedOut:
            state.remove()
            return
        begun, done = state.get if state.exists else (False, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "ok"], kind="stable")
        out = {"started": 0, "completed": 0, "succeeded": 0, "score": 0.0, "refused": 0, "total_cases": None, "marked": False, "broken": False}
        for kind, ok, score, total in zip(rows["kind"], rows["ok"], rows["score"], rows["total_cases"], strict=True):
            if kind in ("start", "result") and not begun:
                begun, out["started"] = True, 1
            if kind == "result" and done:
                out["refused"] += 1
            elif kind == "result":
                done, out["completed"] = True, 1
                if ok:
                    out["succeeded"], out["score"] = 1, float(score)
            elif kind == "completed":
                out["marked"], out["total_cases"] = True, None if pd.isna(total) else int(total)
            elif kind == "failed":
                out["broken"] = True
        state.update((bool(begun), bool(done)))
        last = max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last + horizon_ms)
        yield pd.DataFrame({"run_id": [key[0]], "case_id": [key[1]], **{k: pd.Series([v], dtype="Int64" if k == "total_cases" else None) for k, v in out.items()}})

    return advance


def changes(events: DataFrame, watermark: str = "1 hour", horizon_ms: int = 86_400_000) -> DataFrame:
    """What a stream of events changes (``DELTA``): one small state for each run and case, dealt over tasks by both, released by a timer once
    the watermark has passed the case's last event by ``horizon_ms``. A result that comes again before that is refused."""
    kept = events.withWatermark("ts", watermark).groupBy("run_id", "case_id")
    return kept.applyInPandasWithState(_advance(horizon_ms), DELTA, _CASE, "append", GroupStateTimeout.EventTimeTimeout)


def follow(events: DataFrame, path: str, checkpoint_dir: str, watermark: str = "1 hour", horizon_ms: int = 86_400_000) -> StreamingQuery:
    """Keep the changes of all runs below ``path``: one row for each run and micro-batch in ``totals``, and the refused results in ``refused``. A
    micro-batch that is repeated after a failure replaces its own files. ``followed`` reads them."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        summed = batch.groupBy("run_id").agg(
            *[F.sum(c).alias(c) for c in ("started", "completed", "succeeded", "score", "refused")], F.max("total_cases").alias("total_cases"),
            F.bool_or("marked").alias("marked"), F.bool_or("broken").alias("broken"),
        )
        summed.write.mode("overwrite").parquet(f"{path}/totals/epoch={epoch}")
        batch.filter("refused > 0").select("run_id", "case_id", "refused").write.mode("overwrite").parquet(f"{path}/refused/epoch={epoch}")
        batch.unpersist()

    stream = changes(events, watermark, horizon_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint_dir)
    return stream.foreachBatch(write).trigger(availableNow=True).start()


def followed(spark: SparkSession, path: str) -> DataFrame:
    """State of every run that ``follow`` keeps."""
    return totals(spark.read.parquet(f"{path}/totals"))
