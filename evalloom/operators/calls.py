"""Model calls as tables: requests, recorded attempts, and what is still to be asked.

Calls themselves are made outside; here a request is a row, its key follows from what is asked, and a recorded reply is
accepted by the first attempt that holds its contract.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import perf_counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import fingerprint
from evalloom.operators.ordering import rank_within
from evalloom.session import ship_package


def cache_key(model: Column, prompt: Column, payload: Column) -> Column:
    """Key of a request: the same for the same model, prompt and payload (JSON text with sorted keys)."""
    return fingerprint(F.concat_ws("\x1f", model, prompt, payload))


def accepted(attempts: DataFrame, code: Column, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(replies, rejected) of recorded attempts (cache_key, attempt, raw): the first of at most ``most`` whose ``code``, a column over
    ``raw``, is null; and the attempts before it, with their codes, as the errors that a next request would carry. A key
    without a sound attempt is in ``rejected`` only."""
    rated = attempts.filter(F.col("attempt") <= most).withColumn("code", code)
    first = rated.filter("code is null").groupBy("cache_key").agg(F.min("attempt").alias("won"))
    both = rated.join(first, "cache_key", "left")
    replies = both.filter("attempt = won").select("cache_key", "attempt", "raw")
    return replies, both.filter("code is not null and (won is null or attempt < won)").select("cache_key", "attempt", "code")


def memoised(requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, open) requests by ``cache_key``: those that a reply answers, with its text, and one of each key still to be asked."""
    answered = requests.join(replies.select("cache_key", "raw"), "cache_key")
    left = requests.join(replies.select("cache_key"), "cache_key", "left_anti")
    return answered, left.dropDuplicates(["cache_key"])


def previous_errors(requests: DataFrame, rejected: DataFrame) -> DataFrame:
    """Requests with the codes of their rejected attempts in order."""
    said = rejected.groupBy("cache_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "code"))), lambda x: x["code"]).alias("previous_errors"))
    return requests.join(said, "cache_key", "left").withColumn("previous_errors", F.coalesce("previous_errors", F.array().cast("array<string>")))


def call_log(requests: DataFrame, attempts: DataFrame, rejected: DataFrame) -> DataFrame:
    """One usage row for each recorded attempt: step, cache_key, model, tokens, and the code for which it was rejected."""
    told = attempts.select("cache_key", "attempt", "input_tokens", "output_tokens").join(rejected.withColumnRenamed("code", "rejected"), ["cache_key", "attempt"], "left")
    return told.join(requests.select("cache_key", "step", "model").dropDuplicates(["cache_key"]), "cache_key").na.fill(0, ["input_tokens", "output_tokens"])


Chain = Callable[[dict], Iterator[tuple[str, str]]]
OUTCOME = (
    "case_id string, execution_status string, error_name string, output_text string, "
    "step_outputs array<struct<name: string, output: string>>, step_timings array<struct<name: string, seconds: double>>"
)


def run_chain(cases: DataFrame, chain: Chain) -> DataFrame:
    """Cases (case_id, context as a map) through a chain, a function that yields (step, output) in order: ``OUTCOME`` of each.

    A case that raises is a failed row with the exception's name, never a failed task; what it had yielded stays. Cases
    are taken batch by batch where they are, so a lost executor runs its cases again and no others.
    """
    ship_package(cases.sparkSession)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for case_id, context in zip(batch["case_id"], batch["context"], strict=True):
                outputs, timings, error, before = [], [], None, perf_counter()
                try:
                    for name, output in chain(dict(context or {})):
                        now = perf_counter()
                        outputs.append({"name": name, "output": output})
                        timings.append({"name": name, "seconds": now - before})
                        before = now
                except Exception as raised:  # noqa: BLE001 - any fault of a chain is its case's
                    error = type(raised).__name__
                rows.append((case_id, "failed" if error else "succeeded", error, outputs[-1]["output"] if outputs else None, outputs, timings))
            yield pd.DataFrame(rows, columns=["case_id", "execution_status", "error_name", "output_text", "step_outputs", "step_timings"])

    return cases.select(F.col("case_id").cast("string").alias("case_id"), "context").mapInPandas(evaluate, OUTCOME)


def in_chunks(rows: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """``chunk`` of each row in its part, from 0, and ``seen``: how many rows of the part the chunks up to this one hold. A fold over
    chunks asks with one chunk and is answered for all that were seen."""
    ranked = rank_within(rows, part, [order], "_n", "_total")
    chunk = F.floor((F.col("_n") - 1) / size).cast("int")
    return ranked.withColumn("chunk", chunk).withColumn("seen", F.least((F.col("chunk") + 1) * size, F.col("_total"))).drop("_n", "_total")
