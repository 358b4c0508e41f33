"""State of a candidate search, replayed from its ledger: entries, plateaus, selection, and what the next round sees.

The ledger is a table of iterations (iteration, candidate_id, parent_id, level, accepted, reason, technique,
train_score, selection_score, train_delta and an array ``alternatives`` of the same fields). Rounds themselves are driven
from outside; every decision in a round is a query over tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import clip, stable_hash
from evalloom.operators.search import acceptance, pareto_frontier

# What an entry carries, and settings that belong to one evaluation only.
ENTRY = ("candidate_id", "parent_id", "level", "technique", "train_score", "selection_score", "train_delta", "reason")
PER_EVALUATION = ("dataset", "output_dir", "run_id")
LICENSE = r"(?s)\A\s*<!--.*?-->[ \t]*\n?"


def entries(ledger: DataFrame) -> DataFrame:
    """One row for each candidate that an iteration tried: the chosen one first (``place`` 0), then its alternatives. An
    iteration without a candidate counts only if a role failed."""
    own = F.struct(*ENTRY)
    chosen = F.when(F.col("candidate_id").isNotNull() | (F.col("reason") == "role_error"), F.array(own)).otherwise(F.array().cast(ledger.select(F.array(own)).schema[0].dataType))
    rest = F.transform(F.coalesce("alternatives", F.array().cast(ledger.schema["alternatives"].dataType)), lambda a: F.struct(*[a[c].alias(c) for c in ENTRY]))
    return ledger.select("iteration", "accepted", F.posexplode(F.concat(chosen, rest)).alias("place", "e")).select("iteration", "accepted", "place", "e.*")


def misses(ledger: DataFrame) -> DataFrame:
    """(level, misses, techniques): iterations since the last accepted one that tried each level, each once, and their
    techniques in order. One aggregate finds the last acceptance; nothing is replayed row by row."""
    last = ledger.agg(F.coalesce(F.max(F.when(F.col("accepted"), F.col("iteration"))), F.lit(-1)).alias("last"))  # one row
    tried = entries(ledger).crossJoin(F.broadcast(last)).filter(F.col("iteration") > F.col("last")).filter("level is not null")
    said = F.array_sort(F.collect_list(F.when(F.col("technique").isNotNull(), F.struct("iteration", "place", "technique"))))
    return tried.groupBy("level").agg(F.count_distinct("iteration").alias("misses"), F.transform(said, lambda x: x["technique"]).alias("techniques"))


def history(ledger: DataFrame, most: int = 20) -> DataFrame:
    """The last ``most`` entries, oldest first."""
    return entries(ledger).orderBy(F.desc("iteration"), F.desc("place")).limit(most).orderBy("iteration", "place")


def screen(candidates: DataFrame, least: float = 0.0) -> DataFrame:
    """Candidates (iteration, candidate_id, train_score, parent_score) with their train gain, whether they pass the screen, and
    which one of an iteration is looked at further: the best on train of those that pass, else of all; the first of equals."""
    gained = candidates.withColumn("train_delta", F.col("train_score") - F.col("parent_score"))
    passed = gained.withColumn("passed", F.coalesce(F.col("train_delta") >= least, F.lit(False)))
    order = Window.partitionBy("iteration").orderBy(F.desc("passed"), F.desc_nulls_last("train_score"), "candidate_id")
    placed = passed.withColumn("chosen", F.row_number().over(order) == 1)
    reason = F.when(~F.col("passed"), "train_screen").when(~F.col("chosen"), "not_selected")
    return placed.withColumn("reason", reason)


def decide(screened: DataFrame, tests: DataFrame, least: float, confidence: float, tiebreak: bool = True) -> DataFrame:
    """Chosen candidates that passed the screen with the decision of the paired test: ``tests`` has candidate_id, val_delta, val_p,
    train_p; without a validation split (null) the train gain decides."""
    both = screened.filter("chosen and passed").join(tests, "candidate_id")
    delta, p = F.coalesce("val_delta", "train_delta"), F.when(F.col("val_delta").isNull(), F.col("train_p")).otherwise(F.col("val_p"))
    tie = F.when(F.lit(tiebreak) & F.col("val_delta").isNotNull(), F.col("train_delta")).otherwise(0.0)
    reason = acceptance(delta, p, tie, F.col("train_p"), least, confidence)
    return both.withColumn("reason", reason).withColumn("accepted", F.col("reason") != "selection_below_threshold")


def ranked(pool: DataFrame) -> DataFrame:
    """Pool members (candidate_id, pos, selection_score, train_score) by rank: the selection score, then the train score; the
    earliest of equals is first."""
    order = [F.desc("selection_score"), F.desc("train_score"), F.col("pos")]
    return pool.orderBy(*order)


def best(pool: DataFrame) -> DataFrame:
    """The member of the highest rank; one row, by one aggregate."""
    return pool.agg(F.max_by("candidate_id", F.struct("selection_score", "train_score", -F.col("pos"))).alias("candidate_id"))


def final_selection(pool: DataFrame, fresh: DataFrame, finalists: int) -> DataFrame:
    """(candidate_id, selection_score, fresh_score, chosen): the ``finalists`` of highest rank; the one with the best score of a fresh
    evaluation (candidate_id, fresh_score) is chosen, its rank breaking ties."""
    top = ranked(pool).limit(finalists).join(fresh, "candidate_id", "left")
    rank = F.struct("fresh_score", "selection_score", "train_score", -F.col("pos"))
    winner = top.agg(F.max_by("candidate_id", rank).alias("winner"))  # one row
    return top.crossJoin(F.broadcast(winner)).select("candidate_id", "selection_score", "fresh_score", (F.col("candidate_id") == F.col("winner")).alias("chosen"))


def parent(scores: DataFrame, pool: DataFrame, iteration: int) -> DataFrame:
    """The parent of the next round: a member of the Pareto frontier, drawn by a hash of the round with weights of one for each case
    on which it reaches the top while not all are equal; without votes the best member."""
    frontier = pareto_frontier(scores, "candidate_id", "case_id", "score")
    w = Window.partitionBy("case_id")
    rated = scores.withColumn("hi", F.max("score").over(w)).withColumn("lo", F.min("score").over(w)).filter("hi > lo and score = hi")
    votes = frontier.join(rated.groupBy("candidate_id").agg(F.count("*").alias("votes")), "candidate_id").join(pool.select("candidate_id", "pos"), "candidate_id")
    running = votes.withColumn("upto", F.sum("votes").over(Window.orderBy("pos")))  # a frontier is a handful of members
    total = votes.agg(F.sum("votes").alias("total"))
    draw = F.pmod(F.conv(F.substring(stable_hash(F.lit("parent"), F.lit(str(iteration))), 1, 12), 16, 10).cast("long"), F.col("total"))
    drawn = running.crossJoin(F.broadcast(total)).filter(F.col("upto") > draw).agg(F.min_by("candidate_id", "pos").alias("drawn"))
    return drawn.crossJoin(best(pool)).select(F.coalesce("drawn", "candidate_id").alias("candidate_id"))


def shown_failures(results: DataFrame, iteration: int, most: int, threshold: float) -> DataFrame:
    """At most ``most`` failing results of a round, drawn by a hash of round and case, worst first."""
    failing = results.filter((F.col("execution_status") == "failed") | (F.col("score") < threshold))
    order = stable_hash(F.lit(f"c{iteration:03d}"), F.col("case_id").cast("string"))
    return failing.orderBy(order, "case_id").limit(most).orderBy("score", "case_id")


def case_views(results: DataFrame, cases: DataFrame, limit: int = 1_500, diagnostics: int = 5, short: int = 500) -> DataFrame:
    """Results with their cases, every text clipped: context and step outputs as maps, the first diagnostics."""

    def clipped(name: str) -> Column:
        return F.transform_values(name, lambda _, v: clip(v, limit)).alias(name)

    both = results.join(cases, "case_id")
    said = F.transform(F.slice("diagnostics", 1, diagnostics), lambda d: clip(d, short))
    return both.select("case_id", "score", clipped("context"), clipped("expected"), clip(F.col("output"), limit).alias("output"), clipped("step_outputs"), said.alias("diagnostics"))


def training_overview(results: DataFrame, cases: DataFrame, threshold: float, most: int, limit: int = 300) -> DataFrame:
    """(case_id, context, expected, passed) of every training case, clipped; nothing where there are more than ``most``."""
    n = results.agg(F.count("*").alias("n"))  # one row
    passed = (F.col("execution_status") != "failed") & (F.col("score") >= threshold)
    rows = results.join(cases, "case_id").crossJoin(F.broadcast(n)).filter(F.col("n") <= most)
    texts = [F.transform_values(c, lambda _, v: clip(v, limit)).alias(c) for c in ("context", "expected")]
    return rows.select("case_id", *texts, passed.alias("passed"))


def restored(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """(candidate_id, case_id, score): mean scores of each candidate's cases over the repeats of its evaluation (``ledger``: candidate_id
    and an array of run ids; ``results``: run_id, case_id, execution_status, score). A failed case counts as 0."""
    runs = ledger.select("candidate_id", F.size("runs").alias("n"), F.explode("runs").alias("run_id"))
    score = F.when(F.col("execution_status") == "failed", 0.0).otherwise(F.col("score"))
    return runs.join(results, "run_id").groupBy("candidate_id", "case_id").agg((F.sum(score) / F.first("n")).alias("score"))


def changes(base: Column, other: Column) -> Column:
    """Settings of ``other`` (map of path to value) that differ from those of ``base``; null and absent are equal."""
    return F.map_filter(other, lambda k, v: ~v.eqNullSafe(F.try_element_at(base, k)))


def candidate_config(config: Column) -> Column:
    """A configuration (map) without what belongs to one evaluation."""
    return F.map_filter(config, lambda k, _: ~k.isin(*PER_EVALUATION))


def header(text: Column) -> Column:
    """Leading licence comment of a prompt, with two line ends; empty if there is none."""
    found = F.regexp_extract(text, LICENSE, 0)
    return F.when(found != "", F.concat(F.trim(found, F.lit(" \t\r\n")), F.lit("\n\n"))).otherwise("")


def body(text: Column) -> Column:
    return F.when(header(text) != "", F.regexp_replace(F.regexp_replace(text, LICENSE, ""), r"\A\n+", "")).otherwise(text)


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens by role; counts that are no number add nothing."""
    number = lambda c: F.coalesce(F.sum(F.col(c).try_cast("long")), F.lit(0))
    return calls.groupBy("role").agg(F.count("*").alias("calls"), number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"))
