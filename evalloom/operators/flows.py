"""Whole flows over recorded replies and outputs: an evaluation run, an evaluation asset, a comparison. The search is ``optimize``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import scores
from evalloom.functions.text import fingerprint, normalize_answer
from evalloom.operators import prepare, replies, run_checks, runs, transcript
from evalloom.operators.evidence import guideline_support
from evalloom.operators.validation import check_lessons, held_out_lessons
from evalloom.session import checkpoint

#: Scorers by name: functions of the output and the expected text that give a score from 0 to 100.
SCORERS = {
    "exact": lambda output, expected: scores.exact_match(normalize_answer(output), normalize_answer(expected)),
    "identifier": lambda output, expected: scores.identifier_score(output, expected)[0],
}


@dataclass(frozen=True)
class Run:
    """Tables of an evaluation: results by case, progress, and the identity's fingerprints."""

    results: DataFrame
    progress: DataFrame
    identity: DataFrame


def evaluate(cases: DataFrame, outputs: DataFrame, run_id: str, scorer: str) -> Run:
    """Score recorded outputs (``calls.OUTCOME``) of cases (case_id, pos, expected) with a scorer of ``SCORERS``.

    Failed cases have no score and count as 0 in ``mean_failed_zero``; the progress is that of the finished run.
    """
    score: Column = SCORERS[scorer](scores.final_output(F.col("output_text"), F.col("step_outputs")), F.col("expected"))
    ok = F.col("execution_status") == "succeeded"
    category = F.when(~ok, run_checks.exception_category(F.col("error_name")))
    joined = cases.join(outputs, "case_id").withColumn("run_id", F.lit(run_id))
    results = joined.select("run_id", "case_id", "pos", "execution_status", category.alias("error_category"), F.when(ok, score).alias("score"), "output_text", "step_outputs", "step_timings")
    progress = runs.progress(results, "run_id", ok, F.col("score"))
    identity = run_checks.case_fingerprints(cases.withColumn("run_id", F.lit(run_id))).withColumn("scorer", fingerprint(F.lit(scorer)))
    return Run(results, progress, identity)


@dataclass(frozen=True)
class Asset:
    """Tables of an evaluation asset."""

    records: DataFrame
    excluded: DataFrame
    lessons: DataFrame
    dropped: DataFrame
    guidelines: DataFrame
    placed: DataFrame
    cases: DataFrame
    review: DataFrame


def build_asset(
    feedback: DataFrame, unlabeled: DataFrame, observed: DataFrame, synthesised: DataFrame, rubrics: DataFrame, asset: str, seed: int = 0, min_confidence: float = 0.5, least: int = 2
) -> Asset:
    """From records and recorded replies to cases: splits, lessons of train records, guidelines, rubrics, cases and a review.

    ``observed`` are checked-out lessons of replies (record_id, pos and ``validation.LESSON``), ``synthesised`` replies by route (route,
    raw), ``rubrics`` what was chosen for each record (record_id, guideline_ids, case_criteria, confidence). A lesson from a
    record outside train is an error.
    """
    records, excluded = prepare.prepare(feedback, unlabeled, seed)
    records = checkpoint(records)
    values = F.transform(transcript.transcript(), lambda e: F.coalesce(e["content"], e["result"], e["error"], F.lit("")))
    told = records.filter("split = 'train'").select(
        "record_id", "route", "labeled", values.alias("trace_values"), F.array(F.coalesce(F.col("feedback.rationale"), F.lit(""))).alias("feedback_values")
    )
    checked = check_lessons(observed.join(told, "record_id"), min_confidence)
    if not held_out_lessons(observed.select(F.col("pos").alias("lesson_id"), "record_id"), records).isEmpty():
        raise ValueError("a lesson came from a held-out record")
    lessons = checkpoint(prepare.number_lessons(checked).withColumn("source", F.when(F.col("labeled"), "feedback").otherwise("trace")))
    guidelines, placed, codes = replies.synthesis(lessons.select("route", "lesson_id"), synthesised)
    broken = codes.orderBy("route", "code").first()
    if broken:
        raise ValueError(f"{broken['route']}: {broken['code']}")
    statements = guidelines.withColumn("criteria", F.transform("criteria", lambda c: c["statement"]))
    catalog = checkpoint(prepare.catalog(statements, lessons, least))
    rated = prepare.rubrics(rubrics, catalog.filter("included"))
    cases, unscored = prepare.cases(records, rated, asset)
    return Asset(
        records, excluded.unionByName(unscored), lessons, checked.filter("reason is not null").select("record_id", "pos", "reason"), catalog, placed, cases, prepare.review(cases)
    )


def support(lessons: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Distinct records behind each guideline, from its lessons."""
    cited = guidelines.select("guideline_id", F.explode("lesson_ids").alias("lesson_id"))
    return guideline_support(cited.join(lessons.select("lesson_id", "record_id"), "lesson_id"), "guideline_id", "record_id")


def compare(baseline: Run, candidate: Run, issues: DataFrame, allow_uncontrolled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(comparison, extremes) of two runs whose checks found nothing; with issues (code) only if ``allow_uncontrolled`` says so."""
    first = issues.orderBy("code").first()
    if first and not allow_uncontrolled:
        raise ValueError(f"runs cannot be compared: {first['code']}")
    score = F.coalesce("score", F.lit(0.0))
    changes = runs.case_changes(baseline.results.select("case_id", score.alias("score")), candidate.results.select("case_id", score.alias("score")), "case_id")
    return runs.comparison(changes), runs.extremes(changes, "case_id")
