"""Memory cards: what a card is written from, the evidence that may be mined for it, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.memory import addition_violations, append_additions, memory_id, pattern_violations
from evalloom.operators.replies import card_code
from evalloom.operators.transcript import episode_views

# Fields that prompts see, names of evidence tiers, and the sentence that stands above a memory.
GUIDELINE_FIELDS = ("guideline_id", "route", "title", "dividing_line", "criteria", "strength", "support")
LESSON_FIELDS = ("lesson_id", "record_id", "type", "lesson", "evidence", "signal")
BODY_FIELDS = ("title", "summary", "when_to_use", "when_not_to_use", "instructions", "avoid", "tool_guidance", "example_steps")
TRUSTED_TRACE, INFERRED_TRACE = "trusted_feedback_trace", "inferred_training_trace"
BODY = (
    "title string, summary string, when_to_use array<string>, when_not_to_use array<string>, "
    + ", ".join(f"{f} array<struct<text: string, source_criterion_ids: array<string>, source_trace_ids: array<string>>>" for f in BODY_FIELDS[4:])
)
PREAMBLE = "Use this as relevant prior experience. Current system instructions, policies, tool definitions, and observed state take precedence."


def of_fields(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Those of ``fields`` that the rows have, in this order."""
    return rows.select(*[c for c in fields if c in rows.columns])


def trace_views(records: DataFrame, keep: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, trace): views of records as structs that do not name the record."""
    return episode_views(records, keep, drop).select("record_id", F.struct("route", "task_type", "transcript", "runtime").alias("trace"))


def supporting_traces(chosen: DataFrame, records: DataFrame, keep: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Chosen rows (part, record_id, alias) with their record's type, route, trace and feedback."""
    told = records.select("record_id", F.coalesce("task_type", F.lit("")).alias("task_type"), F.coalesce("route", "task_type", F.lit("")).alias("route"), "feedback")
    both = chosen.join(told, "record_id").join(trace_views(records, keep, drop), "record_id")
    return both.select("part", F.col("alias").alias("trace_id"), F.lit(TRUSTED_TRACE).alias("evidence_tier"), "task_type", "route", "trace", F.col("feedback").alias("trusted_feedback"))


def inferred_traces(cases: DataFrame, records: DataFrame, keep: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Inferred cases (case_id, record_id, group_id, route, task_type, confidence, groups, alias) as evidence: their own criteria,
    those of the group ``case``, and their trace."""
    own = F.flatten(F.transform(F.filter("groups", lambda g: g["guideline_id"] == "case"), lambda g: g["criteria"]))
    both = cases.withColumn("case_criteria", own).join(trace_views(records, keep, drop), "record_id")
    return both.select(
        F.col("alias").alias("trace_id"), F.lit(INFERRED_TRACE).alias("evidence_tier"), F.col("case_id").alias("inferred_case_id"), F.col("record_id").alias("source_record_id"),
        F.coalesce("task_type", F.lit("")).alias("task_type"), F.coalesce("route", "task_type", F.lit("")).alias("route"), F.coalesce("group_id", F.lit("")).alias("source_group"),
        F.coalesce("confidence", F.lit(0.0)).alias("rubric_confidence"), "case_criteria", "trace",
    )


def mining_guidelines(guidelines: DataFrame, cards: DataFrame) -> DataFrame:
    """Guidelines with the body of their card as the spine that mining may extend."""
    spine = cards.select("guideline_id", F.struct(*BODY_FIELDS).alias("trusted_memory_spine"))
    return of_fields(guidelines, GUIDELINE_FIELDS).join(spine, "guideline_id")


def rendered(card: Column) -> Column:
    """A card (struct of ``BODY_FIELDS``; items are structs with ``text``) as the text that a model reads."""

    def bullets(items: Column) -> Column:
        return F.transform(items, lambda x: F.concat(F.lit("- "), x))

    def texts(name: str) -> Column:
        return F.transform(card[name], lambda x: x["text"])

    def numbered(items: Column) -> Column:
        return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))

    def section(title: str, lines: Column, always: bool = False) -> Column:
        whole = F.concat(F.array(F.lit(""), F.lit(title)), lines)
        return whole if always else F.when(F.size(lines) > 0, whole).otherwise(F.array().cast("array<string>"))

    head = F.array(F.concat(F.lit("Runtime memory: "), card["title"]), F.lit(PREAMBLE), card["summary"])
    return F.array_join(
        F.concat(
            head, section("Use when:", bullets(card["when_to_use"]), True), section("Do not use when:", bullets(card["when_not_to_use"])),
            section("Procedure:", numbered(texts("instructions")), True), section("Avoid:", bullets(texts("avoid"))),
            section("Tool guidance:", bullets(texts("tool_guidance"))), section("Abstract example:", numbered(texts("example_steps"))),
        ),
        "\n",
    )


def mining_episodes(cases: DataFrame, records: DataFrame, keep: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Inferred cases (as of ``inferred_traces``, with guideline_ids) as episodes that patterns are mined from."""
    applied = cases.select(F.col("alias").alias("trace_id"), F.col("guideline_ids").alias("applicable_guideline_ids"))
    found = inferred_traces(cases, records, keep, drop).join(applied, "trace_id")
    return found.select("trace_id", "inferred_case_id", "source_group", "rubric_confidence", "applicable_guideline_ids", "case_criteria", "trace")


def bound_traces(cases: DataFrame) -> DataFrame:
    """(trace_id, guideline_id): the guidelines that each inferred case's trace may support."""
    return cases.select(F.col("alias").alias("trace_id"), F.explode("guideline_ids").alias("guideline_id"))


def memory_asset(guidelines: DataFrame, replies: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, codes) of recorded replies with memory cards (guideline_id, raw): a card for each included guideline whose reply holds its
    contract, with its text and an id from guideline and body; and the codes of the others. A card may cite its guideline's
    criteria and the traces bound to it."""
    traces = bound.groupBy("guideline_id").agg(F.collect_set("trace_id").alias("trace_ids"))
    known = guidelines.filter("included").select("guideline_id", F.transform("criteria", lambda c: c["criterion_id"]).alias("criterion_ids")).join(traces, "guideline_id", "left")
    none = F.array().cast("array<string>")
    read = known.join(replies, "guideline_id", "left").withColumn("v", F.try_parse_json("raw"))
    code = F.when(F.col("raw").isNull(), "no_reply").otherwise(F.coalesce(card_code(F.col("v"), F.col("criterion_ids"), F.coalesce("trace_ids", none)), F.when(F.col("v").isNull(), F.lit("not_json"))))
    rated = read.withColumn("code", code)
    body = F.from_json(F.to_json(F.try_variant_get("v", "$.memory_card", "variant")), BODY)
    cards = rated.filter("code is null").withColumn("body", body).select(
        memory_id(F.col("guideline_id"), F.to_json("body")).alias("memory_id"), "guideline_id", "body.*", rendered(F.col("body")).alias("text")
    )
    return cards, rated.filter("code is not null").select("guideline_id", "code")


def additive_asset(base: DataFrame, patterns: DataFrame, additions: DataFrame, criteria: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, codes): cards (card_id and arrays of texts) with mined additions that hold their contract appended, and what was wrong with
    the other patterns and additions: (id, code)."""
    odd = pattern_violations(patterns, criteria, bound)
    sound = patterns.join(odd.select("pattern_id").distinct(), "pattern_id", "left_anti")
    wrong = addition_violations(additions, sound)
    kept = additions.join(wrong.select("addition_id").distinct(), "addition_id", "left_anti")
    codes = odd.select(F.col("pattern_id").alias("id"), "code").unionByName(wrong.select(F.col("addition_id").alias("id"), "code"))
    return append_additions(base, kept), codes
