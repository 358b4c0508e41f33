"""Evidence for memory cards: which cases may support one, and what patterns and additions may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import blank
from evalloom.operators.prepare import INFERRED
from evalloom.operators.validation import first_code

# Kinds of patterns, and the part of a card that each kind is appended to.
TARGETS = {"procedure": "instructions", "avoid": "avoid", "tool_guidance": "tool_guidance", "example": "example_steps"}

PATTERN = "guideline_id string, kind string, text string, source_criterion_ids array<string>, source_trace_ids array<string>, confidence double"
ADDITION = "kind string, text string, source_criterion_ids array<string>, source_trace_ids array<string>, source_pattern_ids array<string>"


def _listed(ids: Column) -> Column:
    """Whether a list of ids is missing, empty, blank somewhere or repeats one."""
    return ids.isNull() | (F.size(ids) == 0) | F.exists(ids, blank) | (F.size(F.array_distinct(ids)) < F.size(ids))


def supporting_cases(cases: DataFrame, guidelines: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, violations): inferred train cases that apply a guideline; ``cases`` as of ``prepare.cases``.

    Cases without a guideline are left out. It is a violation to be no inferred train case, to cite an
    unknown guideline or to have no source trace.
    """
    cited = cases.select("case_id", F.explode("guideline_ids").alias("guideline_id"))
    unknown = cited.join(guidelines.select("guideline_id"), "guideline_id", "left_anti").select("case_id", F.lit("unknown_guideline").alias("code"))
    wrong = cases.filter((F.col("split") != "train") | (F.col("trust_tier") != INFERRED)).select("case_id", F.lit("not_inferred_train").alias("code"))
    lost = cases.join(traces.select("record_id"), "record_id", "left_anti").select("case_id", F.lit("no_source_trace").alias("code"))
    return cases.filter(F.size("guideline_ids") > 0), unknown.unionByName(wrong).unionByName(lost).distinct()


def pattern_violations(patterns: DataFrame, criteria: DataFrame, bound: DataFrame) -> DataFrame:
    """(pattern_id, code): ``patterns`` as ``PATTERN`` with pattern_id, ``criteria`` (guideline_id, criterion_id), ``bound``
    (trace_id, guideline_id). A pattern may cite its guideline's criteria and traces bound to it only."""
    own = first_code(
        ("kind", F.col("kind").isNull() | ~F.col("kind").isin(*TARGETS)),
        ("text", blank(F.col("text"))),
        ("criteria", _listed(F.col("source_criterion_ids"))),
        ("traces", _listed(F.col("source_trace_ids"))),
        ("confidence", F.col("confidence").isNull() | ~F.col("confidence").between(0, 1)),
    )
    found = patterns.select("pattern_id", own.alias("code")).filter("code is not null")
    named = patterns.select("pattern_id", "guideline_id", F.explode("source_criterion_ids").alias("criterion_id"))
    odd = named.join(criteria, ["guideline_id", "criterion_id"], "left_anti").select("pattern_id", F.lit("unknown_criterion").alias("code"))
    seen = patterns.select("pattern_id", "guideline_id", F.explode("source_trace_ids").alias("trace_id"))
    free = seen.join(bound, ["guideline_id", "trace_id"], "left_anti").select("pattern_id", F.lit("unbound_trace").alias("code"))
    return found.unionByName(odd).unionByName(free).distinct()


def addition_violations(additions: DataFrame, patterns: DataFrame) -> DataFrame:
    """(addition_id, code): additions (``ADDITION`` with addition_id) may cite what their patterns cite, must be of their kind
    and say nothing twice."""
    cited = additions.select("addition_id", F.col("kind").alias("k"), F.explode("source_pattern_ids").alias("pattern_id"))
    both = cited.join(patterns.select("pattern_id", "kind", F.col("source_criterion_ids").alias("c"), F.col("source_trace_ids").alias("t")), "pattern_id", "left")
    allowed = both.groupBy("addition_id").agg(
        F.bool_or(F.col("kind").isNull()).alias("unknown"),
        F.bool_or(F.col("kind") != F.col("k")).alias("other"),
        F.flatten(F.collect_list("c")).alias("c"),
        F.flatten(F.collect_list("t")).alias("t"),
    )
    code = first_code(
        ("kind", F.col("kind").isNull() | ~F.col("kind").isin(*TARGETS)),
        ("text", blank(F.col("text"))),
        ("unknown_pattern", F.coalesce("unknown", F.lit(True))),
        ("pattern_kind", F.col("other")),
        ("criteria", _listed(F.col("source_criterion_ids")) | (F.size(F.array_except("source_criterion_ids", "c")) > 0)),
        ("traces", _listed(F.col("source_trace_ids")) | (F.size(F.array_except("source_trace_ids", "t")) > 0)),
    )
    own = additions.join(allowed, "addition_id", "left").select("addition_id", code.alias("code")).filter("code is not null")
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    again = additions.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.max("addition_id").alias("addition_id")).filter("n > 1")
    return own.unionByName(again.select("addition_id", F.lit("duplicate_text").alias("code")))


def append_additions(cards: DataFrame, additions: DataFrame) -> DataFrame:
    """Cards (card_id and an array of texts for each target) with the additions' texts appended to the part of their kind,
    in the order of their ids."""
    item = F.struct("addition_id", "kind", "text")
    found = additions.groupBy("card_id").agg(F.array_sort(F.collect_list(item)).alias("more"))
    both = cards.join(found, "card_id", "left")
    for kind, part in TARGETS.items():
        new = F.transform(F.filter("more", lambda a: a["kind"] == kind), lambda a: a["text"])
        both = both.withColumn(part, F.concat(F.col(part), F.coalesce(new, F.array().cast("array<string>"))))
    return both.drop("more")


def memory_id(guideline_id: Column, body: Column) -> Column:
    return F.concat(F.lit("memory-"), F.substring(F.sha2(F.concat_ws("\x1f", guideline_id, body), 256), 1, 16))
