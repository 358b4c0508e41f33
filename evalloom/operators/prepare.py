"""From feedback and unlabeled records to splits, cases and a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import canonical_json, fingerprint, redact
from evalloom.operators.grouping import SHARES, SHARES_WITH_REGRESSION, connected_groups, greedy_split
from evalloom.operators.ordering import global_row_number
from evalloom.operators.transcript import RECORD
from evalloom.session import checkpoint

# Splits in order, the confidence below which a case is listed, names of trust tiers.
SPLITS = ("train", "validation", "test", "regression")
LOW_CONFIDENCE = 0.5
TRUSTED, INFERRED = "trusted_feedback", "inferred_from_trusted_feedback"
#: Fields that redaction leaves as they are.
IDENTITY = ("record_id", "group_id", "schema_version", "request_id", "task_type", "route")


def redacted(records: DataFrame) -> DataFrame:
    """Records with masked addresses in every text outside the identity fields, nested ones included."""

    def mask(c: Column, kind) -> Column:
        name = kind.typeName()
        if name == "string":
            return redact(c)
        if name == "array":
            return F.transform(c, lambda x: mask(x, kind.elementType))
        if name == "map":
            return F.transform_values(c, lambda _, v: mask(v, kind.valueType))
        if name == "struct":
            return F.when(c.isNotNull(), F.struct(*[mask(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return records.select(*[F.col(f.name) if f.name in IDENTITY else mask(F.col(f.name), f.dataType).alias(f.name) for f in records.schema.fields])


def context_key() -> Column:
    """What the model saw of a record, as one comparable text."""
    return F.to_json(F.struct("conversation_context", "user_input", "tool_calls", "runtime"))


def prepare(feedback: DataFrame, unlabeled: DataFrame, seed: int = 0, regression: bool = False, mask: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) records: kept ones with ``labeled``, ``group_name`` and ``split``.

    Records that share a group or a model-visible context are one group and one split; redaction comes
    first, so it can join groups. Groups with feedback are split by their labeled records, others by
    their size, separately. In the regression split unlabeled records are excluded.
    """
    rows = feedback.withColumn("labeled", F.lit(True)).unionByName(unlabeled.withColumn("labeled", F.lit(False)), allowMissingColumns=True)
    rows = checkpoint(redacted(rows) if mask else rows)
    repeated = rows.groupBy("record_id").agg(F.count_distinct("labeled").alias("n")).filter("n > 1").agg(F.min("record_id")).first()[0]
    if repeated is not None:
        raise ValueError(f"record_id {repeated!r} appears in both the feedback and unlabeled inputs")
    named = rows.join(connected_groups(rows, "record_id", [F.col("group_id"), context_key()]), "record_id")
    weights = named.groupBy("group_name").agg(F.count_if("labeled").alias("l"), F.count("*").alias("n"))
    shares = SHARES_WITH_REGRESSION if regression else SHARES
    told = greedy_split(weights.filter("l > 0").select("group_name", F.col("l").alias("weight")), shares, seed)
    rest = greedy_split(weights.filter("l = 0").select("group_name", F.col("n").alias("weight")), SHARES, seed)
    placed = checkpoint(named.join(told.unionByName(rest), "group_name"))
    out = (F.col("split") == "regression") & ~F.col("labeled")
    return placed.filter(~out), placed.filter(out).select("record_id", F.lit("unlabeled_in_regression_group").alias("reason"))


def number_lessons(lessons: DataFrame) -> DataFrame:
    """Ids L0001, L0002, ... of kept lessons by record and position."""
    kept = global_row_number(lessons.filter("reason is null"), ["record_id", "pos"])
    return kept.withColumn("lesson_id", F.format_string("L%04d", "rn")).drop("rn")


def catalog(guidelines: DataFrame, lessons: DataFrame, least: int = 2, strong: int = 3) -> DataFrame:
    """Guidelines (route, pos, title, criteria as texts, lesson_ids) with ids, support, counts by signal, strength and
    whether they are included."""
    named = global_row_number(guidelines, ["route", "pos"]).withColumn("guideline_id", F.format_string("G%03d", "rn")).drop("rn")
    cited = named.select("guideline_id", F.explode("lesson_ids").alias("lesson_id")).join(lessons.select("lesson_id", "record_id", "signal"), "lesson_id")
    support = cited.groupBy("guideline_id").agg(
        F.count_distinct("record_id").alias("support"), *[F.count_if(F.col("signal") == s).alias(s) for s in ("explicit", "clear", "weak")]
    )
    criteria = F.transform("criteria", lambda c, i: F.struct(F.concat_ws(".c", "guideline_id", (i + 1).cast("string")).alias("criterion_id"), c.alias("statement")))
    full = named.withColumn("criteria", criteria).join(support, "guideline_id", "left").na.fill(0, ["support", "explicit", "clear", "weak"])
    return full.withColumn("strength", F.when(F.col("support") >= strong, "strong").otherwise("emerging")).withColumn("included", F.col("support") >= least)


def set_aside(lessons: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Lessons that no guideline accounts for."""
    return lessons.join(guidelines.select(F.explode("lesson_ids").alias("lesson_id")), "lesson_id", "left_anti")


def rubrics(chosen: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Per record (record_id, guideline_ids, case_criteria, confidence): its criteria groups in the chosen order, then the
    case's own, and where they come from."""
    picked = chosen.select("record_id", F.posexplode("guideline_ids").alias("pos", "guideline_id"))
    group = F.struct("pos", "guideline_id", "title", "criteria")
    found = picked.join(guidelines.select("guideline_id", "title", "criteria"), "guideline_id").groupBy("record_id").agg(F.array_sort(F.collect_list(group)).alias("g"))
    groups = F.transform("g", lambda x: F.struct(x["guideline_id"].alias("guideline_id"), x["title"].alias("title"), x["criteria"].alias("criteria")))
    own = F.transform("case_criteria", lambda c, i: F.struct(F.concat(F.lit("case.c"), i + 1).alias("criterion_id"), c.alias("statement")))
    case = F.struct(F.lit("case").alias("guideline_id"), F.lit("Case-specific criteria").alias("title"), own.alias("criteria"))
    none = F.array().cast(guidelines.select(F.array(F.struct("guideline_id", "title", "criteria"))).schema[0].dataType)
    both = F.concat(F.coalesce(groups, none), F.when(F.size("case_criteria") > 0, F.array(case)).otherwise(none))
    origin = F.when(F.size("guideline_ids") > 0, "guideline_grounded").otherwise("trace_inferred")
    return chosen.join(found, "record_id", "left").select("record_id", "guideline_ids", both.alias("groups"), origin.alias("provenance"), "confidence")


def cases(records: DataFrame, rubric: DataFrame, asset: str) -> tuple[DataFrame, DataFrame]:
    """(cases, excluded): records joined with their rubrics; a record without any criterion cannot be scored."""
    tier = F.when(F.col("labeled"), TRUSTED).otherwise(INFERRED)
    kind = F.when(F.col("labeled"), "feedback").otherwise("inferred")
    both = records.join(rubric, "record_id")
    scored = F.exists("groups", lambda g: F.size(g["criteria"]) > 0)
    out = both.filter(scored).select(
        F.concat_ws("-", kind, "record_id").alias("case_id"), "task_type", "record_id", "group_id", "split", tier.alias("trust_tier"),
        F.lit(asset).alias("dataset_version"), "provenance", "confidence", "guideline_ids", "groups", fingerprint(context_key()).alias("context_fingerprint"),
    )
    return out, both.filter(~scored).select("record_id", F.lit("no_checkable_criteria").alias("reason"))


def review(case_rows: DataFrame) -> DataFrame:
    """Counts of trusted and inferred cases by split."""
    found = case_rows.groupBy("split").pivot("trust_tier", [TRUSTED, INFERRED]).count().na.fill(0)
    return found.select("split", F.col(TRUSTED).alias("trusted"), F.col(INFERRED).alias("inferred"))


def model_context(records: DataFrame) -> DataFrame:
    """(record_id, messages_json, tool_context_json, runtime_json): what a chain replays of each record; keys sorted."""
    message = lambda role, content: F.struct(content.alias("content"), role.alias("role"))
    said = F.transform("conversation_context", lambda m: message(m["role"], m["content"]))
    call = F.transform("tool_calls", lambda c: F.struct(*[c[f].alias(f) for f in ("arguments", "error", "name", "result")]))
    whole = F.concat(said, F.array(message(F.lit("user"), F.col("user_input"))))
    return records.select(
        "record_id", F.to_json(whole).alias("messages_json"), F.to_json(call).alias("tool_context_json"), F.coalesce(canonical_json(F.col("runtime")), F.lit("{}")).alias("runtime_json")
    )


def low_confidence(case_rows: DataFrame, least: float = LOW_CONFIDENCE) -> DataFrame:
    """Cases below a confidence, the lowest first; ties in the order of ids."""
    return case_rows.filter(F.col("confidence") < least).select("case_id", "confidence").orderBy("confidence", "case_id")


def in_split_order(rows: DataFrame, *then: str) -> DataFrame:
    """Rows by split in the fixed order, then by other columns; unknown splits come last."""
    place = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    return rows.orderBy(F.when(place == 0, len(SPLITS) + 1).otherwise(place), *then)


def catalog_summary(guidelines: DataFrame, placed: DataFrame, case_rows: DataFrame) -> DataFrame:
    """One row of counts for a review: guidelines, those included and strong, lessons set aside or beyond repair, and cases whose
    rubric comes from their trace alone. Each table is one aggregate; the rows joined are three."""
    g = guidelines.agg(F.count("*").alias("guidelines"), F.count_if("included").alias("included"), F.count_if(F.col("included") & (F.col("strength") == "strong")).alias("strong"))
    p = placed.agg(F.count_if(F.col("place") == "cannot_fix").alias("cannot_fix_lessons"), F.count_if(F.col("place") == "set_aside").alias("set_aside_lessons"))
    c = case_rows.agg(F.count_if(F.col("provenance") == "trace_inferred").alias("trace_inferred_cases"))
    return g.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(c))


__all__ = ["RECORD", "cases", "catalog", "catalog_summary", "context_key", "in_split_order", "low_confidence", "model_context", "number_lessons", "prepare", "redacted", "review", "rubrics", "set_aside"]
