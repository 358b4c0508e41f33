"""Projections of runs, cases, calls and skills for readers outside the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that a reader may see of a manifest, usage counts, and a placeholder's form.
MANIFEST_FIELDS = (
    "schema_version", "hash_algorithm", "run_id", "status", "run_identity_fingerprint", "ordered_case_ids_fingerprint", "result_count",
    "successful_result_count", "failed_result_count",
)
USAGE_FIELDS = ("input_tokens", "output_tokens", "total_tokens")
PLACEHOLDER_HASH = r"^(.)\1{31,}$"
FRONT_MATTER = r"(?s)\A\x{FEFF}?---\r?\n.*?\r?\n---\r?\n"
COMMENT = r"(?s)\A\s*<!--.*?-->\s*"

_MAP = "map<string, variant>"


def manifest_facts(manifests: DataFrame, raw: str) -> DataFrame:
    """The fields of run manifests (JSON texts) that a reader may see; others are dropped, missing ones null."""
    v = F.try_parse_json(raw)
    return manifests.select(*[F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in MANIFEST_FIELDS])


def case_summaries(results: DataFrame) -> DataFrame:
    """Results (run_id, pos, case_id, task_type, score, calls as an array of structs with ``error``) with their place from 0 and
    how many tool calls they made and lost."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("pos")) - 1
    failed = F.size(F.filter("calls", lambda c: F.coalesce(c["error"], F.lit("")) != ""))
    return results.select("run_id", place.alias("index"), "case_id", "task_type", "score", F.size("calls").alias("total_tool_calls"), failed.alias("failed_tool_calls"))


def case_with_truth(results: DataFrame, cases: DataFrame, run: str, index: int) -> DataFrame:
    """One result of a run by its place, with its case; a case that is not there leaves nulls."""
    chosen = case_summaries(results).filter((F.col("run_id") == run) & (F.col("index") == index))
    return chosen.join(cases.withColumnRenamed("task_type", "case_type"), "case_id", "left")


def run_view(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs (run_id, tenant, status, authority) with their cases' summaries; runs of other tenants are not shown."""
    cases = case_summaries(results).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("index", "case_id", "score", "total_tool_calls", "failed_tool_calls"))).alias("cases"))
    shown = runs.filter(F.col("authority") != "foreign_rejected").join(cases, "run_id", "left")
    return shown.withColumn("cases", F.coalesce("cases", F.array().cast(shown.schema["cases"].dataType)))


def call_indices(calls: DataFrame) -> DataFrame:
    """Calls (case_id, iteration, pos) numbered from 0 within their case."""
    return calls.withColumn("call_index", F.row_number().over(Window.partitionBy("case_id").orderBy("iteration", "pos")) - 1)


def text_entries(values: Column) -> Column:
    """Entries of a variant object whose values are texts."""
    entries = F.try_variant_get(values, "$", _MAP)
    return F.transform_values(F.map_filter(entries, lambda _, v: F.schema_of_variant(v) == "STRING"), lambda _, v: F.try_variant_get(v, "$", "string"))


def objects(values: Column) -> Column:
    """Items of a variant list that are objects, as JSON texts."""
    items = F.try_variant_get(values, "$", "array<variant>")
    return F.transform(F.filter(items, lambda i: F.schema_of_variant(i).startswith("OBJECT")), lambda i: F.to_json(i))


def diagnostics(value: Column) -> Column:
    """A text or a list of scalars as a list of texts; nothing else is one."""
    kind = F.schema_of_variant(value)
    listed = F.filter(F.try_variant_get(value, "$", "array<string>"), lambda x: x.isNotNull())
    return F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))).when(kind.startswith("ARRAY"), listed).otherwise(F.array().cast("array<string>"))


def timing_pairs(value: Column) -> Column:
    """Step timings, a variant list of [name, seconds] or object, as an array of structs; objects in the order of names."""
    pair = lambda n, s: F.struct(n.alias("name"), s.alias("seconds"))
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e: pair(F.try_variant_get(e, "$[0]", "string"), F.try_variant_get(e, "$[1]", "double")))
    named = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string, double>")), lambda e: pair(e["key"], e["value"]))
    return F.coalesce(listed, F.array_sort(named), F.array().cast("array<struct<name: string, seconds: double>>"))


def supporting_facts(titles: Column, sentences: Column) -> Column:
    """Parallel lists as one list of pairs."""
    return F.transform(F.arrays_zip(titles.alias("title"), sentences.alias("sent_id")), lambda p: F.struct(p["title"].alias("title"), p["sent_id"].alias("sent_id")))


def settings(value: Column, defaults: dict[str, str]) -> Column:
    """A variant object of settings as a map: known keys only, defaults where one is missing or null."""
    given = F.try_variant_get(value, "$", "map<string, string>")
    return F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.coalesce(F.try_element_at(given, F.lit(k)), F.lit(v)))])


def call_metadata(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, gaps): known fields of transport metadata (call_id, pos, raw JSON text), and calls whose ordinals do not run 1, 2, ...

    Counts that are no whole number are null; every unknown field is dropped.
    """
    v = F.try_parse_json("raw")
    ordinal = F.try_variant_get(v, "$.transport_ordinal", "long")
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("pos"))
    rows = calls.withColumn("ordinal", F.when(F.schema_of_variant(F.try_variant_get(v, "$.transport_ordinal", "variant")) == "BIGINT", ordinal)).withColumn("place", place)
    gaps = rows.groupBy("call_id").agg(F.bool_or(~F.col("ordinal").eqNullSafe(F.col("place").cast("long"))).alias("gap")).filter("gap").select("call_id")
    fields = [F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in ("response_id", "request_id", "model", "system_fingerprint")]
    counts = [F.try_variant_get(v, f"$.usage.{f}", "long").alias(f) for f in USAGE_FIELDS]
    known = rows.select("call_id", "ordinal", *fields, *counts, F.try_variant_get(v, "$.retry_count", "long").alias("retry_count"))
    return known.join(gaps, "call_id", "left_anti"), gaps


def variants_tried(iterations: DataFrame, tenant: str) -> DataFrame:
    """Sum over each tenant's iterations of ``variants_tried``, a text; what is no number adds nothing."""
    number = F.col("variants_tried").try_cast("double").cast("long")
    return iterations.groupBy(tenant).agg(F.coalesce(F.sum(number), F.lit(0)).alias("variants_tried"))


def repaired_hash(value: Column, seed: Column) -> Column:
    """A hash that is one character 32 times or more is a placeholder: the seed's hash instead."""
    return F.when(value.rlike(PLACEHOLDER_HASH), F.sha2(seed, 256)).otherwise(value)


def without_metadata(text: Column) -> Column:
    """A skill's text without front matter and leading comment, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, FRONT_MATTER, ""), COMMENT, ""), F.lit(" \t\r\n"))


def skill_title(path: Column) -> Column:
    """A title from the directory that holds a skill's file, else from the file's name."""
    parts = F.split(path, "/")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.[^.]*$", ""))
    return F.initcap(F.trim(F.regexp_replace(folder, "[-_]", " ")))


def skills_block(skills: DataFrame, part: str) -> DataFrame:
    """One text per ``part`` of its skills (path, text, pos): a heading and the body of each, in order; empty bodies are left out."""
    section = F.concat(F.lit("### "), skill_title(F.col("path")), F.lit("\n\n"), without_metadata(F.col("text")))
    kept = F.when(without_metadata(F.col("text")) != "", F.struct("pos", section.alias("s")))
    each = skills.groupBy(part).agg(F.array_sort(F.collect_list(kept)).alias("s"))
    return each.select(part, F.array_join(F.transform("s", lambda x: x["s"]), "\n\n").alias("block"))


def system_message(template: Column) -> Column:
    """Text of a prompt template's system part: from the line that opens it to the user's, or to the end."""
    return F.trim(F.regexp_extract(template, r"(?ms)^System:\s*(.+?)(?=^User:|\z)", 1), F.lit(" \t\r\n"))


def pruned(rows: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """Rows whose key is not among the removed ones (a table with the same key column)."""
    return rows.join(removed.select(key), key, "left_anti")
