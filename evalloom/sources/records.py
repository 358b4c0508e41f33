"""Sources: JSON lines with a contract, authenticated run bundles and directory scans."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.ordering import rank_within
from evalloom.operators.prepare import redacted
from evalloom.operators.validation import raw_record_code
from evalloom.session import ship_package
from evalloom.sources.archives import archived_passages

CASE = (
    "case_id string, task_type string, context map<string,string>, expected string, metadata string, "
    "messages_template map<string,string>, prompt_template_path string"
)
REQUIRED = ("case_id", "task_type", "context", "expected", "metadata")


class ContractError(ValueError):
    """A row that breaks its contract: where, and how."""


def lines(spark: SparkSession, path: str, unicode_breaks: bool = False) -> DataFrame:
    """(path, line, value) of every line that is not blank.

    Lines end at ``\\n`` alone; with ``unicode_breaks`` also at the other separators that end lines in
    text. Files are read in splits; lines are numbered by their split's start and their place in it, so
    no task holds a file.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    breaks = "\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
    parts = F.split(F.regexp_replace("value", "\\r$", ""), breaks) if unicode_breaks else F.array("value")
    each = placed.select("path", "_split", "_at", F.posexplode(parts).alias("_part", "value"))
    numbered = rank_within(each, "path", ["_split", "_at", "_part"], "line")
    return numbered.select("path", F.col("line").cast("int").alias("line"), "value").filter(F.trim("value") != "")


def case_violations(rows: DataFrame) -> DataFrame:
    """(path, line, code) of lines that are no JSON object, lack a key or repeat a case id."""
    v = F.try_parse_json("value")
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(keys, F.array().cast("array<string>")))
    case_id = F.try_variant_get(v, "$.case_id", "string")
    code = (
        F.when(v.isNull() | keys.isNull(), "not_an_object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_"), F.get(missing, F.lit(0))))
        .when(case_id.isNull() | (F.trim(case_id) == ""), "blank_case_id")
    )
    rated = rows.select("path", "line", code.alias("code"), case_id.alias("case_id"))
    firsts = rated.filter("code is null").groupBy("case_id").agg(F.count("*").alias("n"), F.max(F.struct("path", "line")).alias("last"))
    repeated = firsts.filter("n > 1").select("last.path", "last.line", F.lit("duplicate_case_id").alias("code"))
    return rated.filter("code is not null").select("path", "line", "code").unionByName(repeated)


def fail_on(violations: DataFrame) -> None:
    """Raise for the first violation by file and line."""
    first = violations.orderBy("path", "line").first()
    if first:
        raise ContractError(f"{first['path']}:{first['line']}: {first['code']}")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; raises for the first line that breaks the contract. Open objects stay JSON text."""
    rows = lines(spark, path, unicode_breaks=True)
    fail_on(case_violations(rows))
    return rows.select("line", F.from_json("value", CASE).alias("c")).select("line", "c.*")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines of a known schema: a malformed row, a repeated key or a number that JSON does not know fails the job."""
    rows = spark.read.text(path).filter(F.trim("value") != "").filter(F.parse_json("value").isNotNull())
    read = F.from_json("value", schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"})
    return rows.select(read.alias("o")).select("o.*")


def load_input(spark: SparkSession, path: str, schema: str, labeled: bool, version: str) -> DataFrame:
    """Input records with a contract for their raw text (``operators.validation.raw_record_code``); raises for the first line
    that breaks it or repeats a record id."""
    rows = lines(spark, path, unicode_breaks=True)
    rated = rows.withColumn("code", raw_record_code(F.col("value"), labeled, version)).withColumn("record_id", F.get_json_object("value", "$.record_id"))
    again = rated.groupBy("record_id").agg(F.count("*").alias("n"), F.max(F.struct("path", "line")).alias("last")).filter("n > 1")
    broken = rated.filter("code is not null").select("path", "line", "code")
    fail_on(broken.unionByName(again.select("last.path", "last.line", F.lit("duplicate_record_id").alias("code"))))
    return rows.select("line", F.from_json("value", schema).alias("o")).select("line", "o.*")


def source_asset(spark: SparkSession, path: str, input_schema: str, lesson_schema: str, guideline_schema: str, mask: bool = True) -> dict[str, DataFrame]:
    """Tables of a finished asset directory: ``records`` (feedback and unlabeled inputs with split and ``labeled``, redacted) and
    ``guidelines`` (included ones with the records of their trusted lessons and the lessons' mean confidence).

    An asset without a manifest is unfinished and refused, and so is a guideline whose lessons are not all there.
    """
    if spark.read.text(f"{path}/manifest.json").isEmpty():
        raise ContractError(f"{path}: no manifest")
    inputs = read_objects(spark, f"{path}/inputs/feedback.jsonl", input_schema).withColumn("labeled", F.lit(True))
    if not _files(spark, f"{path}/inputs", "unlabeled.jsonl").isEmpty():
        inputs = inputs.unionByName(read_objects(spark, f"{path}/inputs/unlabeled.jsonl", input_schema).withColumn("labeled", F.lit(False)))
    splits = read_objects(spark, f"{path}/splits.jsonl", "record_id string, split string")
    lessons = read_objects(spark, f"{path}/lessons.jsonl", lesson_schema)
    catalog = spark.read.text(f"{path}/catalog.json", wholetext=True)
    guidelines = catalog.select(F.inline(F.from_json("value", f"guidelines array<struct<{guideline_schema}>>")["guidelines"])).filter("included")
    cited = guidelines.select("guideline_id", F.explode_outer("lesson_ids").alias("lesson_id")).join(lessons, "lesson_id", "left")
    found = cited.groupBy("guideline_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("source") == "feedback", F.col("record_id")))).alias("source_record_ids"),
        F.round(F.avg("confidence"), 4).alias("confidence"), F.bool_or(F.col("record_id").isNull()).alias("lost"),
    )
    lost = found.filter("lost").orderBy("guideline_id").first()
    if lost:
        raise ContractError(f"{path}: guideline {lost['guideline_id']} has no lessons")
    records = inputs.join(splits, "record_id", "left")
    return {"records": redacted(records) if mask else records, "guidelines": guidelines.join(found.drop("lost"), "guideline_id")}


def passages(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """(title, passage) of archives (tar, bz2-compressed or not) of JSON-lines files, themselves compressed or not: the title and
    the first paragraph longer than ``least`` characters, with single spaces. Archives are streamed member by member, one
    task each; lines that do not parse, and documents without such a paragraph, are left out."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(partial(archived_passages, least=least), "title string, passage string")


def bundle_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files in a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bundle_mismatches(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest lacks, misses or describes otherwise; none for an authentic bundle."""
    other = manifest.select("name", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha256"))
    both = inventory.join(other, "name", "full_outer")
    same = F.col("bytes").eqNullSafe(F.col("m_bytes")) & F.col("sha256").eqNullSafe(F.col("m_sha256"))
    return both.filter(~same).select("name")


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, rows) of the JSON-lines files below a directory."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count_if(F.trim("value") != "").alias("rows"))


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fields that older snapshots lack get their defaults."""
    return rows.select("*", *[v.alias(k) for k, v in defaults.items() if k not in rows.columns]).withColumns(
        {k: F.coalesce(k, v) for k, v in defaults.items() if k in rows.columns}
    )


def _files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(directory, name, bytes) of the files below a directory; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    return files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("directory"), F.element_at(parts, -1).alias("name"), F.col("length").alias("bytes"))


def run_directories(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("progress.json", "run_config.json", "results.jsonl")) -> DataFrame:
    """Directories that hold any of the wanted files, and which of them they hold."""
    has = [F.bool_or(F.col("name") == w).alias(w.split(".")[0]) for w in wanted]
    return _files(spark, path).filter(F.col("name").isin(*wanted)).groupBy("directory").agg(*has)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Markdown assets with the group that their directory names."""
    found = _files(spark, path, "*.md")
    return found.select(F.element_at(F.split("directory", "/"), -1).alias("group"), "name", "bytes")
