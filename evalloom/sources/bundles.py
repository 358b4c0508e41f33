"""Run bundles: artifacts of a finished evaluation under a manifest that is written last, and their loader.

An artifact is a file or a directory of part files; parts are read, hashed and checked one by one, so that a large run is many
tasks. A bundle is loaded whole or refused: the first broken rule is named, with the artifact where it is one's own.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.ordering import global_row_number
from evalloom.operators.run_checks import SETTLED, identity_issues, sealed_identity, terminal_issues
from evalloom.sources.records import ContractError

# Artifacts of a bundle and fields of its manifest.
MANIFEST = "run_manifest.json"
ARTIFACTS = ("progress.json", "results.jsonl", "run_config.json", "run_identity.json", "summary.md")
FIELDS = (
    "schema_version", "hash_algorithm", "run_id", "status", "run_identity_fingerprint", "ordered_case_ids_fingerprint", "result_count",
    "successful_result_count", "failed_result_count", "artifacts",
)
SHA256 = re.compile(r"sha256:[0-9a-f]{64}")
VERSION = "run-bundle-1"
#: Result rows of a part file.
PART_ROWS = 500_000

RESULT = "case_id string, pos long, execution_status string, raw string"


@dataclass(frozen=True)
class RunBundle:
    """A bundle that holds: its identity and settings (JSON text), results in order, summary lines and progress (one row)."""

    run_id: str
    status: str
    manifest: dict
    config: dict
    identity: str
    results: DataFrame
    summary: DataFrame
    progress: DataFrame


def inventory(spark: SparkSession, path: str) -> dict[str, dict]:
    """Bytes and hash of every artifact: of a file that of its bytes, of a directory that of its parts' hashes in order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    parts = F.split(below, "/")
    each = files.select(F.get(parts, F.lit(0)).alias("artifact"), F.size(parts).alias("depth"), below.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    # A row for each part file, of which a run has one for each PART_ROWS results.
    found = each.groupBy("artifact").agg(F.sum("bytes").alias("bytes"), F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("parts")).collect()
    out = {}
    for r in found:
        digests = [p["sha256"] for p in r["parts"]]
        digest = digests[0] if r["depth"] == 1 else hashlib.sha256("\n".join(digests).encode()).hexdigest()
        out[r["artifact"]] = {"bytes": r["bytes"], "sha256": f"sha256:{digest}"}
    return out


def _strict(text: str, label: str) -> dict:
    def pairs(given: list[tuple]) -> dict:
        out = dict(given)
        if len(out) < len(given):
            raise ContractError(f"{label}: repeats a key")
        return out

    def constant(value: str):
        raise ContractError(f"{label}: holds {value}")

    try:
        found = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except json.JSONDecodeError as broken:
        raise ContractError(f"{label}: is no JSON") from broken
    if not isinstance(found, dict):
        raise ContractError(f"{label}: is no object")
    return found


def _object(spark: SparkSession, path: str, name: str) -> tuple[str, dict]:
    rows = spark.read.text(f"{path}/{name}", wholetext=True).collect()
    text = "".join(r["value"] for r in rows)
    return text, _strict(text, name)


def _checked_manifest(spark: SparkSession, path: str, version: str) -> dict:
    found = inventory(spark, path)
    if set(found) != {*ARTIFACTS, MANIFEST}:
        raise ContractError(f"{path}: the artifacts are {sorted(found)}")
    _, manifest = _object(spark, path, MANIFEST)
    if set(manifest) != set(FIELDS) or manifest["schema_version"] != version or manifest["hash_algorithm"] != "sha256":
        raise ContractError(f"{MANIFEST}: schema")
    if not isinstance(manifest["run_id"], str) or not manifest["run_id"]:
        raise ContractError(f"{MANIFEST}: run_id")
    if manifest["status"] not in SETTLED:
        raise ContractError(f"{MANIFEST}: status")
    listed = manifest["artifacts"]
    if not isinstance(listed, dict) or set(listed) != set(ARTIFACTS):
        raise ContractError(f"{MANIFEST}: artifacts")
    for name in ARTIFACTS:
        record = listed[name]
        size = record.get("bytes") if isinstance(record, dict) and set(record) == {"bytes", "sha256"} else None
        if isinstance(size, bool) or not isinstance(size, int) or size < 0 or not isinstance(record["sha256"], str) or not SHA256.fullmatch(record["sha256"]):
            raise ContractError(f"{MANIFEST}: record of {name}")
        if record != found[name]:
            raise ContractError(f"{name}: does not match the manifest")
    return manifest


def _results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows in the order of part files and lines; the row's JSON stays as text."""
    raw = spark.read.text(f"{path}/results.jsonl").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw")
    )
    numbered = global_row_number(raw, ["file", "start", "at"], "pos")
    value = F.try_parse_json("raw")
    text = lambda name: F.try_variant_get(value, f"$.{name}", "string")
    return numbered.select(text("case_id").alias("case_id"), F.col("pos"), text("execution_status").alias("execution_status"), "raw", value.isNull().alias("broken"))


def load_run_bundle(spark: SparkSession, path: str, dimensions: list[str], version: str = VERSION) -> RunBundle:
    """A bundle whose artifacts, identity, settings, progress and results fit its manifest and each other; raises ``ContractError`` for
    the first rule that is broken."""
    manifest = _checked_manifest(spark, path, version)
    run_id = manifest["run_id"]
    _, config = _object(spark, path, "run_config.json")
    identity_text, identity = _object(spark, path, "run_identity.json")
    progress_text, told = _object(spark, path, "progress.json")
    results = _results(spark, path)
    bad = results.filter(F.col("broken") | F.coalesce(F.col("case_id") == "", F.lit(True))).orderBy("pos").first()
    if bad:
        raise ContractError(f"results.jsonl:{bad['pos']}: no object with a case_id")
    if config.get("run_id") != run_id:
        raise ContractError("run_config.json: run_id")
    if told.get("run_id") != run_id:
        raise ContractError("progress.json: run_id")
    controls = identity.get("always_controls")
    if not isinstance(controls, dict) or not isinstance(controls.get("ordered_case_ids"), list):
        raise ContractError("run_identity.json: always_controls")
    if config.get("dataset_path") != controls.get("dataset_path"):
        raise ContractError("run_config.json: dataset_path")
    one = spark.createDataFrame([(run_id, identity_text, progress_text)], "run_id string, raw string, progress string")
    ids = F.try_variant_get(F.try_parse_json("raw"), "$.always_controls.ordered_case_ids", "array<string>")
    cases = one.select("run_id", F.posexplode(ids).alias("pos", "case_id"))
    broken = identity_issues(one.select("run_id", "raw"), cases, dimensions).first()
    if broken:
        raise ContractError(f"run_identity.json: {broken['code']}")
    p = F.try_parse_json("progress")
    get = lambda name, kind: F.try_variant_get(p, f"$.{name}", kind)
    progress = one.select(
        "run_id", get("status", "string").alias("status"), *[get(c, "long").alias(c) for c in ("total_cases", "completed_cases", "successful_cases")],
        get("attempted_case_ids", "array<string>").alias("attempted"), get("successful_case_ids", "array<string>").alias("successful"),
        get("failed_case_ids", "array<string>").alias("failed"), get("in_flight_case_ids", "array<string>").alias("in_flight"),
    )
    rows = results.select(F.lit(run_id).alias("run_id"), "case_id", "pos", "execution_status")
    broken = terminal_issues(cases, rows, progress).first()
    if broken:
        raise ContractError(f"progress.json: {broken['code']}")
    n, ok = rows.agg(F.count("*"), F.count_if(F.col("execution_status") == "succeeded")).first()
    links = {
        "status": told["status"], "run_identity_fingerprint": identity.get("identity_fingerprint"), "ordered_case_ids_fingerprint": controls.get("ordered_case_ids_fingerprint"),
        "result_count": n, "successful_result_count": ok, "failed_result_count": n - ok,
    }
    for name, want in links.items():
        if manifest[name] != want:
            raise ContractError(f"{MANIFEST}: {name}")
    summary = global_row_number(spark.read.text(f"{path}/summary.md").select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")), ["at"], "line")
    return RunBundle(run_id, manifest["status"], manifest, config, identity_text, results.drop("broken"), summary.select("line", "text"), progress)


def publish_run(path: str, run_id: str, cases: DataFrame, results: DataFrame, config: dict, facts: dict, variants: dict, dimensions: list[str], summary: DataFrame, version: str = VERSION) -> None:
    """Write a finished run below ``path``, the manifest last: without it there is no bundle, and artifacts of a publication that broke off
    are written anew; a manifest that stands is never replaced.

    ``cases`` (case_id, pos) is the dataset in order, ``results`` has case_id, execution_status and what else a result holds, ``summary``
    (section, line, text). ``facts`` are the undeclared dimensions, ``variants`` the declared ones. Identity and progress list a run's
    ids, as their formats ask; results stay rows.
    """
    spark = results.sparkSession
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        raise FileExistsError(f"{path} is published")
    placed = results.join(cases.select("case_id", "pos"), "case_id")
    write = placed.repartitionByRange("pos").sortWithinPartitions("pos").drop("pos")
    write.select(*sorted(write.columns)).write.mode("overwrite").option("maxRecordsPerFile", PART_ROWS).json(f"{path}/results.jsonl")
    ok = F.col("execution_status") == "succeeded"
    ids = lambda of: F.transform(F.array_sort(F.collect_list(of)), lambda x: x["case_id"])
    listed = F.struct("pos", "case_id")
    done = placed.agg(
        F.count("*").alias("completed_cases"), F.count_if(ok).alias("successful_cases"), ids(listed).alias("attempted_case_ids"),
        ids(F.when(ok, listed)).alias("successful_case_ids"), ids(F.when(~ok, listed)).alias("failed_case_ids"),
    )
    from evalloom.functions.scores import run_status
    from evalloom.operators.run_checks import case_fingerprints

    total = cases.count()
    status = F.when(F.col("successful_cases") == 0, "failed").otherwise(run_status(F.lit(total), F.col("successful_cases")))
    progress = done.select(F.lit(run_id).alias("run_id"), status.alias("status"), F.lit(total).alias("total_cases"), "*", F.array().cast("array<string>").alias("in_flight_case_ids"))
    progress.coalesce(1).write.mode("overwrite").json(f"{path}/progress.json")
    prints = case_fingerprints(cases.withColumn("run_id", F.lit(run_id)))
    order = cases.agg(ids(listed).alias("ordered_case_ids"))
    controls = prints.crossJoin(order).select(  # one row each
        F.to_json(
            F.struct(
                "ordered_case_ids", F.col("ordered").alias("ordered_case_ids_fingerprint"), F.col("as_set").alias("case_id_set_fingerprint"), F.lit(config.get("dataset_path")).alias("dataset_path")
            )
        ).alias("c")
    )
    declared = [d for d in dimensions if d in variants]
    left = {d: facts.get(d, {"status": "absent"}) for d in dimensions if d not in variants}
    core = F.concat(
        F.lit(f'{{"schema_version":"1","declared_variant_dimensions":{json.dumps(declared)},"control_dimensions":{json.dumps(left)},"variants":{json.dumps(variants)},"always_controls":'),
        F.col("c"), F.lit("}"),
    )
    controls.select(sealed_identity(core).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/run_identity.json")
    spark.createDataFrame([(json.dumps({**config, "run_id": run_id}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run_config.json")
    summary.repartitionByRange(1, "section", "line").sortWithinPartitions("section", "line").select("text").write.mode("overwrite").text(f"{path}/summary.md")  # aggregates only
    told = _object(spark, path, "progress.json")[1]
    identity = _object(spark, path, "run_identity.json")[1]
    manifest = {
        "schema_version": version, "hash_algorithm": "sha256", "run_id": run_id, "status": told["status"], "run_identity_fingerprint": identity["identity_fingerprint"],
        "ordered_case_ids_fingerprint": identity["always_controls"]["ordered_case_ids_fingerprint"], "result_count": told["completed_cases"],
        "successful_result_count": told["successful_cases"], "failed_result_count": told["completed_cases"] - told["successful_cases"],
        "artifacts": {k: v for k, v in inventory(spark, path).items() if k in ARTIFACTS},
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/{MANIFEST}")
