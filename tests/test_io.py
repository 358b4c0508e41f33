"""Sources, sinks and the progress stream."""

import json

import pytest
from pyspark.sql import functions as F

from evalloom.sources import records, sinks
from evalloom.streaming import progress

GOOD = {"case_id": "c1", "task_type": "t", "context": {"q": "x y"}, "expected": {"answer": 1}, "metadata": {}}


def write(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_cases(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", GOOD, "", {**GOOD, "case_id": "c2"})
    rows = records.load_cases(spark, path).orderBy("line").collect()
    assert [(r["line"], r["case_id"]) for r in rows] == [(1, "c1"), (3, "c2")]
    assert rows[0]["expected"] == '{"answer":1}'


@pytest.mark.parametrize(
    ("bad", "code"),
    [("{", "not_an_object"), ({"case_id": "z"}, "missing_task_type"), ({**GOOD, "case_id": " "}, "blank_case_id"), (GOOD, "duplicate_case_id")],
)
def test_first_violation_is_named(spark, tmp_path, bad, code):
    path = write(tmp_path / "a.jsonl", GOOD, bad)
    with pytest.raises(records.ContractError, match=f":2: {code}"):
        records.load_cases(spark, path)


def test_two_ways_to_end_a_line(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"a": "x y"}')
    assert records.lines(spark, path).count() == 1
    assert records.lines(spark, path, unicode_breaks=True).count() == 2


def test_bundle(spark, tmp_path):
    path = str(tmp_path / "bundle")
    manifest = sinks.publish_bundle({"results": spark.range(3), "summary": spark.range(1)}, path)
    found = records.bundle_inventory(spark, path).filter(F.col("name").startswith("part-") & ~F.col("name").endswith(".crc"))
    kept = found.join(manifest.select("name"), "name", "left_semi")
    assert manifest.count() >= 2 and records.bundle_mismatches(kept, manifest).count() == 0
    changed = manifest.withColumn("sha256", F.lit("0"))
    assert records.bundle_mismatches(kept, changed).count() == manifest.count()


def test_split_sink_and_listing(spark, tmp_path):
    df = spark.createDataFrame([("train", "trusted", 1), ("test", "trusted", 2), ("train", "inferred", 3)], "split string, trust_tier string, x int")
    sinks.write_splits(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).filter("split = 'train'").count() == 2
    write(tmp_path / "d.jsonl", GOOD, "", GOOD)
    listed = records.datasets(spark, str(tmp_path)).collect()
    assert [(r["rows"], r["bytes"] > 10) for r in listed] == [(2, True)]
    sinks.append_events(spark.range(2), str(tmp_path / "log"))
    sinks.append_events(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).filter("created_at is not null").count() == 3


def test_progress_stream(spark, tmp_path):
    rows = [("r1", "c1", True, 80.0), ("r1", "c2", False, 0.0), ("r2", "c1", True, 50.0), ("r1", "c1", True, 80.0)]
    df = spark.createDataFrame(rows, "run_id string, case_id string, ok boolean, score double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    stream = progress.progress(progress.results_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("progress_test").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {r["run_id"]: (r["total"], r["succeeded"], r["mean_successful"], r["status"]) for r in spark.table("progress_test").collect()}
    assert got == {"r1": (2, 1, 80.0, "degraded"), "r2": (1, 1, 50.0, "completed")}


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("r1", "c1", True, 80.0)], "run_id string, case_id string, ok boolean, score double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    progress.snapshots(progress.results_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("status = 'completed'").count() >= 1


def test_agent_messages(spark):
    lines = [json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use"}]}}), "noise", '{"type": "system"}']
    got = progress.agent_messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["text"] for r in got.collect()] == ["hi"]


def test_directory_listings(spark, tmp_path):
    for name in ("a/progress.json", "a/results.jsonl", "b/run_config.json", "b/sub/x.md", "other/y.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    got = {r["directory"].rsplit("/", 1)[1]: (r["progress"], r["run_config"], r["results"]) for r in records.run_directories(spark, str(tmp_path)).collect()}
    assert got == {"a": (True, False, True), "b": (False, True, False)}
    assert [tuple(r) for r in records.prompts(spark, str(tmp_path)).collect()] == [("sub", "x.md", 2)]
