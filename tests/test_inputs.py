"""Input contracts on raw text, archives, source assets, reservations and frozen inputs."""

import bz2
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from evalloom.operators import validation
from evalloom.sources import records, sinks

GOOD = {
    "schema_version": "v1", "record_id": "r1", "group_id": "g", "task_type": "t", "user_input": "u", "conversation_context": [], "tool_calls": [], "runtime": {}, "metadata": {},
    "assistant_output": "a", "feedback": {"polarity": "positive"},
}


def without(*names, **changes):
    return {k: v for k, v in (GOOD | changes).items() if k not in names}


@pytest.mark.parametrize(
    ("row", "code"),
    [
        (GOOD, None), (without("runtime"), "missing_field"), (without(schema_version="v2"), "schema_version"), (without(user_input=" "), "blank_user_input"), (without(route=None), "route"),
        (without(request_id=""), "request_id"), (without(assistant_output=1), "assistant_output"), (without("assistant_output"), "no_assistant_output"), (without("feedback"), "no_feedback"),
        (without(runtime=[]), "runtime"), (without(metadata="x"), "metadata"), (without(tool_calls={}), "tool_calls"),
        (without(episode={"events": [{"type": "tool_result", "call_id": "c"}]}), "empty_result"), (without(episode={"events": [{"type": "tool_result", "call_id": "c", "result": None}]}), None),
        ("[1]", "not_an_object"), ('{"record_id": 1, "record_id": 2}', "not_an_object"),
    ],
)
def test_raw_record_rules(spark, row, code):
    raw = row if isinstance(row, str) else json.dumps(row)
    assert spark.createDataFrame([(raw,)], "raw string").select(validation.raw_record_code(F.col("raw"), True, "v1")).first()[0] == code


def test_unlabeled_records_have_no_feedback(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),), (json.dumps(without("feedback", "assistant_output")),)], "raw string")
    assert [r[0] for r in df.select(validation.raw_record_code(F.col("raw"), False, "v1")).collect()] == ["unexpected_feedback", None]
    assert validation.protected_rows(df, "raw", ("polarity",)).count() == 1


def test_load_input(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text(json.dumps(GOOD) + "\n\n" + json.dumps(without(record_id="r2")) + "\n")
    got = records.load_input(spark, str(path), "record_id string, user_input string", True, "v1").orderBy("line").collect()
    assert [tuple(r) for r in got] == [(1, "r1", "u"), (3, "r2", "u")]
    path.write_text(json.dumps(GOOD) + "\n" + json.dumps(GOOD) + "\n")
    with pytest.raises(records.ContractError, match=":2: duplicate_record_id"):
        records.load_input(spark, str(path), "record_id string", True, "v1")


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\r\n" if i % 3 else "\r\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for breaks in (False, True):
            got = records.lines(spark, str(path), breaks).select("line", F.trim(F.regexp_replace("value", "\r", "")).alias("v")).collect()
            assert sorted((r["line"], r["v"]) for r in got if r["v"]) == [(i, f"line {i}") for i in range(1, 3001) if i % 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_objects(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in records.read_objects(spark, str(path), "a int").collect()) == [1, 2]
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "{"):
        path.write_text(bad + "\n")
        with pytest.raises(Exception):  # noqa: B017 - Spark's own errors
            records.read_objects(spark, str(path), "a int").collect()


def test_passages_of_archives(spark, tmp_path):
    long = "a paragraph that is certainly longer than fifty characters, \t it is"
    docs = [{"title": " T ", "text": ["short", ["joined", long]]}, {"title": "", "text": [long]}, {"title": "none", "text": ["short"]}, [1]]
    body = "\n".join(map(json.dumps, docs)).encode() + b"\nnot json\n"
    with tarfile.open(tmp_path / "x.tar.bz2", "w:bz2") as tar:
        for name, data in (("a.bz2", bz2.compress(body)), ("b", body)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = [tuple(r) for r in records.passages(spark, str(tmp_path / "x.tar.bz2")).collect()]
    plain = " ".join(long.split())
    assert sorted(got) == sorted([("T", f"T. joined {plain}"), ("", plain)] * 2)


def test_source_asset(spark, tmp_path):
    root = tmp_path / "asset"
    (root / "inputs").mkdir(parents=True)

    def put(name, *rows):
        (root / name).write_text("\n".join(map(json.dumps, rows)) + "\n")

    put("inputs/feedback.jsonl", {"record_id": "r1", "text": "mail a@b.co"}, {"record_id": "r2", "text": "x"})
    put("inputs/unlabeled.jsonl", {"record_id": "r3", "text": "y"})
    put("splits.jsonl", {"record_id": "r1", "split": "train"}, {"record_id": "r3", "split": "test"})
    put("lessons.jsonl", {"lesson_id": "L1", "record_id": "r1", "source": "feedback", "confidence": 0.5}, {"lesson_id": "L2", "record_id": "r3", "source": "trace", "confidence": 0.8})
    put("catalog.json", {"guidelines": [{"guideline_id": "G1", "included": True, "lesson_ids": ["L1", "L2"]}, {"guideline_id": "G2", "included": False, "lesson_ids": []}]})
    put("manifest.json", {"version": 1})
    schemas = ("record_id string, text string", "lesson_id string, record_id string, source string, confidence double", "guideline_id: string, included: boolean, lesson_ids: array<string>")
    got = records.source_asset(spark, str(root), *schemas)
    assert sorted((r["record_id"], r["text"], r["labeled"], r["split"]) for r in got["records"].collect()) == [("r1", "mail <email>", True, "train"), ("r2", "x", True, None), ("r3", "y", False, "test")]
    (g,) = got["guidelines"].collect()
    assert (g["source_record_ids"], g["confidence"]) == (["r1"], 0.65)
    put("lessons.jsonl", {"lesson_id": "L1", "record_id": "r1", "source": "feedback", "confidence": 0.5})
    with pytest.raises(records.ContractError, match="G1"):
        records.source_asset(spark, str(root), *schemas)


def test_reservation_and_frozen_inputs(spark, tmp_path):
    sinks.reserve(spark, str(tmp_path / "run"), "r1")
    with pytest.raises(Exception):  # noqa: B017 - the path exists
        sinks.reserve(spark, str(tmp_path / "run"), "r2")
    rows = spark.range(10).withColumn("x", F.lit("a"))
    sinks.freeze({"feedback": rows}, "s", str(tmp_path / "asset"))
    assert sinks.freeze({"feedback": rows.repartition(3)}, "s", str(tmp_path / "asset")).count() == 1
    for inputs, settings in (({"feedback": rows.limit(9)}, "s"), ({"feedback": rows}, "t")):
        with pytest.raises(ValueError):
            sinks.freeze(inputs, settings, str(tmp_path / "asset"))
    usage = spark.createDataFrame([("s", "k", "m", 1, 2, None)], "step string, cache_key string, model string, input_tokens int, output_tokens int, rejected string")
    sinks.append_calls(usage, str(tmp_path / "calls"))
    assert spark.read.json(str(tmp_path / "calls")).filter("created_at is not null").count() == 1


def test_parameter_values(spark):
    def code(text, *args, **kwargs):
        return spark.range(1).select(validation.parameter_value_code(F.parse_json(F.lit(text)), *args, **kwargs)).first()[0]

    assert [code("true", "bool"), code("1", "bool")] == [None, "not_bool"]
    assert [code('"a"', "choice", choices=("a",)), code('"b"', "choice", choices=("a",))] == [None, "not_a_choice"]
    assert [code("5", "int", 1, 9), code("5.5", "int"), code("true", "float"), code("0", "int", 1, 9), code("10", "float", 1, 9)] == [None, "not_int", "not_numeric", "below_minimum", "above_maximum"]
