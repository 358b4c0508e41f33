"""Run bundles: every broken rule is named; an evaluation that stops halfway gives the same bundle as one in one go."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from evalloom.operators.evaluation import committed, run_evaluation
from evalloom.sources.bundles import MANIFEST, load_run_bundle
from evalloom.sources.records import ContractError

DIMENSIONS = ["model", "prompt", "skills"]


def make_chain():
    """A function of its own scope, which workers get by value."""

    def chain(context):
        if context["q"] == "boom":
            raise TimeoutError("late")
        yield "first", context["q"]
        yield "answer", context["q"].upper()

    return chain


def run(spark, path, n=23, **more):
    rows = [(f"case-{i:03d}", i, {"q": "boom" if i % 7 == 3 else f"w{i}"}, f"W{i}" if i % 2 else "other") for i in range(n)]
    cases = spark.createDataFrame(rows, "case_id string, pos long, context map<string, string>, expected string").repartition(3)
    settings = {"config": {"dataset_path": "cases.jsonl", "tenant": "t"}, "dimensions": DIMENSIONS, "variants": {"model": {"name": "m"}}, "batch_size": 5} | more
    return run_evaluation(cases, str(path), "run-1", make_chain(), "exact", **settings)


def content(bundle):
    """What a bundle says, without the seconds that its steps took."""
    rows = []
    for r in bundle.results.orderBy("pos").collect():
        raw = json.loads(r["raw"])
        raw.pop("step_timings")
        rows.append((r["pos"], raw))
    lines = [r["text"] for r in bundle.summary.orderBy("line").collect() if not r["text"].startswith("| ")]
    return rows, bundle.identity, bundle.status, lines, bundle.progress.collect()


def test_a_run_that_stops_gives_the_same_bundle(spark, tmp_path):
    whole = run(spark, tmp_path / "whole")
    assert whole.status == "degraded" and whole.results.count() == 23 and whole.manifest["failed_result_count"] == 3
    rows = content(whole)[0]
    assert [r["case_id"] for _, r in rows] == [f"case-{i:03d}" for i in range(23)]
    assert rows[1][1]["composite_score"] == 100.0 and rows[2][1]["composite_score"] == 0.0 and rows[3][1]["error_category"] == "timeout"
    path = tmp_path / "cut"
    assert run(spark, path, most_batches=2) is None
    assert committed(spark, f"{path}/outcomes") == [0, 1]
    # The third batch broke off while it was written.
    (path / "outcomes" / "batch-000002" / "_temporary").mkdir(parents=True)
    times = {p.name: p.stat().st_mtime_ns for p in (path / "outcomes" / "batch-000000").iterdir()}
    assert run(spark, path, most_batches=1) is None
    assert content(run(spark, path)) == content(whole)
    assert times == {p.name: p.stat().st_mtime_ns for p in (path / "outcomes" / "batch-000000").iterdir()}
    # A publication that broke off before its manifest is made again.
    shutil.rmtree(path / "bundle" / MANIFEST)
    assert content(run(spark, path)) == content(whole)
    with pytest.raises(ValueError, match="other settings or inputs"):
        run(spark, path, n=22)
    repeated = run(spark, tmp_path / "twice", n=4, repeats=2)
    assert [r["composite_score"] for _, r in content(repeated)[0]] == [0.0, 100.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def sound(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sound")
    run(spark, path, n=9)
    return path / "bundle"


def resealed(bundle, change=None):
    """The manifest after a change, so that the hashes fit and the rules behind them are reached."""
    place = next((bundle / MANIFEST).glob("part-*"))
    manifest = json.loads(place.read_text())
    for name in manifest["artifacts"]:
        parts = sorted((bundle / name).glob("part-*"))
        digests = [hashlib.sha256(p.read_bytes()).hexdigest() for p in parts]
        manifest["artifacts"][name] = {"bytes": sum(p.stat().st_size for p in parts), "sha256": "sha256:" + hashlib.sha256("\n".join(digests).encode()).hexdigest()}
    if change:
        change(manifest)
    place.write_text(json.dumps(manifest))


def edited(bundle, name, change):
    for place in sorted((bundle / name).glob("part-*")):
        text = place.read_text()
        if text:
            place.write_text(change(text))
            break


def object_edit(**values):
    return lambda text: json.dumps({**json.loads(text), **values}) + "\n"


RULES = {
    "missing artifact": (lambda b: shutil.rmtree(b / "summary.md"), None, "the artifacts are"),
    "extra artifact": (lambda b: (b / "more.txt").write_text("x"), None, "the artifacts are"),
    "no manifest": (lambda b: shutil.rmtree(b / MANIFEST), None, "the artifacts are"),
    "changed summary": (lambda b: edited(b, "summary.md", lambda t: t + "more\n"), "keep", "summary.md: does not match"),
    "changed results": (lambda b: edited(b, "results.jsonl", lambda t: t.replace("succeeded", "failed", 1)), "keep", "results.jsonl: does not match"),
    "manifest field": (lambda b: None, lambda m: m.update(extra=1), "schema"),
    "manifest version": (lambda b: None, lambda m: m.update(schema_version="0"), "schema"),
    "manifest status": (lambda b: None, lambda m: m.update(status="running"), "run_manifest.json: status"),
    "manifest record": (lambda b: None, lambda m: m["artifacts"]["summary.md"].update(bytes=True), "record of summary.md"),
    "manifest count": (lambda b: None, lambda m: m.update(result_count=8), "run_manifest.json: result_count"),
    "config run": (lambda b: edited(b, "run_config.json", object_edit(run_id="other")), None, "run_config.json: run_id"),
    "config dataset": (lambda b: edited(b, "run_config.json", object_edit(dataset_path="other")), None, "run_config.json: dataset_path"),
    "config repeats a key": (lambda b: edited(b, "run_config.json", lambda t: t.replace("{", '{"tenant": 1, ', 1)), None, "run_config.json: repeats a key"),
    "progress run": (lambda b: edited(b, "progress.json", object_edit(run_id="other")), None, "progress.json: run_id"),
    "progress status": (lambda b: edited(b, "progress.json", object_edit(status="completed")), lambda m: m.update(status="completed"), "progress.json: status"),
    "progress ids": (lambda b: edited(b, "progress.json", object_edit(attempted_case_ids=[])), None, "progress.json: attempted_ids"),
    "progress in flight": (lambda b: edited(b, "progress.json", object_edit(in_flight_case_ids=["case-001"])), None, "progress.json: in_flight"),
    "identity": (lambda b: edited(b, "run_identity.json", lambda t: t.replace('"name":"m"', '"name":"n"')), None, "run_identity.json: identity_fingerprint"),
    "identity cases": (lambda b: edited(b, "run_identity.json", lambda t: t.replace('"case-001",', "", 1)), None, "run_identity.json: ordered_case_ids"),
    "results no object": (lambda b: edited(b, "results.jsonl", lambda t: "[]\n" + t), None, "results.jsonl:1"),
    "result twice": (lambda b: edited(b, "results.jsonl", lambda t: t.splitlines(True)[0] + t), None, "progress.json: duplicate_results"),
    "result elsewhere": (lambda b: edited(b, "results.jsonl", lambda t: t.replace('"case_id":"case-000"', '"case_id":"x"')), None, "progress.json: result_outside_dataset"),
}


@pytest.mark.parametrize("name", RULES)
def test_a_broken_bundle_is_refused(spark, tmp_path, sound, name):
    spoil, manifest, message = RULES[name]
    bundle = tmp_path / "bundle"
    shutil.copytree(sound, bundle, ignore=shutil.ignore_patterns("*.crc"))
    spoil(bundle)
    if manifest != "keep" and (bundle / MANIFEST).exists() and (bundle / "summary.md").exists():
        resealed(bundle, manifest)
    with pytest.raises(ContractError, match=message):
        load_run_bundle(spark, str(bundle), DIMENSIONS)


def test_a_sound_bundle_loads(spark, sound):
    bundle = load_run_bundle(spark, str(sound), DIMENSIONS)
    assert (bundle.run_id, bundle.status, bundle.config["tenant"]) == ("run-1", "degraded", "t")
    assert bundle.results.filter(F.col("execution_status") == "failed").count() == 1
