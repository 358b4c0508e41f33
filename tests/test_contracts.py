"""Contracts, preparation of records and the review of prompts."""

import pytest
from pyspark.sql import functions as F

from evalloom.operators import prepare, review, transcript, validation

FEEDBACK = "feedback struct<polarity string, signals array<struct<kind string, check_id string, passed boolean>>>"


def record(i, group=None, text=None, labeled=True, **change):
    base = {
        "record_id": f"r{i:03}", "group_id": group or f"g{i:03}", "task_type": "t", "user_input": text or f"ask {i}", "conversation_context": [("user", "x")],
        "tool_calls": [("add", "{}", None, None)], "runtime": "{}", "assistant_output": "out", "events": None, "feedback": ("positive", []) if labeled else None,
    } | change
    return tuple(base.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, f"{transcript.RECORD}, {FEEDBACK}")


def event(seq, kind, **x):
    return (seq, kind, x.get("role"), x.get("content"), x.get("call_id"), x.get("name"), x.get("arguments"), x.get("result"), x.get("error"))


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({}, None),
        ({"user_input": " "}, "blank_user_input"),
        ({"conversation_context": [("user", "")]}, "context_message"),
        ({"tool_calls": [("", "{}", None, None)]}, "tool_call"),
        ({"feedback": ("good", [])}, "polarity"),
        ({"feedback": ("mixed", [("odd", "c", True)])}, "correctness_signal"),
        ({"feedback": None}, "no_feedback"),
        ({"events": []}, "no_events"),
        ({"events": [event(2, "message", role="user", content="a"), event(2, "message", role="user", content="b")]}, "sequence_not_increasing"),
        ({"events": [event(1, "tool_result", call_id="c", result="1")]}, "result_without_call"),
        ({"events": [event(1, "tool_call", call_id="c", name="f"), event(2, "tool_result", call_id="c", error="e"), event(3, "tool_result", call_id="c", result="1")]}, "second_result"),
        ({"events": [event(1, "tool_call", call_id="c", name="f"), event(2, "tool_result", call_id="c", result="1")]}, None),
    ],
)
def test_record_contract(spark, change, code):
    found = validation.record_violations(frame(spark, [record(1, **change)]), labeled=True).collect()
    assert [r["code"] for r in found] == ([code] if code else [])


def test_repeated_ids_and_unexpected_feedback(spark):
    twice = frame(spark, [record(1), record(1)])
    assert [r["code"] for r in validation.record_violations(twice, True).collect()] == ["duplicate_record_id"]
    assert [r["code"] for r in validation.record_violations(frame(spark, [record(1)]), False).collect()] == ["unexpected_feedback"]
    raw = spark.createDataFrame([('{"record_id": null, "schema_version": 1}',)], "raw string")
    assert len(raw.select(validation.missing_fields("raw")).first()[0]) == len(validation.REQUIRED_FIELDS) - 2


def test_quotes(spark):
    cases = [("The  QUICK fox", True), ("quick ... jumps over", True), ("jumps ... quick", False), ("quick", False), ("the quick ... ju", False), ("“lazy dog now”", True)]
    values = F.array(F.lit("the quick fox jumps over"), F.lit("a lazy dog now"))
    got = spark.range(1).select(*[validation.quote_found(F.lit(q), values).alias(f"q{i}") for i, (q, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_lessons(spark):
    told, seen = ["it never checked the order"], ["order 7 was cancelled at once"]

    def lesson(signal="explicit", confidence=0.9, knowable=True, source="feedback", text="never checked", kind="failure"):
        return ("r1", 0, kind, "look first", signal, confidence, knowable, [(source, text)], told, seen)

    rows = [lesson(), lesson(source="trace", text="cancelled at once"), lesson(knowable=None), lesson(confidence=0.1), lesson(text="made up quote"), lesson(kind="odd"), lesson(confidence=1.5)]
    df = spark.createDataFrame([(*r[:1], i, *r[2:]) for i, r in enumerate(rows)], f"record_id string, pos int, {validation.LESSON}, feedback_values array<string>, trace_values array<string>")
    got = validation.check_lessons(df).orderBy("pos")
    assert [r["reason"] for r in got.collect()] == [None, None, "needs_hindsight", "low_confidence", "unverified_evidence", "malformed", "malformed"]
    assert [r["signal"] for r in got.limit(2).collect()] == ["explicit", "clear"]
    assert [r["lesson_id"] for r in prepare.number_lessons(got).orderBy("lesson_id").collect()] == ["L0001", "L0002"]


def test_scores(spark):
    rows = [("50", {"a": "120"}, None), ("101", {}, "out_of_range"), ("x", {}, "not_numeric"), ("NaN", {}, "not_finite"), ("1", {"a": "-1"}, "out_of_range"), ("1", {"": "1"}, "unnamed_part"), ("1", None, "no_breakdown")]
    df = spark.createDataFrame(rows, "score string, parts map<string,string>, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", validation.score_code(F.col("score"), F.col("parts"))).collect())


@pytest.mark.parametrize(("regression", "want"), [(False, {"train": 12, "validation": 4, "test": 4}), (True, {"train": 12, "validation": 4, "test": 4, "regression": 5})])
def test_prepare_meets_its_targets(spark, regression, want):
    feedback = frame(spark, [record(i) for i in range(sum(want.values()))])
    # Five unlabeled records share groups with feedback and do not count for the balance.
    unlabeled = frame(spark, [record(100 + i, group=f"g{i:03}", labeled=False) for i in range(5)])
    kept, excluded = prepare.prepare(feedback, unlabeled, regression=regression)
    assert {r["split"]: r["count"] for r in kept.filter("labeled").groupBy("split").count().collect()} == want
    assert validation.split_leaks(kept).count() == 0
    assert kept.count() + excluded.count() == sum(want.values()) + 5


def test_prepare_joins_equal_contexts_after_redaction(spark):
    feedback = frame(spark, [record(1, text="mail a@b.org"), record(2, text="mail c@d.org"), record(3)])
    kept, _ = prepare.prepare(feedback, frame(spark, []))
    assert {r["record_id"]: r["group_name"] for r in kept.collect()} == {"r001": "r001", "r002": "r001", "r003": "r003"}
    with pytest.raises(ValueError, match="r001"):
        prepare.prepare(feedback, frame(spark, [record(1, labeled=False)]))


def test_catalog_and_cases(spark):
    lessons = spark.createDataFrame([(f"L{i}", f"r{i % 3}", "clear" if i else "explicit") for i in range(5)], "lesson_id string, record_id string, signal string")
    guidelines = spark.createDataFrame([("b", 0, "B", ["x"], ["L0"]), ("a", 0, "A", ["y", "z"], ["L0", "L1", "L2", "L3"])], "route string, pos int, title string, criteria array<string>, lesson_ids array<string>")
    found = prepare.catalog(guidelines, lessons)
    rows = {r["guideline_id"]: r for r in found.collect()}
    assert (rows["G001"]["route"], rows["G001"]["support"], rows["G001"]["strength"], rows["G001"]["included"]) == ("a", 3, "strong", True)
    assert (rows["G002"]["support"], rows["G002"]["included"], rows["G002"]["explicit"]) == (1, False, 1)
    assert [c["criterion_id"] for c in rows["G001"]["criteria"]] == ["G001.c1", "G001.c2"]
    assert [r["lesson_id"] for r in prepare.set_aside(lessons, guidelines).collect()] == ["L4"]
    chosen = spark.createDataFrame([("r001", ["G002", "G001"], ["own"], 0.9), ("r002", [], [], 0.2)], "record_id string, guideline_ids array<string>, case_criteria array<string>, confidence double")
    rubric = prepare.rubrics(chosen, found)
    kept, _ = prepare.prepare(frame(spark, [record(1), record(2)]), frame(spark, []))
    cases, excluded = prepare.cases(kept, rubric, "asset")
    case = cases.first()
    assert case["case_id"] == "feedback-r001" and [g["guideline_id"] for g in case["groups"]] == ["G002", "G001", "case"]
    assert case["provenance"] == "guideline_grounded"
    assert [(r["record_id"], r["reason"]) for r in excluded.collect()] == [("r002", "no_checkable_criteria")]
    assert prepare.review(cases).agg(F.sum("trusted")).first()[0] == 1


def test_rubric_guidelines_and_parameters(spark):
    known = F.array(F.lit("G001"), F.lit("G002"))
    row = spark.range(1).select(
        validation.rubric_guidelines(F.array(*map(F.lit, ("G002.c1", "G001", "G002"))), known),
        validation.parameter_code(F.lit(5), F.lit(0), F.lit(4), F.lit(1)), validation.parameter_code(F.lit(3), F.lit(0), F.lit(4), F.lit(3)),
        validation.parameter_code(F.lit(3), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(3)),
    ).first()
    assert list(row) == [["G002", "G001"], "parameter_bounds", "no_change", "parameter_scope"]


def test_review_of_prompts(spark):
    base = "System: answer ${question}\nUser: go"
    long = "one two three four five six seven eight nine"
    variants = [
        (1, base, " "), (2, base, base + " "), (3, base, "System: answer ${other}"), (4, base, base + " like case-0001 did"),
        (5, base, base + " e.g. Acme Suite"), (6, base, base + " " + long), (7, base, base + " and Hidden Tool"), (8, base, base + " be brief"),
    ]
    cases = "case_id string, text string, input string"
    train = spark.createDataFrame([("case-0001", f"a {long}", "Acme Suite"), ("abc", "b", "be")], cases)
    held = spark.createDataFrame([("h1", "text", "Hidden Tool")], cases)
    found = review.review_prompts(spark.createDataFrame(variants, "variant int, previous string, proposed string"), train, held).collect()
    codes = {}
    for r in found:
        codes.setdefault(r["variant"], set()).add(r["code"])
    assert codes == {
        1: {"non_empty"}, 2: {"no_change"}, 3: {"placeholder_integrity", "section_structure"}, 4: {"case_id_reference"},
        5: {"train_input_copy"}, 6: {"train_example_leakage"}, 7: {"specific_input_reference"},
    }
    assert not any(r["detail"] for r in found if r["code"] == "specific_input_reference")


def test_fingerprints_of_long_lists_are_trees(spark, monkeypatch):
    """A list of one chunk has the fingerprint of its JSON; a longer one that of its chunks' fingerprints, whatever the order of rows."""
    import hashlib
    import json

    from evalloom.operators import run_checks

    def digest(value):
        return "sha256:" + hashlib.sha256(json.dumps(value, separators=(",", ":")).encode()).hexdigest()

    cases = spark.createDataFrame([("hot", f"c{(i * 37) % 101}", i * 3) for i in range(101)] + [("cold", "x", 1), ("cold", "a", 2)], "run_id string, case_id string, pos long").repartition(7)
    ids = [f"c{(i * 37) % 101}" for i in range(101)]
    got = {r["run_id"]: (r["ordered"], r["as_set"]) for r in run_checks.case_fingerprints(cases).collect()}
    assert got == {"hot": (digest(ids), digest(sorted(ids))), "cold": (digest(["x", "a"]), digest(["a", "x"]))}
    monkeypatch.setattr(run_checks, "CHUNK_IDS", 10)
    tree = lambda x: digest([digest(x[i : i + 10]) for i in range(0, len(x), 10)])
    got = {r["run_id"]: (r["ordered"], r["as_set"]) for r in run_checks.case_fingerprints(cases).collect()}
    assert got == {"hot": (tree(ids), tree(sorted(ids))), "cold": (digest(["x", "a"]), digest(["a", "x"]))}
