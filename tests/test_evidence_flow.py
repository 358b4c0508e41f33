"""Memory evidence, episodes, the feedback sample and reports."""

import pytest
from pyspark.sql import functions as F

from evalloom.operators import episodes, memory, reports, sampling


def test_supporting_cases(spark):
    rows = [("c1", "r1", "train", memory.INFERRED, ["G1"]), ("c2", "r2", "train", memory.INFERRED, []), ("c3", "r3", "test", memory.INFERRED, ["G9"]), ("c4", "r4", "train", memory.INFERRED, ["G1"])]
    cases = spark.createDataFrame(rows, "case_id string, record_id string, split string, trust_tier string, guideline_ids array<string>")
    guidelines = spark.createDataFrame([("G1",)], "guideline_id string")
    kept, bad = memory.supporting_cases(cases, guidelines, spark.createDataFrame([("r1",), ("r2",), ("r3",)], "record_id string"))
    assert {r["case_id"] for r in kept.collect()} == {"c1", "c3", "c4"}
    assert {tuple(r) for r in bad.collect()} == {("c3", "unknown_guideline"), ("c3", "not_inferred_train"), ("c4", "no_source_trace")}


def test_patterns_and_additions(spark):
    rows = [("P1", "G1", "avoid", "x", ["G1.c1"], ["t1"], 0.5), ("P2", "G1", "odd", "x", ["G1.c1"], ["t1"], 0.5), ("P3", "G1", "avoid", "x", ["G1.c9"], ["t9"], 0.5), ("P4", "G1", "avoid", "x", [], ["t1"], 2.0)]
    patterns = spark.createDataFrame(rows, f"pattern_id string, {memory.PATTERN}")
    criteria = spark.createDataFrame([("G1", "G1.c1")], "guideline_id string, criterion_id string")
    bound = spark.createDataFrame([("t1", "G1")], "trace_id string, guideline_id string")
    found = {tuple(r) for r in memory.pattern_violations(patterns, criteria, bound).collect()}
    assert found == {("P2", "kind"), ("P3", "unknown_criterion"), ("P3", "unbound_trace"), ("P4", "criteria")}
    adds = [("A1", "k", "avoid", "do it", ["G1.c1"], ["t1"], ["P1"]), ("A2", "k", "procedure", "b", ["G1.c1"], ["t1"], ["P1"]), ("A3", "k", "avoid", "c", ["G1.c2"], ["t1"], ["P1"]),
            ("A4", "k", "avoid", "d", ["G1.c1"], ["t1"], ["P7"]), ("A5", "k", "avoid", "Do  it", ["G1.c1"], ["t1"], ["P1"])]
    additions = spark.createDataFrame(adds, f"addition_id string, card_id string, {memory.ADDITION}")
    found = {tuple(r) for r in memory.addition_violations(additions, patterns).collect()}
    assert found == {("A2", "pattern_kind"), ("A3", "criteria"), ("A4", "unknown_pattern"), ("A5", "duplicate_text")}
    cards = spark.createDataFrame([("k", ["i"], ["v"], [], []), ("other", [], [], [], [])], "card_id string, instructions array<string>, avoid array<string>, tool_guidance array<string>, example_steps array<string>")
    got = {r["card_id"]: r for r in memory.append_additions(cards, additions.limit(2)).collect()}
    assert (got["k"]["instructions"], got["k"]["avoid"], got["other"]["avoid"]) == (["i", "b"], ["v", "do it"], [])
    assert spark.range(1).select(memory.memory_id(F.lit("G"), F.lit("b"))).first()[0].startswith("memory-")


def test_episodes(spark):
    def msg(role, content=None, id_=None, error=None, calls=None):
        return (role, content, id_, error, calls)

    good = [msg("assistant", "hello"), msg("user", "help"), msg("assistant", None, calls=[("c1", "find", "{}")]), msg("tool", "oops", "c1", True), msg("assistant", "done"), msg("assistant", " ")]
    rows = [("s1", "7", 0, 1, "stop", good), ("s2", "7", 1, 1, "stop", good[:3] + good[4:]), ("s3", "8", 0, 1, "stop", good), ("s4", "7", 2, 1, "stop", good[:1]), ("s5", "7", 3, 1, "stop", [])]
    tasks = spark.createDataFrame([("7", "train", "fam")], "task_id string, partition string, group_id string")
    got = {r["record_id"]: r for r in episodes.episodes(spark.createDataFrame(rows, episodes.SIMULATION), tasks).collect()}
    e = got["task-7-trial-0"]
    assert e["code"] is None and [x["type"] for x in e["events"]] == ["message", "message", "tool_call", "tool_result", "message"]
    assert [x["sequence"] for x in e["events"]] == [0, 1, 2, 3, 4] and e["events"][3]["error"] == "oops"
    assert (e["user_input"], [c["content"] for c in e["conversation_context"]], e["assistant_output"]) == ("help", ["hello"], "done")
    assert {k: r["code"] for k, r in got.items()} == {
        "task-7-trial-0": None, "task-7-trial-1": "unanswered_call", "task-8-trial-0": "unassigned_task", "task-7-trial-2": "no_user_message", "task-7-trial-3": "no_messages",
    }


def test_feedback_sample(spark):
    rows = [(f"r{i:02}", f"g{i % 6}", f"t{i}", i % 2, 10 + i, int(i == 5), [["refund"], ["cancel"], [], ["refund", "cancel"]][i % 4]) for i in range(20)]
    df = spark.createDataFrame(rows, "record_id string, group_id string, task_id string, trial int, event_count int, tool_error_count int, categories array<string>")
    got = sampling.select_records(df, ["refund", "cancel"], 8, "s").collect()
    strata = [r["stratum"] for r in got]
    assert len({r["record_id"] for r in got}) == 8 and {"operation:refund", "operation:cancel", "operation:no_consequential_action"} <= set(strata)
    assert got == sampling.select_records(df, ["refund", "cancel"], 8, "s").collect()
    with pytest.raises(ValueError):
        sampling.select_records(df, [], 20, "s")


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "step string, n int")
    got = [r["text"] for r in reports.table_lines(df, 1, "Steps", [F.desc("step")]).orderBy("section", "line").collect()]
    assert got == ["## Steps", "| step | n |", "|---|---|", "| b |  |", "| a | 1 |"]
    row = spark.range(1).select(
        reports.names(F.transform(F.sequence(F.lit(1), F.lit(22)), lambda i: i.cast("string"))),
        reports.labelled_field(F.lit("Polarity: good\nx"), "Polarity:"),
        reports.labelled_field(F.lit("A: 1\nA: 2"), "A:"),
        reports.dialogue_text(F.lit("r1"), F.lit(2), F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))),
    ).first()
    assert row[0].endswith("20 and 2 more") and row[1] == "good" and row[2] is None and row[3] == "# 2. r1\n\n**User**\n\nhi"
