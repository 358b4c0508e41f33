"""Operators on small inputs, with the known values of their rules."""

import pytest
from pyspark.sql import functions as F

from evalloom.operators import attribution, evidence, grouping, ordering, retrieval, runs, search, transcript


def test_bootstrap_closed_forms(spark):
    rows = [("one_of_3", f"{i}", 1.0 if i == 0 else 0.0) for i in range(3)]
    rows += [("even", f"{i:02}", 1.0 if i < 10 else -1.0) for i in range(20)]
    rows += [("up", f"{i}", 100.0) for i in range(4)] + [("flat", f"{i}", 0.0) for i in range(4)]
    got = {r["k"]: r for r in search.bootstrap_gain(spark.createDataFrame(rows, "k string, c string, g double"), "k", "c", "g").collect()}
    assert got["one_of_3"]["p_improve"] == pytest.approx(1 - (2 / 3) ** 3, abs=0.03)
    assert got["even"]["p_improve"] == pytest.approx((1 - 184756 / 2**20) / 2, abs=0.04)
    assert (got["up"]["mean_gain"], got["up"]["p_improve"]) == (100.0, 1.0)
    assert (got["flat"]["mean_gain"], got["flat"]["p_improve"]) == (0.0, 0.0)


def test_acceptance(spark):
    def decide(*x):
        return spark.range(1).select(search.acceptance(*map(F.lit, x), 1.0, 0.9)).first()[0]

    assert decide(2.0, 0.95, 0.0, 0.0) == "accepted"
    assert decide(0.5, 0.95, 0.0, 0.0) == "selection_below_threshold"
    assert decide(0.0, 0.1, 3.0, 0.95) == "accepted_train_tiebreak"
    assert decide(-1.0, 0.1, 3.0, 0.95) == "selection_below_threshold"


def test_pareto(spark):
    rows = [("a", 1, 5.0), ("a", 2, 1.0), ("b", 1, 1.0), ("b", 2, 5.0), ("c", 1, 1.0), ("c", 2, 1.0), ("a", 3, 2.0), ("b", 3, 2.0), ("c", 3, 2.0)]
    scores = spark.createDataFrame(rows, "m string, c int, s double")
    assert {r["m"] for r in search.pareto_frontier(scores, "m", "c", "s").collect()} == {"a", "b"}
    assert {(r["m"], r["votes"]) for r in search.pareto_votes(scores, "m", "c", "s").collect()} == {("a", 1), ("b", 1), ("c", 0)}


def test_connected_groups(spark):
    rows = [("r4", "g1", "x"), ("r2", "g1", None), ("r3", "g2", "x"), ("r1", "g3", "y"), ("r5", None, None)]
    df = spark.createDataFrame(rows, "r string, g string, c string")
    got = {x["r"]: x["group_name"] for x in grouping.connected_groups(df, "r", [F.col("g"), F.col("c")]).collect()}
    assert got == {"r2": "r2", "r3": "r2", "r4": "r2", "r1": "r1", "r5": "r5"}


@pytest.mark.parametrize(("shares", "want"), [(grouping.SHARES, {"train": 12, "validation": 4, "test": 4}), (grouping.SHARES_WITH_REGRESSION, {"train": 12, "validation": 4, "test": 4, "regression": 5})])
def test_greedy_split_meets_its_targets(spark, shares, want):
    n = sum(want.values())
    groups = spark.createDataFrame([(f"g{i:03}", 1) for i in range(n)], "group_name string, weight long")
    split = grouping.greedy_split(groups, shares)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == want


def test_stratified_split_sends_rare_keys_to_test(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)] + [("c", i) for i in range(4)], "k string, r int")
    got = {(r["k"], r["split"]): r["count"] for r in grouping.stratified_split(df, "k", "r").groupBy("k", "split").count().collect()}
    assert got == {("a", "dev"): 2, ("a", "test"): 8, ("b", "test"): 3, ("c", "dev"): 1, ("c", "test"): 3}


def test_global_row_number_and_islands(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    got = ordering.global_row_number(df, ["k"]).collect()
    assert all(r["rn"] == r["k"] + 1 for r in got) and len(got) == 1000
    rows = [("p", 1, 0, 1), ("p", 2, 1, 0), ("p", 3, 0, 1), ("p", 4, 0, 1), ("q", 1, 0, 1)]
    df = spark.createDataFrame(rows, "p string, t int, reset int, miss int")
    found = ordering.islands(df, "p", ["t"], F.col("reset") == 1, F.col("miss") == 1)
    assert {(r["p"], r["resets"], r["since"]) for r in found.collect()} == {("p", 1, 2), ("q", 0, 1)}


CASES = "case_id string, failed_execution boolean, score double, steps array<struct<name string, output string>>, question string, expected string, tool_error struct<tool string, message string>"


def attributed(spark, *rows):
    return [tuple(r) for r in attribution.attribute(spark.createDataFrame(rows, CASES)).collect()]


def test_attribution_precedence(spark):
    steps = [("retrieve_docs", ""), ("answer", "I don't know")]
    assert attributed(spark, ("c", True, 100.0, steps, None, None, ("t", "x")))[0][2:4] == ("__infrastructure__", "execution_failure")
    assert attributed(spark, ("c", False, 100.0, steps, None, None, None)) == []
    assert attributed(spark, ("c", False, 0.0, [], None, None, None))[0][2] == "__no_steps__"
    assert attributed(spark, ("c", False, 0.0, steps, None, None, ("add", "Not found")))[0][2:4] == ("tool_add", "tool_failure_not_found")
    assert attributed(spark, ("c", False, 0.0, steps, None, None, None)) == [("c", 0, "retrieve_docs", "retrieval_empty", "high", "miss")]
    cascade = attributed(spark, ("c", False, 0.0, [("a", ""), ("b", "x"), ("c", " ")], None, None, None))
    assert [(r[2], r[3]) for r in cascade] == [("a", "cascade"), ("b", "cascade_downstream"), ("c", "cascade_downstream")]
    overlap = attributed(spark, ("c", False, 0.0, [("search_passages", "nothing of it"), ("answer", "x")], "capital France geography Europe", None, None))
    assert overlap == [("c", 0, "search_passages", "retrieval_overlap", "high", "miss")]
    assert attributed(spark, ("c", False, 0.0, [("plan", ""), ("answer", "x")], None, None, None))[0][3] == "empty_intermediate"
    assert attributed(spark, ("c", False, 0.0, [("answer", "It is surely Paris")], None, "paris", None))[0][3:5] == ("format_failure", "medium")
    assert attributed(spark, ("c", False, 0.0, [("answer", "Rome")], None, "paris", None))[0][3:5] == ("final_step_fallback", "low")


def test_judge(spark):
    rows = [("c", "critical", "partial"), ("c", "major", "satisfied"), ("c", "minor", "violated"), ("c", "major", "not_applicable")]
    got = evidence.judge(spark.createDataFrame(rows, "c string, s string, v string"), "c", "s", "v").first()
    assert (got["judge_score"], got["critical_violations"], got["applicable"]) == (58.3333, 1, 3)


def test_label_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "")]
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in evidence.label_metrics(spark.createDataFrame(rows, "e string, p string"), "e", "p").collect()}
    assert got == {"a": (100.0, 50.0, 66.67), "b": (50.0, 50.0, 50.0)}


def test_comparison(spark):
    a = spark.createDataFrame([("x", 100.0), ("y", 0.0), ("z", 50.0), ("only", 1.0)], "c string, score double")
    b = spark.createDataFrame([("x", 0.0), ("y", 100.0), ("z", 50.0)], "c string, score double")
    changes = runs.case_changes(a, b, "c")
    got = runs.comparison(changes).first()
    assert (got["shared"], got["regressions"], got["improvements"], got["mean_delta"]) == (3, 1, 1, 0.0)
    assert [r["kind"] for r in runs.extremes(changes, "c").collect()] == ["regression", "improvement"]
    assert runs.comparison(changes.limit(0)).first()["baseline_mean"] == 0.0


def test_leakage(spark):
    text = "one two three four five six seven eight nine"
    held = spark.createDataFrame([(text,)], "text string")
    cases = spark.createDataFrame([("c1", f"x {text}"), ("c2", text[:30]), ("c3", "two three four five six seven eight nine ten")], "c string, text string")
    got = {r["ngram"]: r["owners"] for r in retrieval.leaked_ngrams(held, cases, "c", "text").collect()}
    assert got == {"one two three four five six seven eight": 1, "two three four five six seven eight nine": 2}


def test_transcript(spark):
    rows = [
        ("r1", "g", "t", " hi ", [("user", "before")], [("add", "{}", None, "boom"), ("echo", "{}", "1", None)], "{}", "done", None),
        ("r2", "g", "t", "ask", [], [], "{}", "bye", [
            (2, "tool_call", None, None, "c1", "add", "{}", None, None), (1, "message", "user", " q ", None, None, None, None, None),
            (3, "tool_result", None, None, "c1", None, None, "3", None), (4, "message", "assistant", "bye", None, None, None, None, None)]),
    ]
    df = spark.createDataFrame(rows, transcript.RECORD)
    got = {r["record_id"]: r for r in df.select("record_id", transcript.transcript().alias("t"), transcript.user_intent().alias("u"), transcript.tool_names().alias("n")).collect()}
    assert [(e["role"], e["name"], e["outcome"]) for e in got["r1"]["t"]] == [
        ("user", None, None), ("user", None, None), (None, "add", "error_returned"), (None, "echo", "result_returned"), ("assistant", None, None),
    ]
    assert [(e["role"], e["name"], e["outcome"]) for e in got["r2"]["t"]] == [("user", None, None), (None, "add", "result_returned"), ("assistant", None, None)]
    assert (got["r1"]["u"], got["r2"]["u"], got["r2"]["n"]) == ("before\nhi", "q", ["add"])


def test_route_falls_back_only_without_the_key(spark):
    df = spark.createDataFrame([('{"route": "a", "task_type": "t"}',), ('{"route": null, "task_type": "t"}',), ('{"task_type": "t"}',)], "raw string")
    assert [r[0] for r in df.select(transcript.route("raw")).collect()] == ["a", None, "t"]


def test_supporting_rows(spark):
    rows = [("g", i, p) for i, p in enumerate(["mixed", "mixed", "negative", "positive", "positive"])]
    got = grouping.supporting_rows(spark.createDataFrame(rows, "g string, r int, p string"), "g", "r", "p", 3).orderBy("place")
    assert [r["r"] for r in got.collect()] == [3, 2, 0]


def test_bootstrap_of_a_key_in_many_blocks(spark):
    """Blocks of sixteen cases: all draws are dealt out, and the share agrees with that of one block; the largest array is a block."""
    import numpy as np

    from evalloom.operators.search import block_counts, resampled_sums

    n, block, resamples = 1000, 16, 400
    counts = np.stack([block_counts(n, leaf, block, resamples, 3) for leaf in range(-(-n // block))])
    assert (counts.sum(0) == n).all() and abs(counts[:-1].mean() - block) < 0.2 and 10 < counts[0].var() < 25
    assert resampled_sums(np.arange(5.0), np.zeros(7, int), 0, 0).tolist() == [0.0] * 7
    rows = [("hot", i, 1.0 if i % 5 < 3 else -1.4) for i in range(n)] + [("cold", i, 1.0 if i % 2 else -0.5) for i in range(20)] + [(None, 1, 1.0)] + [("flat", i, 0.0) for i in range(40)]
    gains = spark.createDataFrame(rows, "k string, c int, g double")
    one = {r["k"]: r for r in search.bootstrap_gain(gains, "k", "c", "g", resamples=2000).collect()}
    many = {r["k"]: r for r in search.bootstrap_gain(gains, "k", "c", "g", resamples=2000, block=block).collect()}
    assert one.keys() == many.keys() == {"hot", "cold", "flat", None}
    assert all(abs(one[k]["p_improve"] - many[k]["p_improve"]) < 0.04 and abs(one[k]["mean_gain"] - many[k]["mean_gain"]) < 1e-9 for k in one)
    assert 0.6 < one["hot"]["p_improve"] < 0.99 and one["flat"]["p_improve"] == 0.0 and one[None]["p_improve"] == 1.0
