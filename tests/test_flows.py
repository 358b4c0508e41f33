"""Whole flows, recorded calls, live progress as a stream, and skewed keys."""

import json

import pytest
from pyspark.sql import functions as F

from evalloom.operators import calls, flows, grouping, loop, ordering, retrieval, search, validation
from evalloom.operators.transcript import RECORD
from evalloom.streaming import progress


def record(i, labeled=True):
    feedback = ("positive", f"good work on number {i}", None) if labeled else None
    return (f"r{i:02}", f"g{i:02}", "task", f"please solve number {i}", [], [], "{}", f"solved number {i}", None, "route-a", feedback)


SCHEMA = RECORD + ", route string, feedback struct<polarity: string, rationale: string, signals: array<struct<kind: string, check_id: string, passed: boolean>>>"


def test_build_asset(spark):
    feedback = spark.createDataFrame([record(i) for i in range(20)], SCHEMA)
    unlabeled = spark.createDataFrame([record(50 + i, False) for i in range(5)], SCHEMA)
    from evalloom.operators import prepare

    records, _ = prepare.prepare(feedback, unlabeled)
    train = sorted(r["record_id"] for r in records.filter("split = 'train' and labeled").collect())
    assert len(train) == 12
    lessons = [(r, 0, "success", "say the number", "explicit", 0.9, True, [("feedback", f"good work on number {int(r[1:])}")]) for r in train]
    lessons[0] = (*lessons[0][:7], [("feedback", "never said")])
    lessons[1] = (*lessons[1][:5], 0.1, *lessons[1][6:])
    observed = spark.createDataFrame(lessons, f"record_id string, pos int, {validation.LESSON.replace('knowable boolean', 'knowable boolean')}")
    criterion = {"kind": "required", "statement": "names the number", "applicability": "always", "severity": "major", "scoring": "0 or 1"}
    reply = {"guidelines": [{"title": "Numbers", "dividing_line": "d", "criteria": [criterion], "lesson_ids": ["L0001", "L0002", "L0003"]}], "set_aside": [{"lesson_ids": ["L0004"], "reason": "thin"}]}
    synthesised = spark.createDataFrame([("route-a", json.dumps(reply))], "route string, raw string")
    everyone = [r["record_id"] for r in records.collect()]
    rubrics = spark.createDataFrame([(r, ["G001"] if i else [], [], 0.8) for i, r in enumerate(everyone)], "record_id string, guideline_ids array<string>, case_criteria array<string>, confidence double")
    asset = flows.build_asset(feedback, unlabeled, observed, synthesised, rubrics, "a1")
    assert asset.lessons.count() == 10 and {r["reason"] for r in asset.dropped.collect()} == {"unverified_evidence", "low_confidence"}
    (g,) = asset.guidelines.collect()
    assert (g["guideline_id"], g["support"], g["strength"], g["included"]) == ("G001", 3, "strong", True)
    places = {r["lesson_id"]: (r["place"], r["reason"]) for r in asset.placed.collect()}
    assert places["L0001"] == ("guideline", None) and places["L0004"] == ("set_aside", "thin") and places["L0010"][1] == "not addressed by the model"
    assert asset.cases.count() == len(everyone) - 1 and [r["reason"] for r in asset.excluded.collect()] == ["no_checkable_criteria"]
    assert sum(r["trusted"] + r["inferred"] for r in [x.asDict() | {"trusted": x[1], "inferred": x[2]} for x in asset.review.collect()]) == len(everyone) - 1
    held_out = records.filter("split <> 'train'").first()["record_id"]
    leaked = spark.createDataFrame([(held_out, *lessons[2][1:])], observed.schema)
    with pytest.raises(ValueError, match="held-out"):
        flows.build_asset(feedback, unlabeled, leaked, synthesised, rubrics, "a1")


def test_evaluate_isolates_failures(spark):
    def chain(context):
        yield "read", context["q"]
        if context["q"] == "bad":
            raise TimeoutError("slow")
        yield "answer", f"The {context['q'].upper()}!"

    cases = spark.createDataFrame([(str(i), i, {"q": q}, "the x") for i, q in enumerate(["x", "bad", "y"])], "case_id string, pos int, context map<string,string>, expected string")
    outputs = calls.run_chain(cases, chain)
    run = flows.evaluate(cases.drop("context"), outputs, "r1", "exact")
    got = {r["case_id"]: (r["execution_status"], r["error_category"], r["score"], len(r["step_outputs"])) for r in run.results.collect()}
    assert got == {"0": ("succeeded", None, 100.0, 2), "1": ("failed", "timeout", None, 1), "2": ("succeeded", None, 0.0, 2)}
    p = run.progress.first()
    assert (p["total"], p["succeeded"], p["mean_successful"], p["status"]) == (3, 2, 50.0, "degraded")
    assert run.identity.first()["ordered"].startswith("sha256:")


def test_recorded_calls(spark):
    attempts = spark.createDataFrame([("a", 1, "{", 5, 1), ("a", 2, "{}", 5, 2), ("b", 1, "x", 1, 1), ("b", 2, "x", 1, 1), ("b", 3, "x", 1, 1), ("b", 4, "{}", 1, 1)], "cache_key string, attempt int, raw string, input_tokens int, output_tokens int")
    replies, rejected = calls.accepted(attempts, F.when(F.try_parse_json("raw").isNull(), "not_json"))
    assert [(r["cache_key"], r["attempt"]) for r in replies.collect()] == [("a", 2)]
    requests = spark.createDataFrame([("a", "observe", "m"), ("b", "observe", "m"), ("b", "observe", "m"), ("c", "observe", "m")], "cache_key string, step string, model string")
    answered, left = calls.memoised(requests, replies)
    assert answered.count() == 1 and {r["cache_key"] for r in left.collect()} == {"b", "c"} and left.count() == 2
    errors = {r["cache_key"]: r["previous_errors"] for r in calls.previous_errors(left, rejected).collect()}
    assert errors == {"b": ["not_json"] * 3, "c": []}
    log = calls.call_log(requests, attempts, rejected)
    assert log.count() == 6 and log.filter("rejected is not null").count() == 4
    chunks = calls.in_chunks(spark.range(7).withColumn("p", F.lit("x")), "p", "id", 3).orderBy("id").collect()
    assert [(r["chunk"], r["seen"]) for r in chunks] == [(0, 3)] * 3 + [(1, 6)] * 3 + [(2, 7)]


def test_live_progress_as_a_stream(spark, tmp_path):
    """Counters by case and run, over a restart: a result that comes again in a later batch is refused, and cases are released in time."""
    hour = 3600

    def events(*rows):
        schema = "run_id string, case_id string, kind string, ok boolean, score double, total_cases long, s long"
        return spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else True, 50.0, r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else 0) for r in rows], schema).select(
            "run_id", "case_id", "kind", "ok", "score", "total_cases", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts")
        )

    first = events(("r", "1", "start"), ("r", "2", "start"), ("r", "1", "result"), ("r", "1", "result"), ("q", "1", "start"), ("q", "", "failed"), *[("big", str(i), "result") for i in range(500)])
    second = events(("r", "1", "result", False, None, 5), ("r", "2", "result", False, None, 6), ("r", "", "completed", True, 2, 9), ("big", "", "completed", True, 500, 9))
    whole = first.unionAll(second)

    def follow(batch):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = progress.follow(spark.readStream.schema(progress.EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), "1 second", hour * 1000)
        query.awaitTermination(240)
        return query

    follow(first)
    got = {r["run_id"]: (r["completed_cases"], r["in_flight"], r["refused_results"], r["status"]) for r in progress.followed(spark, str(tmp_path / "out")).collect()}
    assert got == {"r": (1, 1, 1, "running"), "q": (0, 1, 0, "failed"), "big": (500, 0, 0, "running")}
    query = follow(second)
    found = {r["run_id"]: tuple(r) for r in progress.followed(spark, str(tmp_path / "out")).collect()}
    assert found == {r["run_id"]: tuple(r) for r in progress.live(whole).collect()}
    assert found["r"][1:] == (2, 1, 1, 50.0, 0, 2, "degraded") and found["big"][-1] == "completed"
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "refused")).groupBy("run_id", "case_id").agg(F.sum("refused")).collect()] == [("r", "1", 2)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 506  # a small row for each case and mark
    follow(events(("late", "1", "start", True, None, 9 * hour)))
    query = follow(events(("late", "2", "start", True, None, 9 * hour + 2)))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 10


def tasks_with_rows(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_one_key_with_most_rows_spreads_over_tasks(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold").alias("k"), F.col("id").alias("r"))
    ranked = ordering.rank_within(rows, "k", ["r"], "turn", "size")
    got = {r["k"]: (r["n"], r["lo"], r["hi"], r["d"], r["s"]) for r in ranked.groupBy("k").agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("d"), F.max("size").alias("s")).collect()}
    assert got == {"hot": (3600, 1, 3600, 3600, 3600), "cold": (200, 1, 200, 200, 200), None: (200, 1, 200, 200, 200)}
    numbered = ordering.global_row_number(rows, ["k", "r"])
    assert tasks_with_rows(numbered.filter("k = 'hot'")) > 1
    split = grouping.stratified_split(rows, "k", "r").groupBy("k", "split").count().collect()
    assert {(r["k"], r["split"]): r["count"] for r in split}[("hot", "dev")] == 720


def test_greedy_split_of_many_groups(spark):
    groups = spark.range(5000).select(F.col("id").alias("group_name"), (F.col("id") % 7 + 1).cast("double").alias("weight"))
    got = {r["split"]: r["w"] for r in grouping.greedy_split(groups, grouping.SHARES).join(groups, "group_name").groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    total = sum(got.values())
    assert all(abs(got[s] / total - share) < 0.01 for s, share in grouping.SHARES.items())
    assert grouping.greedy_split(groups.limit(0), grouping.SHARES).count() == 0


def test_merge_pairs_compares_sets(spark):
    pool = spark.createDataFrame([(i, [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(40)], "m int, ch array<string>")
    got = {tuple(r) for r in search.merge_pairs(pool, "m", "ch").collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if {a % 4, b % 4} == {0, 1}}


def test_bm25_over_passes_and_hot_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the " * (i % 5 + 1) + f"word{i % 17} word{i % 5}") for i in range(300)] + [(999, None)], "d int, text string")
    queries = spark.createDataFrame([(q, f"the word{q}") for q in range(9)] + [(20, ""), (21, "nothing here")], "q int, text string")
    whole = sorted(map(tuple, retrieval.bm25_top(docs, queries, "d", "q", "text", k=5).collect()))
    assert len(whole) == 45 and {r[0] for r in whole} == set(range(9))
    monkeypatch.setattr(retrieval, "PASS_QUERIES", 2)
    assert sorted(map(tuple, retrieval.bm25_top(docs, queries, "d", "q", "text", k=5).collect())) == whole
    assert retrieval.bm25_top(docs, queries.limit(0), "d", "q", "text").count() == 0
    monkeypatch.setattr(retrieval, "FILTER_BITS", 1 << 4)  # nearly everything passes: the join decides
    held = spark.createDataFrame([("a b c d e f g h i",), ("z " * 9,)], "text string")
    cases = spark.createDataFrame([(1, "x a b c d e f g h i"), (2, "a b c d e f g h"), (3, None), (4, "z " * 30)], "c int, text string")
    got = {r["ngram"]: r["owners"] for r in retrieval.leaked_ngrams(held, cases, "c", "text").collect()}
    assert got == {"a b c d e f g h": 2, "b c d e f g h i": 1, "z z z z z z z z": 1}


def test_additive_asset_keeps_what_holds(spark):
    from evalloom.operators import cards, memory

    base = spark.createDataFrame([("k", ["i"], [], [], [])], "card_id string, instructions array<string>, avoid array<string>, tool_guidance array<string>, example_steps array<string>")
    patterns = spark.createDataFrame([("P1", "G1", "avoid", "x", ["G1.c1"], ["t1"], 0.5), ("P2", "G1", "avoid", "y", ["G1.c9"], ["t1"], 0.5)], f"pattern_id string, {memory.PATTERN}")
    additions = spark.createDataFrame([("A1", "k", "avoid", "no haste", ["G1.c1"], ["t1"], ["P1"]), ("A2", "k", "avoid", "z", ["G1.c9"], ["t1"], ["P2"])], f"addition_id string, card_id string, {memory.ADDITION}")
    criteria, bound = spark.createDataFrame([("G1", "G1.c1")], "guideline_id string, criterion_id string"), spark.createDataFrame([("t1", "G1")], "trace_id string, guideline_id string")
    got, codes = cards.additive_asset(base, patterns, additions, criteria, bound)
    assert [r["avoid"] for r in got.collect()] == [["no haste"]]
    assert {tuple(r) for r in codes.collect()} == {("P2", "unknown_criterion"), ("A2", "unknown_pattern")}


def test_compare_refuses_runs_with_issues(spark):
    def run(scores):
        results = spark.createDataFrame([(str(i), s) for i, s in enumerate(scores)], "case_id string, score double")
        return flows.Run(results, None, None)

    none = spark.createDataFrame([], "code string")
    found, extremes = flows.compare(run([10.0, None, 50.0]), run([20.0, 5.0, 40.0]), none)
    r = found.first()
    assert (r["shared"], r["regressions"], r["improvements"], round(r["mean_delta"], 6)) == (3, 1, 2, round(5 / 3, 6))
    assert {(x["kind"], x["case_id"]) for x in extremes.collect()} == {("regression", "2"), ("improvement", "0"), ("improvement", "1")}
    issues = none.unionAll(spark.createDataFrame([("results.missing",)], "code string"))
    with pytest.raises(ValueError, match="results.missing"):
        flows.compare(run([1.0]), run([2.0]), issues)
    assert flows.compare(run([1.0]), run([2.0]), issues, allow_uncontrolled=True)[0].first()["shared"] == 1


def test_splits_in_their_order(spark):
    from evalloom.operators import prepare

    rows = spark.createDataFrame([("test", 1), ("other", 2), ("train", 4), ("train", 3), ("validation", 5)], "split string, n int")
    assert [r["n"] for r in prepare.in_split_order(rows, "n").collect()] == [3, 4, 5, 1, 2]


def test_sections_of_a_summary_are_left_out_where_empty(spark):
    from evalloom.operators import reports

    schema = "case_id string, ok boolean, score double, breakdown map<string,double>, timings array<struct<name: string, seconds: double>>, tier string"
    rows = [("a", True, 80.0, {"f1": 0.5}, [("x", 1.0), ("y", 2.0)], None), ("b", True, 60.0, {"f1": 1.0}, [("x", 3.0)], None), ("c", False, None, None, None, None)]
    text = [r["text"] for r in reports.summary_lines(spark.createDataFrame(rows, schema)).orderBy("section", "line").collect()]
    assert text == [
        "# Evaluation Summary", "", "Total cases: 3", "Successful cases: 2", "Infrastructure failures: 1", "", "## Composite Score", "- average: 70.00", "", "## Score Breakdown", "- f1: 0.75",
        "", "## Step Timings", "", "| Step | Avg (s) | P50 (s) | P95 (s) |", "|------|---------|---------|---------|", "| x | 2.000 | 2.000 | 3.000 |", "| y | 2.000 | 2.000 | 2.000 |", "| **Total** | **3.000** | **3.000** | **3.000** |",
    ]
    assert reports.summary_lines(spark.createDataFrame([], schema)).count() == 6


def test_leakage_reads_the_cases_once(spark, tmp_path):
    """Thirty thousand held-out n-grams and one scan of the corpus, with a filter that is too small for them."""
    spark.range(3000).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.concat(F.lit("w"), F.col("id") % 1500, F.lit("x"), i)), " ").alias("text")).write.parquet(str(tmp_path / "cases"))
    cases = spark.read.parquet(str(tmp_path / "cases"))
    held = spark.range(1400, 4000).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("x"), i)), " ").alias("text"))
    found = retrieval.leaked_ngrams(held, cases, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert (found.count(), {r["owners"] for r in found.select("owners").distinct().collect()}) == (100 * 12, {2})
