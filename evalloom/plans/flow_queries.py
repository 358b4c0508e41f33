"""Contracts of inputs, recorded calls and an evaluation run over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import values
from evalloom.operators import calls, cards, evaluation, flows, merges, prepare, replies, sampling, validation
from evalloom.plans.registry import query
from evalloom.session import new_folder, table


def _pick(i: Column, *texts: str | None) -> Column:
    return F.get(F.array(*map(F.lit, texts)), i % len(texts))


@query("""
SELECT doc_id, (['missing_field', 'schema_version', 'blank_user_input', 'route', 'assistant_output', 'runtime', 'no_feedback', 'empty_result', 'not_an_object', NULL])[doc_id % 10 + 1] AS labeled,
  (['missing_field', 'schema_version', 'blank_user_input', 'route', 'assistant_output', 'runtime', NULL, 'empty_result', 'not_an_object', 'unexpected_feedback'])[doc_id % 10 + 1] AS unlabeled
FROM documents
""")
def input_contract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 10
    raw = F.concat(
        F.lit('{"schema_version":"'), F.when(i == 1, "v0").otherwise("v1"), F.lit('","record_id":"r'), F.col("doc_id").cast("string"), F.lit('","group_id":"g","task_type":"t","user_input":"'),
        F.when(i == 2, "  ").otherwise("u"), F.lit('","conversation_context":[],"tool_calls":[],"runtime":'), F.when(i == 5, "[]").otherwise("{}"),
        F.when(i == 0, "").otherwise(',"metadata":{}'), F.when(i == 3, ',"route":null').otherwise(""), F.lit(',"assistant_output":'), F.when(i == 4, "1").otherwise('"a"'),
        F.when(i.isin(6, 7), "").otherwise(',"feedback":{"polarity":"mixed"}'), F.when(i == 7, ',"episode":{"events":[{"type":"tool_result"}]}').otherwise(""),
        F.when(i == 8, ',"route":"a","route":"b"}').otherwise("}"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", validation.raw_record_code(raw, True, "v1").alias("labeled"), validation.raw_record_code(raw, False, "v1").alias("unlabeled"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0")
def protected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, '{"a":[{"b":{"reward_info":1}}]}').otherwise('{"a":"reward_info"}')
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return validation.protected_rows(rows, "raw", ("reward_info", "ticket")).select("event_id")


@query("""
SELECT event_id, (['not_bool', NULL])[event_id % 2 + 1] AS flag, (['not_int', 'below_minimum', 'above_maximum', 'not_numeric', NULL])[event_id % 5 + 1] AS top_k,
  (['not_a_choice', NULL])[event_id % 2 + 1] AS mode FROM events
""")
def parameter_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    flag, top_k, mode = (F.try_parse_json(x) for x in (_pick(i, "1", "true"), _pick(i, "2.5", "0", "99", "true", "5"), _pick(i, '"other"', '"fast"')))
    return table(spark, sf_dir, "events").select(
        "event_id", validation.parameter_value_code(flag, "bool").alias("flag"), validation.parameter_value_code(top_k, "int", 1, 20).alias("top_k"),
        validation.parameter_value_code(mode, "choice", choices=("fast", "deep")).alias("mode"),
    )


@query("SELECT 'L' || event_id AS lesson_id, user_id::VARCHAR AS record_id FROM events WHERE user_id % 5 >= 3")
def held_out_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string").alias("record_id")
    records = events.filter("user_id % 5 <> 4").select(user, F.when(F.col("user_id") % 5 < 3, "train").otherwise("test").alias("split")).distinct()
    return validation.held_out_lessons(events.select(F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("lesson_id"), user), records)


@query("""
SELECT user_id::VARCHAR AS cache_key, CASE WHEN user_id % 4 < 3 THEN user_id % 4 + 1 END AS attempt, CASE WHEN user_id % 4 < 3 THEN user_id % 4 ELSE 3 END::BIGINT AS rejected FROM events GROUP BY ALL
""")
def recorded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's request has four recorded attempts; the first sound one is number 1, 2, 3 or 4, and three may be used."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    attempts = users.select(F.col("user_id").cast("string").alias("cache_key"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"), (F.col("user_id") % 4 + 1).alias("sound"))
    attempts = attempts.select("cache_key", "attempt", F.when(F.col("attempt") >= F.col("sound"), "{}").otherwise("{").alias("raw"))
    replies, rejected = calls.accepted(attempts, F.when(F.try_parse_json("raw").isNull(), "not_json"))
    lost = rejected.groupBy("cache_key").agg(F.count("*").alias("rejected"))
    found = users.select(F.col("user_id").cast("string").alias("cache_key")).join(replies, "cache_key", "left").join(lost, "cache_key", "left").na.fill(0, ["rejected"])
    return found.select("cache_key", F.col("attempt").cast("long").alias("attempt"), "rejected")


@query("""
SELECT event_id, (n - 1) // 60 AS chunk, least(((n - 1) // 60 + 1) * 60, total) AS seen
FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events)
""")
def lesson_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls.in_chunks(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 60)
    return found.select("event_id", F.col("chunk").cast("long").alias("chunk"), "seen")


@query("""
SELECT doc_id, lower(regexp_replace(source, '\\s+', ' ', 'g')) || chr(0) || doc_id || chr(0) || 'deep text' AS haystack FROM documents WHERE source IS NOT NULL
""".replace("\\\\s", "\\s"))
def haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.to_json(F.struct("source", "doc_id", F.lit("x").alias("route"), F.array(F.struct(F.lit("Deep \n TEXT").alias("t"), F.lit(True).alias("b"))).alias("more")))
    return table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", values.haystack(("route",))(row).alias("haystack"))


@query("""
SELECT doc_id::VARCHAR AS case_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS execution_status, CASE WHEN doc_id % 7 = 0 THEN 'timeout' END AS error_category,
  (CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 0.0 ELSE 100.0 END)::DOUBLE AS score FROM documents
""")
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language code is the answer; a third of the outputs are wrong and every seventh case timed out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.col("doc_id").alias("pos"), F.lit("A code").alias("expected"), "doc_id")
    failed = F.col("doc_id") % 7 == 0
    output = F.when(failed, F.lit(None)).when(F.col("doc_id") % 3 == 0, "other").otherwise("the  Code.")
    steps = F.array().cast("array<struct<name: string, output: string>>")
    outputs = docs.select(
        "case_id", F.when(failed, "failed").otherwise("succeeded").alias("execution_status"), F.when(failed, "ReadTimeout").alias("error_name"), output.alias("output_text"),
        steps.alias("step_outputs"), F.array().cast("array<struct<name: string, seconds: double>>").alias("step_timings"),
    )
    run = flows.evaluate(docs.drop("doc_id"), outputs, "r", "exact")
    return run.results.select("case_id", "execution_status", "error_category", "score")


@query("""
SELECT doc_id, (['not_an_object', 'guideline_ids', 'unknown_guideline', 'tool_expectations', 'reference_output', 'kind', 'confidence', NULL])[doc_id % 8 + 1] AS code FROM documents
""")
def rubric_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 8
    ids = F.when(i == 1, '"G1"').when(i == 2, '["G1.c2","G7"]').otherwise('["G1.c2","G1"]')
    criterion = F.when(i == 5, '{"kind":"odd","statement":"s","applicability":"a","severity":"minor","scoring":"z"}').otherwise("")
    raw = F.concat(
        F.lit('{"applicable_guideline_ids":'), ids, F.lit(',"case_criteria":['), criterion, F.lit('],"tool_expectations":'), F.when(i == 3, "[1]").otherwise("{}"),
        F.lit(',"reference_output":'), F.when(i == 4, "1").otherwise("null"), F.lit(',"confidence":'), F.when(i == 6, "true").otherwise("0.5"), F.lit("}"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", replies.rubric_code(F.when(i == 0, "[]").otherwise(raw), F.array(F.lit("G1"), F.lit("G2"))).alias("code"))


@query("""
SELECT user_id::VARCHAR AS record_id, 't' || user_id % 5 AS task_id, CASE WHEN user_id % 2 = 0 THEN user_id % 3 ELSE 0 END::INT AS trial, count(*)::INT AS event_count, 3 AS tool_call_count,
  CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS tool_error_count, CASE WHEN user_id % 3 = 0 THEN 'cancel,refund' ELSE 'refund' END AS categories FROM events GROUP BY ALL
""")
def record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("user_id")
    call = lambda name, error: F.struct(name.alias("name"), F.lit("{}").alias("arguments"), F.lit("1").alias("result"), error.alias("error"))
    none = F.lit(None).cast("string")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("events"))
    tools = F.array(call(F.lit("pay_back"), none), call(F.when(i % 3 == 0, "stop").otherwise("look"), F.when(i % 2 == 0, "x").otherwise("")), call(F.lit("return"), none))
    runtime = F.concat(F.lit('{"task_id":"t'), (i % 5).cast("string"), F.when(i % 2 == 0, F.concat(F.lit('","trial":'), (i % 3).cast("string"))).otherwise('","trial":"x"'), F.lit("}"))
    records = users.select(i.cast("string").alias("record_id"), F.lit("g").alias("group_id"), runtime.alias("runtime"), "events", tools.alias("tool_calls"))
    found = sampling.record_metrics(records, {"pay_back": "refund", "return": "refund", "stop": "cancel"})
    return found.drop("group_id").withColumn("categories", F.array_join("categories", ","))


@query("""
WITH RECURSIVE p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 1 THEN s_suppkey // 3 END AS parent, s_suppkey % 11 AS score FROM supplier),
line(id, anc, depth) AS (SELECT id, id, 0 FROM p UNION ALL SELECT line.id, p.parent, depth + 1 FROM line JOIN p ON p.id = line.anc WHERE p.parent IS NOT NULL AND p.parent IN (SELECT id FROM p)),
met AS (SELECT a.id AS a, b.id AS b, min_by(a.anc, a.depth + b.depth) AS c, min_by(a.depth, a.depth + b.depth) AS da, min_by(b.depth, a.depth + b.depth) AS db FROM line a JOIN line b ON a.anc = b.anc AND a.id < b.id GROUP BY ALL),
f AS (SELECT met.*, pa.score + pb.score AS score FROM met JOIN p pa ON pa.id = a JOIN p pb ON pb.id = b WHERE da > 0 AND db > 0
  AND (a % 2 <> c % 2 OR a % 3 <> c % 3) AND (b % 2 <> c % 2 OR b % 3 <> c % 3) AND NOT (a % 2 <> c % 2 AND b % 2 <> c % 2) AND NOT (a % 3 <> c % 3 AND b % 3 <> c % 3))
SELECT a, b, c AS common, score::DOUBLE AS score FROM f ORDER BY score DESC, a, b LIMIT 1
""")
def search_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers are a pool, each the child of a third of its number, with two settings."""
    i = F.col("s_suppkey")
    pool = table(spark, sf_dir, "supplier").select(
        i.alias("candidate_id"), F.when(i > 1, F.floor(i / 3)).cast("long").alias("parent_id"), (i % 11).cast("double").alias("selection_score")
    )
    values_ = F.array(F.struct(F.lit("p").alias("path"), (F.col("candidate_id") % 2).alias("value")), F.struct(F.lit("q").alias("path"), (F.col("candidate_id") % 3).alias("value")))
    return merges.best_merge(pool, pool.select("candidate_id", F.inline(values_))).select("a", "b", "common", "score")


@query("""
SELECT user_id::VARCHAR AS record_id, '[{"content":"before","role":"assistant"},{"content":"ask ' || user_id || '","role":"user"}]' AS messages_json,
  '[{"arguments":"{}","error":"e","name":"n"}]' AS tool_context_json, '{"a":1,"b":' || user_id || '}' AS runtime_json FROM events GROUP BY ALL
""")
def model_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("user_id").cast("string")
    call = F.struct(F.lit("n").alias("name"), F.lit("{}").alias("arguments"), F.lit(None).cast("string").alias("result"), F.lit("e").alias("error"))
    rows = table(spark, sf_dir, "events").select("user_id").distinct().select(
        i.alias("record_id"), F.array(F.struct(F.lit("assistant").alias("role"), F.lit("before").alias("content"))).alias("conversation_context"),
        F.concat(F.lit("ask "), i).alias("user_input"), F.array(call).alias("tool_calls"), F.concat(F.lit('{ "b": '), i, F.lit(', "a": 1}')).alias("runtime"),
    )
    return prepare.model_context(rows)


@query("""
SELECT doc_id::VARCHAR AS case_id, (doc_id % 9) / 10.0::DOUBLE AS confidence FROM documents WHERE doc_id % 9 < 5
""")
def low_confidence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), ((F.col("doc_id") % 9) / 10).alias("confidence"))
    return prepare.low_confidence(rows)


@query("""
SELECT (SELECT count(*) FROM part) AS guidelines, (SELECT count(*) FROM part WHERE p_size > 2) AS included, (SELECT count(*) FROM part WHERE p_size > 2 AND p_size % 2 = 0) AS strong,
  (SELECT count(*) FROM events WHERE event_id % 3 = 1) AS cannot_fix_lessons, (SELECT count(*) FROM events WHERE event_id % 3 = 2) AS set_aside_lessons, (SELECT count(*) FROM documents WHERE lang = 'en') AS trace_inferred_cases
""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    guidelines = table(spark, sf_dir, "part").select((F.col("p_size") > 2).alias("included"), F.when(F.col("p_size") % 2 == 0, "strong").otherwise("emerging").alias("strength"))
    placed = table(spark, sf_dir, "events").select(_pick(F.col("event_id"), "guideline", "cannot_fix", "set_aside").alias("place"))
    cases = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "trace_inferred").otherwise("guideline_grounded").alias("provenance"))
    return prepare.catalog_summary(guidelines, placed, cases)


@query("""
SELECT 'G' || s_suppkey AS guideline_id, CASE s_suppkey % 4 WHEN 0 THEN 'no_reply' WHEN 1 THEN 'instructions' END AS code, CASE WHEN s_suppkey % 4 > 1 THEN 'Do ' || s_suppkey END AS title,
  CASE WHEN s_suppkey % 4 > 1 THEN 1 END AS steps FROM supplier WHERE s_suppkey % 5 > 0
""")
def memory_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a guideline, included but for every fifth; replies are missing, cite a foreign criterion, or hold."""
    i = F.col("s_suppkey")
    name = F.concat(F.lit("G"), i.cast("string"))
    suppliers = table(spark, sf_dir, "supplier")
    guidelines = suppliers.select(name.alias("guideline_id"), (i % 5 > 0).alias("included"), F.array(F.struct(F.concat(name, F.lit(".c1")).alias("criterion_id"))).alias("criteria"))
    card = F.concat(
        F.lit('{"memory_card":{"title":"Do '), i.cast("string"), F.lit('","summary":"s","when_to_use":["w"],"when_not_to_use":[],"instructions":[{"text":"go","source_criterion_ids":["'),
        name, F.when(i % 4 == 1, ".c9").otherwise(".c1"), F.lit('"]}],"avoid":[],"tool_guidance":[],"example_steps":[{"text":"e","source_trace_ids":["t'), i.cast("string"), F.lit('"]}]}}'),
    )
    told = suppliers.filter("s_suppkey % 4 > 0").select(name.alias("guideline_id"), card.alias("raw"))
    bound = suppliers.select(F.concat(F.lit("t"), i.cast("string")).alias("trace_id"), name.alias("guideline_id"))
    found, codes = cards.memory_asset(guidelines, told, bound)
    none = F.lit(None).cast("string")
    return codes.select("guideline_id", "code", none.alias("title"), F.lit(None).cast("int").alias("steps")).unionByName(found.select("guideline_id", none.alias("code"), "title", F.size("example_steps").alias("steps")))


@query("""
SELECT p_partkey::VARCHAR AS case_id, CASE WHEN p_size % 7 = 3 THEN 'failed' ELSE 'succeeded' END AS execution_status,
  CASE WHEN p_size % 7 <> 3 AND p_partkey % 2 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS composite_score, CASE WHEN p_size % 7 = 3 THEN 'timeout' END AS error_category FROM part
""")
def evaluation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are cases of a run that is stopped after its first batch and started again; the results are those of the bundle that it loads."""
    key = F.col("p_partkey").cast("string")
    parts = table(spark, sf_dir, "part")
    expected = F.when(F.col("p_partkey") % 2 == 0, F.element_at(F.split("p_brand", "#"), -1)).otherwise("nothing")
    cases = parts.select(key.alias("case_id"), F.col("p_partkey").alias("pos"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("context"), expected.alias("expected"))

    def chain(context: dict):
        yield "brand", context["brand"]
        if int(context["size"]) % 7 == 3:
            raise TimeoutError(context["size"])
        yield "answer", context["brand"].split("#")[-1]

    path = new_folder(spark, "evaluation")
    given = {"config": {"dataset_path": "part"}, "dimensions": ["model", "prompt"], "batch_size": max(1, cases.count() // 3)}
    evaluation.run_evaluation(cases, path, "run-1", chain, "exact", most_batches=1, **given)
    bundle = evaluation.run_evaluation(cases, path, "run-1", chain, "exact", **given)
    value = F.from_json("raw", "composite_score double, error_category string")
    return bundle.results.select("case_id", "execution_status", value["composite_score"].alias("composite_score"), value["error_category"].alias("error_category"))
