"""Replies of models, made from events, suppliers and documents so that every rule is broken by known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import replies
from evalloom.plans.registry import query
from evalloom.session import table


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def _observed(spark: SparkSession, sf_dir: str):
    """A user is a batch, its events the records asked for; the user's number decides what is wrong with the reply."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_id"))
    lessons = F.when(F.col("batch") % 6 == 3, "1").otherwise('["x", "y"]')
    episode = F.concat(F.lit('{"record_id":'), _quoted(F.col("event_id")), F.lit(',"lessons":'), lessons, F.lit("}"))
    each = events.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("event_id", episode.alias("e")))).alias("e")).withColumn("e", F.transform("e", lambda x: x["e"]))
    kind = F.col("batch") % 6
    shown = F.when(kind == 0, F.concat("e", F.slice("e", 1, 1))).when(kind == 1, F.slice("e", 2, 1 << 20)).when(kind == 2, F.concat(F.array(F.lit('{"record_id":"none","lessons":[]}')), "e")).otherwise(F.col("e"))
    raw = F.when(kind == 4, '{"episodes":1}').otherwise(F.concat(F.lit('{"episodes":['), F.array_join(shown, ","), F.lit("]}")))
    return replies.observations(events.select("batch", F.col("event_id").cast("string").alias("record_id")), each.select("batch", raw.alias("raw")))


@query("""
SELECT user_id AS batch, (['unexpected_record', 'missing_record', 'unexpected_record', 'lessons_not_list', 'episodes_not_list'])[user_id % 6 + 1] AS code
FROM events WHERE user_id % 6 < 5 GROUP BY ALL
""")
def observation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir)[1]


@query("""
SELECT user_id AS batch, event_id::VARCHAR AS record_id, pos, (['x', 'y'])[pos + 1] AS lesson FROM events CROSS JOIN (VALUES (0), (1)) AS t(pos) WHERE user_id % 6 = 5
""")
def observed_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _observed(spark, sf_dir)[0]
    return found.select("batch", "record_id", "pos", F.try_variant_get("lesson", "$", "string").alias("lesson"))


def _synthesised(spark: SparkSession, sf_dir: str):
    """An event type is a route and its events the lessons: thirds of them in a guideline, set aside, and left out."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("lesson_id"), "event_id")
    ids = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("event_id") % 3 == k, _quoted(F.col("lesson_id"))))), ",")
    criterion = '{"kind":"required","statement":"s","applicability":"a","severity":"major","scoring":"z"}'
    odd = F.when(F.col("route") == "view", '"none",').otherwise("")
    wrong = F.when(F.col("route") == "click", '"kind":"other"').otherwise('"kind":"required"')
    raw = F.concat(
        F.lit('{"guidelines":[{"title":" t ","dividing_line":"d","criteria":['), F.regexp_replace(F.lit(criterion), '"kind":"required"', wrong), F.lit('],"lesson_ids":['), odd, F.col("g"),
        F.lit(']}],"set_aside":[{"lesson_ids":['), F.col("s"), F.lit('],"reason":"thin"}]}'),
    )
    told = events.groupBy("route").agg(ids(0).alias("g"), ids(1).alias("s")).select("route", raw.alias("raw"))
    return replies.synthesis(events.select("route", "lesson_id"), told)


@query("""
SELECT event_type AS route, 'L' || event_id AS lesson_id, CASE event_id % 3 WHEN 0 THEN 'guideline' ELSE 'set_aside' END AS place,
  CASE event_id % 3 WHEN 1 THEN 'thin' WHEN 2 THEN 'not addressed by the model' END AS reason FROM events
""")
def synthesis_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synthesised(spark, sf_dir)[1]


@query("SELECT DISTINCT event_type AS route, CASE event_type WHEN 'view' THEN 'unknown_lesson' ELSE 'kind' END AS code FROM events WHERE event_type IN ('view', 'click')")
def synthesis_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synthesised(spark, sf_dir)[2]


@query("""
SELECT doc_id, (['criteria', 'kind', 'severity', 'statement', 'no_criteria', NULL, 'scoring'])[doc_id % 7 + 1] AS code,
  (['not_unit', 'not_numeric', 'not_numeric', NULL])[doc_id % 4 + 1] AS confidence_code FROM documents
""")
def criteria_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 7
    one = F.struct(
        F.when(k == 1, "must").otherwise("required").alias("kind"), F.when(k == 3, "  ").otherwise("s").alias("statement"), F.lit("a").alias("applicability"),
        F.when(k == 2, "odd").otherwise("minor").alias("severity"), F.when(k == 6, F.lit(None).cast("string")).otherwise("z").alias("scoring"),
    )
    many = F.when(k == 0, F.lit(None)).when(k == 4, F.slice(F.array(one), 1, 0)).otherwise(F.array(one))
    unit = F.get(F.array(*map(F.lit, ("1.5", "true", '"0.5"', "0.5"))), F.col("doc_id") % 4)
    return table(spark, sf_dir, "documents").select("doc_id", replies.criteria_code(many, True).alias("code"), replies.unit_code(F.try_parse_json(unit)).alias("confidence_code"))


@query("""
SELECT s_suppkey AS reply_id, pos, CASE WHEN pos = 0 THEN 'prompt' ELSE 'parameter' END AS level,
  CASE WHEN pos = 0 THEN CASE s_suppkey % 6 WHEN 0 THEN 'module' WHEN 1 THEN 'technique' WHEN 2 THEN 'scope' END
    ELSE CASE WHEN s_suppkey % 4 = 0 THEN 'parameter_bounds' WHEN s_suppkey % 4 = 1 THEN 'parameter_changes' END END AS code
FROM supplier CROSS JOIN (VALUES (0), (2)) AS t(pos)
""")
def analysis_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three plans in each reply, of which the second repeats the first."""
    i = F.col("s_suppkey")
    prompt = F.concat(
        F.lit('{"level":"prompt","module":"'), F.when(i % 6 == 0, "other").otherwise("answer"), F.lit('","scope":"'), F.when(i % 6 == 2, "all").otherwise("edit"),
        F.lit('","technique":"'), F.when(i % 6 == 1, " ").otherwise("examples"), F.lit('","hypothesis":"h"}'),
    )
    changes = F.when(i % 4 == 1, "1").otherwise(F.concat(F.lit('{"top_k":'), F.when(i % 4 == 0, "99").otherwise("5"), F.lit("}")))
    parameter = F.concat(F.lit('{"level":"parameter","technique":"t","hypothesis":"h","parameter_changes":'), changes, F.lit("}"))
    raw = F.concat(F.lit('{"plans":['), F.concat_ws(",", prompt, prompt, parameter), F.lit("]}"))
    rows = table(spark, sf_dir, "supplier").select(i.alias("reply_id"), raw.alias("raw"))
    return replies.plans(rows, ["prompt", "parameter"], ["answer"], {"top_k": (1, 20)}, most=2).select("reply_id", "pos", "level", "code")


@query("""
SELECT s_suppkey AS reply_id, CASE s_suppkey % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'maybe' END AS verdict,
  unnest(CASE s_suppkey % 4 WHEN 0 THEN ['llm_leak', 'llm_review'] WHEN 1 THEN ['llm_tone', 'llm_review'] WHEN 2 THEN ['llm_review'] ELSE ['verdict'] END) AS "check",
  unnest(CASE s_suppkey % 4 WHEN 0 THEN ['warn', 'block'] WHEN 1 THEN ['block', 'warn'] WHEN 2 THEN ['warn'] ELSE ['invalid'] END) AS severity
FROM supplier
""")
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = (
        '{"verdict":"fail","issues":[{"check":"leak","severity":"odd"}]}', '{"verdict":"fail","issues":[{"check":"tone","severity":"block"},{"severity":"warn"}]}',
        '{"verdict":"warn","issues":[{"description":"d"}]}', '{"verdict":"maybe"}',
    )
    raw = F.get(F.array(*map(F.lit, texts)), F.col("s_suppkey") % 4)
    return replies.review_issues(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("reply_id"), raw.alias("raw")))


@query("""
SELECT p_partkey, (['memory_card', 'fields', 'title', 'when_to_use', 'when_not_to_use', 'instructions', 'avoid', 'example_steps', NULL])[p_partkey % 9 + 1] AS code FROM part
""")
def memory_card_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 9
    item = F.concat(F.lit('{"text":"do","source_criterion_ids":["'), F.when(k == 5, "c9").otherwise("c1"), F.lit('"]}'))
    avoid = F.when(k == 6, '[{"text":"x","source_criterion_ids":["c1"],"more":1}]').otherwise("[]")
    steps = F.when(k == 7, '[{"text":"x","source_trace_ids":["t1","t1"]}]').otherwise('[{"text":"x","source_trace_ids":["t1"]}]')
    card = F.concat(
        F.lit('{"title":'), F.when(k == 2, "1").otherwise('"t"'), F.lit(',"summary":"s","when_to_use":'), F.when(k == 3, "[]").otherwise('["a"]'), F.lit(',"when_not_to_use":'),
        F.when(k == 4, '["a","a "]').otherwise("[]"), F.lit(',"instructions":['), item, F.lit('],"avoid":'), avoid, F.when(k == 1, "").otherwise(',"tool_guidance":[]'),
        F.lit(',"example_steps":'), steps, F.lit("}"),
    )
    raw = F.concat(F.lit('{"memory_card":'), card, F.when(k == 0, ',"more":1').otherwise(""), F.lit("}"))
    title = F.when(k == 2, F.regexp_replace(raw, '"title":1', '"title":" "')).otherwise(raw)
    code = replies.card_code(F.try_parse_json(title), F.array(F.lit("c1"), F.lit("c2")), F.array(F.lit("t1")))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 0.0 WHEN 2 THEN 42.5 END::DOUBLE AS score, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 'ok' ELSE '' END AS reason,
  CASE WHEN event_id % 4 = 2 THEN 1 END AS verdicts FROM events
""")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ('```json\n{"score": 250}\n```', 'I say {"score": -3}', 'So: {"score": 42.5, "reason": "ok", "criteria": [{"criterion_id": "c1", "status": "satisfied"}]} .', "no object")
    raw = F.get(F.array(*map(F.lit, texts)), F.col("event_id") % 4)
    v = replies.judge_verdict(raw)
    return table(spark, sf_dir, "events").select("event_id", v["score"].alias("score"), v["reason"].alias("reason"), F.nullif(F.coalesce(F.size(replies.judge_criteria(raw)), F.lit(-1)), F.lit(-1)).alias("verdicts"))
