"""Views of runs, cases, transcripts, cards and skills, and reports as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import scores
from evalloom.operators import attribution, cards, reports, transcript, views
from evalloom.plans import run_queries
from evalloom.plans.registry import query
from evalloom.session import table
from evalloom.streaming import progress


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as an episode: clicks and purchases are messages, views tool calls of which thirds fail and return."""
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'purchase', 'view')")
    none = F.lit(None).cast("string")
    call = F.concat(F.lit("c"), F.col("event_id").cast("string"))

    def event(offset: int, **fields) -> F.Column:
        names = ("type", "role", "content", "call_id", "name", "arguments", "result", "error")
        return F.struct((F.col("event_id") * 2 + offset).cast("int").alias("sequence"), *[fields.get(n, none).cast("string").alias(n) for n in names])

    i = F.col("event_id") % 3
    said = event(0, type=F.lit("message"), role=F.when(F.col("event_type") == "click", "user").otherwise("assistant"), content=F.col("props"))
    called = event(0, type=F.lit("tool_call"), call_id=call, name=F.lit("look"), arguments=F.col("props"))
    told = event(1, type=F.lit("tool_result"), call_id=call, error=F.when(i == 0, F.lit("broken")), result=F.when(i == 1, F.lit(' {"k": 1, "other": [2]} ')))
    rows = F.when(F.col("event_type") != "view", F.array(said)).when(i == 2, F.array(called)).otherwise(F.array(called, told))
    each = e.select("user_id", F.explode(rows).alias("x")).groupBy("user_id").agg(F.collect_list("x").alias("events"))
    context = F.array().cast("array<struct<role: string, content: string>>")
    calls = F.array().cast("array<struct<name: string, arguments: string, result: string, error: string>>")
    return each.select(
        F.col("user_id").cast("string").alias("record_id"), F.lit("g").alias("group_id"), F.lit("t").alias("task_type"), F.lit("r").alias("route"), F.lit("ask").alias("user_input"),
        context.alias("conversation_context"), calls.alias("tool_calls"), F.lit("{}").alias("runtime"), none.alias("assistant_output"), "events",
    )


@query("""
WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase', 'view')),
u AS (SELECT user_id, count(*) FILTER (event_type = 'click') = 0 AS request FROM e GROUP BY ALL),
rows AS (
  SELECT user_id, -1 AS o, 'user' AS role, NULL AS outcome, NULL AS error, NULL AS result FROM u WHERE request
  UNION ALL SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'assistant' END,
    CASE WHEN event_type = 'view' THEN (['error_returned', 'result_returned', 'not_recorded'])[event_id % 3 + 1] END,
    CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN '"broken"' END, CASE WHEN event_type = 'view' AND event_id % 3 = 1 THEN '{"k":1}' END FROM e
)
SELECT user_id::VARCHAR AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY o) - 1 AS pos, role, outcome, error, result FROM rows
""")
def transcript_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = transcript.episode_views(_records(spark, sf_dir), keep="^k$").select("record_id", F.posexplode("transcript").alias("pos", "e"))
    return shown.select("record_id", F.col("pos").cast("long").alias("pos"), *[F.col("e")[c].alias(c) for c in ("role", "outcome", "error", "result")])


@query("""
SELECT user_id::VARCHAR AS record_id, CASE WHEN user_id % 2 = 0 THEN 'praise' END AS feedback FROM events
WHERE event_type IN ('click', 'purchase', 'view') AND user_id % 3 <> 0 AND (user_id % 2 = 0 OR user_id % 5 > 9) GROUP BY ALL
""")
def observed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the users are in train, half of all are labeled; unlabeled ones are not observed."""
    n = F.col("record_id").cast("long")
    rows = _records(spark, sf_dir).withColumns({"split": F.when(n % 3 == 0, "test").otherwise("train"), "labeled": n % 2 == 0, "feedback": F.lit("praise")})
    return transcript.observed(rows).select("record_id", "feedback")


@query("""
SELECT p_partkey, 'Runtime memory: ' || p_name || chr(10) || 'Use this as relevant prior experience. Current system instructions, policies, tool definitions, and observed state take precedence.'
  || chr(10) || p_type || chr(10) || chr(10) || 'Use when:' || chr(10) || '- ' || p_brand
  || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Do not use when:' || chr(10) || '- never' ELSE '' END
  || chr(10) || chr(10) || 'Procedure:' || chr(10) || '1. look' || chr(10) || '2. act'
  || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || 'Avoid:' || chr(10) || '- haste' ELSE '' END AS memory
FROM part
""")
def memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda t: F.struct(F.lit(t).alias("text"))
    empty = F.array().cast("array<struct<text: string>>")
    card = F.struct(
        F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.array("p_brand").alias("when_to_use"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("never"))).otherwise(F.array().cast("array<string>")).alias("when_not_to_use"),
        F.array(item("look"), item("act")).alias("instructions"), F.when(F.col("p_size") % 3 == 0, F.array(item("haste"))).otherwise(empty).alias("avoid"),
        empty.alias("tool_guidance"), empty.alias("example_steps"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", cards.rendered(card).alias("memory"))


@query("""
WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE event_type IN ('click', 'purchase', 'view'))
SELECT 't' || user_id AS trace_id, user_id::VARCHAR AS source_record_id, 'g' || user_id % 4 AS source_group, 'inferred_training_trace' AS evidence_tier,
  0.5::DOUBLE AS rubric_confidence, 'own' || user_id AS criterion, count(*) >= 1 AS traced FROM c GROUP BY ALL
""")
def inferred_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    group = lambda name, text: F.struct(F.lit(name).alias("guideline_id"), F.array(text).alias("criteria"))
    n = F.col("record_id")
    cases = records.select(
        F.concat(F.lit("inferred-"), n).alias("case_id"), "record_id", F.concat(F.lit("g"), (n.cast("long") % 4).cast("string")).alias("group_id"), "route", "task_type",
        F.lit(0.5).alias("confidence"), F.array(group("G001", F.lit("x")), group("case", F.concat(F.lit("own"), n))).alias("groups"), F.concat(F.lit("t"), n).alias("alias"),
    )
    found = cards.inferred_traces(cases, records)
    return found.select("trace_id", "source_record_id", "source_group", "evidence_tier", "rubric_confidence", F.col("case_criteria")[0].alias("criterion"), (F.size("trace.transcript") >= 1).alias("traced"))


@query("""
WITH r AS (SELECT user_id AS run_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT run_id, i AS index, event_id AS case_id, value AS score, 2 AS total_tool_calls, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS failed_tool_calls FROM r
""")
def case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.case_summaries(_results(spark, sf_dir))
    return found.select("run_id", F.col("index").cast("long").alias("index"), "case_id", "score", "total_tool_calls", "failed_tool_calls")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.array(F.struct(F.lit("").alias("error")), F.struct(F.when(F.col("event_id") % 3 == 0, "broken").alias("error")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("case_id"), F.col("event_type").alias("task_type"), F.col("value").alias("score"), calls.alias("calls")
    )


@query("""
SELECT user_id AS run_id, count(*)::INT AS cases FROM events WHERE user_id % 4 <> 1 GROUP BY ALL
""")
def run_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct().withColumn("authority", F.when(F.col("run_id") % 4 == 1, "foreign_rejected").otherwise("authoritative"))
    return views.run_view(runs, _results(spark, sf_dir)).select("run_id", F.size("cases").alias("cases"))


@query("""
WITH r AS (SELECT user_id AS run_id, event_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT case_id, p_name AS truth FROM r LEFT JOIN part ON p_partkey = case_id WHERE run_id = (SELECT min(user_id) FROM events) AND i = 0
""")
def case_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    truth = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("truth"), F.col("p_type").alias("task_type"))
    return views.case_with_truth(_results(spark, sf_dir), truth, first, 0).select("case_id", "truth")


@query("""
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos % 2, pos) - 1 AS call_index
FROM (SELECT l_orderkey AS case_id, l_linenumber AS pos, min(l_partkey) AS tool FROM lineitem GROUP BY ALL)
""")
def call_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("tool"))
    return views.call_indices(calls.withColumn("iteration", F.col("pos") % 2)).select("case_id", "pos", "tool", F.col("call_index").cast("long").alias("call_index"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k=x' ELSE '' END AS texts, CASE WHEN event_id % 3 = 1 THEN '{"tool":"t"}' ELSE '' END AS calls,
  CASE event_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'a|2' ELSE '' END AS notes, CASE event_id % 3 WHEN 0 THEN 'a:1.5|b:2.0' WHEN 1 THEN 'z:1.0|a:0.5' ELSE '' END AS timings FROM events
""")
def safe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(*texts: str) -> F.Column:
        return F.try_parse_json(F.get(F.array(*map(F.lit, texts)), F.col("event_id") % 3))

    texts = views.text_entries(pick('{"k":"x","n":1}', "[1]", "null"))
    calls = views.objects(pick("{}", '[{"tool":"t"}, 1, "x"]', "[]"))
    timings = F.transform(views.timing_pairs(pick('{"b":2,"a":1.5}', '[["z",1],["a",0.5]]', "null")), lambda t: F.concat_ws(":", t["name"], F.round(t["seconds"], 1).cast("string")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(F.array_join(F.transform(F.map_entries(texts), lambda e: F.concat_ws("=", e["key"], e["value"])), "|"), F.lit("")).alias("texts"),
        F.coalesce(F.array_join(calls, "|"), F.lit("")).alias("calls"), F.array_join(views.diagnostics(pick('"one"', '["a", 2, null]', "{}")), "|").alias("notes"), F.array_join(timings, "|").alias("timings"),
    )


@query("""
WITH c AS (SELECT user_id AS call_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT call_id, n AS ordinal, 'm' AS model, event_id AS input_tokens, NULL::BIGINT AS total_tokens FROM c WHERE call_id % 4 <> 0
""")
def transport_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every fourth user start at 2, which is a gap."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + (F.col("user_id") % 4 == 0).cast("int")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("pos"), n.alias("n"))
    raw = F.concat(F.lit('{"transport_ordinal":'), F.col("n").cast("string"), F.lit(',"secret":"s","model":"m","usage":{"input_tokens":'), F.col("pos").cast("string"), F.lit(',"total_tokens":"x"}}'))
    found, _ = views.call_metadata(rows.select("call_id", "pos", raw.alias("raw")))
    return found.select("call_id", "ordinal", "model", "input_tokens", "total_tokens")


@query(r"""
SELECT user_id AS tenant, sum(CASE WHEN event_id % 4 > 0 THEN event_id % 10 ELSE 0 END)::BIGINT AS variants_tried FROM events GROUP BY ALL
""")
def variants_tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 10).cast("string")).otherwise("many").alias("variants_tried"))
    return views.variants_tried(rows, "tenant")


@query(r"""
SELECT s_nationkey AS tenant, string_agg('### Skill ' || s_suppkey || chr(10) || chr(10) || s_name, chr(10) || chr(10) ORDER BY s_suppkey) AS block FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY ALL
UNION ALL SELECT s_nationkey, '' FROM supplier GROUP BY s_nationkey HAVING bool_and(s_suppkey % 3 = 0)
""")
def skills_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    body = F.when(i % 3 > 0, F.col("s_name")).otherwise("  ")
    text = F.concat(F.when(i % 2 == 0, "---\nname: x\n---\n").otherwise(""), F.lit("<!-- licence -->\n"), body, F.lit("\n"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tenant"), F.concat(F.lit("skills/skill_"), i.cast("string"), F.lit("/variant-001.md")).alias("path"), text.alias("text"), i.alias("pos"))
    return views.skills_block(rows, "tenant")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN sha256(p_name) ELSE 'abc' END AS hash, 'Be ' || p_brand AS system, '[{"title":"a","sent_id":1},{"title":"b","sent_id":2}]' AS facts,
  p_brand || '/5' AS settings FROM part WHERE p_size % 5 > 0
""")
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kept = views.pruned(part, "p_partkey", part.filter("p_size % 5 = 0"))
    given = F.try_parse_json(F.concat(F.lit('{"model":"'), "p_brand", F.lit('","other":1}')))
    known = views.settings(given, {"model": "none", "retries": "5"})
    return kept.select(
        "p_partkey", views.repaired_hash(F.when(F.col("p_size") % 2 == 0, "0" * 40).otherwise("abc"), F.col("p_name")).alias("hash"),
        views.system_message(F.concat(F.lit("# x\nSystem: Be "), "p_brand", F.lit("\n\nUser: ask\n"))).alias("system"),
        F.to_json(views.supporting_facts(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1), F.lit(2)))).alias("facts"), F.concat_ws("/", known["model"], known["retries"]).alias("settings"),
    )


@query("""
SELECT run_id, schema_version, result_count FROM (SELECT 'run-' || s_suppkey AS run_id, '1' AS schema_version, (s_suppkey % 9)::VARCHAR AS result_count FROM supplier)
""")
def manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey").cast("string")
    raw = F.concat(F.lit('{"schema_version":1,"secret":"s","run_id":"run-'), i, F.lit('","result_count":'), (F.col("s_suppkey") % 9).cast("string"), F.lit("}"))
    return views.manifest_facts(table(spark, sf_dir, "supplier").select(raw.alias("raw")), "raw").select("run_id", "schema_version", "result_count")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 50.0 ELSE 0.0 END::DOUBLE AS arguments, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS repeated,
  CASE event_id % 4 WHEN 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS exact, (['100', '50', '0', '100'])[event_id % 4 + 1]::DOUBLE AS form, 70.0::DOUBLE AS judged,
  CASE WHEN event_id % 2 = 0 THEN 'told' ELSE 'last' END AS output
FROM events
""")
def trajectory_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    args = lambda v: F.create_map(F.lit("n"), v, F.lit("unit"), F.lit("m"))
    call = lambda v: F.struct(F.lit("add").alias("tool"), args(v).alias("arguments"))
    step = lambda v: F.struct(F.lit("add").alias("tool"), F.create_map(F.lit("n"), F.lit(v)).alias("arguments"))
    calls = F.array(call(F.when(i % 3 == 2, "9").otherwise("1")), call(F.when(i % 3 == 0, "2").otherwise("8")), call(F.when(i % 2 == 1, "5").when(i % 3 == 0, "2").otherwise("8")))
    steps = F.array(F.struct(F.lit("a").alias("name"), F.lit("first").alias("output")), F.struct(F.lit("b").alias("name"), F.lit("last").alias("output")))
    reply = F.get(F.array(F.lit("CWE-79"), F.lit("It is CWE-80."), F.lit("none"), F.lit(" cwe-7 ")), i % 4)
    exact, form = scores.identifier_score(reply, F.lit("CWE-79"))
    return table(spark, sf_dir, "events").select(
        "event_id", scores.argument_match(calls, F.array(step("1"), step("2"))).alias("arguments"), scores.repeated_calls(calls).alias("repeated"), exact.alias("exact"), form.alias("form"),
        scores.judged(F.lit(80.0), F.lit(40.0), 3.0, 1.0).alias("judged"), scores.final_output(F.when(i % 2 == 0, F.lit("told")), steps).alias("output"),
    )


@query("""
WITH l AS (SELECT l_suppkey AS run_id, l_orderkey * 8 + l_linenumber AS case_id, min(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT run_id, case_id, CASE WHEN q % 3 = 0 THEN 'answer' ELSE 'retrieve_docs' END AS step, CASE WHEN q % 3 = 0 THEN 'format_failure' ELSE 'retrieval_empty' END AS heuristic
FROM l WHERE run_id % 5 > 0 AND q < 30 AND q % 3 < 2
""")
def verified_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every fifth supplier did not pass their checks and are left out."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("case_id")).agg(F.min("l_quantity").alias("q"))
    rows = rows.filter("q % 3 < 2")
    step = lambda name, output: F.struct(F.lit(name).alias("name"), output.alias("output"))
    steps = F.array(step("retrieve_docs", F.when(F.col("q") % 3 == 0, "the question and its facts").otherwise("")), step("answer", F.lit("I think that the answer is surely forty two")))
    error = F.lit(None).cast("struct<tool: string, message: string>")
    results = rows.select("run_id", "case_id", F.lit(False).alias("failed_execution"), F.when(F.col("q") < 30, 0.0).otherwise(100.0).alias("score"), steps.alias("steps"), error.alias("tool_error"))
    cases = rows.select("run_id", "case_id", F.lit("the question").alias("question"), F.lit('{"other": 1, "label": "forty two"}').alias("expected"))
    issues = rows.filter("run_id % 5 = 0").select("run_id").distinct().withColumn("code", F.lit("in_flight"))
    return attribution.verified(results, cases, issues).select("run_id", "case_id", "step", "heuristic")


@query("""
WITH r AS (SELECT event_id, event_type <> 'error' AS ok, value, user_id FROM events),
c AS (SELECT count(*) AS n, count(*) FILTER (ok) AS k, avg(value) FILTER (ok) AS m FROM r)
SELECT 0 AS section, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS line, unnest(['# Evaluation Summary', '', 'Total cases: ' || n, 'Successful cases: ' || k, 'Infrastructure failures: ' || (n - k), '',
  '## Composite Score', '- average: ' || printf('%.2f', m), '']) AS text FROM c
UNION ALL SELECT 1, unnest([0, 1]), unnest(['## Score Breakdown', '- points_earned: ' || printf('%.2f', avg((event_id % 5)::DOUBLE) FILTER (ok))]) FROM r
UNION ALL SELECT 1, 2, '- points_possible: 5.00'
UNION ALL SELECT 2, unnest([0, 1, 2, 3, 4]), unnest(['', '## Weighted Score', '- weighted_score: ' || printf('%.2f', 100.0 * sum(event_id % 5) FILTER (ok) / (5 * k)), '- total_earned: ' || (sum(event_id % 5) FILTER (ok))::BIGINT,
  '- total_possible: ' || 5 * k]) FROM r, c GROUP BY k
UNION ALL SELECT 4, unnest([0, 1, 2, 3, 4, 5]), unnest(['', '## Trust-Tier Diagnostics', '', '| Trust tier | Total | Successful | Failed | Mean composite score |', '|---|---:|---:|---:|---:|',
  '| trusted_feedback | ' || count(*) || ' | ' || count(*) FILTER (ok) || ' | ' || count(*) FILTER (NOT ok) || ' | ' || printf('%.2f', avg(value) FILTER (ok)) || ' |']) FROM r WHERE event_id % 2 = 0
UNION ALL SELECT 6, unnest([0, 1, 2, 3, 4]), unnest(['', '## Step Attribution', '', '| Step | Failure Count |', '|------|--------------|'])
UNION ALL SELECT 6, 4 + row_number() OVER (ORDER BY n DESC, step), '| ' || step || ' | ' || n || ' |' FROM (SELECT 's' || user_id % 3 AS step, count(*) AS n FROM r WHERE NOT ok GROUP BY ALL)
""")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    earned = (F.col("event_id") % 5).cast("double")
    results = e.select(
        F.col("event_id").alias("case_id"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("score"),
        F.create_map(F.lit("points_earned"), earned, F.lit("points_possible"), F.lit(5.0)).alias("breakdown"),
        F.array().cast("array<struct<name: string, seconds: double>>").alias("timings"), F.when(F.col("event_id") % 2 == 0, "trusted_feedback").alias("tier"),
    )
    attributed = e.filter("event_type = 'error'").select(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("step"), F.lit("cascade").alias("heuristic"))
    return reports.summary_lines(results, attributed)


@query(f"""
WITH {run_queries._SCORES},
m AS (SELECT avg(baseline) AS b, avg(candidate) AS c, median(baseline) AS mb, median(candidate) AS mc FROM changes),
x AS ((SELECT 'regression' AS kind, case_id, delta FROM changes WHERE delta < 0 ORDER BY delta, case_id LIMIT 5) UNION ALL (SELECT 'improvement', case_id, delta FROM changes WHERE delta > 0 ORDER BY delta DESC, case_id LIMIT 5))
SELECT 0 AS section, unnest([0, 1]) AS line, unnest(['# Run Comparison', '']) AS text
UNION ALL SELECT 1, unnest([0, 1, 2, 3, 4]), unnest(['> **EXPLORATORY / UNCONTROLLED:** this comparison does not support causal or headline claims.', '', '## Incompatibilities', '', '- `dataset.mismatch`: other cases'])
UNION ALL SELECT 2, unnest([0, 1, 2, 3, 4, 5]), unnest(['## Composite Score', '- Baseline mean: ' || printf('%.2f', b), '- Candidate mean: ' || printf('%.2f', c), '- Mean delta: ' || printf('%+.2f', c - b),
  '- Median delta: ' || printf('%+.2f', mc - mb), '']) FROM m
UNION ALL SELECT 5, unnest([0, 1]), unnest(['## Largest Regressions', ''])
UNION ALL SELECT 5, 1 + row_number() OVER (ORDER BY delta, case_id), '- ' || case_id || ': ' || printf('%+.2f', delta) FROM x WHERE kind = 'regression'
UNION ALL SELECT 6, unnest([0, 1]), unnest(['## Largest Improvements', ''])
UNION ALL SELECT 6, 1 + row_number() OVER (ORDER BY delta DESC, case_id), '- ' || case_id || ': ' || printf('%+.2f', delta) FROM x WHERE kind = 'improvement'
""")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalloom.operators import runs

    changed = run_queries._changes(spark, sf_dir)
    issues = spark.createDataFrame([("dataset.mismatch", "other cases")], "code string, message string")
    checks = spark.createDataFrame([], "check_name string, baseline double, candidate double, delta double")
    return reports.comparison_lines(runs.comparison(changed), runs.extremes(changed, "case_id"), checks, issues=issues)


@query("""
WITH r AS (SELECT user_id AS run_id, event_id::VARCHAR AS case_id, event_type <> 'error' AS ok, value, event_id % 4 = 0 AS open FROM events),
g AS (SELECT run_id, count(*) AS n, count(*) FILTER (NOT open) AS done, count(*) FILTER (NOT open AND ok) AS good, round(avg(value) FILTER (NOT open AND ok), 6) AS mean, count(*) FILTER (open) AS flying FROM r GROUP BY ALL)
SELECT run_id::VARCHAR AS run_id, done AS completed_cases, good AS successful_cases, mean AS mean_successful, flying::INT AS in_flight, done AS refused_results,
  CASE WHEN run_id % 5 = 0 THEN 'failed' WHEN run_id % 2 = 0 THEN CASE WHEN good = n AND done = n THEN 'completed' WHEN good > 0 THEN 'degraded' ELSE 'failed' END ELSE 'running' END AS status FROM g
""")
def live_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a case that starts; three of four have a result, twice; some runs are marked as completed or failed."""
    e = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id").cast("string").alias("case_id"), "event_id", (F.col("event_type") != "error").alias("ok"), "value", "ts")
    row = lambda kind, score, total=F.lit(None): [F.col("user_id").cast("string").alias("run_id"), "case_id", F.lit(kind).alias("kind"), "ok", score.alias("score"), total.cast("long").alias("total_cases"), "ts"]
    results = e.filter("event_id % 4 <> 0").select(*row("result", F.col("value")))
    marks = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts")).withColumns({"case_id": F.lit(""), "ok": F.lit(True)})
    done, broken = marks.filter("user_id % 2 = 0").select(*row("completed", F.lit(0.0), F.col("n"))), marks.filter("user_id % 5 = 0").select(*row("failed", F.lit(0.0)))
    found = progress.live(e.select(*row("start", F.lit(0.0))).unionAll(results).unionAll(results).unionAll(done).unionAll(broken))
    return found.select("run_id", "completed_cases", "successful_cases", F.round(F.round("mean_successful", 9), 6).alias("mean_successful"), F.col("in_flight").cast("int").alias("in_flight"), "refused_results", "status")
