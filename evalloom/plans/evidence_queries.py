"""Rubric, trajectory and pattern queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import scores
from evalloom.operators import evidence
from evalloom.plans.registry import query
from evalloom.session import table

_LABELS = """pairs AS (SELECT lang AS expected, CASE WHEN doc_id % 9 = 0 THEN 'en' WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS predicted FROM documents),
counts AS (SELECT label, count(*) FILTER (e = label) AS expected, count(*) FILTER (p = label) AS predicted, count(*) FILTER (e = label AND p = label) AS hits
  FROM (SELECT expected AS label, expected AS e, NULL AS p FROM pairs WHERE expected <> predicted UNION ALL SELECT predicted, NULL, predicted FROM pairs WHERE expected <> predicted
    UNION ALL SELECT expected, expected, predicted FROM pairs WHERE expected = predicted) WHERE label <> '' GROUP BY ALL),
metrics AS (SELECT label, expected, predicted, round(CASE WHEN predicted > 0 THEN 100.0::double * hits / predicted ELSE 0 END, 2) AS precision,
  round(CASE WHEN expected > 0 THEN 100.0::double * hits / expected ELSE 0 END, 2) AS recall, round(200.0::double * hits / (expected + predicted), 2) AS f1 FROM counts)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when(F.col("doc_id") % 9 == 0, "en").when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("expected"), wrong.alias("predicted"))


@query(f"WITH {_LABELS} SELECT label, expected, predicted, precision, recall, f1 FROM metrics")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.label_metrics(_pairs(spark, sf_dir), "expected", "predicted")


@query(f"WITH {_LABELS} SELECT round(avg(f1), 6) AS macro_f1, count(*) AS labels FROM metrics")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.label_metrics(_pairs(spark, sf_dir), "expected", "predicted")
    return found.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("labels"))


@query("""
WITH c AS (SELECT l_orderkey AS case_id, CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' END AS severity,
  CASE WHEN l_quantity < 10 THEN 'satisfied' WHEN l_quantity < 20 THEN 'partial' WHEN l_quantity < 30 THEN 'violated' WHEN l_quantity < 40 THEN 'not_applicable' END AS status FROM lineitem),
v AS (SELECT case_id, severity, status, CASE severity WHEN 'critical' THEN 3.0 WHEN 'minor' THEN 1.0 ELSE 2.0 END AS w,
  CASE WHEN status = 'not_applicable' THEN NULL WHEN status = 'satisfied' THEN 1.0 WHEN status = 'partial' THEN 0.5 ELSE 0.0 END AS val FROM c)
SELECT case_id, round((100.0 * sum(val * w) / nullif(sum(w) FILTER (val IS NOT NULL), 0))::DOUBLE, 4) AS judge_score,
  count(*) FILTER (severity = 'critical' AND val IS NOT NULL AND coalesce(status, '') <> 'satisfied') AS critical_violations, count(val) AS applicable
FROM v GROUP BY ALL
""")
def severity_weighted_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber") % 4, F.col("l_quantity")
    severity = F.when(n == 0, "critical").when(n == 1, "major").when(n == 2, "minor")
    status = F.when(q < 10, "satisfied").when(q < 20, "partial").when(q < 30, "violated").when(q < 40, "not_applicable")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), severity.alias("severity"), status.alias("status"))
    return evidence.judge(rows, "case_id", "severity", "status")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as tool calls in order; errors are failed calls."""
    call = F.struct(F.col("ts"), F.col("event_id"), F.col("event_type").alias("tool"), F.col("props"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(call)).alias("calls"))


_TRAJECTORY = """
calls AS (SELECT user_id, event_type AS tool, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
ok AS (SELECT * FROM calls WHERE tool <> 'error'),
s1 AS (SELECT user_id, min(i) AS i FROM ok WHERE tool = 'view' GROUP BY ALL),
s2 AS (SELECT user_id, min(ok.i) AS i FROM ok JOIN s1 USING (user_id) WHERE tool = 'click' AND ok.i > s1.i GROUP BY ALL),
s3 AS (SELECT user_id, min(ok.i) AS i FROM ok JOIN s2 USING (user_id) WHERE tool = 'purchase' AND ok.i > s2.i GROUP BY ALL),
t AS (SELECT user_id, count(*) FILTER (tool = 'error') AS failed, count(DISTINCT tool) FILTER (tool IN ('view', 'click', 'purchase')) AS hit,
  count(*) FILTER (tool <> 'error') - count(DISTINCT tool || '|' || props) FILTER (tool <> 'error') AS dup FROM calls GROUP BY ALL),
parts AS (SELECT user_id, CASE WHEN hit = 3 THEN 100.0 ELSE hit / 3.0::double * 70.0 END::DOUBLE AS selection,
  ((s1.i IS NOT NULL)::int + (s2.i IS NOT NULL)::int + (s3.i IS NOT NULL)::int) / 3.0::double * 100.0 AS ordering,
  greatest(0.0, 100.0 - 20.0 * failed - 15.0 * dup)::DOUBLE AS redundancy, failed, dup
  FROM t LEFT JOIN s1 USING (user_id) LEFT JOIN s2 USING (user_id) LEFT JOIN s3 USING (user_id))
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.array(*map(F.lit, ("view", "click", "purchase")))
    calls = _calls(spark, sf_dir).withColumn("ok", F.filter("calls", lambda c: c["tool"] != "error"))
    tools = F.transform("ok", lambda c: c["tool"])
    kinds = F.transform("ok", lambda c: F.concat_ws("|", c["tool"], c["props"]))
    failed, dup = F.size("calls") - F.size("ok"), F.size("ok") - F.size(F.array_distinct(kinds))
    return calls.select(
        "user_id",
        scores.tool_selection(F.array_distinct(tools), expected).alias("selection"),
        scores.call_ordering(tools, expected).alias("ordering"),
        scores.non_redundancy(failed, dup).alias("redundancy"),
        failed.cast("long").alias("failed"), dup.cast("long").alias("dup"),
    )


@query(f"WITH {_TRAJECTORY} SELECT user_id, round(selection, 6) AS selection, round(ordering, 6) AS ordering, round(0.35 * selection + 0.2 * ordering + 0.3 * 100 + 0.15 * redundancy, 6) AS score FROM parts")
def trajectory_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    score = scores.trajectory(F.col("selection"), F.col("ordering"), F.lit(100.0), F.col("redundancy"))
    return p.select("user_id", F.round("selection", 6).alias("selection"), F.round("ordering", 6).alias("ordering"), F.round(score, 6).alias("score"))


@query(f"WITH {_TRAJECTORY} SELECT user_id, failed, dup, redundancy FROM parts")
def dup_call_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("user_id", "failed", "dup", "redundancy")


@query("""
WITH p AS (SELECT p_partkey, p_brand AS guideline, p_size % 3 AS kind, upper(p_type) || ' -- ' || (p_partkey % 5) AS text, p_partkey % 17 AS grp, p_retailprice AS conf FROM part)
SELECT guideline, kind, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key, min_by(text, p_partkey) AS text, count(DISTINCT p_partkey) AS sources,
  count(DISTINCT grp) AS support, max(conf) AS confidence FROM p GROUP BY guideline, kind, key
""")
def pattern_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("guideline"), (F.col("p_size") % 3).alias("kind"),
        F.concat(F.upper("p_type"), F.lit(" -- "), F.col("p_partkey") % 5).alias("text"), (F.col("p_partkey") % 17).alias("grp"), F.col("p_retailprice").alias("conf"),
    )
    return evidence.consolidate_patterns(rows, "guideline", "kind", "text", "p_partkey", "grp", "p_partkey", "conf")


@query("""
SELECT p_brand AS guideline, count(DISTINCT p_partkey % 50) AS support, count(DISTINCT p_partkey % 50) >= 2 AS included, count(DISTINCT p_partkey % 50) >= 3 AS strong FROM part GROUP BY ALL
""")
def guideline_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("guideline"), (F.col("p_partkey") % 50).alias("record"))
    return evidence.guideline_support(rows, "guideline", "record")


@query("SELECT n_name AS route FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def routes_without_guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(covered, "n_nationkey", "left_anti").select(F.col("n_name").alias("route"))


@query("""
SELECT l_suppkey AS guideline, count(DISTINCT l_partkey) AS trusted, round(avg(l_discount), 4) AS confidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
""")
def guideline_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    lessons = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return lessons.groupBy(F.col("l_suppkey").alias("guideline")).agg(F.count_distinct("l_partkey").alias("trusted"), F.round(F.avg("l_discount"), 4).alias("confidence"))
