"""Progress, summaries and comparison of runs.

A part is a case and a return flag a run; a user's events are a run's results or a case's step visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import ordering, runs
from evalloom.plans.registry import query
from evalloom.session import table

_SCORES = """
scores AS (
  SELECT l_returnflag AS run, l_partkey AS case_id, 2 * sum(l_quantity) / count(*) AS score
  FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL
), changes AS (
  SELECT b.case_id, b.score AS baseline, c.score AS candidate, c.score - b.score AS delta
  FROM scores b JOIN scores c USING (case_id) WHERE b.run = 'A' AND c.run = 'R'
)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a part in a run: twice its mean quantity, 2 to 100."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    keys = [F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("case_id")]
    return lines.groupBy(*keys).agg((2 * F.sum("l_quantity") / F.count("*")).alias("score"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    return runs.case_changes(scores.filter("run = 'A'"), scores.filter("run = 'R'"), "case_id")


@query(f"""
WITH {_SCORES}
SELECT count(*) AS shared, round(avg(baseline), 6) AS baseline_mean, round(avg(candidate), 6) AS candidate_mean,
  round(median(baseline), 6) AS baseline_median, round(median(candidate), 6) AS candidate_median,
  count(*) FILTER (delta < 0) AS regressions, count(*) FILTER (delta > 0) AS improvements,
  round(avg(candidate) - avg(baseline), 6) AS mean_delta
FROM changes
""")
def paired_run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.comparison(_changes(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])


@query(f"""
WITH {_SCORES}
(SELECT 'regression' AS kind, case_id, round(delta, 6) AS delta FROM changes WHERE delta < 0 ORDER BY changes.delta, case_id LIMIT 5)
UNION ALL
(SELECT 'improvement' AS kind, case_id, round(delta, 6) AS delta FROM changes WHERE delta > 0 ORDER BY changes.delta DESC, case_id LIMIT 5)
""")
def case_regressions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.extremes(_changes(spark, sf_dir), "case_id").select("kind", "case_id", F.round("delta", 6).alias("delta"))


@query("""
WITH m AS (
  SELECT 'step' || l_linenumber AS check_name,
    avg(l_quantity) FILTER (l_returnflag = 'A') AS baseline, avg(l_quantity) FILTER (l_returnflag = 'N' AND l_linenumber > 2) AS candidate
  FROM lineitem GROUP BY ALL
)
SELECT check_name, round(coalesce(baseline, 0), 6) AS baseline, round(coalesce(candidate, 0), 6) AS candidate,
  round(coalesce(candidate, 0) - coalesce(baseline, 0), 6) AS delta
FROM m WHERE baseline IS NOT NULL OR candidate IS NOT NULL
""")
def check_deltas_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("check_name", F.concat(F.lit("step"), "l_linenumber"))
    found = runs.grouped_deltas(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'N' and l_linenumber > 2"), "check_name", "l_quantity")
    return found.select("check_name", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")])


@query("""
SELECT step, count(*) AS cases, round(avg(s), 6) AS mean_s
FROM (SELECT event_type AS step, user_id, sum(value) AS s FROM events GROUP BY ALL) GROUP BY step
""")
def timing_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = table(spark, sf_dir, "events").withColumnRenamed("event_type", "step")
    found = runs.timings_per_case(visits, "user_id", "step", "value")
    return found.withColumn("mean_s", F.round("mean_s", 6))


@query("""
SELECT event_type AS step, count(*) AS visits, round(avg(value), 6) AS mean_s, round(median(value), 6) AS p50_s,
  quantile_disc(value, 0.95) AS p95_s
FROM events GROUP BY ALL
""")
def step_timing_p50_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = table(spark, sf_dir, "events").withColumnRenamed("event_type", "step")
    found = runs.timings(visits, "step", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_s", "p50_s")})


_PROGRESS = """
SELECT user_id AS run_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded,
  count(*) FILTER (event_type = 'error') AS failed
FROM events GROUP BY ALL
"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    return runs.progress(results, "run_id", F.col("event_type") != "error", F.col("value"))


@query(f"""
SELECT *, CASE WHEN succeeded = total THEN 'completed' WHEN succeeded > 0 THEN 'degraded' ELSE 'failed' END AS status
FROM ({_PROGRESS})
""")
def progress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).select("run_id", "total", "succeeded", "failed", "status")


@query("""
SELECT user_id AS run_id, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_successful,
  round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) / count(*), 6) AS mean_failed_zero
FROM events GROUP BY ALL
""")
def mean_success_only_vs_failed_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _progress(spark, sf_dir)
    return found.select("run_id", F.round("mean_successful", 6).alias("mean_successful"), F.round("mean_failed_zero", 6).alias("mean_failed_zero"))


@query("""
SELECT l_linestatus AS scorer, round(100 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 6) AS weighted_score
FROM lineitem GROUP BY ALL
""")
def weighted_points_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "scorer")
    earned = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)
    found = runs.weighted_points(lines, ["scorer"], earned, F.col("l_quantity"))
    return found.withColumn("weighted_score", F.round("weighted_score", 6))


_TIER = """CASE WHEN quality = 1 THEN 'trusted_feedback' WHEN quality = 0 THEN 'inferred_from_trusted_feedback'
  ELSE 'synthetic_from_trusted_rubric' END"""


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the trust tier that their label gives them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    tier = (
        F.when(F.col("quality") == 1, "trusted_feedback")
        .when(F.col("quality") == 0, "inferred_from_trusted_feedback")
        .otherwise("synthetic_from_trusted_rubric")
    )
    return docs.join(labels, "doc_id", "left").withColumn("tier", tier)


@query(f"""
SELECT {_TIER} AS tier, count(*) AS total, count(*) FILTER (coalesce(toxic, 0) = 0) AS succeeded,
  count(*) FILTER (toxic = 1) AS failed, round(avg(n_chars) FILTER (coalesce(toxic, 0) = 0), 6) AS mean_score
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL
""")
def trust_tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce("toxic", F.lit(0)) == 0
    found = runs.progress(_tiers(spark, sf_dir), "tier", ok, F.col("n_chars"))
    return found.select("tier", "total", "succeeded", "failed", F.round("mean_successful", 6).alias("mean_score"))


@query(f"""
SELECT lang AS split, count(*) FILTER (tier = 'trusted_feedback') AS trusted,
  count(*) FILTER (tier = 'inferred_from_trusted_feedback') AS inferred, count(*) FILTER (tier = 'synthetic_from_trusted_rubric') AS synthetic
FROM (SELECT lang, {_TIER} AS tier FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL
""")
def split_tier_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"trusted": "trusted_feedback", "inferred": "inferred_from_trusted_feedback", "synthetic": "synthetic_from_trusted_rubric"}
    found = _tiers(spark, sf_dir).groupBy("lang").pivot("tier", list(names.values())).count().na.fill(0)
    return found.select(F.col("lang").alias("split"), *[F.col(v).alias(k) for k, v in names.items()])


@query(f"""
WITH {_SCORES}
(SELECT 'improved' AS kind, case_id FROM changes WHERE candidate >= 60 AND baseline < 60 ORDER BY case_id LIMIT 40)
UNION ALL
(SELECT 'regressed' AS kind, case_id FROM changes WHERE candidate < 60 AND baseline >= 60 ORDER BY case_id LIMIT 40)
""")
def case_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    return runs.flips(scores.filter("run = 'A'"), scores.filter("run = 'R'"), "case_id", threshold=60.0)


@query("""
WITH b AS (SELECT l_linenumber AS dimension, sha256(string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus)) AS fp FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
c AS (SELECT l_linenumber AS dimension, sha256(string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus)) AS fp FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber <> 3 GROUP BY ALL)
SELECT dimension, CASE WHEN b.fp IS NULL OR c.fp IS NULL THEN 'missing' WHEN b.fp = c.fp THEN 'same' ELSE 'different' END AS state
FROM b FULL JOIN c USING (dimension)
""")
def run_identity_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")

    def identity(rows: DataFrame) -> DataFrame:
        values = F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",")
        return rows.groupBy(F.col("l_linenumber").alias("dimension")).agg(F.sha2(values, 256).alias("fingerprint"))

    return runs.identity_compatibility(identity(lines.filter("l_returnflag = 'A'")), identity(lines.filter("l_returnflag = 'N' and l_linenumber <> 3")))


@query("""
SELECT event_type AS step, count(*) AS calls, sum(length(props)) AS tokens, count(DISTINCT user_id) AS users FROM events GROUP BY ALL
""")
def usage_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(
        F.count("*").alias("calls"), F.sum(F.length("props")).alias("tokens"), F.count_distinct("user_id").alias("users")
    )


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def top8_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(8).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(50).limit(25)


@query("""
WITH d AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_type FROM events)
SELECT event_type AS step, count(p) AS visits, sum(date_diff('second', p, ts))::BIGINT AS seconds FROM d GROUP BY ALL
""")
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").withColumn("p", F.lag("ts").over(w))
    whole = F.unix_timestamp("ts") - F.unix_timestamp("p")
    return d.groupBy(F.col("event_type").alias("step")).agg(F.count("p").alias("visits"), F.sum(whole).alias("seconds"))


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
t AS (SELECT l_suppkey AS tenant, count(*) AS runs, sum(l_quantity)::BIGINT AS points FROM lineitem GROUP BY ALL)
SELECT count(*) AS tenants, sum(runs)::BIGINT AS runs, sum(points)::BIGINT AS points, (SELECT max(c) FROM n) AS most FROM t
""")
def tenant_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("runs"), F.sum("l_quantity").alias("points"))
    most = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count().agg(F.max("count").alias("most"))  # one row
    total = tenants.agg(F.count("*").alias("tenants"), F.sum("runs").alias("runs"), F.sum("points").cast("long").alias("points"))
    return total.crossJoin(F.broadcast(most))
