"""The candidate search replayed: customers are candidates, their orders iterations and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import values
from evalloom.operators import loop, optimize
from evalloom.plans.registry import query
from evalloom.session import new_folder, table


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is an iteration; every seventh is accepted, every fifth has no candidate, every third an alternative."""
    i = F.col("s_suppkey")
    level = F.when(i % 2 == 0, "prompt").otherwise("parameter")
    other = F.struct(
        F.concat(F.lit("b"), i.cast("string")).alias("candidate_id"), F.lit("c0").alias("parent_id"), F.lit("prompt").alias("level"), F.lit("short").alias("technique"),
        F.col("s_acctbal").alias("train_score"), F.lit(None).cast("double").alias("selection_score"), F.lit(0.0).alias("train_delta"), F.lit("not_selected").alias("reason"),
    )
    return table(spark, sf_dir, "supplier").select(
        i.alias("iteration"), (i % 7 == 0).alias("accepted"), F.when(i % 5 > 0, F.concat(F.lit("c"), i.cast("string"))).alias("candidate_id"), F.lit("c0").alias("parent_id"),
        F.when(i % 5 > 0, level).alias("level"), F.when(i % 5 > 0, F.concat(F.lit("t"), (i % 4).cast("string"))).alias("technique"), F.col("s_acctbal").alias("train_score"),
        F.col("s_acctbal").alias("selection_score"), F.lit(1.0).alias("train_delta"), F.when(i % 10 == 0, "role_error").otherwise("x").alias("reason"),
        F.when(i % 3 == 0, F.array(other)).alias("alternatives"),
    )


_ENTRIES = """
entries AS (
  SELECT s_suppkey AS iteration, 0 AS place, CASE WHEN s_suppkey % 5 > 0 THEN 'c' || s_suppkey END AS candidate_id,
    CASE WHEN s_suppkey % 5 > 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'prompt' ELSE 'parameter' END END AS level, CASE WHEN s_suppkey % 5 > 0 THEN 't' || s_suppkey % 4 END AS technique
  FROM supplier WHERE s_suppkey % 5 > 0 OR s_suppkey % 10 = 0
  UNION ALL
  SELECT s_suppkey, (s_suppkey % 5 > 0 OR s_suppkey % 10 = 0)::INT, 'b' || s_suppkey, 'prompt', 'short' FROM supplier WHERE s_suppkey % 3 = 0
)"""


@query(f"WITH {_ENTRIES} SELECT * FROM entries ORDER BY iteration DESC, place DESC LIMIT 20")
def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop.history(_ledger(spark, sf_dir)).select("iteration", "place", "candidate_id", "level", "technique")


@query(f"""
WITH {_ENTRIES}, last AS (SELECT max(s_suppkey) AS m FROM supplier WHERE s_suppkey % 7 = 0)
SELECT level, count(DISTINCT iteration) AS misses, string_agg(technique, ',' ORDER BY iteration, place) AS techniques FROM entries, last WHERE iteration > coalesce(m, -1) AND level IS NOT NULL GROUP BY level
""")
def search_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop.misses(_ledger(spark, sf_dir)).select("level", "misses", F.array_join("techniques", ",").alias("techniques"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates of the iteration that their nation is; every ninth failed on train."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("iteration"), c.alias("candidate_id"), F.when(c % 9 > 0, F.round("c_acctbal")).alias("train_score"), (c % 4000).cast("double").alias("parent_score")
    )


_SCREEN = """
s AS (SELECT c_nationkey AS iteration, c_custkey AS candidate_id, CASE WHEN c_custkey % 9 > 0 THEN round(c_acctbal) END AS t, (c_custkey % 4000)::DOUBLE AS p FROM customer),
placed AS (SELECT *, coalesce(t - p >= 0, false) AS passed, row_number() OVER (PARTITION BY iteration ORDER BY coalesce(t - p >= 0, false) DESC, t DESC NULLS LAST, candidate_id) = 1 AS chosen FROM s)
"""


@query(f"WITH {_SCREEN} SELECT candidate_id, passed, chosen, CASE WHEN NOT passed THEN 'train_screen' WHEN NOT chosen THEN 'not_selected' END AS reason FROM placed")
def search_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop.screen(_candidates(spark, sf_dir)).select("candidate_id", "passed", "chosen", "reason")


@query(f"""
WITH {_SCREEN}
SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 THEN 'accepted' WHEN candidate_id % 3 = 1 AND t - p > 0 THEN 'accepted_train_tiebreak'
  WHEN candidate_id % 3 = 2 AND t - p > 0 THEN 'accepted' ELSE 'selection_below_threshold' END AS reason FROM placed WHERE passed AND chosen
""")
def search_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the candidates gain on validation, a third tie there, and a third have no validation split."""
    screened = loop.screen(_candidates(spark, sf_dir))
    k = F.col("candidate_id") % 3
    tests = screened.select("candidate_id", F.when(k == 0, 5.0).when(k == 1, 0.0).alias("val_delta"), F.lit(0.9).alias("val_p"), F.lit(0.95).alias("train_p"))
    return loop.decide(screened, tests, 0.0, 0.8).select("candidate_id", "reason")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("candidate_id"), F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") % 6).cast("double").alias("selection_score"), (F.col("s_suppkey") % 4).cast("double").alias("train_score"))


@query("""
WITH top AS (SELECT s_suppkey AS candidate_id, s_suppkey % 6 AS s, s_suppkey % 4 AS t, (s_suppkey % 3)::DOUBLE AS fresh_score FROM supplier ORDER BY s DESC, t DESC, s_suppkey LIMIT 5)
SELECT candidate_id, s::DOUBLE AS selection_score, fresh_score, candidate_id = first(candidate_id) OVER (ORDER BY fresh_score DESC, s DESC, t DESC, candidate_id) AS chosen FROM top
""")
def search_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    fresh = pool.select("candidate_id", (F.col("candidate_id") % 3).cast("double").alias("fresh_score"))
    return loop.final_selection(pool, fresh, 5)


@query("SELECT s_suppkey AS candidate_id FROM supplier ORDER BY s_suppkey % 6 DESC, s_suppkey % 4 DESC, s_suppkey LIMIT 1")
def search_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop.best(_pool(spark, sf_dir))


@query("""
WITH s AS (SELECT l_suppkey % 12 AS m, l_linenumber AS c, sum(l_quantity) % 40 AS s FROM lineitem GROUP BY ALL),
pairs AS (SELECT a.m, b.m AS o, bool_and(b.s >= a.s) AS al, bool_or(b.s > a.s) AS so FROM s a JOIN s b USING (c) WHERE a.m <> b.m GROUP BY ALL),
f AS (SELECT DISTINCT m FROM s WHERE m NOT IN (SELECT m FROM pairs WHERE al AND so)),
v AS (SELECT m, count(*) AS votes FROM (SELECT *, max(s) OVER (PARTITION BY c) AS hi, min(s) OVER (PARTITION BY c) AS lo FROM s) WHERE hi > lo AND s = hi AND m IN (SELECT m FROM f) GROUP BY m),
r AS (SELECT m, sum(votes) OVER (ORDER BY m) AS upto, sum(votes) OVER () AS total FROM v)
SELECT coalesce((SELECT min(m) FROM r WHERE upto > ('0x' || substr(sha256('parent' || chr(31) || '7'), 1, 12))::BIGINT % total), (SELECT m FROM s ORDER BY m % 6 DESC, m LIMIT 1)) AS candidate_id
""")
def search_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [(F.col("l_suppkey") % 12).alias("candidate_id"), F.col("l_linenumber").alias("case_id")]
    scores = table(spark, sf_dir, "lineitem").groupBy(*keys).agg((F.sum("l_quantity") % 40).alias("score"))
    pool = scores.select("candidate_id").distinct().select("candidate_id", F.col("candidate_id").alias("pos"), (F.col("candidate_id") % 6).alias("selection_score"), F.lit(0).alias("train_score"))
    return loop.parent(scores, pool, 7)


@query("""
WITH f AS (SELECT o_orderkey AS case_id, o_orderstatus, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 100000)
SELECT * FROM (SELECT case_id, score FROM f ORDER BY sha256('c003' || chr(31) || case_id), case_id LIMIT 12)
""")
def search_failures_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("execution_status"), F.col("o_totalprice").alias("score")
    )
    return loop.shown_failures(results, 3, 12, 100_000.0).select("case_id", "score")


@query("""
SELECT l_suppkey AS candidate_id, l_partkey AS case_id, round(sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_quantity END) / 2, 6) AS score
FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL
""")
def search_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's two runs are its returned and accepted line items."""
    name = F.concat_ws("-", F.col("l_suppkey").cast("string"), "l_returnflag")
    results = table(spark, sf_dir, "lineitem").select(name.alias("run_id"), F.col("l_partkey").alias("case_id"), F.when(F.col("l_linestatus") == "O", "failed").otherwise("succeeded").alias("execution_status"), F.col("l_quantity").alias("score"))
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("candidate_id"), F.transform(F.array(F.lit("A"), F.lit("R")), lambda f: F.concat_ws("-", F.col("s_suppkey").cast("string"), f)).alias("runs"))
    return loop.restored(ids, results).withColumn("score", F.round("score", 6))


@query("""
SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '[' || (length(text) - 300) || ' chars truncated]' ELSE text END AS context, coalesce(quality, 0) = 1 AS passed
FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 50 = 0
""")
def search_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("case_id"), F.create_map(F.lit("text"), "text").alias("context"), F.create_map(F.lit("a"), F.lit("b")).alias("expected"))
    score = (F.coalesce("quality", F.lit(0)) * 100).cast("double")
    labels = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("case_id"), score.alias("score"), F.lit("succeeded").alias("execution_status"))
    found = loop.training_overview(labels, docs, 100.0, most=1 << 40)
    return found.select(F.col("case_id").alias("doc_id"), F.col("context")["text"].alias("context"), "passed")


@query("""
SELECT doc_id, CASE WHEN length(text) > 1500 THEN left(text, 1500) || '[' || (length(text) - 1500) || ' chars truncated]' ELSE text END AS output,
  left(coalesce(source, ''), 500) AS first_note, 5::INT AS notes FROM documents WHERE doc_id % 40 = 0
""")
def search_case_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("doc_id % 40 = 0")
    one = F.create_map(F.lit("k"), F.lit("v"))
    results = docs.select(F.col("doc_id").alias("case_id"), F.lit(1.0).alias("score"), F.col("text").alias("output"), one.alias("step_outputs"), F.array_repeat(F.coalesce("source", F.lit("")), 7).alias("diagnostics"))
    cases = docs.select(F.col("doc_id").alias("case_id"), one.alias("context"), one.alias("expected"))
    found = loop.case_views(results, cases)
    return found.select(F.col("case_id").alias("doc_id"), "output", F.col("diagnostics")[0].alias("first_note"), F.size("diagnostics").alias("notes"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'brand' ELSE 'brand,size' END AS changed, CASE WHEN p_size % 3 = 0 THEN '<!-- licence -->' || chr(10) || chr(10) ELSE '' END AS header,
  'Say ' || p_name AS body, '{"a":{"b":' || p_size || '},"keep":1}' AS config FROM part
""")
def search_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("brand"), F.lit("none"), F.lit("size"), F.lit("1"), F.lit("dataset"), F.lit("d"))
    other = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.when(F.col("p_size") % 2 == 0, "1").otherwise("x"), F.lit("dataset"), F.lit("e"))
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "\n <!-- licence --> \n\n").otherwise(""), F.lit("Say "), "p_name")
    changed = F.array_join(F.array_sort(F.map_keys(loop.candidate_config(loop.changes(base, other)))), ",")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_name", F.concat(F.lit('{"a.b":'), F.col("p_size").cast("string"), F.lit("}")).alias("u"), F.lit('{"keep":1}').alias("c"))
    return rows.select("p_partkey", changed.alias("changed"), loop.header(text).alias("header"), loop.body(text).alias("body"), values.with_parameters("c", "u").alias("config"))


@query("""
SELECT event_type AS role, count(*) AS calls, sum(CASE WHEN event_id % 3 > 0 THEN event_id ELSE 0 END)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens FROM events GROUP BY ALL
""")
def search_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("role"), F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("string")).otherwise("n/a").alias("input_tokens"), (F.col("event_id") % 7).cast("string").alias("output_tokens")
    )
    return loop.usage(calls)


@query("""
WITH RECURSIVE e AS (SELECT j, avg(((o_orderkey * (37 * j + 11)) % 101) * 0.5 + (5 * j % 13) + (floor(o_totalprice)::BIGINT % 10)) FILTER (WHERE o_orderkey % 3 > 0) AS train,
  avg(((o_orderkey * (37 * j + 11)) % 101) * 0.5 + (5 * j % 13) + (floor(o_totalprice)::BIGINT % 10)) FILTER (WHERE o_orderkey % 3 = 0) AS val FROM orders CROSS JOIN range(0, 13) AS t(j) GROUP BY j),
w AS (SELECT (j + 1) // 2 AS i, arg_max(j, train) AS j, max(train) AS train, arg_max(val, train) AS val FROM e WHERE j > 0 GROUP BY 1),
s(i, j, parent, train, val, reason, best, best_train, best_val) AS (
  SELECT 0::BIGINT, 0::BIGINT, NULL::BIGINT, train, val, NULL::VARCHAR, 0::BIGINT, train, val FROM e WHERE j = 0
  UNION ALL
  SELECT w.i, w.j, s.best, w.train, CASE WHEN w.train >= s.best_train THEN w.val END, CASE WHEN w.train < s.best_train THEN 'train_screen' WHEN w.val > s.best_val THEN 'accepted' ELSE 'selection_below_threshold' END,
    CASE WHEN w.train >= s.best_train AND w.val > s.best_val THEN w.j ELSE s.best END, CASE WHEN w.train >= s.best_train AND w.val > s.best_val THEN w.train ELSE s.best_train END,
    CASE WHEN w.train >= s.best_train AND w.val > s.best_val THEN w.val ELSE s.best_val END
  FROM s JOIN w ON w.i = s.i + 1)
SELECT i::INTEGER AS iteration, 'c' || lpad(j::VARCHAR, 3, '0') AS candidate_id, 'c' || lpad(parent::VARCHAR, 3, '0') AS parent_id, reason = 'accepted' AS accepted, reason,
  round(train, 6) AS train_score, round(val, 6) AS selection_score FROM s WHERE i > 0
""")
def search_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded search of six rounds with two plans each: every order is a case of every candidate, a third of them for validation."""
    j = F.col("j")
    score = (F.col("o_orderkey") * (37 * j + 11) % 101) * 0.5 + (5 * j % 13) + F.floor("o_totalprice") % 10
    cases = table(spark, sf_dir, "orders").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))))
    name = F.concat(F.lit("c"), F.lpad(j.cast("string"), 3, "0"))
    evaluations = cases.select(
        name.alias("candidate_id"), F.when(F.col("o_orderkey") % 3 == 0, "val").otherwise("train").alias("split"), F.lit(0).alias("repeat"), F.col("o_orderkey").cast("string").alias("case_id"),
        F.lit("succeeded").alias("execution_status"), score.alias("score"),
    )
    plans = spark.range(1, 13).select(
        F.floor((F.col("id") + 1) / 2).cast("int").alias("iteration"), F.col("id").cast("int").alias("place"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("candidate_id"),
        F.lit("prompt").alias("level"), F.lit("t").alias("technique"), F.create_map(F.lit("p"), F.col("id").cast("string")).alias("config"), F.lit(None).cast("string").alias("reason"),
    )
    policy = optimize.Policy(("prompt",), 6, plateau_patience=9, confidence=0.0, resamples=20, pareto_parent=False)
    ledger = optimize.run_optimization(spark, policy, new_folder(spark, "search"), {"p": "0"}, plans, evaluations)
    return ledger.filter("type = 'iteration'").select(
        "iteration", "candidate_id", "parent_id", "accepted", "reason", F.round("train_score", 6).alias("train_score"), F.round("selection_score", 6).alias("selection_score")
    )
