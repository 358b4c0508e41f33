"""Queries over JSON records: validation, canonical text and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import base36, canonical_json
from evalloom.plans.registry import query
from evalloom.session import table


@query("SELECT event_id, regexp_extract(props, ':\\s*(-?\\d+)', 1)::BIGINT AS k, (regexp_extract(props, ':\\s*(-?\\d+)', 1)::BIGINT > 50) AS high FROM events".replace("\\\\", "\\"))
def json_path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", v.alias("k"), (v > 50).alias("high"))


@query("SELECT props AS canonical, count(*) AS n FROM (SELECT replace(props, ' ', '') AS props FROM events) GROUP BY ALL")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(canonical_json(F.col("props")).alias("canonical")).agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE d(k, n, s) AS (SELECT o_orderkey, o_orderkey // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (1 + o_orderkey % 36)::int, 1) FROM orders
  UNION ALL SELECT k, n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (1 + n % 36)::int, 1) || s FROM d WHERE n > 0)
SELECT k AS o_orderkey, s AS run_id FROM d WHERE n = 0
""")
def base36_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", base36(F.col("o_orderkey")).alias("run_id"))


@query("""
SELECT code, count(*) AS n, min(o_orderkey) AS first_row FROM (
  SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'out_of_range' WHEN o_orderpriority LIKE '%LOW%' THEN 'bad_choice' END AS code FROM orders) WHERE code IS NOT NULL GROUP BY ALL
""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("o_totalprice") < 1000, "out_of_range").when(F.col("o_orderpriority").contains("LOW"), "bad_choice")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")).filter("code is not null")
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_row"))
