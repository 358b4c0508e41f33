"""What only shows on tables larger than those given."""

import random

import duckdb
from oracle import assert_same, connect
from pyspark.sql import functions as F

from evalloom.operators import search
from evalloom.plans.catalogue import ORACLE, QUERIES


def test_aliases_of_more_than_a_million_rows_are_those_of_the_sql(spark, tmp_path):
    spark.range(1_000_030).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["batch_assignment"](spark, str(tmp_path)).filter("rn > 999970").select("o_orderkey", "rn", "batch", "alias").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT o_orderkey, rn, batch, alias FROM ({ORACLE['batch_assignment']}) WHERE rn > 999970").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 60


def test_merge_pairs_of_many_members_are_written_out_where_blocks_meet(spark, tmp_path):
    """Pairs of members are shuffled neither for the join nor to leave out those tried; blocks of any size give the same."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.range(3000).selectExpr("id AS s_suppkey", "CAST(xxhash64(id) % 25 AS int) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    before = store.executorList(True).apply(0).totalShuffleWrite()
    found = QUERIES["merge_pairs"](spark, str(tmp_path)).agg(F.count("*"), F.sum(F.pmod(F.col("a") * 31 + F.col("b"), F.lit(1009)))).first()
    assert store.executorList(True).apply(0).totalShuffleWrite() - before < 2_000_000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert tuple(found) == con.execute(f"SELECT count(*), sum((a * 31 + b) % 1009)::BIGINT FROM ({ORACLE['merge_pairs']})").fetchone()
    pool = spark.createDataFrame([(i, [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(40)], "m int, ch array<string>")
    tried = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40) if (a + b) % 3 == 0], "a int, b int")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if {a % 4, b % 4} == {0, 1} and (a + b) % 3}
    for size, left_out in ((3, tried), (7, (F.col("a") + F.col("b")) % 3 == 0)):
        got = [tuple(r) for r in search.merge_pairs(pool, "m", "ch", left_out, block=size).collect()]
        assert set(got) == want and len(got) == len(want)


def test_lineage_follows_chains_within_ranges_and_across_them(spark, tmp_path, monkeypatch):
    """Chains of neighbours are not shuffled; parents anywhere, several parents and unknown ones give the same as following each."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.range(60_000).filter("id % 1000 <> 7").selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    before = store.executorList(True).apply(0).totalShuffleWrite()
    found = QUERIES["candidate_lineage"](spark, str(tmp_path)).agg(F.count("*"), F.sum("depth"), F.sum(F.pmod(F.col("candidate") * 31 + F.col("ancestor"), F.lit(1009)))).first()
    assert store.executorList(True).apply(0).totalShuffleWrite() - before < 2_000_000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert tuple(found) == con.execute(f"SELECT count(*), sum(depth)::BIGINT, sum((candidate * 31 + ancestor) % 1009)::BIGINT FROM ({ORACLE['candidate_lineage']})").fetchone()
    rng = random.Random(1)
    tree = [(f"n{i:03}", f"n{rng.randrange(i):03}" if i % 9 else None) for i in range(200)]
    merged = tree + [(f"n{i:03}", f"n{i - 2:03}") for i in range(20, 40)] + [("n199", "gone")]
    for few in (1 << 16, 0):
        monkeypatch.setattr(search, "FEW_STEPS", few)
        for edges, listed in ((tree, True), (merged, True), (merged, False)):
            known = {c for c, _ in edges}
            up = {c: {p for x, p in edges if x == c and p is not None and (p in known or not listed)} for c in known}
            want, step = set(), {(c, p, 1) for c in known for p in up[c]}
            while step:
                want |= step
                step = {(c, p, d + 1) for c, a, d in step for p in up.get(a, ())}
            got = [tuple(r) for r in search.lineage(spark.createDataFrame(edges, "c string, p string"), "c", "p", listed).collect()]
            assert set(got) == want and len(got) == len(want)


def test_finished_runs_are_checked_with_one_deal_by_run(spark):
    """Cases, results and listed ids meet by run and id without being shuffled again: less than 150 bytes for each line item."""
    store = spark.sparkContext._jsc.sc().statusStore()
    data = "/root/testdata/sf0.01"
    before = store.executorList(True).apply(0).totalShuffleWrite()
    assert_same(QUERIES["run_terminal_issues"](spark, data), connect(data), ORACLE["run_terminal_issues"])
    assert store.executorList(True).apply(0).totalShuffleWrite() - before < 150 * 60_000
