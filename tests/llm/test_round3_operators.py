"""Licence scans, hard negatives and whitening against SQL and brute force, with odd rows."""

import math

import numpy as np
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from evalloom.llm.hard_negatives import PositiveQuery, Searcher, hard_negatives
from evalloom.llm.license_scan import license_scan, words_of
from evalloom.llm.queries import QUERIES, oracle_sql
from evalloom.llm.whitening import whiten

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_hard_negatives"])
def test_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), connect(SMALL), oracle_sql()[name])


# Licence scans ------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, words string, known string, at int, base string"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense"


def scan(spark, texts):
    rows = [(i, t, "w", "k", 1, "b") for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, DOCS)).collect()}


def test_license_labels(spark):
    filler = " word" * 50
    got = scan(
        spark,
        [
            "Released under the MIT License.",
            f"first{filler} {MIT}{filler}",
            "the MIT-License and the mit\nlicense, MIT  licensed; GNU General Public License version 3",
            "Licensed under CC BY-NC 4.0.",
            "cc and by and nc, licensed",
            "under the license of the public, generally",
            None,
            "",
            "...",
            "ÄMIT license MIT licenseK",
            "a mit license here " * 1500,
        ],
    )
    assert (got[0]["labels"], got[0]["base_labels"], got[0]["n_base"], got[0]["first_word"], got[0]["score"]) == ("mit", "mit", 1, 3, 1.0)
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["notices"]) == ("mit", "", ["mit-text"])
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (3, 1, 10, "gpl,mit")
    assert (got[3]["labels"], got[3]["base_labels"], got[3]["n_base"], got[3]["first_word"]) == ("cc-by-nc", "", 0, None)
    for i in (4, 5, 6, 7, 8):
        assert (got[i]["labels"], got[i]["n_base"], got[i]["last_word"], got[i]["score"]) == ("", 0, None, 0.0)
    assert [got[i]["n_words"] for i in (6, 7, 8)] == [0, 0, 0]
    # Only A-Z are lower-cased: the first word is not "mit", the last is not "licensek".
    assert (got[9]["n_words"], got[9]["n_base"]) == (4, 0)
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"]) == (1500, 1, 5997)


def test_license_words_follow_the_contract(spark):
    texts = ["", " a", "a ", "A-b_c{d}e", "é9:ß", "\x00x\x7fy\x80z", "  ", "mit"]
    got = scan(spark, texts)
    assert [got[i]["n_words"] for i in range(len(texts))] == [len(words_of(t)) for t in texts]


def test_license_scan_of_an_empty_table(spark):
    assert license_scan(spark.createDataFrame([], DOCS)).collect() == []


def test_license_plan_is_native(spark):
    plan = license_scan(spark.createDataFrame([(1, "mit license", "", "", 1, "")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Hard negatives -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, id string, x int, leaf int, key string"


def brute_negatives(rows, every=5):
    seen = sorted(
        {
            (i, lab, tuple(math.floor(256 * c) for c in v))
            for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
        }
    )

    def dot(a, b):
        return sum(p * q for p, q in zip(a, b, strict=False))

    out = []
    for i, lab, v in seen:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in seen)
        for s, j, _ in [t for t in scored if t[2] == lab and t[1] != i][:5]:
            hits = [(n, k) for n, k, m in scored if m != lab and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(i, j, r, k, -s, -n) for r, (n, k) in enumerate(hits, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "i", 1, 2, "k") for i, v, lab in rows], VECTORS)


def clusters(n=400, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(i, (centres[i % 7] + 0.2 * rng.normal(size=dims)).tolist(), int(rng.integers(4))) for i in range(n)]


def mined(spark, rows, **more):
    return sorted(tuple(r) for r in hard_negatives(vectors(spark, rows), F.col("id") % 5 == 0, **more).collect())


def test_negatives_equal_brute_force_over_many_blocks_and_anchor_parts(spark):
    rows = clusters()
    assert mined(spark, rows, block_rows=40, anchors_per_part=30) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = clusters(120, 3)
    same = rows[0][1]
    rows += [(1000 + i, same, i % 3) for i in range(90)] + [rows[5]] * 40 + [(10, same, 1), (10, rows[3][1], 2)]
    rows += [(None, same, 1), (7, None, 1), (8, same, None), (9, [0.1, None, 1.0], 1), (11, [math.nan, 1.0, 1.0], 1), (12, [math.inf, 1.0, 1.0], 1)]
    rows += [(200, [0.5], 1), (205, [], 1), (210, [0.0, 0.0, 0.0], 2), (215, [1e9, 0.0, 0.0], 2)]
    usable = [r for r in rows if r[0] != 215]
    assert mined(spark, rows, block_rows=30) == brute_negatives(usable)


def test_negatives_of_an_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, None, 1)]) == []
    assert mined(spark, [(5, [1.0], 1)]) == []


def test_search_opens_few_parts_where_vectors_cluster():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(64, 8)) * 100
    points = np.floor(np.repeat(centres, 64, 0) + rng.normal(size=(4096, 8)))
    s = Searcher(np.arange(4096), np.zeros(4096, int), points, int((points**2).sum(1).max()), 6, 48)
    opened = []
    buckets = s.slices
    s.slices = type("Counted", (list,), {"__getitem__": lambda self, i: (opened.append(i), list.__getitem__(self, i))[1]})(buckets)
    anchor = points[:1]
    query = PositiveQuery(-1, 0, None, 5)
    s.search(anchor[0], s.to_vantages(anchor)[0], query)
    assert [-score for score, _ in query.best.found] == sorted((points @ anchor[0]).tolist(), reverse=True)[:5]
    assert len(opened) < len(buckets) / 2


# Whitening ----------------------------------------------------------------------------------------


def white(spark, rows, **more):
    return whiten(spark.createDataFrame([(i, v, 1, "v", 3) for i, v in rows], "vec_id long, embedding array<float>, n int, v string, component int"), **more).toPandas()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(300, 5)) * [3, 1, 0.5, 20, 1] + 7).astype(np.float32)
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [math.nan] * 5), (903, [math.inf] * 5), (904, [1.0]), (905, []), (906, [1e30] * 5)]
    got = white(spark, [(i, r.tolist()) for i, r in enumerate(v)] + odd, components=4).sort_values(["vec_id", "component"])
    x = np.floor(v.astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ directions[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    found = got.whitened.to_numpy().reshape(n, 4)
    assert np.abs(found * np.sign((found * want).sum(0)) - want).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(n, 4) == ((n * x - s) ** 2).sum(1)[:, None]).all()
    assert np.allclose(got.explained.to_numpy()[:4], values[::-1][:4] / values.sum(), rtol=1e-12)
    assert set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.component.tolist()[:5] == [1, 2, 3, 4, 1]


def test_whitening_of_equal_repeated_and_missing_rows(spark):
    assert white(spark, []).empty
    assert white(spark, [(1, None)]).empty
    one = white(spark, [(1, [1.0, 2.0])])
    assert len(one) == 2 and one.whitened.isna().all() and (one.deviation == 0).all()
    flat = white(spark, [(None, [1.0, 2.0])] * 3 + [(None, [2.0, 4.0])])
    # One direction only: the other has no variance and so no scale.
    assert len(flat) == 8 and flat[flat.component == 2].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all()
    assert flat.identity_error.max() < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    far = white(spark, [(1, [2.0**40]), (2, [0.0]), (3, [0.0])])
    assert far.deviation.isna().sum() == 3
    assert np.isclose(far.whitened.max(), math.sqrt(2))
