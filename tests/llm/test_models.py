"""Language id, quality classifier, decontamination: held-out accuracy and exact parts against brute force."""

import random

import numpy as np
import pytest
from data import frame
from pyspark.sql import functions as F

from evalloom.llm import decontaminate as dc
from evalloom.llm import language_id as lid
from evalloom.llm import quality_classifier as qc
from evalloom.llm.queries import QUERIES, fold
from evalloom.session import table

SF = "/root/testdata/sf0.01"


def test_language_id_on_held_out_documents(spark):
    found = QUERIES["op4_language_id"](spark, SF)
    truth = table(spark, SF, "documents").select("doc_id", "lang")
    held = found.join(truth, "doc_id").filter("held_out")
    n, right, lo, hi = held.agg(F.count("*"), F.count_if(F.expr("lang = lang_pred")), F.min("score"), F.max("score")).first()
    assert found.count() == 1000 and n > 150 and right >= 0.99 * n and lo >= 0 and hi <= 1


def model(switch=4.0):
    texts = {"aa": ["mamo tamo lamo ramo"] * 4, "bb": ["xuk tuk wuk zuk"] * 4, "ru": ["мир дом сад"] * 4}
    counts = {k: lid.gram_counts(v) for k, v in texts.items()}
    logs, writes = [], []
    for k in texts:
        grams, script = np.split(counts[k], [len(lid.GRAMS) * lid.TABLE])
        per = grams.reshape(len(lid.GRAMS), lid.TABLE) + 0.2
        logs.append(np.log(per / per.sum(axis=1, keepdims=True)).ravel())
        writes.append(script > 0.02 * script.sum())
    return lid.LanguageModel(tuple(texts), np.array(logs, np.float32), np.array(writes), switch, -6.0)


def test_spans_of_mixed_text():
    text = "mamo tamo lamo xuk tuk wuk xuk мир дом сад"
    (lang, score, spans), empty, none = lid._predict(model(), [text, "", "12 !"])
    assert [(s["lang"], s["start"], s["stop"]) for s in spans] == [("aa", 0, 3), ("bb", 3, 7), ("ru", 7, 10)]
    assert lang == "aa" and 0 < score < 1
    assert empty == none == ("und", 0.0, [])


def test_a_script_leaves_only_its_languages():
    m = model()
    rated = m.word_scores([w.encode() for w in ("мир", "mamo", "ελλ")])
    assert rated[0].argmax() == 2 and rated[1].argmax() != 2
    assert np.isfinite(rated).all()


def brute_path(score, switch):
    best = None
    n, k = score.shape
    for code in range(k**n):
        path = [code // k**i % k for i in range(n)]
        value = sum(score[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or value > best:
            best = value
    return best


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    scores = [np.round(rng.normal(0, 2, (n, 3)), 3) for n in (1, 2, 5, 7)] + [np.zeros((0, 3))]
    for s, path in zip(scores, lid.viterbi(scores, 1.5)):
        value = sum(s[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        assert len(path) == len(s) and (not len(s) or value == pytest.approx(brute_path(s, 1.5)))


def test_language_id_of_odd_rows(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "hello there"), (3, "hello there"), (None, "x " * 50_000)])
    found = lid.language_id(df, F.lit(True)).collect()
    assert sorted(r["lang_pred"] for r in found) == ["en", "en", "en", "und", "und"]
    assert lid.language_id(frame(spark, []), F.lit(True)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lid.language_id(unlabelled, F.lit(True)).collect()} == {"und"}


def test_quality_on_held_out_documents(spark):
    found = QUERIES["op6_quality_classifier"](spark, SF).join(table(spark, SF, "labels"), "doc_id")
    rows = found.filter("held_out").collect()
    kept = [r["predicted"] for r in rows if r["quality"] == 1]
    junk = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(kept) >= 0.98 and np.mean(junk) <= 0.35
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_features_do_not_depend_on_the_batch():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "cde", "É", "x!!"]) for _ in range(n)).encode() for n in (0, 1, 5, 300)]
    table_ = qc.context_sums(texts)
    whole = qc.features(texts, table_)
    assert np.allclose(whole, np.vstack([qc.features([t], table_) for t in texts]), atol=1e-6)
    assert not whole[0].any()


def test_training_separates_and_calibrates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    x = rng.normal(0, 1, (600, qc.N_FEATURES)) + y[:, None] * 0.8
    net = qc.train(x, y, epochs=10)
    score = net.score(x)
    assert ((score > 0.5) == y).mean() > 0.97 and net.temperature > 0
    assert qc.train(x[:5], y[:5]).score(x[:1])[0] == pytest.approx((y[:5].sum() + 1) / 7)


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "abc"), (3, "abc " * 40_000), (3, "abc")])
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (9, 1)], "doc_id long, quality int")
    found = qc.quality_scores(docs, labels, fold("id") != 0).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert qc.quality_scores(frame(spark, []), labels.limit(0), fold("id") != 0).count() == 0


def test_repeated_rows_do_not_enlarge_the_sample(spark):
    docs = frame(spark, [(i % 40, f"text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    drawn = qc._sample(docs, labels, "doc_id", "text", "quality", F.lit(True), 30).collect()
    assert len(drawn) == 30 and {int(r["text"].split()[1]) for r in drawn} <= set(range(400))


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 20))] for _ in range(2))
        assert dc.lcs(a, b) == brute_lcs(a, b)


def test_svd_spans_the_items(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.sample(vocabulary, 12))) for i in range(10)]
    idf = np.ones(dc.SLOTS)
    slots, factors = dc.randomised_svd(spark.createDataFrame(items, "i long, text string"), "text", idf, 10)
    a = dc._rows([t.encode() for _, t in items], idf)
    full = np.zeros((10, dc.SLOTS))
    full[a[0], a[1]] = a[2]
    latent = full[:, slots] @ factors
    assert np.allclose(np.linalg.norm(latent, axis=1), 1, atol=1e-3)


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(120)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (16, 30, 60)]
    texts[3] = texts[3] + " " + items[0].upper() + ". " + texts[4]
    texts[50] = items[1].replace(" ", "\n")
    changed = items[2].split()
    for i in range(5, 60, 4):  # a quarter of the words, but not the rarest ones
        changed[i] = "other"
    texts[77] = " ".join([texts[77], *changed])
    texts[90] = texts[90] + " " + " ".join(items[2].split()[:25])  # less than half
    rows = [*enumerate(texts), (500, None), (501, "")]
    benchmark = spark.createDataFrame([*enumerate(items), (7, None), (None, "a b"), (8, "")], "item_id long, text string")
    found = dc.decontaminate(frame(spark, rows), benchmark, params=dc.Params(paraphrase=0.6))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(3, 0), (50, 1), (77, 2)}
    small = dc.decontaminate(frame(spark, rows), benchmark, params=dc.Params(block_items=1))
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in found.collect()}
    assert dc.decontaminate(frame(spark, rows), benchmark.limit(0)).count() == 0
    assert dc.decontaminate(frame(spark, []), benchmark).count() == 0


def test_candidates_miss_no_contained_item(spark):
    """Recall of the latent search against a plain search for the items' words."""
    docs = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    items = table(spark, SF, "benchmark").toPandas()
    plain = {i: b" ".join(dc.words_of(t.encode())) for i, t in zip(docs.doc_id, docs.text)}
    held = {(i, k) for k, t in zip(items.item_id, items.text) for i, x in plain.items() if b" ".join(dc.words_of(t.encode())) in x}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_benchmark_decontamination"](spark, SF).collect()}
    assert held <= found and held
