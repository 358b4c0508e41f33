"""Decontamination of leaks that are everywhere, of large benchmarks, and of long and short items."""

import random

import numpy as np
import pytest
from data import frame

from evalloom.llm import decontaminate as dc


def vocabulary(n):
    return [f"word{i}" for i in range(n)]


def test_an_item_that_a_third_of_the_documents_hold(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(vocabulary(2000), k=150)) for _ in range(90)]
    items = [" ".join(rng.sample(vocabulary(2000), 20)) for _ in range(3)]
    for i in range(0, 90, 3):
        texts[i] += " " + items[0] + " " + texts[i + 1]
    texts[4] += " " + items[1]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = dc.decontaminate(frame(spark, [*enumerate(texts)]), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, 0) for i in range(0, 90, 3)} | {(4, 1)}
    assert all(r["cosine"] > 0 for r in found)


def test_runs_that_every_copy_keeps():
    for size in range(1, 80):
        n, kept = dc.run_length(size, 0.8)
        lost = size - -(-8 * size // 10)
        assert 1 <= n <= 3 and 1 <= kept == size - n + 1 - n * lost


def test_exact_search_against_a_plain_one():
    rng = random.Random(5)
    items = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)] for n in (1, 2, 3, 5, 8, 12)]
    texts = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)] for n in (0, 1, 4, 40, 90)]
    texts.append([*texts[4], *items[5], b"e"])
    found = dc.Exact([dc.Item(i, w, frozenset(), (w[0],)) for i, w in enumerate(items)], 0.8)
    sizes = [len(t) for t in texts]
    got = found.find(dc.hashes(sum(texts, [])), dc.np.repeat(range(len(texts)), sizes), dc.np.concatenate([dc.np.arange(n) for n in sizes]))
    got = set(zip(*(x.tolist() for x in got)))
    for t, text in enumerate(texts):
        for k, item in enumerate(items):
            for a in range(len(text) - len(item) + 1):
                assert text[a : a + len(item)] != item or (t, a, k) in got


def test_copies_of_a_large_benchmark_reach_the_latent_cut(spark):
    """The latent search alone, without the exact one, finds copies among more items than one group's rank."""
    rng = random.Random(8)
    items = [" ".join(rng.sample(vocabulary(4000), 20)) for _ in range(120)]
    texts = [" ".join([*rng.choices(vocabulary(4000), k=60), item, *rng.choices(vocabulary(4000), k=60)]) for item in items]
    docs, benchmark = frame(spark, [*enumerate(texts)]), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    params = dc.Params(rank=8, block_groups=6)
    found = dc.Decontaminator(docs, benchmark, params=params)
    missed = {i for i in range(120)}
    for lexicon in found._blocks():
        lexicon.exact.find = lambda *_: (dc.np.zeros(0, int),) * 3
        for i, leaks in enumerate(lexicon.leaks([t.encode() for t in texts])):
            missed -= {i} & {x[0] for x in leaks}
    assert len(missed) <= 3
    got = {(r["doc_id"], r["item_id"]) for r in dc.decontaminate(docs, benchmark, params=params).collect()}
    assert got == {(i, i) for i in range(120)}


def test_passages_cover_an_item():
    assert dc.passages(5, 48, 24) == dc.passages(48, 48, 24) == [0]
    for size in range(49, 300):
        found = dc.passages(size, 48, 24)
        assert found[0] == 0 and found[-1] + 48 == size and max(b - a for a, b in zip(found, found[1:])) <= 24


def test_long_and_short_items(spark):
    rng = random.Random(9)
    sizes = (1, 2, 3, 4, 5, 6, 8, 12, 300, 1000)
    words = vocabulary(6000)
    items = [rng.sample(words, n) for n in sizes]
    taken = {w for x in items for w in x[:12]}
    other = [w for w in words if w not in taken]
    texts = [" ".join([*rng.choices(other, k=70), *item, *rng.choices(other, k=70)]) for item in items]
    spread = list(items[6])
    spread[3] = "other"  # one of eight words replaced, a foreign one between any two
    texts.append(" ".join([*rng.choices(other, k=50), *(x for w in spread for x in (w, "foreign")), *rng.choices(other, k=50)]))
    changed = list(items[9])
    changed[::6] = ["other"] * len(changed[::6])
    texts.append(" ".join(changed))
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = frame(spark, [*enumerate(texts)])
    got = {(r["doc_id"], r["item_id"]) for r in dc.decontaminate(docs, benchmark).collect()}
    assert {*((i, i) for i in range(len(items))), (10, 6), (11, 9)} <= got
    # The latent search alone finds the long ones.
    (lexicon,) = dc.Decontaminator(docs, benchmark)._blocks()
    lexicon.exact.find = lambda *_: (dc.np.zeros(0, int),) * 3
    assert all(i in {x[0] for x in lexicon.leaks([texts[i].encode()])[0]} for i in (8, 9))


def test_the_planted_paraphrase_is_found(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(vocabulary(3000), k=200)) for _ in range(120)]
    item = rng.sample(vocabulary(3000), 60)
    docs = frame(spark, [*enumerate(texts)])
    idf = dc.Decontaminator(docs, spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")).idf
    answer = sorted(item, key=lambda w: (-idf[dc.slots_of([w.encode()])[0]], w))[:3]
    changed = [w if i % 3 or w in answer else "other" for i, w in enumerate(item)]  # a third of the words
    rows = [*enumerate(texts), (200, " ".join([*texts[77].split(), *changed]))]
    benchmark = spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")
    found = dc.decontaminate(frame(spark, rows), benchmark, params=dc.Params(copy=0.9))
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(200, 2)]


def changed(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), round(share * len(out))):
        out[i] = f"new{rng.randrange(100_000)}"
    return out


def natural(rng, n, size=6000):
    """Words of a steep frequency distribution."""
    return [f"word{int(size ** rng.random())}" for _ in range(n)]


def test_recall_against_the_longest_common_subsequence_of_all_pairs(spark):
    """Items of 3 to 1,000 words, whole and with 15, 25 and 35 % of their words replaced: every pair of
    a document and an item is judged by its longest common subsequence."""
    rng = random.Random(11)
    sizes = (3, 4, 6, 10, 16, 24, 40, 80, 200, 400, 1000)
    items = [natural(rng, n) for n in sizes for _ in range(3 if n <= 200 else 1)]
    docs = []
    for share in (0, 0.15, 0.25, 0.35):
        for item in items:
            docs.append([*natural(rng, rng.randint(20, 200)), *changed(rng, item, share), *natural(rng, rng.randint(20, 200))])
    rows = [*enumerate(" ".join(d) for d in docs)]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.decontaminate(frame(spark, rows), benchmark).collect()}
    held = {
        (i, k): dc.lcs([w.encode() for w in item], [w.encode() for w in doc]) / len(item)
        for i, doc in enumerate(docs) for k, item in enumerate(items)
        if len(item) >= 16 or i % len(items) == k
    }
    whole = {(i, i) for i in range(len(items))}
    planted = {(i, i % len(items)) for i in range(len(docs))}
    near = {p for p in planted if held[p] >= 0.6}
    assert whole <= found
    assert len(near & found) >= 0.9 * len(near)
    assert {p for p in near if held[p] >= 0.8 and len(items[p[1]]) >= 16} <= found
    # What is found without having been planted is in order at 60 % all the same, within a larger stretch.
    assert all(held[p] >= 0.6 for p in found if p in held)


def test_recall_among_thousands_of_items(spark):
    """3,000 items: more groups of factors than one block holds."""
    rng = random.Random(12)
    items = [natural(rng, rng.choice((12, 20, 40)), 20_000) for _ in range(3000)]
    planted = [(i, rng.randrange(3000)) for i in range(200)]
    shares = [rng.choice((0, 0.15, 0.25)) for _ in planted]
    docs = [(i, " ".join([*natural(rng, 60, 20_000), *changed(rng, items[k], s), *natural(rng, 60, 20_000)])) for (i, k), s in zip(planted, shares)]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.decontaminate(frame(spark, docs), benchmark).collect()}
    assert {p for p, s in zip(planted, shares) if s == 0} <= found
    assert len(found & set(planted)) >= 0.9 * len(planted)


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_only_passages_that_can_reach_the_cut_are_projected(monkeypatch, blocks):
    """The latent search finds what projecting every passage finds, and projects few blocks of texts that hold no item."""
    rng = random.Random(14)
    items = [natural(rng, rng.randint(10, 40)) for _ in range(30)]
    docs = [natural(rng, rng.randint(0, 400)) for _ in range(300)]
    for i in range(0, 300, 15):
        docs[i] += [*changed(rng, items[i % 30], rng.random()), *natural(rng, 30)]
    docs[7] = items[3][:1] * 100  # one word again and again
    split = [[w.encode() for w in d] for d in docs]
    held = np.zeros(dc.SLOTS)
    for words in split:
        held[np.unique(dc.slots_of(words))] += 1
    idf = np.log((len(docs) + 1) / (held + 1)) + dc.FLOOR
    texts = [" ".join(x).encode() for x in items]
    row, slot, value = dc._rows(texts, idf)
    slots, at = np.unique(slot, return_inverse=True)
    matrix = np.zeros((len(items), len(slots)))
    matrix[row, at] = value
    group = dc.Factors(idf, slots, np.linalg.svd(matrix, full_matrices=False)[2].T, list(range(len(items))), texts)
    params = dc.Params(passage=24 * blocks, cosine=0.3)
    lexicon = dc.Lexicon(idf, [group], [dc.Item(i, t.split(), frozenset(), (t.split()[0],)) for i, t in enumerate(texts)], params)
    lexicon.exact.find = lambda *_: (np.zeros(0, int),) * 3
    plain = set()
    for i, words in enumerate(split):
        of = dc.slots_of(words)
        for a in range(0, len(words), 24):
            mine = of[a : a + params.passage]
            total = group.sums(np.zeros(len(mine), np.int64), mine, 1)[0]
            cosine = group.latent @ total / np.sqrt((lexicon.idf[mine].astype(float) ** 2).sum())
            assert not (abs(cosine - params.cosine) < 1e-5).any()  # no tie that rounding decides
            plain |= {(i, a, k) for k in np.flatnonzero(cosine >= params.cosine).tolist()}
    projected, sums = [], dc.Factors.sums
    monkeypatch.setattr(dc.Factors, "sums", lambda self, block, slot, n: projected.append(n) or sums(self, block, slot, n))
    assert {(i, a, k) for i, found in lexicon._candidates(split) for a, k in found} == plain
    assert {k for _, _, k in plain} and (7, 0, 3) in plain
    assert sum(projected) < sum(-(-len(words) // 24) for words in split) / 2
