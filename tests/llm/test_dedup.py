"""Substring, suffix-array and line dedup, and the n-gram join, against brute force."""

import random

import pyarrow as pa
import pytest
from brute import components, covered, sha, shingles, spans, words
from data import corpus, frame
from pyspark.sql import functions as F

from evalloom.llm.blocks import Answers, Blocks, Texts
from evalloom.llm.components import connected_components
from evalloom.llm.ngram_join import ngram_jaccard_join, ngram_jaccard_links
from evalloom.llm.suffix_dedup import Bytes, Candidates, _first_exchange, lcp_intervals, maximal_repeats, repeat_groups, suffix_array_dedup
from evalloom.llm.window_dedup import line_dedup, substring_dedup

BLOCK = 2_000  # many blocks even for a small corpus


def expected_substring(rows, window):
    seqs = [(k, words(t)) for k, t in rows]
    gone = covered(seqs, window, True, strict=False)
    return [(k, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (k, w), g in zip(seqs, gone)]


@pytest.mark.parametrize(("window", "seed"), [(20, 10), (20, 5), (8, 8)])
def test_substring_dedup(spark, window, seed):
    rows = corpus()
    got = substring_dedup(frame(spark, rows), window=window, seed=seed, block_bytes=BLOCK)
    found = sorted((r["doc_id"], r["n_units"], r["n_removed"], r["kept_text"]) for r in got.collect())
    assert found == expected_substring(rows, window)
    for r in got.collect():
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_substring_dedup_refuses_other_windows(spark):
    with pytest.raises(ValueError):
        substring_dedup(frame(spark, []), window=20, seed=6)


@pytest.mark.parametrize(("block", "hot"), [(BLOCK, 1 << 15), (1 << 20, 1 << 15), (BLOCK, 1)])
def test_suffix_array_dedup(spark, block, hot):
    rows = corpus()
    data = [(k, (t or "").encode()) for k, t in rows]
    gone = covered(data, 50, False, strict=True)
    want = [
        (k, len(b), len(g), spans(g), sha(bytes(x for i, x in enumerate(b) if i not in g)))
        for (k, b), g in zip(data, gone)
    ]
    got = suffix_array_dedup(frame(spark, rows), block_bytes=block, hot_pieces=hot).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)
    )
    assert sorted(map(tuple, got.collect())) == want


def test_maximal_repeats_are_left_diverse_and_complete():
    rng = random.Random(3)
    pieces = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 12))) for _ in range(40)})
    found = list(maximal_repeats(pieces, 6))
    windows = {}
    for p, text in enumerate(pieces):
        for i in range(len(text) - 5):
            windows.setdefault(text[i : i + 6], set()).add((p, i))
    for repeat in found:
        texts = {pieces[p][i : i + repeat.length] for p, i in repeat.occurrences}
        assert len(texts) == 1 and len(repeat.occurrences) > 1
        left = {pieces[p][i - 1] if i else ("edge", p) for p, i in repeat.occurrences}
        assert len(left) > 1
    covered_pairs = {
        (p, i + d) for r in found for p, i in r.occurrences for d in range(r.length - 5)
    }
    assert covered_pairs == {x for at in windows.values() if len(at) > 1 for x in at}


def occurrences_of(data, text):
    return {(k, i) for k, b in data.items() for i in range(len(b) - len(text) + 1) if b.startswith(text, i)}


def whole_repeat(data, at, length):
    """The longest common string round the occurrences ``at``."""
    at = sorted(at)
    back = 0
    while len({data[k][i - back - 1] if i > back else (k, i) for k, i in at}) == 1:
        back += 1
    while len({data[k][i + length] if i + length < len(data[k]) else (k, i) for k, i in at}) == 1:
        length += 1
    return length + back, frozenset((k, i - back) for k, i in at)


def nested():
    """Texts whose repeats hold shorter repeats that are more frequent."""
    rng = random.Random(4)
    a, b, c = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (700, 300, 90))
    return list(enumerate([a + b, "x" + b + c, a + b + "yy", c, "z" + c + a[:400], b + "q" * 120, a[300:] + "w", "q" * 90]))


@pytest.mark.parametrize(("rows", "hot"), [(corpus(), 1 << 15), (corpus(), 2), (nested(), 1 << 15), (nested(), 1)])
def test_repeat_groups_are_the_whole_repeats_of_all_windows(spark, rows, hot):
    data = {k: (t or "").encode() for k, t in rows}
    windows = {}
    for k, b in data.items():
        for i in range(len(b) - 49):
            windows.setdefault(b[i : i + 50], set()).add((k, i))
    want = {whole_repeat(data, at, 50) for at in windows.values() if len(at) > 1}
    groups = {}
    for r in repeat_groups(frame(spark, rows), block_bytes=BLOCK, hot_pieces=hot).collect():
        groups.setdefault((r["repeat"], r["length"]), set()).add((r["doc_id"], r["start"]))
    found = {(n, frozenset(at)) for (_, n), at in groups.items()}
    assert len(found) == len(groups) and want <= found
    for n, at in found - want:  # repeats of longer strings: maximal, with all their occurrences
        k, i = min(at)
        assert at == occurrences_of(data, data[k][i : i + n]) and whole_repeat(data, at, n) == (n, at)


def test_lcp_intervals():
    # banana, bananas, band, bat, cat
    assert sorted(lcp_intervals([0, 6, 3, 2, 0])) == [(0, 0, 4), (2, 0, 3), (3, 0, 2), (6, 0, 1)]


def test_line_dedup(spark):
    rows = corpus()
    split = [(k, [x for x in (t or "").split("\n") if words(x)]) for k, t in rows]
    gone = covered(split, 3, True, strict=False)
    want = []
    for (k, t), (_, lines), g in zip(rows, split, gone):
        kept, at, drop = [], 0, False
        for x in (t or "").split("\n"):
            if words(x):
                drop, at = at in g, at + 1
            if not drop:
                kept.append(x)
        want.append((k, len(lines), len(g), "\n".join(kept)))
    got = line_dedup(frame(spark, rows), block_bytes=BLOCK, carry=True)
    assert sorted((r["doc_id"], r["n_units"], r["n_removed"], r["kept_text"]) for r in got.collect()) == want
    assert got.filter("row.doc_id <> doc_id or row.key <> 2").count() == 0


def test_ngram_join(spark):
    rows = corpus(90)
    rng = random.Random(9)
    base = rows[4][1].split() + [f"w{i}" for i in range(80)]
    for i in range(30):  # a chain of near copies whose ends are far apart
        base[rng.randrange(len(base))] = f"new{i}"
        rows.append((200 + i, " ".join(base)))
    got = ngram_jaccard_join(frame(spark, rows), block_bytes=BLOCK)
    assert sorted(map(tuple, got.collect())) == components(rows)


def test_links_between_classes(spark):
    rows = corpus(90)
    sets = {k: shingles(t) for k, t in rows}
    links, members = ngram_jaccard_links(frame(spark, rows), block_bytes=BLOCK)
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert of == {k: min(j for j in sets if sets[j] == s) for k, s in sets.items() if s}
    both = {(a, b): len(sets[a] & sets[b]) for a in set(of.values()) for b in set(of.values()) if a < b}
    want = {(a, b, len(sets[a]), len(sets[b]), n) for (a, b), n in both.items() if n and 100 * n >= 80 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in links.select("a", "b", "na", "nb", "n").collect()} == want and len(want) > 3


def test_ngram_join_at_the_threshold(spark):
    words_ = [f"w{i}" for i in range(94)]  # 90 shingles
    near = [*words_[:84], *[f"x{i}" for i in range(10)]]  # 80 of 100 are shared
    far = [*words_[:83], *[f"y{i}" for i in range(11)]]
    rows = [(1, " ".join(words_)), (2, " ".join(near)), (3, " ".join(far)), (4, "A b"), (5, "a B"), (6, "a b c")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(frame(spark, rows)).collect()}
    assert got == {k: c for k, _, c in components(rows)}
    assert got[4] == got[5] == 4 and got[6] == 6


@pytest.mark.parametrize("op", [substring_dedup, suffix_array_dedup, line_dedup, ngram_jaccard_join])
def test_odd_rows(spark, op):
    text = " ".join(f"word{i}" for i in range(60)) + "\na\nb\nc\nd"
    rows = [(None, text), (None, None), (7, text), (7, text), (8, "x" * 300_000), (9, "\n".join([text] * 3))]
    found = op(frame(spark, rows), block_bytes=50_000).collect()
    assert sorted((r["doc_id"] for r in found), key=lambda k: (k is not None, k)) == [None, None, 7, 7, 8, 9]
    assert op(frame(spark, [])).count() == 0


def ordered(spark, rows):
    """Rows in the order that the operators give to repeated ids: by a hash of the text."""
    texts = spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string")
    tie = {r["t"]: r["h"] % (1 << 64) for r in texts.select("t", F.xxhash64(F.col("t").cast("binary")).alias("h")).collect()}
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1] or ""]))


@pytest.mark.parametrize("key", [7, None])
@pytest.mark.parametrize("op", [substring_dedup, suffix_array_dedup, line_dedup, ngram_jaccard_join])
def test_rows_of_one_id_spread_over_blocks(spark, op, key):
    """A table whose rows all share one id, or have none, gives the same as any other."""
    rows = ordered(spark, [(key, t) for _, t in corpus()])
    blocks = Blocks(frame(spark, rows), "doc_id", "text", BLOCK, 1 / 6)
    sizes = [r["n"] for r in blocks.frame.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert len(sizes) > 5 and max(sizes) < sum(sizes) / 3
    found = op(frame(spark, rows), block_bytes=BLOCK)
    if op is ngram_jaccard_join:
        assert {r["component_id"] for r in found.collect()} == {key}
        return
    if op is suffix_array_dedup:  # rows with one id do not remove each other's bytes
        assert found.filter("n_removed > 0").count() == 0
        return
    split = words if op is substring_dedup else lambda t: [x for x in (t or "").split("\n") if words(x)]
    seqs = [(i, split(t)) for i, (_, t) in enumerate(rows)]
    gone = covered(seqs, 20 if op is substring_dedup else 3, True, strict=False)
    assert sorted((r["n_units"], r["n_removed"]) for r in found.collect()) == sorted((len(w), len(g)) for (_, w), g in zip(seqs, gone))


def test_a_hot_string_does_not_fill_one_bucket(spark):
    """A rule line in every text: the pieces round it are filed under two minimisers."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(10)) + " -=-=-=-=-=-=-=-=- " + " ".join(word() for _ in range(10))) for i in range(150)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:40])]
    told = {}
    for hot in (8, 1 << 15):
        blocks, shape, answers = _first_exchange(frame(spark, rows), "doc_id", "text", 50, 16, BLOCK, hot)

        def keys(group, told):  # noqa: B023 - different pieces of a block, by what they are filed under
            pieces = Candidates(Bytes(Texts(group).texts), Answers(told), shape)
            filed = pieces.keys[pieces.first].view("int64")
            return pa.table({"key": pa.array(filed, pa.int64()), "n": pa.array([1] * len(filed), pa.int64())})

        parts = blocks._with(answers).applyInArrow(keys, "key long, n long")
        told[hot] = max(r["n"] for r in parts.groupBy("key").agg(F.sum("n").alias("n")).collect())
        gone = covered([(k, t.encode()) for k, t in rows], 50, False, strict=True)
        got = suffix_array_dedup(frame(spark, rows), block_bytes=BLOCK, hot_pieces=hot).collect()
        assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(k, len(g)) for (k, _), g in zip(rows, gone)]
    assert told[8] < told[1 << 15] / 3


@pytest.mark.parametrize("op", [substring_dedup, suffix_array_dedup, line_dedup, ngram_jaccard_join])
def test_a_third_of_the_table_is_one_row(spark, op):
    """Equal rows are dealt as one, so no block holds them all, and each gets its result."""
    text = " ".join(f"word{i}" for i in range(60)) + "\na\nb\nc\nd"
    rows = [(k, t) for k, t in corpus() if k != 7] + [(7, text)] * 400 + [(None, None)] * 300 + [(90, "x " + text)]
    blocks = Blocks(frame(spark, rows), "doc_id", "text", BLOCK, 1 / 6)
    sizes = [r["count"] for r in blocks.frame.groupBy("block").count().collect()]
    assert blocks.collapsed and max(sizes) < 40 and blocks.frame.agg(F.sum("copies")).first()[0] == len(rows)
    found = op(frame(spark, rows), block_bytes=BLOCK)
    assert found.count() == len(rows)
    if op is ngram_jaccard_join:
        once = {k: t for k, t in rows if k is not None}
        want = {k: (n, c) for k, n, c in components(list(once.items()))}
        assert all((r["n_shingles"], r["component_id"]) == want.get(r["doc_id"], (0, None)) for r in found.collect())
        return
    rows = ordered(spark, rows)
    if op is suffix_array_dedup:
        gone = covered([(-1 if k is None else k, (t or "").encode()) for k, t in rows], 50, False, strict=True)
        assert sorted(r["n_removed"] for r in found.collect()) == sorted(map(len, gone))
        return
    split = words if op is substring_dedup else lambda t: [x for x in (t or "").split("\n") if words(x)]
    seqs = [(i, split(t)) for i, (_, t) in enumerate(rows)]
    gone = covered(seqs, 20 if op is substring_dedup else 3, True, strict=False)
    assert sorted((r["n_units"], r["n_removed"]) for r in found.collect()) == sorted((len(w), len(g)) for (_, w), g in zip(seqs, gone))
    assert found.filter("doc_id = 7 and n_removed = 0").count() == 1


def test_templates_with_changing_numbers_fill_no_bucket(spark):
    """Log lines of one template: the two smallest hashes of a window both lie in the fixed part, so their pieces grow with the
    corpus until windows are filed one by one."""
    rng = random.Random(11)

    def line(i):
        return f"{rng.randrange(10**8):08d} the request was finished by worker of tenant {rng.randrange(10**8):08d}"

    most = {}
    for n in (150, 300):
        rows = [(i, line(i)) for i in range(n)]
        rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[::9])]
        for hot in (20, 1 << 15):
            blocks, shape, answers = _first_exchange(frame(spark, rows), "doc_id", "text", 50, 16, BLOCK, hot)

            def keys(group, told):  # noqa: B023
                pieces = Candidates(Bytes(Texts(group).texts), Answers(told), shape)
                return pa.table({"key": pa.array(pieces.keys[pieces.first].view("int64"), pa.int64()), "text": pa.array(pieces.texts, pa.binary())})

            parts = blocks._with(answers).applyInArrow(keys, "key long, text binary")
            most[n, hot] = max([r["n"] for r in parts.groupBy("key").agg(F.count_distinct("text").alias("n")).collect()], default=0)
        gone = covered([(k, t.encode()) for k, t in rows], 50, False, strict=True)
        got = suffix_array_dedup(frame(spark, rows), block_bytes=BLOCK, hot_pieces=20).collect()
        assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(k, len(g)) for (k, _), g in zip(rows, gone)]
    assert most[300, 1 << 15] > 1.5 * most[150, 1 << 15] > 100  # without splitting
    assert most[300, 20] <= 20 and most[150, 20] <= 20


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.unionAll(spark.createDataFrame([(100, 101), (102, 101)], "a long, b long"))
    found = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}
