"""Tokenisation, URL filters and quality rules against plain restatements."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from brute import sha, words
from data import corpus, frame
from oracle import assert_same, connect
from pyspark.sql import functions as F

from evalloom.llm import bpe
from evalloom.llm.bpe import SAFE_CUT, byte_bpe, encode_pieces, read_ranks, safe_pieces
from evalloom.llm.quality_rules import Threshold, quality_rules
from evalloom.llm.queries import QUERIES, URL_RULES, oracle_sql
from evalloom.llm.url_filter import RuleIndex, UrlRule, url_filter

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding():
    pairs = (line.split() for line in open(RANKS, "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_bpe_equals_the_library(spark, piece):
    enc = encoding()
    rows = [*corpus(30), (90, "it's 12ab  \n\n x" * 50 + "<|endoftext|>"), (91, "日本語 ß 👍🏽" * 40), (92, "a" * 3000), (None, "x"), (90, "x")]
    got = byte_bpe(frame(spark, rows), RANKS, public_tokenizers.PATTERN, piece_chars=piece)
    want = sorted((str(k), ids := enc.encode_ordinary(t or ""), len(ids), (t or "").encode()) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["n_tokens"], bytes(r["decoded"])) for r in got.collect()) == want
    digests = byte_bpe(frame(spark, rows), RANKS, public_tokenizers.PATTERN, piece_chars=piece, digests=True)
    want = sorted((str(k), n, sha(" ".join(map(str, ids))), sha(raw)) for k, ids, n, raw in want)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests.collect()) == want


def test_safe_cuts_never_change_ids():
    enc, rng = encoding(), random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("ab1 \n\t'sé.!") for _ in range(60))
        whole = enc.encode_ordinary(text)
        assert [i for p in safe_pieces(text, 3) for i in enc.encode_ordinary(p)] == whole
        assert "".join(safe_pieces(text, 3)) == text
    assert SAFE_CUT.search("ab") is None


def test_rank_files_are_bounded():
    with pytest.raises(ValueError):
        read_ranks(RANKS, max_bytes=1000)


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://ORG/x", "https://a.example.org/es/1?q=/de/", "http://example.org/en/1",
        "http://example.org/en/123", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/#a", "http://com/de", "http://com",
        "http://a.com?x=/de/", "http://é.COM/de/", "ftp://b.org#/es/", "http://example.org/es", "http://a://b.com/de/", "http://org.net/", "http://x.org\n/y",
    ]
    rows = [(i % 15, u, i, "x", "y") for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int, best string, found string")
    for block in (50_000, 2):
        got = url_filter(pages, URL_RULES, block_rules=block).collect()
        assert sorted((r["page_id"], str(r["url"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got) == sorted(
            (k, str(u), *(str(x) if i == 2 else x for i, x in enumerate(judge(u)))) for k, u, *_ in rows
        )
    assert url_filter(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter(pages, [], default="block").collect()} == {"block"}


def test_rules_are_filed_under_their_rarest_token():
    rules = [UrlRule("block", f"site{i}.com", "/ads/") for i in range(50)]
    index = RuleIndex(rules)
    assert "com" not in index.by_token and len(index.by_token["site7"]) == 1
    assert index.best("www.site7.com", "/ads/x").name == "site7.com/ads/"
    assert index.best("www.site7.com", "/adsx") is None and index.best("xsite7.com", "/ads/") is None


def expected_counts(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_rules(spark):
    rows = [*corpus(40), (70, "#a|b <c>\n\nx\nx\n x\nx"), (71, "a b a b a b a b"), (72, "👍 é\x0bz"), (None, None), (70, "w " * 5000)]
    rows = [(k, t) for k, t in rows]
    got = quality_rules(frame(spark, rows))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = sorted((str(k), *expected_counts(t)) for k, t in rows if not t or len(t) < 9000)
    assert sorted((str(r["doc_id"]), *[r[c] for c in cols]) for r in got.filter("n_words < 5000").collect()) == want
    assert [r["n_repeat_words"] for r in got.filter("n_words = 5000").collect()] == [5000]
    assert got.filter("kept and base_failed").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_thresholds_are_compiled(spark):
    df = frame(spark, [(1, "one two three " + "word " * 60)])
    rules = (Threshold("a", "n_words", "n_lines", low=100), Threshold("b", "word_chars", "n_words", high=1), Threshold("c", "n_words", "n_lines"))
    assert quality_rules(df, thresholds=rules, max_repeat_percent=100).first()["broken_rules"] == ["a", "b"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        if i < 4:
            assert docs.columns == columns
            docs = docs.cache()
            assert 0 < docs.count() <= before.count()
            assert docs.filter("n_chars <> length(text)").count() == 0
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids))
    assert docs.join(before, "doc_id").filter(F.col("decoded_sha256") != F.sha2("text", 256)).count() == 0
    assert corpus_pipeline.run(spark, SF).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", None, 0), (2, "", "en", None, 0)]
    for odd in (rows, []):
        docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= len(odd)


def test_long_runs_of_white_space_are_encoded_as_one_match(spark):
    """Runs at which the library's pattern overflows its stack: the ids are those of the parts, whose matches are known."""
    enc = bpe.encoding(read_ranks(RANKS), public_tokenizers.PATTERN)
    for unit in (" ", "\n", "\r\n", " \u3000\t", "\u00a0"):
        for n in (4000, 4096, 20_000):
            for before, after in (("", ""), ("a", ""), ("", "b"), ("a", " b"), ("a.", "1"), ("\u00e9", "!")):
                text = before + unit * n + after
                assert [i for p in encode_pieces(enc, text, 1 << 16) for i in p] == enc.encode_ordinary(text)
    for n in (1_000_000, 3_000_000):
        for unit in (" ", "\n", " \n\t"):
            run = unit * n
            for before, after in (("", ""), ("word", ""), ("word", "next"), ("", "x")):
                got = [i for p in encode_pieces(enc, before + run + after, 1 << 16) for i in p]
                # All but the last character is one match; the last one is matched with what follows.
                want = enc.encode_ordinary(before) + enc._encode_single_piece(run[:-1] if after else run) + (enc.encode_ordinary(run[-1] + after) if after else [])
                assert got == want
    rows = [(1, " " * 1_200_000), (2, "a" + "\n" * 1_200_000 + "b"), (3, "plain text")]
    got = {r["doc_id"]: r for r in byte_bpe(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect()}
    assert {k: bytes(r["decoded"]).decode() for k, r in got.items()} == dict(rows)
    assert got[1]["n_tokens"] == len(got[1]["ids"])
