"""Text, retrieval and leakage queries over documents, benchmark items, pages and conversations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import scores, text, values
from evalloom.operators import evidence, retrieval
from evalloom.plans.registry import query
from evalloom.session import spread, table

_REDACT = r"regexp_replace(regexp_replace({0}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '<email>', 'g'), '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '<ip_address>', 'g')"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"


@query(f"SELECT doc_id, sha256({_REDACT.format('text')}) AS redacted, ({_REDACT.format('text')} <> text) AS changed FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.redact(F.col("text")).alias("r"))
    return docs.select("doc_id", F.sha2("r", 256).alias("redacted"), (F.col("r") != F.col("text")).alias("changed"))


@query(f"""
WITH t AS (
  SELECT item_id, list_filter(string_split({_NORM.format('b.text')}, ' '), lambda x: x <> '') AS p,
    list_filter(string_split({_NORM.format('d.text')}, ' '), lambda x: x <> '') AS e
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id
), c AS (
  SELECT item_id, len(p) AS np, len(e) AS ne,
    coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(e, lambda y: y = x))))), 0) AS common
  FROM t
)
SELECT item_id, round(CASE WHEN np + ne > 0 THEN 200.0::double * common / (np + ne) ELSE 0 END, 6) AS f1 FROM c
""")
def token_f1_documents_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", text.answer_tokens(F.col("text")).alias("p"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), text.answer_tokens(F.col("text")).alias("e"))
    found = evidence.token_f1(items.join(docs, "item_id"), "item_id", "p", "e")
    return found.select("item_id", F.round("f1", 6).alias("f1"))


@query(f"""
SELECT a.conv_id, a.turn, CASE WHEN {_NORM.format('a.text')} = {_NORM.format('b.text')} THEN 100.0 ELSE 0.0 END::DOUBLE AS exact
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def normalized_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("t"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", scores.exact_match(F.col("t"), F.col("u")).alias("exact"))


@query(f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS words, (CASE WHEN len(w) >= 8 THEN len(list_distinct(list_transform(range(1, len(w) - 6),
  lambda i: array_to_string(w[i:i + 7], ' ')))) ELSE 0 END)::BIGINT AS ngrams FROM w
""")
def word_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("words"), text.ngram_count(F.col("w")).alias("ngrams"))


_GRAMS = """SELECT DISTINCT {0} AS id, array_to_string(w[i:i + 7], ' ') AS ngram
  FROM (SELECT {0}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {0}, {1} AS w FROM {2}) WHERE len(w) >= 8)"""


@query(f"""
WITH b AS ({_GRAMS.format('item_id', _WORDS.format('text'), 'benchmark')}), d AS ({_GRAMS.format('doc_id', _WORDS.format('text'), 'documents')})
SELECT ngram, count(DISTINCT d.id) AS owners FROM d WHERE ngram IN (SELECT ngram FROM b) GROUP BY ngram HAVING count(DISTINCT d.id) <= 2
""")
def leakage_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.leaked_ngrams(table(spark, sf_dir, "benchmark"), docs, "doc_id", "text")


@query(f"""
WITH v AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[2:3], ' ') AS value FROM benchmark),
s AS (SELECT value FROM v WHERE length(value) >= 4 AND value = trim(value) AND regexp_full_match(value, '[A-Za-z]+ [A-Za-z]+'))
SELECT doc_id, value FROM documents JOIN s ON contains(text, value)
WHERE regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_-])' || value || '($|[^\\p{{L}}\\p{{N}}_-])')
""")
def short_input_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.array_join(F.slice(F.split("text", " "), 2, 2), " ")
    inputs = table(spark, sf_dir, "benchmark").select(two.alias("value")).filter(F.col("value").rlike("^[A-Za-z]+ [A-Za-z]+$"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.short_inputs(inputs, docs, "value", "doc_id", "text")


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS words FROM documents
WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) <= 10
  AND NOT regexp_matches(text, '(?im)^\s*(hi|hello|dear|hey)\b') AND NOT regexp_matches(text, '(?im)^\s*(regards|sincerely|best|thanks|cheers)\b')
""")
def severe_short_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("words", text.word_count(F.col("text")))
    return docs.filter((F.col("words") <= 10) & ~text.has_greeting_or_signature(F.col("text"))).select("doc_id", "words")


@query(r"""
SELECT conv_id, turn, regexp_extract_all(text, '\b(\d+)\b', 1)[-1] AS answer FROM conversations
UNION ALL
SELECT page_id, -1, regexp_extract_all(url, '\b(\d+)\b', 1)[-1] FROM pages
""")
def last_integer_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.last_integer(F.col("text")).alias("answer"))
    pages = table(spark, sf_dir, "pages")
    return turns.unionAll(pages.select("page_id", F.lit(-1).cast("long"), text.last_integer(F.col("url"))))


@query(r"""
SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(p_name, '[`"'']', '', 'g')), '[\s-]+', '_', 'g')) AS label,
  lower(regexp_replace(trim(p_type), '[\s-]+', '_', 'g')) AS kind FROM part
""")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.normalize_label(F.col("p_name")).alias("label"), text.normalize_label(F.col("p_type")).alias("kind")
    )


@query(r"""
SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref, regexp_extract(url, '/(\d+)', 1) AS number FROM pages
""")
def url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^(https?)://", 1).alias("scheme"),
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"[?&]ref=([^&#]*)", 1).alias("ref"),
        F.regexp_extract("url", r"/(\d+)", 1).alias("number"),
    )


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
a AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS t FROM benchmark),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w),
tf AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM w) WHERE t IN (SELECT t FROM a) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
sc AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len / avg_len))), 6) AS score
  FROM tf JOIN df USING (t) JOIN a USING (t) CROSS JOIN s GROUP BY ALL
)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 7
""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.bm25_top(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")


@query("""
WITH q AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS q, max_by(text, turn) FILTER (role = 'assistant') AS o FROM conversations GROUP BY ALL),
t AS (SELECT conv_id, o, list_distinct(list_filter(string_split_regex(lower(coalesce(q, '')), '\\s+'), lambda x: x <> '')) AS q,
  list_distinct(list_filter(string_split_regex(lower(coalesce(o, '')), '\\s+'), lambda x: x <> '')) AS a FROM q),
r AS (SELECT conv_id, CASE WHEN o IS NULL OR trim(o) = '' THEN 0.0 WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, a))::double / len(q) END AS overlap FROM t)
SELECT conv_id, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.4 THEN 'hit' WHEN overlap >= 0.2 THEN 'partial' ELSE 'miss' END AS tier FROM r
""".replace("\\\\s", "\\s"))
def retrieval_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("q"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("o"),
    )
    rated = asked.select("conv_id", scores.retrieval_overlap(F.col("q"), F.col("o")).alias("overlap"))
    return rated.select("conv_id", F.round("overlap", 6).alias("overlap"), scores.retrieval_tier(F.col("overlap")).alias("tier"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS fingerprint, sha256(concat_ws(chr(31), source, lang, doc_id::varchar)) AS stable FROM documents")
def fingerprint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stable = text.stable_hash(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), stable.alias("stable"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '[' || (length(text) - 500) || ' chars truncated]' ELSE text END AS clipped,
  trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', ' ', 'g')) AS pattern_key,
  trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[-1]) AS last_line
FROM documents
""")
def clipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = text.pattern_key(F.concat_ws(" ", "source", "lang"))
    return docs.select("doc_id", text.clip(F.col("text"), 500).alias("clipped"), key.alias("pattern_key"), text.last_line(F.col("text")).alias("last_line"))


@query("""
SELECT event_id, CASE WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'timeout' WHEN m LIKE '%not found%' OR m LIKE '%unknown tool%' THEN 'not_found'
  WHEN m LIKE '%invalid%' OR m LIKE '%missing%' OR m LIKE '%required%' THEN 'invalid_args'
  WHEN m LIKE '%permission%' OR m LIKE '%forbidden%' OR m LIKE '%unauthorized%' THEN 'permission' ELSE 'other' END AS kind
FROM (SELECT event_id, (['Timeout after 5s', 'tool not found', 'Missing key', 'forbidden', 'boom'])[1 + event_id % 5] AS msg, lower(msg) AS m FROM events WHERE event_type = 'error')
""")
def tool_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.array(*map(F.lit, ["Timeout after 5s", "tool not found", "Missing key", "forbidden", "boom"]))
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return failed.select("event_id", text.classify_tool_error(F.get(messages, (F.col("event_id") % 5).cast("int"))).alias("kind"))


@query("SELECT event_id, replace(props, ': ', ':') AS props, len(json_keys(props))::INT AS n_keys FROM events")
def compact_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return events.select("event_id", values.compact_json("props").alias("props"), F.size(values.nested_keys("props")).alias("n_keys"))


def _decomposed(column: str) -> str:
    """SQL that splits the accented letters of Latin-1, the ones that the tables hold."""
    for letter in map(chr, range(0xC0, 0x100)):
        parts = unicodedata.normalize("NFD", letter)
        if parts != letter:
            column = f"replace({column}, '{letter}', '{parts[0]}' || chr({ord(parts[1])}))"
    return column


# A letter after a combining mark begins a word, as the mark is no letter; two passes, since neighbours share a border.
_ARTICLES = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}_])(?:a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \2', 'g')"
_BARE = r"regexp_replace(lower(t), '[!-/:-@\[-`{-~]', '', 'g')"


@query(f"""
SELECT doc_id, length(t)::INT AS length, sha256(trim(regexp_replace({_ARTICLES.format(_ARTICLES.format(_BARE))}, '\\s+', ' ', 'g'))) AS normalized
FROM (SELECT doc_id, {_decomposed('text')} AS t FROM documents)
""")
def nfd_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", values.decompose("text").alias("t"))
    return docs.select("doc_id", F.length("t").alias("length"), F.sha2(text.normalize_answer(F.col("t")), 256).alias("normalized"))
