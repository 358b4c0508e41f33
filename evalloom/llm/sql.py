"""DuckDB SQL for the operators that SQL can express, by query name."""

from __future__ import annotations

from evalloom.llm.license_scan import MIN_PERCENT, PHRASE_SCORE, PHRASES, SEEDS, TEMPLATES, words_of
from evalloom.llm.quality_rules import STOP_WORDS, THRESHOLDS

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SEPARATORS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _kept() -> str:
    out = []
    for t in THRESHOLDS:
        base = f"greatest({t.denominator}, 1)"
        if t.low is not None:
            out.append(f"{t.numerator}::double >= {t.low}::double * {base}")
        if t.high is not None:
            out.append(f"{t.numerator}::double <= {t.high}::double * {base}")
    return " AND ".join(out)


OP9 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
)
SELECT p.page_id, p.host, p.path,
  (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM r
   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
  coalesce((SELECT max_by(r.verdict, length(r.host || r.path)) FROM r
   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM p
"""

OP10 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, {_SEPARATORS}, '') <> '') AS lines
  FROM documents
), w AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)
), hit AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM w) WHERE n > 1
), rep AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM hit CROSS JOIN (VALUES (0), (1), (2)) AS s(k) GROUP BY row_id
), m AS (
  SELECT doc_id, len(words) AS n_words, length(translate(text, {_SEPARATORS}, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
    len(list_filter(words, lambda w: lower(rtrim(w, '.,;:!?')) IN ({_STOP}))) AS n_stop_words
  FROM d LEFT JOIN rep USING (row_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_kept()} AS kept
FROM m
"""

OP1 = rf"""
WITH d AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later CROSS JOIN range(0, 20) AS s(k)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id) AS c USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(doc_id, low) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(low)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY ALL
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win) WHERE f < doc_id
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later CROSS JOIN range(0, 50) AS s(k)
), runs AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE p IS NULL OR p < i - 1) AS spans
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM covered) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i) AS t
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d) ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), line AS (
  SELECT doc_id, i, x, translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '' AS full_line
  FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM d)
), unit AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS u FROM line WHERE full_line
), win AS (
  SELECT a.doc_id, a.u, a.x AS x1, b.x AS x2, c.x AS x3 FROM unit a
  JOIN unit b ON a.doc_id = b.doc_id AND b.u = a.u + 1 JOIN unit c ON a.doc_id = c.doc_id AND c.u = a.u + 2
), later AS (
  SELECT doc_id, u FROM (SELECT doc_id, u, row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id, u) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, u + k AS u FROM later CROSS JOIN range(0, 3) AS s(k)
), owner AS (
  SELECT line.doc_id, line.i, line.x, max(unit.u) OVER (PARTITION BY line.doc_id ORDER BY line.i) AS u
  FROM line LEFT JOIN unit USING (doc_id, i)
), kept AS (
  SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM owner ANTI JOIN covered USING (doc_id, u) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM unit GROUP BY doc_id) AS n USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id) AS c USING (doc_id)
"""


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_TEMPLATES = ", ".join(
    f"({i}, '{t.label}', {_list(t.words)}, {t.slack}, {_list(' '.join(words_of(k)) for k in t.key)}, {_list(sorted({w for k in t.key for w in words_of(k)}))})"
    for i, t in enumerate(TEMPLATES)
)
_PHRASES = ", ".join(f"('{p.label}', {_list(words_of(p.text))})" for p in PHRASES)

OP11 = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t(tid, label, body, slack, phrases, needed) AS (VALUES {_TEMPLATES}
), p(label, body) AS (VALUES {_PHRASES}
), posting AS (
  SELECT tid, unnest(body) AS w, unnest(range(len(body))) AS j FROM t
), vocabulary AS (
  SELECT DISTINCT w FROM (SELECT w FROM posting UNION ALL SELECT unnest(needed) FROM t UNION ALL SELECT unnest(body) FROM p)
), word AS MATERIALIZED (
  SELECT rid, i, w FROM (SELECT rid, unnest(w) AS w, unnest(range(len(w))) AS i FROM d) SEMI JOIN vocabulary USING (w)
), known AS MATERIALIZED (
  SELECT DISTINCT rid, w FROM word
), weight AS MATERIALIZED (
  SELECT v.w, floor(1000 * ln((1.0 + (SELECT count(*) FROM d)) / (1 + count(k.rid))))::INTEGER + 1 AS n
  FROM vocabulary v LEFT JOIN known k USING (w) GROUP BY v.w
), total AS (
  SELECT tid, sum(n) AS n FROM (SELECT DISTINCT tid, w FROM posting) JOIN weight USING (w) GROUP BY tid
), candidate AS (
  SELECT k.rid, t.tid FROM (SELECT tid, len(needed) AS n, unnest(needed) AS w FROM t) AS t JOIN known k USING (w)
  GROUP BY k.rid, t.tid, t.n HAVING count(*) = t.n
), seed AS (
  SELECT c.rid, c.tid, k.w FROM candidate c JOIN (SELECT DISTINCT tid, w FROM posting) x ON x.tid = c.tid
  JOIN known k ON k.rid = c.rid AND k.w = x.w JOIN weight ON weight.w = k.w
  QUALIFY row_number() OVER (PARTITION BY c.rid, c.tid ORDER BY weight.n DESC, k.w) <= {SEEDS}
), place AS (
  SELECT s.rid, s.tid, word.i - posting.j AS o,
    lead(word.i - posting.j) OVER (PARTITION BY s.rid, s.tid ORDER BY word.i - posting.j) AS after
  FROM seed s JOIN word ON word.rid = s.rid AND word.w = s.w JOIN posting ON posting.tid = s.tid AND posting.w = s.w
), region AS (
  SELECT DISTINCT place.rid, t.tid, t.label, t.phrases, t.body, o,
    d.w[greatest(o, 0) + 1 : greatest(o + len(t.body) + t.slack, 0)] AS r
  FROM place JOIN t USING (tid) JOIN d ON d.rid = place.rid WHERE after - o <= t.slack
), found AS (
  SELECT rid, tid, label, o, (SELECT sum(weight.n) FROM weight WHERE list_contains(body, weight.w) AND list_contains(r, weight.w)) AS n
  FROM region WHERE len(list_filter(phrases, lambda k: contains(' ' || array_to_string(r, ' ') || ' ', ' ' || k || ' '))) = len(phrases)
), good AS (
  SELECT rid, label, max(found.n)::DOUBLE / total.n AS share FROM found JOIN total USING (tid)
  GROUP BY rid, tid, label, total.n HAVING 100 * max(found.n) >= {MIN_PERCENT} * total.n
), base AS (
  SELECT rid, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(body)] = body)) AS i FROM d CROSS JOIN p
), b AS (
  SELECT rid, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid
), l AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM good) GROUP BY rid
)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  coalesce((SELECT max(share) FROM good WHERE good.rid = d.rid), CASE WHEN b.n > 0 THEN {PHRASE_SCORE} ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)
"""

OP12 = r"""
WITH e AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), score AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_dot_product(a.x, b.x)::BIGINT AS s
  FROM e a JOIN e b ON a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM score WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.s AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.s DESC, n.vec_id)::INTEGER AS rank
  FROM positive p JOIN score n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label
    AND 100 * n.s BETWEEN 50 * p.positive_score AND 95 * p.positive_score
) WHERE rank <= 3
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op2_ngram_jaccard_join": OP2,
    "op3_suffix_array_dedup": OP3,
    "op8_line_dedup": OP8,
    "op9_url_filter": OP9,
    "op10_quality_rules": OP10,
    "op11_license_scan": OP11,
    "op12_hard_negatives": OP12,
}
