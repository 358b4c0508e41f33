"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring and review rules.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
WORD = r"[\p{L}\p{N}_]+"
LEAKAGE_NGRAM = 8
MIN_SHORT_INPUT = 4


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.trim(text, F.lit(" \t\n\r\x0b\x0c"))


def redact(text: Column) -> Column:
    """Mask e-mail and IPv4 addresses."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "<email>"), IPV4, "<ip_address>")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces. Accents are left as they are;
    ``functions.values.decompose`` splits them first where a corpus mixes forms."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "), r"\s+", " "))


def answer_tokens(text: Column) -> Column:
    """Tokens of the normalized answer; none for an empty one."""
    return F.filter(F.split(normalize_answer(text), " "), lambda t: t != "")


def ngrams(tokens: Column, n: int = LEAKAGE_NGRAM) -> Column:
    """Distinct n-grams of a token array, joined by spaces."""

    def of(t: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    # Bound to a lambda variable, the tokens are computed once and not once per n-gram.
    return F.get(F.transform(F.array(tokens), of), F.lit(0))


def ngram_count(tokens: Column, n: int = LEAKAGE_NGRAM) -> Column:
    """How many distinct n-grams a token array has, by 64-bit hashes: among the millions of n-grams of a very
    long text two are taken for one with a chance below one in a million."""

    def of(t: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.xxhash64(F.slice(t, i + 1, n)))
        return F.when(F.size(t) >= n, F.size(F.array_distinct(found))).otherwise(0)

    return F.get(F.transform(F.array(tokens), of), F.lit(0)).cast("long")


def last_line(text: Column) -> Column:
    """Last line with content, trimmed."""
    return strip(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""), F.lit(-1)))


def normalize_label(text: Column) -> Column:
    """A label without fences and quotes, blanks and hyphens as underscores, lower-cased."""
    bare = F.trim(F.regexp_replace(text, r"[`\"']", ""))
    return F.lower(F.regexp_replace(bare, r"[\s-]+", "_"))


def first_label(text: Column, labels: list[str]) -> Column:
    """The first of ``labels`` that stands in the text as a word, in the labels' order; else the last line."""
    known = [F.when(F.lower(text).rlike(rf"\b{x}\b"), F.lit(x)) for x in labels]
    return F.coalesce(*known, normalize_label(last_line(text)))


def last_integer(text: Column) -> Column:
    """Last boxed integer, else the last integer that stands alone, else null."""
    boxed = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{\s*(\d+)\s*\}"), 1), F.lit(-1))
    alone = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), 1), F.lit(-1))
    return F.coalesce(boxed, alone)


def marked_field(text: Column, name: str) -> Column:
    """Text between ``[[ ## name ## ]]`` and the next marker, else the whole text; trimmed."""
    found = F.regexp_extract(text, rf"(?s)\[\[ ## {name} ## \]\](.*?)(?=\[\[ ##|$)", 1)
    return strip(F.when(found != "", found).otherwise(text))


def strip_fences(text: Column) -> Column:
    """Without a first and a last code-fence line."""
    return F.regexp_replace(F.regexp_replace(text, r"\A\s*```[^\n]*\n", ""), r"\n```\s*\z", "")


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, with a note of how many are missing."""
    note = F.concat(F.substring(text, 1, limit), F.lit("["), (F.length(text) - limit).cast("string"), F.lit(" chars truncated]"))
    return F.when(F.length(text) > limit, note).otherwise(text)


def pattern_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def has_greeting_or_signature(text: Column) -> Column:
    return text.rlike(r"(?im)^\s*(hi|hello|dear|hey)\b") | text.rlike(r"(?im)^\s*(regards|sincerely|best|thanks|cheers)\b")


def clean_query(text: Column) -> Column:
    """A search query without quotes and Boolean operators."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[\"']", ""), r"\b(AND|OR|NOT)\b", " "), r"\s+", " "))


def is_retrieval_step(name: Column) -> Column:
    return F.lower(name).rlike("retriev|search|fetch")


def classify_tool_error(message: Column) -> Column:
    """Kind of a tool error; the first rule that fits decides."""
    low = F.lower(message)
    return (
        F.when(low.rlike("timeout|timed out"), "timeout")
        .when(low.rlike("not found|unknown tool"), "not_found")
        .when(low.rlike("invalid|missing|required"), "invalid_args")
        .when(low.rlike("permission|forbidden|unauthorized"), "permission")
        .otherwise("other")
    )


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def occurs_as_word(text: Column, literal: Column) -> Column:
    """Whether ``literal`` stands in the text with no word character or hyphen on either side."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_-])\Q"), F.replace(literal, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![\p{L}\p{N}_-])"))
    return F.regexp_like(text, pattern)


def stable_hash(*cols: Column) -> Column:
    """SHA-256 of the parts, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *cols), 256)


def fingerprint(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def json_object(text: Column) -> Column:
    """First JSON object of a model's reply, fences dropped, as variant; null if it does not parse."""
    return F.try_parse_json(F.regexp_extract(strip_fences(text), r"(?s)(\{.*\})", 1))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null for text that is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))
