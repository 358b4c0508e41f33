"""Static review of prompt variants: what a proposed prompt may not do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import LEAKAGE_NGRAM, ngrams, occurs_as_word, strip, words
from evalloom.operators.retrieval import short_inputs

# Fixed values of the review.
MIN_CASE_ID = 4
MAX_OWNERS = 2


def placeholders(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([^}]*)\}"), 1))


def sections(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(System|User):"), 1))


def review_prompts(variants: DataFrame, train: DataFrame, held_out: DataFrame) -> DataFrame:
    """(variant, code, detail) of every issue; variants have ``variant, previous, proposed``, cases ``case_id, text`` and
    ``input``.

    An empty or unchanged prompt has that issue alone. Issues on held-out cases do not tell which case.
    Variants are few and cases many: cases reach the variants through shared n-grams and first words,
    never by pairing all with all.
    """
    empty = strip(F.col("proposed")) == ""
    same = strip(F.col("proposed")) == strip(F.col("previous"))
    alone = variants.select("variant", F.when(empty, "non_empty").when(same, "no_change").alias("code"), F.lit("").alias("detail")).filter("code is not null")
    live = variants.filter(~empty & ~same)
    old, new = placeholders(F.col("previous")), placeholders(F.col("proposed"))
    moved = F.array_sort(F.concat(F.array_except(new, old), F.array_except(old, new)))
    lost = F.array_sort(F.array_except(sections(F.col("previous")), sections(F.col("proposed"))))
    own = live.select(
        "variant",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit("placeholder_integrity").alias("code"), F.array_join(moved, ",").alias("detail")),
                    F.struct(F.lit("section_structure").alias("code"), F.array_join(lost, ",").alias("detail")),
                ),
                lambda x: x["detail"] != "",
            )
        ),
    )
    ids = train.filter(F.length("case_id") >= MIN_CASE_ID).select(F.col("case_id").alias("value")).distinct()
    named = _named(live, ids, "value").select("variant", F.lit("case_id_reference").alias("code"), F.col("value").alias("detail"))
    copied = _named(live, train.select(F.col("input").alias("value")), "value", short=True)
    inputs = copied.select("variant", F.lit("train_input_copy").alias("code"), F.col("value").alias("detail"))
    text = _copied(live, train).select("variant", F.lit("train_example_leakage").alias("code"), F.col("ngram").alias("detail"))
    hidden = _copied(live, held_out).select("variant").unionByName(
        _named(live, held_out.select(F.col("input").alias("value")), "value", short=True).select("variant")
    )
    secret = hidden.distinct().select("variant", F.lit("specific_input_reference").alias("code"), F.lit("").alias("detail"))
    out = alone
    for part in (own, named, inputs, text, secret):
        out = out.unionByName(part)
    return out


def _named(variants: DataFrame, values: DataFrame, value: str, short: bool = False) -> DataFrame:
    """(variant, value): values that stand in the proposed prompt as words, but not in the previous one."""
    if short:
        found = short_inputs(values, variants, value, "variant", "proposed")
    else:
        first = values.withColumn("t", F.get(words(F.col(value)), F.lit(0)))
        held = variants.select("variant", "proposed", F.explode(F.array_distinct(words(F.col("proposed")))).alias("t"))
        found = held.join(first, "t").filter(occurs_as_word(F.col("proposed"), F.col(value))).select("variant", value)
    both = found.distinct().join(variants.select("variant", "previous"), "variant")
    return both.filter(~occurs_as_word(F.col("previous"), F.col(value))).select("variant", value)


def _copied(variants: DataFrame, cases: DataFrame) -> DataFrame:
    """(variant, ngram): n-grams new in the proposed prompt that one or two cases hold."""
    new = F.array_except(ngrams(words(F.col("proposed"))), ngrams(words(F.col("previous"))))
    fresh = variants.select("variant", F.explode(new).alias("ngram"))
    theirs = cases.select("case_id", F.explode(ngrams(words(F.col("text")), LEAKAGE_NGRAM)).alias("ngram"))
    owned = theirs.join(fresh.select("ngram").distinct(), "ngram", "left_semi").groupBy("ngram").agg(F.count("*").alias("owners"))
    return fresh.join(owned.filter(F.col("owners") <= MAX_OWNERS), "ngram").select("variant", "ngram")
