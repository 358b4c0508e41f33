"""Guidelines, patterns and rubric verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.scores import severity_weight, status_value
from evalloom.functions.text import pattern_key


def consolidate_patterns(patterns: DataFrame, guideline: str, kind: str, text: str, source: str, group: str, order: str, confidence: str) -> DataFrame:
    """Patterns with the same guideline, kind and normalized text as one: first text, number of sources and of
    distinct groups, highest confidence."""
    return (
        patterns.withColumn("key", pattern_key(F.col(text)))
        .groupBy(guideline, kind, "key")
        .agg(
            F.min_by(text, order).alias("text"),
            F.count_distinct(source).alias("sources"),
            F.count_distinct(group).alias("support"),
            F.max(confidence).alias("confidence"),
        )
    )


def guideline_support(lessons: DataFrame, guideline: str, record: str, least: int = 2, strong: int = 3) -> DataFrame:
    """Distinct records behind each guideline; included from ``least`` on, strong from ``strong`` on."""
    found = lessons.groupBy(guideline).agg(F.count_distinct(record).alias("support"))
    return found.withColumn("included", F.col("support") >= least).withColumn("strong", F.col("support") >= strong)


def judge(criteria: DataFrame, case: str, severity: str, status: str) -> DataFrame:
    """Severity-weighted score of each case (0 to 100, rounded to 4 digits), critical violations and applicable
    criteria. Criteria that do not apply are left out; critical ones count as violated unless satisfied."""
    value, weight = status_value(F.col(status)), severity_weight(F.col(severity))
    used = F.when(value.isNotNull(), weight)
    critical = (F.col(severity) == "critical") & value.isNotNull() & (F.coalesce(status, F.lit("")) != "satisfied")
    return criteria.groupBy(case).agg(
        F.round(100.0 * F.try_divide(F.sum(value * weight), F.sum(used)), 4).alias("judge_score"),
        F.count_if(critical).alias("critical_violations"),
        F.count(used).alias("applicable"),
    )


def label_metrics(pairs: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Per label precision, recall and F1 (times 100, rounded to 2 digits). The macro F1 of a run is the mean of
    these rounded values."""
    e, p = F.coalesce(expected, F.lit("")), F.coalesce(predicted, F.lit(""))
    sides = F.array(
        F.struct(e.alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p"), (e == p).cast("int").alias("both")),
        F.struct(p.alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("both")),
    )
    counts = pairs.select(F.inline(sides)).filter("label <> ''").groupBy("label").agg(
        F.sum("e").alias("expected"), F.sum("p").alias("predicted"), F.sum("both").alias("both")
    )

    def share(of: Column) -> Column:
        return F.round(F.when(of > 0, 100.0 * F.col("both") / of).otherwise(0.0), 2)

    total = F.col("expected") + F.col("predicted")
    return counts.select(
        "label", "expected", "predicted", share(F.col("predicted")).alias("precision"), share(F.col("expected")).alias("recall"),
        F.round(F.when(total > 0, 200.0 * F.col("both") / total).otherwise(0.0), 2).alias("f1"),
    )


def token_f1(pairs: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    """(key, f1): overlap F1 of two token arrays as multisets, times 100; 0 if either is empty. Tokens are counted by
    grouping, so work grows with the texts' lengths. ``key`` tells the pairs apart."""
    sides = [
        pairs.select(key, F.explode(predicted).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("e")),
        pairs.select(key, F.explode(expected).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("e")),
    ]
    counts = sides[0].unionAll(sides[1]).groupBy(key, "t").agg(F.sum("p").alias("p"), F.sum("e").alias("e"))
    common = counts.groupBy(key).agg(F.sum(F.least("p", "e")).alias("common"), F.sum(F.col("p") + F.col("e")).alias("total"))
    f1 = F.coalesce(200.0 * F.col("common") / F.col("total"), F.lit(0.0))
    return pairs.select(key).join(common, key, "left").select(key, f1.alias("f1"))
