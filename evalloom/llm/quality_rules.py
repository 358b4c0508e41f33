"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a native expression over the whole text, so the operator is a narrow projection:
no shuffle, no Python, any number of partitions. Repeated word windows are found by sorting a
document's own three-word windows, which costs n log n for a text of n words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators and symbols of the contract, and common function words.
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "with", "be", "as",
    "le", "la", "les", "de", "des", "et", "un", "en", "que", "qui", "du", "est", "pour",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht",
    "el", "los", "las", "y", "se", "del", "por", "con", "una", "para",
)

WORD_SPLIT = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Threshold:
    """``low <= numerator / denominator <= high``; a missing bound does not count."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: Bounds that clean prose in any of the corpus languages meets with a wide margin.
THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2.0, 12.0),
    Threshold("symbols", "n_symbols", "n_words", high=0.2),
    Threshold("stop_words", "n_stop_words", "n_words", low=0.02),
    Threshold("upper_case", "n_upper", "word_chars", high=0.3),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text, first ones included."""
    n = F.size(words)
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
            ),
        ),
    )

    def starts(ordered: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            match = y["h"] == x["h"]
            for k in range(3):
                match = match & (F.get(words, y["i"] + k) == F.get(words, x["i"] + k))
            return F.coalesce(match, F.lit(False))

        return F.transform(
            ordered,
            lambda x, i: F.when(same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)), x["i"]),
        )

    # Binding the sorted array to a lambda variable evaluates it once.
    repeated = F.flatten(F.transform(F.array(F.sort_array(windows)), starts))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.sort_array(F.filter(repeated, lambda x: x.isNotNull())),
        zero,
        lambda a, x: F.struct(
            (a["n"] + (x + 3 - F.greatest(x, a["end"]))).cast("long").alias("n"), (x + 3).alias("end")
        ),
        lambda a: a["n"],
    )
    return F.coalesce(covered, F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with every count that the threshold table refers to (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.trim(text, F.lit(SEPARATORS)).alias("inner"))
    words = F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", WORD_SPLIT))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    stop = F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*STOP_WORDS))
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size(stop).cast("long").alias("n_stop_words"),
    )


def compile_rules(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The threshold table as one array of the names of the rules that a row breaks."""

    def broken(t: Threshold) -> Column:
        value, base = F.col(t.numerator).cast("double"), F.greatest(F.col(t.denominator), F.lit(1))
        fails = F.lit(False)
        if t.low is not None:
            fails = fails | (value < F.lit(t.low) * base)
        if t.high is not None:
            fails = fails | (value > F.lit(t.high) * base)
        return F.when(fails, F.lit(t.name))

    return F.array_compact(F.array(*[broken(t) for t in thresholds]))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    thresholds: tuple[Threshold, ...] = THRESHOLDS,
) -> DataFrame:
    """Counts, broken rules and verdict of every row.

    A null or empty text has no words: all counts are 0, ``base_failed`` is true. Repeated rows and
    null ids are judged row by row. Other columns of ``docs`` are ignored, whatever their names.
    """
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    rated = measures(docs, id_col, text_col).select("*", failed.alias("base_failed"), compile_rules(thresholds).alias("broken_rules"))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
