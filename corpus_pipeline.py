"""The corpus pipeline: documents through the training-data operators, stage by stage.

Every stage judges what its predecessor kept, and takes and returns the columns of ``documents``; the
last one returns token ids. Rows are carried through the operators or filtered where they stand, so
columns beyond id and text stay as they are. A row without an id passes the deduplication of whole
documents; a null text counts as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.bpe import byte_bpe
from evalloom.llm.decontaminate import Decontaminator
from evalloom.llm.ngram_join import ngram_jaccard_join
from evalloom.llm.quality_classifier import fit_quality
from evalloom.llm.queries import fold
from evalloom.llm.window_dedup import line_dedup
from evalloom.session import checkpoint, forget, table

QUALITY_CUT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels outside the held-out fold, accepts."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold("id") != 0)
    return docs.filter(model.scores(F.col("text"), spark) >= QUALITY_CUT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of three-line windows that occurred before; those that lose every
    line go, for all they held stands in earlier documents."""
    found = line_dedup(docs, carry=True).filter("n_units = 0 or n_removed < n_units")
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by similar sets of shingles; of
    rows that repeat that id the one with the least text."""
    first = ngram_jaccard_join(docs).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("first_id")).agg(F.count("*").alias("n"))
    first = checkpoint(first)
    same = docs["doc_id"] == F.col("first_id")
    kept = docs.join(first.filter("n = 1"), same, "left_semi")
    repeated = docs.join(first.filter("n > 1"), same, "left_semi")
    least = F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.struct(F.col("text").isNotNull(), "text")).alias("row")
    one = repeated.groupBy("doc_id").agg(least).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionAll(one).unionAll(docs.filter(docs["doc_id"].isNull()))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = Decontaminator(docs, table(spark, sf_dir, "benchmark"))
    return docs.filter(F.size(found.leaks(F.col("text"))) == 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe(docs, path, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]
#: The classifier's scores cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage kept is deleted once its successor's rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
            if before is not None:
                forget(before)
            before = docs
    return docs
