"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import checkpoint, forget


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (both long, not null) reaches.

    Each round every node takes the smallest label among its own and its neighbours', then that
    label's own label, so labels jump along chains; rounds end when none changes. State is one row
    per node, cut from its lineage each round; the round before is deleted. Nodes with very many links are reduced before the
    shuffle; the join that reads their links can be split by adaptive execution.
    """
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = checkpoint(edges.unionAll(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = old = checkpoint(edges.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = checkpoint(step.join(up, "low").select("node", F.least("low", "lower").alias("label"), (F.least("low", "lower") < F.col("label")).alias("moved")))
        forget(old)
        labels, old = new.select("node", "label"), new
        if new.filter("moved").isEmpty():
            forget(edges)
            return labels.withColumnRenamed("label", "component")
