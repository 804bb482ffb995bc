"""Connected components of a link table, as Spark joins.

Each round every node takes the smallest label among its neighbours and its
own, then the label of that label (pointer jumping), so the rounds grow with
the logarithm of a chain's length. A round is two equi-joins and aggregates
that combine before the shuffle; a node with very many links is a skewed join
key, which adaptive execution splits. Labels are written to the shared folder
each round; the driver sees one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import few_files, saved


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every node in ``links`` (a long, b long); the
    component is the smallest node id that can be reached."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(both.where("a <> b").distinct(), f"{tag}-edges")
    rows = edges.count()  # no fewer than nodes
    labels = saved(few_files(edges.groupBy("a").agg(F.min("b").alias("low"))
                   .select(F.col("a").alias("node"), F.least("a", "low").alias("label"), F.lit(True).alias("moved")), rows), tag)
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy("a").agg(F.min("label").alias("near")))
        least = (labels.join(near.withColumnRenamed("a", "node"), "node")
                 .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        hop = least.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = saved(few_files(least.join(hop, "label").select(
            "node", F.least("label", "beyond").alias("label"), (F.col("old") > F.least("label", "beyond")).alias("moved")), rows), tag)
        if labels.where("moved").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
