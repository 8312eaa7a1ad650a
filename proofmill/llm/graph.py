"""Connected components of links, as tables: labels fall to the smallest neighbour's and jump along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.session import written_once


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``a, b`` links; the label is the smallest node that can be reached.

    Each round is a written table, so a lost executor repeats one round at most. It ends when no label
    falls any more, after about as many rounds as the logarithm of the longest chain.
    """
    links = links.select("a", "b").filter("a <> b")
    edges = written_once(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written_once(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"), F.lit(True).alias("fell")), "labels")
    while not labels.filter("fell").isEmpty():
        old = labels.select("node", F.col("label").alias("old"))
        near = (
            edges.join(labels.select(F.col("node").alias("a"), "label"), "a")
            .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        )
        fallen = old.join(near, "node").select("node", "old", F.least("old", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = F.least("mid", F.coalesce("far", "mid"))
        labels = written_once(
            fallen.join(jump, "mid", "left").select("node", new.alias("label"), (new < F.col("old")).alias("fell")), "labels"
        )
    return labels.select("node", "label")
