"""Connected components of an undirected graph by minimum labels with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, settled


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> (node, comp): comp is the smallest node that the node reaches.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so
    paths shorten by half.  Labels are written to the shared folder each round; nothing but a count
    comes to the driver.  An empty graph gives no rows; loops and repeated edges are harmless."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = settled(both, "cc-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
    labels = written = settled(labels, "cc-labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        new = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = new.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = new.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        new = settled(new, "cc-labels")
        forget(written)
        written = new
        if not new.filter("comp <> old").limit(1).count():
            forget(both)
            return new.select("node", "comp")
        labels = new.select("node", "comp")
    raise RuntimeError("components did not settle")
