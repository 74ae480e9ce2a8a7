"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def thinned(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b), a > b, with the same components, and mostly far
    fewer where nodes have many neighbours in common: a node keeps the edge to the
    least of its lesser neighbours, and the others are tied to that one."""
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return low.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least
    node reachable. Each round takes the least label among a node's neighbours
    and then that label's own label, so distances shrink geometrically. A hub
    with very many edges is summed before its rows are shuffled, and the joins
    are plain equi-joins, which adaptive execution splits where one key is
    hot. They pass one row for each direction of the ``thinned`` edges. Rounds end in ``checkpoint()``; only a count comes to the driver."""
    few = thinned(edges)
    # both directions of every edge; none comes twice
    both = few.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").checkpoint()
    lab = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    lab = lab.checkpoint()
    while True:
        near = (both.join(lab.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")))
        new = lab.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hop = lab.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = (new.join(hop, "label").select("node", F.least("label", "next").alias("label"), "old")).checkpoint()
        moved = new.where("label <> old").limit(1).count()
        lab = new.select("node", "label")
        if not moved:
            return lab
