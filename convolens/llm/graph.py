"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours above (large) or not above (small) a node point at its least neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
    joined = both.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))
    return out.where("src > dst").distinct()


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``pairs`` (columns a, b); the component is its least node.

    Each round is written to the shared folder. Rounds end when the edges no longer change, which
    is when every node points at the least node of its component.
    """
    edges = pairs.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).where("src > dst").distinct()
    edges = materialize(edges, "edges")
    mark = None
    for _ in range(max_rounds):
        edges = materialize(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst") % 1_000_000_007)).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
