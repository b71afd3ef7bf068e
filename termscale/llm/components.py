"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscale.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or other smaller) neighbours to the smallest one among them and itself."""
    both = edges
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    linked = both.join(least, "a")
    if large:
        return linked.filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
    others = linked.filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return others.unionByName(least.select("a", F.col("root").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b) that is not the smallest of its component, which is its root.

    Edges are undirected; loops, repeated edges and edges with a null end change nothing. A node's neighbours are
    combined before the shuffle and never gathered. The number of rounds grows with the logarithm of the nodes.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = edges.filter("a <> b").select(larger, smaller).distinct()
    current, before = written(current, "edges"), None
    while True:
        sums = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
        current = written(_star(_star(current, True), False), "edges")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
