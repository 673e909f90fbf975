"""Connected components by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame, functions as F

from .shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points from its larger to its smaller end here
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _signature(edges: DataFrame) -> tuple:
    value = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(F.shiftright(value, 20)), F.bit_xor(value)).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component is the smallest node.

    Each round keeps the components and ends in a written table, so lost executors cost one round
    at most. A node's neighbours are reduced by partial minima and joins; they never meet in one
    row, and only a count and a checksum reach the driver. Loops and repeated edges are allowed;
    nodes without an edge do not appear. An edge with a null end is ignored.
    """
    current = materialize(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars"
    )
    seen = _signature(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        current = materialize(_small_star(_large_star(current).distinct()).distinct(), "stars")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
