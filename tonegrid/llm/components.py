"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two joins and aggregations on the node, so that no component is ever gathered in
one task; minima are pre-aggregated before they are shuffled, and the edges of hubs, which their
counts tell, are joined apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hot_limit, joined
from .storage import checkpointed


def _large_star(edges: DataFrame, limit: int | None) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("n", "m")
    least = both.groupBy("n").agg(F.min("m").alias("least"), F.count("*").alias("degree")).withColumn("least", F.least("n", "least"))
    return _with_least(both.where("m > n"), least, limit).where("m <> least").select(F.col("m").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame, limit: int | None) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
    least = down.groupBy("n").agg(F.min("m").alias("least"), F.count("*").alias("degree"))
    rest = _with_least(down, least, limit).where("m <> least").select(F.col("m").alias("a"), F.col("least").alias("b"))
    return rest.union(least.select("n", "least")).distinct()


def _with_least(edges: DataFrame, least: DataFrame, limit: int | None) -> DataFrame:
    """Edges with the least neighbour of ``n``; with a limit those of nodes of more edges are joined apart."""
    return edges.join(least.drop("degree"), "n") if limit is None else joined(edges, least, "n", "degree", limit)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; a differs from b); root is the least node reachable.

    Ends when a round changes nothing, which the number and a digest of the edges tell; every round
    is checkpointed.  Nodes without an edge don't occur in the result.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    told = None
    while True:
        # Hubs gather as `b`, the lesser end of their edges.
        by_node = edges.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"))
        row = by_node.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("most")).first()
        if (row.n, row.h) == told or not row.n:
            break
        told = (row.n, row.h)
        limit = hot_limit(2 * row.n)
        limit = limit if row.most > limit // 2 else None
        edges = checkpointed(_small_star(_large_star(edges, limit), limit))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
