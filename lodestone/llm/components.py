"""Connected components over an edge table, without gathering links or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node links to the smallest node around it."""
    around = _both(edges)
    low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, link to the smallest of them. Edges have a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, store: Stored, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it reaches.

    Alternates large and small stars until the edges stop changing; every round is a written table. Minima are
    pre-aggregated and hot nodes' joins are Spark's to split, so a star of any degree is no single task's work.
    Loops (a = b), repeated edges and an empty table are allowed; a node with only a loop isn't returned.
    """
    rows = edges.count()
    now = store.put("cc", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    mark = None
    for i in range(max_rounds):
        after = store.put(f"cc{i % 2}", _small_star(_large_star(now)), rows)
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        store.drop("cc")
        now, rows = after, seen[0]
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
