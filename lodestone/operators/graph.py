"""k-nearest-neighbour graphs of all points, their undirected form and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.boxes import nearest_in_boxes
from lodestone.operators.cells import nearest_in_cells
from lodestone.operators.nearest import nearest


def nearest_pairs(points: DataFrame, k: int, axes: Sequence[str], metric: str | None = "m", block: int = 2048, search: str = "pairs") -> DataFrame:
    """(source, target, weight): the k + 1 nearest of every point, itself included, under the mean of both points' metrics.

    points: (row_id, axes, metric: row-major array). Without a metric, plain squared distances. Ties go by target.
    search: "pairs" compares all pairs, block by block, which long vectors need; "cells" gives the same rows and leaves out
    the pairs that bounds rule out, for points of a few axes; without a metric, through boxes."""
    if search == "cells":
        return nearest_in_boxes(points, points, k + 1, axes) if metric is None else nearest_in_cells(points, points, k + 1, axes, metric)
    return nearest(points, points, k + 1, axes, metric, block)


def updated_pairs(points: DataFrame, near: DataFrame, batch: DataFrame, k: int, axes: Sequence[str], metric: str | None = "m") -> DataFrame:
    """nearest_pairs of points and batch together, from near, those of points alone: the same rows.

    A point's k + 1 nearest change only if a new point is at most as far as the last of them. Those distances go along as
    bounds, so points meet the cells of new points that may be so near, and no others; points with fewer than k + 1 neighbours
    have none. New points are searched in all. Work grows with the batch, not with the square of the points."""
    reach = near.groupBy(F.col("source").alias("row_id")).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("w"))
    bounds = reach.select("row_id", F.when(F.col("n") > k, F.col("w")).otherwise(F.lit(float("inf"))).alias("bound"))
    closer = nearest_in_cells(points, batch, k + 1, axes, metric, bounds=bounds)
    order = Window.partitionBy("source").orderBy("weight", "target")
    old = near.select("source", "target", "weight").unionByName(closer).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")
    names = ["row_id", *axes, *([metric] if metric else [])]
    return old.unionByName(nearest_in_cells(batch, points.select(*names).unionByName(batch.select(*names)), k + 1, axes, metric))


def edges_of(near: DataFrame) -> DataFrame:
    """The edges in both directions of nearest_pairs, without loops."""
    one = near.where("source <> target")
    return one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))


def knn_edges(points: DataFrame, k: int, axes: Sequence[str], metric: str | None = "m", dedup: bool = False, block: int = 2048, search: str = "pairs") -> DataFrame:
    """(source, target, weight) in both directions, a multiset: mutual neighbours give an edge twice unless dedup.

    Loops go after the k + 1 nearest are chosen, so a point that isn't among its own nearest keeps k + 1 edges."""
    both = edges_of(nearest_pairs(points, k, axes, metric, block, search))
    return both.groupBy("source", "target").agg(F.min("weight").alias("weight")) if dedup else both


def graph_points(points: DataFrame, allocation: DataFrame, hub_table: DataFrame) -> DataFrame:
    """points with the metric of their hub."""
    return points.join(allocation, "row_id").join(hub_table.select("hub", "m"), "hub").drop("hub")


def nodes(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    return points.select(F.col("row_id").alias("id"), F.array(*(F.col(a).cast("float") for a in axes)).alias("features"))


def undirected(edges: DataFrame) -> DataFrame:
    """One row an unordered pair, source below target, with the least weight."""
    return edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.min("weight").alias("weight"))


def stats(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(num_nodes, num_edges, average_degree)."""
    n, e = points.agg(F.count(F.lit(1)).alias("num_nodes")), edges.agg(F.count(F.lit(1)).alias("num_edges"))
    return n.crossJoin(e).withColumn("average_degree", F.try_divide("num_edges", "num_nodes"))


def isolated(points: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("row_id")).unionByName(edges.select(F.col("target").alias("row_id")))
    return points.select("row_id").join(ends, "row_id", "left_anti")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source = target")
