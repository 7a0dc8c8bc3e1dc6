"""How much neighbourhoods of two methods overlap, and what methods cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def iou_curve(a: DataFrame, b: DataFrame, axes: Sequence[str], k: int) -> DataFrame:
    """(K, intersection, union, iou) for K = 1 .. k - 1: the first K neighbours without rank 0, compared as parameter rows.

    a, b: (rank, axes). A row of a counts at K once K reaches its rank and the first rank of an equal row in b, so one
    join and a running sum over at most k rows give the whole curve."""
    inside = lambda x: x.where((F.col("rank") >= 1) & (F.col("rank") < k))
    first = inside(b).groupBy(*axes).agg(F.min("rank").alias("first"))
    hits = inside(a).join(first, list(axes)).groupBy(F.greatest("rank", "first").alias("K")).agg(F.count(F.lit(1)).alias("n"))
    ks = a.sparkSession.range(1, k).select(F.col("id").cast("int").alias("K"))
    so_far = Window.orderBy("K").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ks.join(hits, "K", "left").withColumn("intersection", F.sum(F.coalesce("n", F.lit(0))).over(so_far))
    out = out.withColumn("union", 2 * F.col("K") - F.col("intersection"))
    return out.select("K", "intersection", F.col("union").cast("long").alias("union"), (F.col("intersection") / F.col("union")).alias("iou"))


def trade_off(spark: SparkSession, measured: Sequence[tuple[str, float, float]]) -> DataFrame:
    """(method, seconds, iou) of own measurements."""
    return spark.createDataFrame(list(measured), "method string, seconds double, iou double")
