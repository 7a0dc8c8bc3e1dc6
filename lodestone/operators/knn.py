"""k nearest neighbours of one or many reference rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import distance as D
from lodestone.operators.nearest import nearest


def _reference(points: DataFrame, ref_id: int, columns: Sequence[str]) -> list:
    row = points.where(F.col("row_id") == int(ref_id)).select(*columns).first()
    if row is None:
        raise ValueError(f"no row {ref_id}")
    return list(row)


def _top(df: DataFrame, k: int) -> DataFrame:
    """The k nearest by (dist, row_id): every task keeps k, the driver's merge sees k a task."""
    return df.orderBy("dist", "row_id").limit(k)


def _ranked(df: DataFrame, ref_id: int) -> DataFrame:
    """Ranks of at most k rows."""
    return df.withColumn("ref_id", F.lit(int(ref_id)).cast("long")).withColumn("rank", (F.row_number().over(Window.partitionBy("ref_id").orderBy("dist", "row_id")) - 1).cast("int"))


def knn(points: DataFrame, ref_id: int, k: int, method: str, axes: Sequence[str] = ("tau", "p", "d", "alpha"), chain=None, metric: Sequence[float] | None = None, store: DataFrame | None = None) -> DataFrame:
    """(ref_id, rank, row_id, dist, axes): the k nearest rows of points; rank 0 is usually the reference itself.

    method: P-loss (axes), PNP (axes under metric, or the metric of chain at the reference) or Bruteforce (store's s).
    Ties go by row_id; if there are fewer than k rows, all come. Only (row_id, dist, axes) of k rows a task are sorted.
    """
    D.distance(method)
    if method == "Bruteforce":
        near = _top(feature_distances(store, _reference(store, ref_id, ["s"])[0], k), k)
        out = near if points is None else near.join(points, "row_id")
        names = [] if points is None else list(axes)
    else:
        r = _reference(points, ref_id, axes)
        if method == "PNP" and metric is None:
            metric = np.asarray(chain.metric(np.array(r))).ravel()
        # one row beside every point; as literals, some sums would be folded in another order
        one = points.sparkSession.createDataFrame([([float(v) for v in r], [float(v) for v in (metric if method == "PNP" else [])])], "_r array<double>, _m array<double>")
        c, ref = [F.col(a) for a in axes], [F.col("_r")[i] for i in range(len(axes))]
        dist = D.ploss(c, ref) if method == "P-loss" else D.pnp(c, ref, [F.col("_m")[i] for i in range(len(axes) ** 2)])
        out, names = _top(points.select("row_id", *axes).crossJoin(F.broadcast(one)).select("row_id", *axes, dist.alias("dist")), k), list(axes)
    return _ranked(out, ref_id).select("ref_id", "rank", "row_id", "dist", *names)


def feature_distances(store: DataFrame, reference: Sequence[float], k: int | None = None) -> DataFrame:
    """(row_id, dist) of stored vectors to one vector; with k, at most the k nearest (and ties) of each batch."""
    r = np.asarray(reference, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, dist = b.column(0), D.block(_matrix(b.column(1)), r)
            if k is not None and k < len(dist):
                near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1]) if k else np.zeros(0, int)
                ids, dist = ids.take(pa.array(near)), dist[near]
            yield pa.RecordBatch.from_arrays([ids, pa.array(dist)], names=["row_id", "dist"])

    return store.select(F.col("row_id").cast("long").alias("row_id"), "s").mapInArrow(run, "row_id long, dist double")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def knn_many(points: DataFrame, refs: DataFrame, k: int, axes: Sequence[str]) -> DataFrame:
    """(ref_id, rank, row_id, dist) of P-loss neighbours for a table of ref_ids, or on any vectors given as axes.

    Any number of references: they are packed into blocks that meet the blocks of points, which are scanned once; a task
    keeps k rows for each reference it is at. Repeated ref_ids count once; those that no point has are left out."""
    mine = points.join(refs.select(F.col("ref_id").alias("row_id")).distinct(), "row_id", "left_semi")
    found = nearest(mine, points, k, axes)
    w = Window.partitionBy("ref_id").orderBy("dist", "row_id")
    found = found.select(F.col("source").alias("ref_id"), F.col("target").alias("row_id"), F.col("weight").alias("dist"))
    return found.select("ref_id", (F.row_number().over(w) - 1).alias("rank"), "row_id", "dist")
