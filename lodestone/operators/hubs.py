"""Hub metrics and the allocation of every point to the hub that is nearest in the hub's own metric."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.cells import nearest_in_cells
from lodestone.operators.nearest import Terms, compare
from lodestone.operators.precompute import metrics

#: Hubs up to which a task holds them all: their parameters and metrics, a few hundred bytes each.
MOST_HUBS = 100_000
#: Hubs whose distances to some points are held at once, found by a matrix product.
HUBS = 512


def hub_metrics(points: DataFrame, hubs: DataFrame, chain, axes: Sequence[str], partitions: int | None = None) -> DataFrame:
    """(hub, row_id, m) for a table of (hub, row_id): each distinct row's metric is computed once."""
    rows = hubs.select("row_id").distinct().join(points, "row_id")
    return hubs.join(metrics(rows, chain, axes, partitions=partitions), "row_id").select("hub", "row_id", "m")


def allocation(points: DataFrame, hub_table: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(row_id, hub) of the nearest hub, the first on ties. hub_table: (hub, row_id, m).

    Hubs are a configured sample of the points. Up to MOST_HUBS they travel with the tasks, and only two numbers a point come
    back; beyond, they are put into metric cells, and points meet the cells that bounds leave open: the same rows, with
    nothing gathered but the cells' pivots."""
    mine = hub_table.join(points, "row_id").select("hub", "m", *axes)
    if mine.count() > MOST_HUBS:
        near = nearest_in_cells(points, mine.withColumnRenamed("hub", "row_id"), 1, axes, "m", of_targets=True)
        return near.select(F.col("source").alias("row_id"), F.col("target").cast("int").alias("hub"))
    rows = mine.orderBy("hub").collect()
    shared = points.sparkSession.sparkContext.broadcast(([r.hub for r in rows], np.array([list(r)[2:] for r in rows], float), np.array([r.m for r in rows], float)))

    def run(batches):
        names, theta, m = shared.value
        parts = []
        for b in batches:
            if not b.num_rows or not names:
                continue
            if not parts:
                y = np.column_stack([theta, m])
                parts = [(np.arange(i, min(i + HUBS, len(y))), y[i : i + HUBS], Terms(y[i : i + HUBS], len(axes), False)) for i in range(0, len(y), HUBS)]
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(axes))])
            best, at = np.full(b.num_rows, np.inf), np.zeros(b.num_rows, np.int64)
            for ids, y, terms in parts:
                r, j, q = compare(x, ids, y, 1, len(axes), best, terms)
                better = q < best[r]
                best[r[better]], at[r[better]] = q[better], j[better]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(names, np.int32)[at])], names=["row_id", "hub"])

    mine = points.select(F.col("row_id").cast("long").alias("row_id"), *(F.col(a).cast("double") for a in axes))
    cores = 2 * points.sparkSession.sparkContext.defaultParallelism  # a small file would be one task
    return (mine.repartition(cores) if mine.rdd.getNumPartitions() < cores else mine).mapInArrow(run, "row_id long, hub int")
