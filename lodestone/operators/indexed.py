"""A stored index of pivot distances, so that the scan for one row's nearest neighbours skips what can't be near.

Every row is stored in the cell of its nearest pivot, in the order of its distance to it. By the triangle inequality a row at
most r from the reference lies between |ref - pivot| - r and |ref - pivot| + r of its cell's pivot: one range of each cell, which
the scan is given as a filter and Parquet's statistics turn into row groups to skip. The range of the cells around the
reference is read first, which bounds r.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.knn import _matrix, _ranked, _top, feature_distances

#: Rows of a row group, and how far bounds are moved to the safe side.
GROUP, LESS, MORE = 1000, 1 - 1e-9, 1 + 1e-9


def write(store: DataFrame, path: str, pivots: int = 64, group: int = GROUP) -> None:
    """Write store (row_id, s) under path as (row_id, s, cell, at) and, beside it, the cells (cell, pivot, rows, least, most).

    Pivots are the `pivots` rows whose ids have the smallest hashes; vectors must be of one length, without nulls. An empty
    store gives an empty index."""
    sample = store.orderBy(F.xxhash64("row_id"), "row_id").limit(pivots).select("s").collect()
    shared = store.sparkSession.sparkContext.broadcast([np.array(r.s, float) for r in sample])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                x, best, cell = _matrix(b.column(1)).astype(float), np.full(b.num_rows, np.inf), np.zeros(b.num_rows, np.int32)
                for i, p in enumerate(shared.value):
                    d = ((x - p) ** 2).sum(1)
                    cell[d < best], best = i, np.minimum(best, d)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(np.sqrt(best))], names=["row_id", "s", "cell", "at"])

    df = store.select(F.col("row_id").cast("long").alias("row_id"), "s")
    placed = df.mapInArrow(place, df.select("*").schema.add("cell", "integer").add("at", "double")).repartitionByRange("cell", "at", "row_id").sortWithinPartitions("cell", "at", "row_id")
    placed.write.option("parquet.block.row.count.limit", group).option("parquet.page.row.count.limit", group).mode("overwrite").parquet(path)
    found = store.sparkSession.read.parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("least"), F.max("at").alias("most"))
    names = store.sparkSession.createDataFrame([(i, [float(v) for v in r.s]) for i, r in enumerate(sample)], "cell int, pivot array<double>")
    found.join(names, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/_cells")


def near(spark: SparkSession, path: str, reference: Sequence[float], k: int) -> DataFrame:
    """The rows of an index among which are the k nearest of a vector, all ties included: filters that are pushed to the scan."""
    rows, ref = spark.read.parquet(path), np.asarray(reference, float)
    cells = spark.read.parquet(f"{path}/_cells").collect()  # a row a pivot
    far = {c.cell: float(np.sqrt(((ref - np.array(c.pivot)) ** 2).sum())) for c in cells}
    # rows are first read from around the reference, in the cells that lie nearest, until they are k
    first, held = [], 0
    for c in sorted(cells, key=lambda c: far[c.cell]):
        if held >= k:
            break
        first.append(c.cell)
        held += c.rows
    if not first or held < k:
        return rows
    some = feature_distances(rows.where(F.col("cell").isin(first)), ref, k).orderBy("dist", "row_id").limit(k)
    r = float(np.sqrt(some.agg(F.max("dist")).first()[0])) * MORE
    open_ = [(c.cell, far[c.cell] * LESS - r, far[c.cell] * MORE + r) for c in cells if far[c.cell] * LESS - r <= c.most and far[c.cell] * MORE + r >= c.least]
    ranges = [(F.col("cell") == cell) & F.col("at").between(low, high) for cell, low, high in open_]
    return rows.where(reduce(lambda a, b: a | b, ranges))


def knn(spark: SparkSession, path: str, ref_id: int, reference: Sequence[float], k: int) -> DataFrame:
    """(ref_id, rank, row_id, dist) as knn's Bruteforce gives them, from an index."""
    return _ranked(_top(feature_distances(near(spark, path, reference, k), reference, k), k), ref_id).select("ref_id", "rank", "row_id", "dist")
