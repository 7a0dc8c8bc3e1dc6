"""Exact nearest neighbours of points of a few axes under plain distances, through boxes.

A tree of planes, made from a sample of the targets, cuts space into boxes of about as many targets each. A task searches the
sources of a box among its targets, which lie in leaves, so a source has k targets and with the last of them a bound. Most
sources are farther than that from every other box and done; the others go to the boxes that are nearer. Work and memory of a
task are those of a box, and what a source costs doesn't grow with the number of points but for the depth of the tree.

Bounds are sums of squares in the order of the distances, and rounding keeps order, so they need no room for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.cells import nearest_in_cells, split
from lodestone.operators.nearest import first
from lodestone.sources.scratch import Stored

#: Targets of a box at least and at most, in the mean; those that no plane parted; sampled targets for each box.
FEW, MANY, HEAVY, SAMPLE = 1 << 11, 1 << 15, 1 << 18, 64
#: Rows of a leaf, leaves that are held against all others at once, and the nearest ones, searched first.
LEAF, TOGETHER, NEAREST = 32, 8, 4


class Planes:
    """A tree of planes across the longest side of what they part. Leaves are numbered boxes."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.axis, self.at, self.child, self.boxes = [], [], [], 0
        todo = [(np.arange(len(sample)), boxes, -1, 0)]
        while todo:
            rows, wanted, parent, side = todo.pop()
            x, me = sample[rows], len(self.axis)
            if parent >= 0:
                self.child[parent][side] = me
            part = wanted > 1 and len(rows) > 1 and np.ptp(x, axis=0).max() > 0
            j = int(np.ptp(x, axis=0).argmax()) if part else 0
            if part:
                low = np.sort(x[:, j])
                at = low[len(low) * (wanted // 2) // wanted]
                at = at if at > low[0] else low[np.searchsorted(low, low[0], side="right")]  # neither side is empty
                right = x[:, j] >= at
                todo += [(rows[right], wanted - wanted // 2, me, 1), (rows[~right], wanted // 2, me, 0)]
            self.axis.append(j)
            self.at.append(at if part else 0.0)
            self.child.append([me, me] if part else [-1 - self.boxes] * 2)
            self.boxes += not part
        self.axis, self.at, self.child = np.array(self.axis), np.array(self.at), np.array(self.child)

    def box(self, x: np.ndarray) -> np.ndarray:
        """The box of each row."""
        node = np.zeros(len(x), np.int64)
        while True:
            some = np.flatnonzero(node >= 0)
            if not len(some):
                return (-1 - node).astype(np.int32)
            n = node[some]
            node[some] = self.child[n, (x[some, self.axis[n]] >= self.at[n]).astype(int)]


def _gap(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The least squared distances between boxes, summed as distances are."""
    out = 0.0
    for j in range(low.shape[1]):
        g = np.maximum(np.maximum(lows[:, j] - high[:, j, None], low[:, j, None] - highs[:, j]), 0)
        out = out + g * g
    return out


def _leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in leaves (-1 where the last has none), their points (nan there) by axis, and the leaves' boxes."""
    at = np.full(-(-len(x) // LEAF) * LEAF, -1)
    at[: len(x)] = split(x, LEAF)
    at = at.reshape(-1, LEAF)
    v = np.where((at >= 0)[None], x.T[:, at], np.nan)
    return at, v, np.nanmin(v, axis=2).T, np.nanmax(v, axis=2).T


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of points by axis, as ploss() sums them."""
    out = None
    for a, b in zip(x, y):
        g = a[:, :, None] - b[:, None, :]
        np.multiply(g, g, out=g)
        out = g if out is None else np.add(out, g, out=out)
    return out


def search(x: np.ndarray, bound: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, counted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, ids and distances of the k nearest of y that are at or below the rows' bounds, by row, distance and id."""
    # equal rows are searched once, and of equal targets only the k with the smallest ids can be among anyone's nearest
    order = np.lexsort((ids, *y.T))
    same = (y[order[1:]] == y[order[:-1]]).all(1)
    if same.any():
        start = np.flatnonzero(np.r_[True, ~same])
        order = order[np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)])) < k]
        ids, y = ids[order], y[order]
    by = np.lexsort(x.T)
    same = (x[by[1:]] == x[by[:-1]]).all(1)
    if same.any():
        one = np.empty(len(x), np.int64)
        one[by] = np.cumsum(np.r_[True, ~same]) - 1
        most = np.full(one.max() + 1, -np.inf)
        np.maximum.at(most, one, bound)
        r, found, q = search(x[by[np.r_[True, ~same]]], most, ids, y, k, counted)
        start, n = np.searchsorted(r, np.arange(len(most))), np.bincount(r, minlength=len(most))[one]
        at = np.repeat(start[one] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows = np.repeat(np.arange(len(x)), n)
        fit = q[at] <= bound[rows]
        return rows[fit], found[at][fit], q[at][fit]

    mine, vx, low, high = _leaves(x)
    theirs, vy, lows, highs = _leaves(y)
    limit, out = np.where(mine >= 0, bound[mine], -np.inf), []

    def keep(q: np.ndarray, leaf: np.ndarray, targets: np.ndarray) -> None:
        """What is at or below the limits of a leaf's rows."""
        if counted is not None:
            counted.add(q.size)
        at = np.flatnonzero(q <= limit[leaf][:, :, None])
        p, i, j = np.unravel_index(at, q.shape)
        found.append((mine[leaf[p], i], ids[targets[p, j]], q.ravel()[at]))

    near = min(len(lows), max(NEAREST, -(-k // LEAF) + 1))
    for s in range(0, len(mine), TOGETHER):
        some, found = np.arange(s, min(s + TOGETHER, len(mine))), []
        gap = _gap(low[some], high[some], lows, highs)
        if np.isinf(limit[some]).any():
            close = np.argpartition(gap, near - 1, axis=1)[:, :near]
            q = _distances(vx[:, some], vy[:, close].reshape(len(vy), len(some), -1))
            if k <= q.shape[2]:
                last = np.partition(q, k - 1, axis=2)[:, :, k - 1]
                limit[some] = np.fmin(limit[some], np.where(mine[some] >= 0, last, -np.inf))
            keep(q, some, theirs[close].reshape(len(some), -1))
            np.put_along_axis(gap, close, np.nan, axis=1)
        a, b = np.nonzero(gap <= limit[some].max(1)[:, None])
        for i in range(0, len(a), 4 * TOGETHER):
            p, t = some[a[i : i + 4 * TOGETHER]], b[i : i + 4 * TOGETHER]
            keep(_distances(vx[:, p], vy[:, t]), p, theirs[t])
        r, i, q = first(*map(np.concatenate, zip(*found)), k) if found else (np.zeros(0, np.int64), ids[:0], bound[:0])
        out.append((r, i, q))
    r, i, q = (np.concatenate(p) for p in zip(*out))
    at = np.argsort(r, kind="stable")
    return r[at], i[at], q[at]


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    """Columns of one row: the arrays' bytes."""
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _rows(v: np.ndarray) -> pa.Array:
    """A column of the bytes of each row of v."""
    width = v.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(np.arange(0, width * len(v) + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(v).tobytes())])


def _get(b: pa.RecordBatch, name: str, i: int, kind: type = float) -> np.ndarray:
    return np.frombuffer(b.column(name)[i].as_buffer(), kind)


def _points(column: pa.Array, d: int) -> np.ndarray:
    """The points whose bytes a column has."""
    return np.array([np.frombuffer(x, float) for x in column.to_pylist()]).reshape(-1, d) if column.offset else np.frombuffer(column.buffers()[2], float, len(column) * d).reshape(-1, d)


def nearest_in_boxes(sources: DataFrame, targets: DataFrame, k: int, axes: Sequence[str], counted=None) -> DataFrame:
    """(source, target, weight): the k nearest rows of targets (row_id) of each row of sources (row_id) under plain distances,
    ties by target; the same rows, bit by bit, as nearest() gives.

    counted: a Spark accumulator of the pairs whose distance was computed. Points with a null or non-finite coordinate have no
    distance and are left out of both sides; repeated ids are rows of their own; an empty side gives an empty table. A table
    with a point so often that no plane parts it goes through cells, which search equal points of all tasks once."""
    spark, d = targets.sparkSession, len(axes)
    store, cores = Stored(spark), spark.sparkContext.defaultParallelism
    values = [F.col(a).cast("double") for a in axes]
    finite = lambda df: df.select(F.col("row_id").cast("long").alias("id"), F.array(*values).alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    theirs = finite(targets)
    count = theirs.count()
    if not count:
        return spark.createDataFrame([], "source long, target long, weight double")
    wanted = max(1, count // max(FEW, min(MANY, count // (4 * cores))))
    sampled = theirs.where(F.pmod(F.xxhash64("id"), F.lit(max(1, count // (SAMPLE * wanted)))) == 0).select("v").toArrow()
    planes = Planes(sampled.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d), wanted)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    shared = spark.sparkContext.broadcast(planes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.box(v)), b.column(0), _rows(v)], names=["box", "id", "v"])

    def packed(rows: DataFrame, most: int, bounded: bool = False) -> DataFrame:
        """One row for each up to `most` rows of a box: their ids, points and bounds as bytes, and the box they fill."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def give() -> Iterator[pa.RecordBatch]:
                ids, v, bound = (np.concatenate(x) for x in zip(*(h[1:] for h in held)))
                for i in range(0, len(ids), most):
                    s = slice(i, i + most)
                    yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), *_bytes(ids[s], v[s], bound[s], np.r_[v[s].min(0), v[s].max(0)]), pa.array([len(ids[s])], pa.int64())], names=["box", "ids", "v", "bounds", "fills", "n"])
                held.clear()

            for b in batches:
                box, ids, v = b.column("box").to_numpy(), b.column("id").to_numpy(), _points(b.column("v"), d)
                bound = b.column("bound").to_numpy() if bounded else np.full(len(ids), np.inf)
                start = np.flatnonzero(np.diff(box, prepend=-1))
                for s, e in zip(start, np.r_[start[1:], len(box)]):
                    if held and (held[0][0] != box[s] or sum(len(h[1]) for h in held) >= most):
                        yield from give()
                    held.append((int(box[s]), ids[s:e].copy(), v[s:e].copy(), bound[s:e].copy()))
            if held:
                yield from give()

        return rows.repartition(parts, "box").sortWithinPartitions("box").mapInArrow(pack, "box int, ids binary, v binary, bounds binary, fills binary, n long")

    placed = "box int, id long, v binary"
    spread = lambda df: df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
    boxes = store.put("boxes", packed(spread(theirs).mapInArrow(place, placed), HEAVY))
    made = boxes.select("box", "fills", "n").toArrow()
    if len(made) > len(set(made.column("box").to_pylist())):
        store.drop("boxes")
        return nearest_in_cells(sources, targets, k, axes, compared=counted)
    fills = np.full((planes.boxes, 2 * d), np.nan)  # a box that no target is in has no distance
    fills[made.column("box").to_numpy()] = np.array([np.frombuffer(x, float) for x in made.column("fills").to_pylist()]).reshape(-1, 2 * d)
    known = spark.sparkContext.broadcast(fills)

    whole = boxes.select("box", F.col("ids").alias("t_ids"), F.col("v").alias("t_v"))
    if sources is targets:
        own = boxes.select("box", "ids", "v", "ids", "v").toDF("box", "ids", "v", "t_ids", "t_v").repartition(parts)
    else:  # a box without targets leaves its sources to the others
        own = packed(spread(finite(sources)).mapInArrow(place, placed), MANY).select("box", "ids", "v").repartition(parts, "box").join(whole.repartition(parts, "box"), "box", "left")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of a box's sources in it, apart for those that are done, and which other boxes the others ask."""
        for b in batches:
            for i in range(b.num_rows):
                box, ids, x = b.column("box")[i].as_py(), _get(b, "ids", i, np.int64), _get(b, "v", i).reshape(-1, d)
                if b.column("t_ids")[i].is_valid:
                    r, found, q = search(x, np.full(len(x), np.inf), _get(b, "t_ids", i, np.int64), _get(b, "t_v", i).reshape(-1, d), k, counted)
                else:
                    r, found, q = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                n = np.bincount(r, minlength=len(x))
                bound, full = np.full(len(x), np.inf), np.flatnonzero(n == k)
                bound[full] = q[np.cumsum(n)[full] - 1]
                low, high = known.value[:, :d], known.value[:, d:]
                may = np.flatnonzero(_gap(x.min(0)[None], x.max(0)[None], low, high)[0] <= bound.max())
                may, row, asked = may[may != box], [], []
                for s in range(0, len(x) if len(may) else 0, 1024):
                    at, to = np.nonzero(_gap(x[s : s + 1024], x[s : s + 1024], low[may], high[may]) <= bound[s : s + 1024, None])
                    row.append(at + s)
                    asked.append(may[to])
                row, asked = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (row, asked))
                open_ = np.zeros(len(x), bool)
                open_[row] = True
                for some, mine in ((~open_[r], True), (open_[r], False)):
                    ask = (asked[:0], row[:0]) if mine else (asked, row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([mine]), *_bytes(ids[r[some]], found[some], q[some], ask[0].astype(np.int32), ids[ask[1]], x[ask[1]], bound[ask[1]])],
                        names=["done", "source", "target", "weight", "to", "id", "v", "bound"],
                    )

    met = store.put("met", own.mapInArrow(inside, "done boolean, source binary, target binary, weight binary, to binary, id binary, v binary, bound binary"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_get(b, n, i, t)) for n, t in (("source", np.int64), ("target", np.int64), ("weight", float))], names=["source", "target", "weight"])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_get(b, "to", i, np.int32)), pa.array(_get(b, "id", i, np.int64)), _rows(_get(b, "v", i).reshape(-1, d)), pa.array(_get(b, "bound", i))], names=["box", "id", "v", "bound"])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What other boxes have at or below the bounds."""
        for b in batches:
            for i in range(b.num_rows):
                ids = _get(b, "ids", i, np.int64)
                r, found, q = search(_get(b, "v", i).reshape(-1, d), _get(b, "bounds", i), _get(b, "t_ids", i, np.int64), _get(b, "t_v", i).reshape(-1, d), k, counted)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(found), pa.array(q)], names=["source", "target", "weight"])

    row = "source long, target long, weight double"
    flat = lambda done: met.where(F.col("done") == done).select("source", "target", "weight").mapInArrow(pairs, row)
    asking = packed(met.where(~F.col("done")).select("to", "id", "v", "bound").mapInArrow(asks, "box int, id long, v binary, bound double"), MANY, True)
    others = asking.select("box", "ids", "v", "bounds").join(whole.repartition(parts, "box"), "box").mapInArrow(beyond, row)
    order = Window.partitionBy("source").orderBy("weight", "target")
    merged = flat(False).unionByName(others).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    return flat(True).unionByName(store.put("merged", merged))
