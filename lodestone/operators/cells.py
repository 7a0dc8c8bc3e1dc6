"""Exact nearest neighbours through metric cells: what bounds rule out is never compared.

Targets are put into the cell of their nearest pivot, a bounded sample of the points; a cell knows how many it has, how far
they reach and the least eigenvalue of their metrics. A first pass compares each source with the cells around it until k
targets are met, which bounds its k-th distance. By the triangle inequality a cell whose pivot is farther than its radius
and that bound can't hold a nearer one, nor can a cell whose side of the plane between two pivots is too far away, so a second
pass visits the remaining cells only. Within a cell, targets lie in leaves that bounds rule out too. Plain distances are
those after a linear map that makes the metrics' mean the identity. Under metrics, the distance of x and y is half of that
under M_x and half of that under M_y: the first is at least (|x - p|_Mx - sqrt(largest eigenvalue of M_x) * radius)^2, the
second the same under the cell's own metric, less what its others may be below that one, or the cell's least eigenvalue times
the squared plain distance. A source whose metric has a negative eigenvalue meets all cells. Where only targets have metrics
(a hub's own), the second counts alone.

Sources meet cells by an equality join, as blocks of rows; hot cells are salted by how many targets they have. Equal points
are searched once, and of equal targets only the k with the smallest ids can be among anyone's nearest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.nearest import MANY, Terms, compare, first
from lodestone.sources.scratch import Stored

#: The most pivots (each task holds them), and salts of a hot cell.
PIVOTS, SALTS = 2048, 64
#: Rows of a leaf, of a block of sources, of a block of targets, and rows that are held against all pivots at once.
LEAF, BLOCK, HELD, STEP = 64, 2048, 8192, 64
#: Targets with metrics up to which a block's leaves aren't looked at.
WHOLE = 1024
#: Sources for each part that a cell's are cut into.
PART = 1 << 15
LESS, MORE = 1 - 1e-9, 1 + 1e-9  # bounds are rounded to the safe side
LOOSE, SLACK = 1e-7, 1e-12  # what rounding may do to eigenvalues, and to distances beside the size of coordinates


class Cells:
    """Pivots with the counts, radii, least eigenvalues, own metrics of their cells and how far those of others are below.

    Plain distances are those after the linear map `a`, if there is one: it makes the metrics' mean the identity."""

    def __init__(self, pivots: np.ndarray, metric: bool, ref: np.ndarray | None = None, a: np.ndarray | None = None, planes: bool = True):
        n, self.d = pivots.shape
        self.pivots, self.metric, self.ref, self.a = pivots, metric, ref, a
        self.mapped, self.inverse = mapped(pivots, a), None if a is None else np.linalg.inv(a)
        self.count, self.radius, self.least, self.loose = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf), np.zeros(n)
        self.top = self.values(ref)[:, -1] if metric else None
        self.planes, self.apart = planes, None

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Plain distances of rows of x to the pivots."""
        out, z = np.zeros((len(x), len(self.pivots))), mapped(x, self.a)
        for j in range(self.d):
            out += (z[:, j, None] - self.mapped[:, j]) ** 2
        return np.sqrt(out)

    def values(self, m: np.ndarray) -> np.ndarray:
        """Eigenvalues of metrics beside the identity of plain distances."""
        return np.linalg.eigvalsh(m if self.a is None else self.inverse.T @ m @ self.inverse)

    def below(self, m: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each metric: at most its least eigenvalue (negative if it isn't a sum of squares), and at least how far it is below ref."""
        raw, own = np.linalg.eigvalsh(m), self.values(m)
        least = np.where(raw[:, 0] >= -1e-12 * np.abs(raw[:, -1]), np.maximum(own[:, 0] - LOOSE * np.abs(own[:, -1]), 0), np.minimum(raw[:, 0], own[:, 0]))  # zero is found by rounding only
        return least, np.maximum(self.values(ref - m)[:, -1] + LOOSE * (np.abs(own[:, -1]) + np.abs(self.values(ref)[:, -1])), 0)

    def lower(self, x: np.ndarray, m: np.ndarray | None, plain: np.ndarray) -> np.ndarray:
        """Below or at the least distance of each row of x to the rows of each cell."""
        slack = SLACK * (np.abs(mapped(x, self.a)).max(1) + np.abs(self.mapped).max())[:, None] if self.a is not None else 0.0
        near, far = np.maximum(0, plain * LESS - self.radius * MORE - slack), plain + self.radius + slack
        if self.planes:  # the rows of a cell are on its pivot's side of the plane between it and the pivot nearest to x
            if self.apart is None:
                self.apart = np.concatenate([self.distances(self.pivots[i : i + STEP]) for i in range(0, len(self.pivots), STEP)])
            j = plain.argmin(1)
            least, between = plain[np.arange(len(x)), j][:, None], self.apart[j]
            room = (plain - least) * (plain + least) - SLACK * far * far - 4 * slack * far
            near = np.maximum(near, np.divide(room, 2 * between, out=np.zeros(plain.shape), where=between > 0) * LESS - slack)
        if not self.metric:
            return near * near * LESS
        apart = [x[:, i, None] - self.pivots[:, i] for i in range(self.d)]

        def reach(metric, top) -> np.ndarray:
            """The square of the least distance under one metric."""
            own = sum(metric(i, j) * apart[i] * apart[j] * (1 if i == j else 2) for i in range(self.d) for j in range(i, self.d))
            return np.maximum(np.sqrt(np.maximum(own * LESS, 0)) - np.sqrt(np.maximum(top, 0) * (1 + LOOSE)) * (self.radius * MORE + slack), 0) ** 2

        low = np.maximum(np.maximum(self.least, 0) * near * near, reach(lambda i, j: self.ref[:, i, j], self.top) - self.loose * far * far)
        safe, top = self.least >= 0, self.top
        if m is not None:
            values = self.values(m)
            raw = np.linalg.eigvalsh(m)
            low = (low + reach(lambda i, j: m[:, i, j, None], values[:, -1:])) / 2
            safe, top = safe & (raw[:, :1] >= -1e-12 * np.abs(raw[:, -1:])), top + values[:, -1:]  # both are squares' sums
        return np.where(safe, low * LESS - SLACK * np.abs(top) * far * far, -np.inf)


class Boxes:
    """The leaves of a block without metrics: boxes along the axes."""

    def __init__(self, stats: np.ndarray, d: int):
        self.low, self.high = stats[:, :d], stats[:, d:]

    def lower(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.low)))
        for j in range(x.shape[1]):
            out += np.maximum(np.maximum(self.low[:, j] - x[:, j, None], x[:, j, None] - self.high[:, j]), 0) ** 2
        return out * LESS


def mapped(x: np.ndarray, a: np.ndarray | None) -> np.ndarray:
    """Rows of x after the linear map a, term by term, so that a row gives the same in any company."""
    return x if a is None else np.column_stack([sum(a[i, j] * x[:, j] for j in range(x.shape[1])) for i in range(len(a))])


def mean_map(m: np.ndarray) -> np.ndarray | None:
    """A map after which the mean of the metrics is the identity, or nearly; None where the mean is no metric."""
    values, vectors = np.linalg.eigh(m.mean(0))
    if not values[-1] > 0 or not np.isfinite(values).all():
        return None
    return np.sqrt(np.maximum(values, 1e-6 * values[-1]))[:, None] * vectors.T


def split(z: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of rows in which each `leaf` of them lie together: halves along the longest side, again and again."""
    out, todo = [], [np.arange(len(z))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        half = leaf * (-(-len(at) // leaf) // 2)
        at = at[np.argpartition(z[at, np.ptp(z[at], axis=0).argmax()], half)]
        todo += [at[half:], at[:half]]
    return np.concatenate(out)


def leaf_stats(v: np.ndarray, c: Cells, d: int) -> np.ndarray:
    """What bounds need of each leaf: its box, or centre, radius, least eigenvalue, looseness and own metric."""
    starts = np.arange(0, len(v), LEAF)
    x, m = v[:, :d], _metrics(v, d)
    if m is None:
        return np.column_stack([np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)])
    size = np.diff(np.r_[starts, len(v)])
    centre, ref = np.add.reduceat(x, starts) / size[:, None], np.add.reduceat(m, starts) / size[:, None, None]
    mine = np.repeat(np.arange(len(starts)), size)
    radius = np.sqrt((mapped(x - centre[mine], c.a) ** 2).sum(1))
    least, loose = c.below(m, ref[mine])
    return np.column_stack([centre, np.maximum.reduceat(radius, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(loose, starts), ref.reshape(len(ref), -1)])


def leaves(stats: np.ndarray, c: Cells, d: int):
    """The bound of a block's leaves as a function of rows and their metrics."""
    if not c.metric:
        boxes = Boxes(stats, d)
        return lambda x, m: boxes.lower(x)
    part = Cells(stats[:, :d], True, stats[:, d + 3 :].reshape(-1, d, d), c.a, planes=False)
    part.radius, part.least, part.loose = stats[:, d], stats[:, d + 1], stats[:, d + 2]
    return lambda x, m: part.lower(x, m, part.distances(x))


def _metrics(v: np.ndarray, d: int) -> np.ndarray | None:
    if v.shape[1] == d:
        return None
    m = v[:, d:].reshape(-1, d, d)
    return (m + m.transpose(0, 2, 1)) / 2


def _values(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = dist.argmin(1)
    return cell, dist[np.arange(len(dist)), cell]


def _list(rows: np.ndarray, kind=pa.float64()) -> pa.Array:
    """A one-row column with an array in it."""
    return pa.ListArray.from_arrays(pa.array([0, rows.size], pa.int32()), pa.array(rows.ravel(), kind))


def _blocks(rows: DataFrame, order: Sequence[str], width: int, size: int, shared, d: int, stats: bool = False, by: tuple | None = None) -> DataFrame:
    """(cell, ids, v, bounds, leaves) of up to `size` rows of one cell that lie together; rows: (cell, id, v, bound).
    by: how to deal rows out, by ranges of the order if not given, for which Spark makes the rows twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        c = shared.value

        def give(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of the cells that are complete, and of any cell with HELD rows; gives back what is left."""
            t = t.combine_chunks()
            cell = t.column("cell").to_numpy()
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            for s, e in zip(starts, np.r_[starts[1:], len(cell)]):
                for a in range(s, e, HELD):
                    n = min(HELD, e - a)
                    if n < HELD and e == len(cell) and not last:
                        held.append(t.slice(a).combine_chunks().to_batches()[0])
                        return
                    b = t.slice(a, n).combine_chunks().to_batches()[0]
                    v = _values(b, "v", width)
                    at = split(mapped(v[:, :d], c.a))
                    v, ids, bounds = v[at], b.column("id").to_numpy()[at], b.column("bound").to_numpy()[at]
                    for i in range(0, n, size):
                        some = slice(i, i + size)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([cell[a]], pa.int32()), _list(ids[some], pa.int64()), _list(v[some]), _list(bounds[some]), _list(leaf_stats(v[some], c, d) if stats else np.zeros(0))],
                            names=["cell", "ids", "v", "bounds", "leaves"],
                        )

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 2 * HELD:
                t = pa.Table.from_batches(held)
                held.clear()
                yield from give(t, False)
        if held:
            yield from give(pa.Table.from_batches(held), True)

    rows = rows.select("cell", "id", "v", "bound")
    rows = (rows.repartition(*by) if by else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "cell int, ids array<bigint>, v array<double>, bounds array<double>, leaves array<double>")


def nearest_in_cells(sources: DataFrame, targets: DataFrame, k: int, axes: Sequence[str], metric: str | None = None, pivots: int | None = None, compared=None, of_targets: bool = False, bounds: DataFrame | None = None) -> DataFrame:
    """(source, target, weight): the k nearest rows of targets (row_id) of each row of sources (row_id), ties by target; the
    same rows, bit by bit, as nearest() gives. of_targets: only targets have the metric, and it alone counts.
    bounds: (row_id, bound) of sources that ask only for targets at or below a bound, up to k; others ask for nothing.

    pivots: cells to make, twice the square root of the different points by default and at most PIVOTS; compared: a Spark
    accumulator of the pairs whose distance was computed. Points with a null or non-finite coordinate have no distance and
    are left out of both sides; repeated ids are rows of their own; an empty side gives an empty table."""
    spark, d = targets.sparkSession, len(axes)
    width = d + (d * d if metric else 0)
    width_s, unbounded = d if of_targets else width, bounds is None
    store = Stored(spark)
    values = [F.col(a).cast("double") for a in axes] + ([F.col(metric)[i].cast("double") for i in range(d * d)] if metric else [])
    plain = lambda df, n: df.select(F.col("row_id").cast("long").alias("id"), F.array(*values[:n]).alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    mine = store.put("sources", plain(sources, width_s))
    if bounds is not None:
        mine = store.put("bounded", mine.join(bounds.select(F.col("row_id").cast("long").alias("id"), F.col("bound").cast("double").alias("bound")), "id"))
    # sources with equal points are searched as one
    one = store.put("one", mine.groupBy("v").agg(F.min("id").alias("id"), *([F.max("bound").alias("bound")] if bounds is not None else [])))
    smallest = Window.partitionBy("v").orderBy("id")
    theirs = store.put("targets", plain(targets, width).withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k).drop("_r"))

    # the work of a row is the same everywhere, whatever few files the rows lie in
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    count = theirs.count()
    wanted = max(1, min(PIVOTS, pivots or round(2 * count**0.5)))
    sample = theirs.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("v"), "id").limit(wanted).select("v").collect()
    empty = spark.createDataFrame([], "source long, target long, weight double")
    if not sample:
        return empty
    first_rows = np.array([r.v for r in sample], float)
    own = _metrics(first_rows, d)
    cells = Cells(first_rows[:, :d], bool(metric), own, mean_map(own) if metric else None)
    shared = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                b = whole.slice(s, BLOCK)
                v = _values(b, "v", width)
                near = [_nearest(c.distances(v[i : i + STEP, :d])) for i in range(0, len(v), STEP)]
                cell, at = (np.concatenate(p) for p in zip(*near))
                m = _metrics(v, d)
                least, loose = c.below(m, c.ref[cell]) if m is not None else (np.zeros(len(v)),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("id"), b.column("v"), pa.array(at), pa.array(least), pa.array(loose)], names=["cell", "id", "v", "at", "bound", "loose"])

    row = "cell int, id long, v array<double>, bound double"
    placed = store.put("placed", theirs.repartition(parts).mapInArrow(place, "cell int, id long, v array<double>, at double, bound double, loose double"))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("radius"), F.min("bound").alias("least"), F.max("loose").alias("loose")).collect():  # a row a pivot
        cells.count[r.cell], cells.radius[r.cell], cells.least[r.cell], cells.loose[r.cell] = r.n, r.radius, r.least, r.loose
    shared = spark.sparkContext.broadcast(cells)
    blocks = store.put("blocks", _blocks(placed, ["cell", "at", "id"], width, HELD, shared, d, stats=True).drop("bounds"))
    fair = 4 * max(1, count // len(cells.pivots))
    salts = spark.createDataFrame([(i, max(1, min(SALTS, int(n) // fair))) for i, n in enumerate(cells.count)], "cell int, salts int")

    def met(c: Cells, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the nearest cells of each source until they have k targets."""
        dist = np.where(c.count > 0, dist, np.inf)
        cell = dist.argmin(1)
        few = np.flatnonzero(c.count[cell] < k)
        if not len(few):
            return np.arange(len(cell)), cell
        order = np.argsort(dist[few], axis=1, kind="stable")
        there = c.count[order]
        rows, cols = np.nonzero((np.cumsum(there, axis=1) - there < k) & (there > 0))
        enough = np.setdiff1d(np.arange(len(cell)), few)
        return np.r_[enough, few[rows]], np.r_[cell[enough], order[rows, cols]]

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, STEP):
                b = whole.slice(s, STEP)
                rows, cell = met(c, c.distances(_values(b, "v", width_s)[:, :d]))
                yield _asked(b, rows, cell, np.full(len(rows), np.inf))

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other cells that may have something at or below a source's bound."""
        c = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, STEP):
                b = whole.slice(s, STEP)
                v, bound = _values(b, "v", width_s), b.column("bound").to_numpy(zero_copy_only=False)
                dist = c.distances(v[:, :d])
                open_ = (c.lower(v[:, :d], _metrics(v, d), dist) <= bound[:, None]) & (c.count > 0)
                if unbounded:
                    open_[met(c, dist)] = False
                rows, cell = np.nonzero(open_)
                yield _asked(b, rows, cell, bound[rows])

    def _asked(b: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("id").take(take), b.column("v").take(take), pa.array(bound)], names=["cell", "id", "v", "bound"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, ids, best = shared.value, None, None

        def done() -> pa.RecordBatch:
            rows, found, q = best
            return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(found), pa.array(q)], names=["source", "target", "weight"])

        for b in batches:
            for i in range(b.num_rows):
                get = lambda name: b.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                a = get("ids")
                if ids is None or not np.array_equal(a, ids):  # rows come block of sources by block of sources
                    if best is not None:
                        yield done()
                    ids, best = a.copy(), None
                    x, bound = get("v").reshape(-1, width_s).copy(), get("bounds").copy()
                names, y = get("t_ids"), get("t_v").reshape(-1, width)
                terms = Terms(y, d, width_s > d) if width > d and len(y) >= MANY else None
                new = [best] if best is not None else []
                if width > d and len(y) <= WHOLE:  # bounds of leaves under metrics cost more than a product with all of them
                    new.append(_all(x, bound, names, y, terms))
                else:
                    lower = leaves(get("leaves").reshape(-(-len(y) // LEAF), -1), c, d)
                    for s in range(0, len(x), LEAF):
                        new += _leaf(x[s : s + LEAF], bound[s : s + LEAF], s, names, y, lower, terms)
                if len(new) > (best is not None):
                    best = first(*map(np.concatenate, zip(*new)), k)
        if best is not None:
            yield done()

    def _all(x: np.ndarray, bound: np.ndarray, names: np.ndarray, y: np.ndarray, terms: Terms | None) -> tuple:
        """Rows, ids and distances of the nearest of a block's targets to a block of sources."""
        if compared is not None:
            compared.add(len(x) * len(y))
        r, found, q = compare(x, names, y, k, d, bound, terms)
        full = np.flatnonzero(np.bincount(r, minlength=len(x)) == k)
        if len(full):
            bound[full] = np.minimum(bound[full], q[np.searchsorted(r, full, side="right") - 1])
        fit = q <= bound[r]
        return r[fit], found[fit], q[fit]

    def _leaf(x: np.ndarray, bound: np.ndarray, at: int, names: np.ndarray, y: np.ndarray, lower, terms: Terms | None) -> list[tuple]:
        """Rows, ids and distances of the nearest of a block's targets to a leaf of sources; their bounds come down with them."""
        low, out = lower(x[:, :d], _metrics(x, d)), []
        size = np.full(low.shape[1], LEAF)
        size[-1] = len(y) - LEAF * (len(size) - 1)
        left = np.ones(len(size), bool)
        order = np.argsort(low.max(0), kind="stable")
        sure = order[: np.searchsorted(np.cumsum(size[order]), k) + 1]  # the nearest leaves, until there are k targets
        for some in (sure if np.isinf(bound).any() else [], None):
            may = (low <= bound[:, None]) & left
            if some is not None:
                may[:, np.setdiff1d(np.arange(len(size)), some)] = False
            rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not len(rows):
                continue
            left[cols] = False
            take = (cols[:, None] * LEAF + np.arange(LEAF)).ravel()
            take = take[take < len(y)]
            r, found, q = compare(x[rows], names[take], y[take], k, d, bound[rows], terms, take)
            if compared is not None:
                compared.add(len(rows) * len(take))
            full = np.flatnonzero(np.bincount(r, minlength=len(rows)) == k)
            fit = q <= bound[rows[r]]
            if len(full):
                bound[rows[full]] = np.minimum(bound[rows[full]], q[np.searchsorted(r, full, side="right") - 1])
            out.append((at + rows[r[fit]], found[fit], q[fit]))
        return out

    def searched(asked: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(1 + count // PART))
        left = _blocks(asked, ["cell", "id"], width_s, BLOCK, shared, d, by=(parts, "cell", part)).drop("leaves").join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), "salts").cast("int")).drop("salts")
        right = blocks.join(F.broadcast(salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        right = right.select("cell", "salt", F.col("ids").alias("t_ids"), F.col("v").alias("t_v"), "leaves")
        pairs = left.repartition(parts, "cell", "salt").join(right.repartition(parts, "cell", "salt"), ["cell", "salt"])
        return top(pairs.mapInArrow(meet, "source long, target long, weight double"))

    def top(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("source").orderBy("weight", "target")
        return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")

    if bounds is None:
        near = store.put("near", searched(one.repartition(parts).mapInArrow(around, row)))
        reached = near.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("w"))
        bounded = one.join(reached, "id").select("id", "v", F.when(F.col("n") >= k, F.col("w")).otherwise(F.lit(float("inf"))).alias("bound"))
        found = top(near.unionByName(store.put("far", searched(bounded.repartition(parts).mapInArrow(beyond, row)))))
    else:
        found = searched(one.select("id", "v", "bound").repartition(parts).mapInArrow(beyond, row))
    found = store.put("found", found)
    store.drop("near", "far", "placed", "blocks", "targets")
    if bounds is not None:  # equal points may have asked for less
        own = mine.select("id", "v", "bound").join(one.select(F.col("id").alias("source"), "v"), "v").select("id", "source", "bound")
        return found.join(own, "source").where("weight <= bound").select(F.col("id").alias("source"), "target", "weight")
    same = mine.join(one.withColumnRenamed("id", "source"), "v").select("id", "source")
    return found.join(same, "source").select(F.col("id").alias("source"), "target", "weight")
