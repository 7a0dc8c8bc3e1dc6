"""The nearest targets of every source, compared block by block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import distance as D
from lodestone.sources.scratch import Stored

#: Sources that are compared at once, and targets that they are compared with.
ROWS, TILE = 128, 2048
#: Blocks that targets are cut into as long as a block has at most MOST points, and points of a partition of targets.
BLOCKS, MOST, PART = 16, 4096, 1 << 17
#: Axes from which on a matrix product finds the pairs to sum term by term.
LONG = 16
#: Targets with metrics from which on a matrix product does so for them.
MANY = 32


def _packed(points: DataFrame, ids: str, axes: Sequence[str], metric: str | None, size: int, parts: int, name: str) -> DataFrame:
    """One row for each up to `size` points: their ids as longs, and coordinates and metrics of all, as the bytes of both."""
    d = len(axes)
    values = [F.col(a).cast("double") for a in axes] + ([F.col(metric)[i].cast("double") for i in range(d * d)] if metric else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            i, v = (np.concatenate(x) for x in zip(*held))
            end = n if last else n // size * size
            for at in range(0, end, size):
                some = slice(at, min(at + size, end))
                yield pa.RecordBatch.from_arrays([pa.array([i[some].tobytes()], pa.binary()), pa.array([v[some].tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_v"])
            held, n = [(i[end:], v[end:])], n - end

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)))
                n += b.num_rows
                if n >= size:
                    yield from give(False)
        if n:
            yield from give(True)

    rows = points.select(F.col(ids).cast("long").alias("id"), F.array(*values).alias("v"))
    # the partitions are asked for by number, so that they stay as many as there are to be; packing is done once, before the last
    packed = rows.repartition(parts, F.xxhash64("id")).mapInArrow(run, f"{name}_ids binary, {name}_v binary")
    return packed.repartition(parts, F.xxhash64(f"{name}_ids"))


class Singles:
    """Long targets as factors of a matrix product in single precision, which gives squared distances but for rounding.

    Beside the targets' middle, half a squared distance is that of the source, that of the target, less their product."""

    def __init__(self, y: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            self.middle = y.mean(0)
            v = y - self.middle
            yy = (v * v).sum(1)
            self.far, self.y = np.sqrt(yy.max()), np.vstack([-v.T, yy / 2]).astype(np.float32)

    def close(self, x: np.ndarray, take: int, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows of x and columns of the pairs that can be among the `take` nearest, at or below a bound; None where numbers
        are too large or too many pairs are alike."""
        with np.errstate(over="ignore", invalid="ignore"):
            u = x - self.middle
            xx = (u * u).sum(1)
            # several times what rounding to single precision and a sum of so many products can do, and what underflow can
            room = (x.shape[1] + 8) * np.finfo(np.float32).eps * 2 * (np.sqrt(xx) + self.far) ** 2 + 1e-35
            if not (room < 1e30).all():
                return None
            q = np.column_stack([u, np.ones(len(u))]).astype(np.float32) @ self.y
        most = np.inf if bound is None else (bound - xx) / 2 + room
        if bound is None or np.isinf(bound).any():
            most = np.minimum(np.partition(q, take - 1, axis=1)[:, take - 1] + 2 * room, most)
        at = np.flatnonzero(q <= np.nextafter(most.astype(np.float32), np.float32(np.inf))[:, None])
        return np.divmod(at, q.shape[1]) if len(at) <= max(1, q.size // 8) else None


class Terms:
    """Targets with metrics as factors of a matrix product, which gives distances but for rounding.

    Beside the targets' middle a distance is a sum of products of a source's numbers with a target's: those of its metric
    with products of coordinates, its metric times its coordinates with coordinates, and so for the other side's metric."""

    def __init__(self, y: np.ndarray, d: int, both: bool):
        self.d, self.both = d, both
        with np.errstate(over="ignore", invalid="ignore"):
            self.middle = y[:, :d].mean(0)
            form, powers = self._sides(y)
            self.y = np.column_stack([form, powers]) if both else form
            self.far, self.size = np.abs(y[:, :d] - self.middle).max(), np.abs(y[:, d:]).sum(1).max()

    def _sides(self, x: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """What rows' metrics (none if they have none) and coordinates give."""
        d = self.d
        u, i, j = x[:, :d] - self.middle, *np.triu_indices(d)
        powers = np.column_stack([u[:, i] * u[:, j], u, np.ones(len(u))])
        if x.shape[1] == d:
            return None, powers
        m = x[:, d:].reshape(-1, d, d)
        m = (m + m.transpose(0, 2, 1)) / 2
        mu = (m @ u[:, :, None])[:, :, 0]
        return np.column_stack([m[:, i, j] * np.where(i == j, 1, 2), -2 * mu, (mu * u).sum(1)]), powers

    def close(self, x: np.ndarray, take: int, some: np.ndarray | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows of x and columns of the pairs that can be among the `take` nearest of some targets, at or below a bound; None
        where numbers are too large or too many pairs are alike."""
        with np.errstate(over="ignore", invalid="ignore"):
            form, powers = self._sides(x)
            y = self.y if some is None else self.y[some]
            q = np.column_stack([powers, form]) @ y.T / 2 if self.both else powers @ y.T
            size = self.size + (np.abs(x[:, self.d :]).sum(1) if self.both else 0)
            room = 16 * (y.shape[1] + 8) * np.finfo(float).eps * size * (np.abs(x[:, : self.d] - self.middle).max(1) + self.far) ** 2
        if not np.isfinite(room).all() or not np.isfinite(q).all():
            return None
        if bound is None or np.isinf(bound).any():
            bound = np.minimum(np.partition(q, take - 1, axis=1)[:, take - 1] + room, np.inf if bound is None else bound)
        rows, cols = np.nonzero(q <= (bound + room)[:, None])
        return (rows, cols) if len(rows) <= max(4 * take * len(x), q.size // 8) else None


def compare(x: np.ndarray, ids: np.ndarray, y: np.ndarray, take: int, d: int, bound: np.ndarray | None = None, terms: Terms | None = None, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, ids and distances of the `take` nearest of y, by row, distance and id. ids are sorted; x and y have d
    coordinates and then, if anything, a metric: distances are under the mean of both, or that of y if only y has one.
    bound: distances above it may be left out. terms, some: of a table of targets, and which rows of it y is."""
    found = []
    if y.shape[1] > d and len(y) >= MANY and terms is None:
        terms, some = Terms(y, d, x.shape[1] > d), None
    c, mc = list(y[:, :d].T), list(y[:, d:].T)
    singles = Singles(y) if d >= LONG and not mc else None
    for at in range(0, len(x), ROWS):
        s = x[at : at + ROWS]
        known = None if bound is None else bound[at : at + ROWS]
        if singles is not None and (near := singles.close(s, min(take, len(y)), known) or _close(s, y, min(take, len(y)))) is not None:
            rows, cols = near
            found.append((rows + at, ids[cols], D.ploss(list(y[cols].T), list(s[rows].T))))
            continue
        if terms is not None and (near := terms.close(s, min(take, len(y)), some, known)) is not None:
            rows, cols = near
            a, b = s[rows], y[cols]
            r, mr, u, mu = list(a[:, :d].T), list(a[:, d:].T), list(b[:, :d].T), list(b[:, d:].T)
            found.append((rows + at, ids[cols], D.symmetric_pnp(u, r, mu, mr) if mr else D.pnp(r, u, mu)))
            continue
        r, mr = [v[:, None] for v in s[:, :d].T], [v[:, None] for v in s[:, d:].T]
        q = D.symmetric_pnp(c, r, mc, mr) if mr else D.pnp(r, c, mc) if mc else D.ploss(c, r)
        n = min(take, len(y))
        rows, cols = np.nonzero(q <= np.partition(q, n - 1, axis=1)[:, n - 1 : n])
        found.append((rows + at, ids[cols], q[rows, cols]))
    return first(*map(np.concatenate, zip(*found)), take)


def _close(x: np.ndarray, y: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows and columns of the pairs that can be among the `take` nearest: by a matrix product, with room for its rounding,
    so that few distances are summed term by term. None where numbers are too large or too many pairs are alike."""
    with np.errstate(over="ignore", invalid="ignore"):
        xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)
    most = yy.max()
    if not np.isfinite(xx.max() + most):
        return None
    q = xx + yy - 2 * (x @ y.T)
    room = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + most)
    rows, cols = np.nonzero(q <= np.partition(q, take - 1, axis=1)[:, take - 1 : take] + room)
    return (rows, cols) if len(rows) <= max(1, q.size // 8) else None


def first(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the first `take` by distance and id."""
    order = np.lexsort((ids, q, rows))
    rows, ids, q = rows[order], ids[order], q[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < take
    return rows[kept], ids[kept], q[kept]


def nearest(sources: DataFrame, targets: DataFrame, k: int, axes: Sequence[str], metric: str | None = None, block: int = 2048) -> DataFrame:
    """(source, target, weight): the k nearest rows of targets (row_id) of each row of sources (row_id), ties by target.

    Both have the axes and, if given, an array column `metric` (row-major): the distance is then that under the mean of
    both metrics, else the squared one. All pairs are compared, as the result is defined, but as blocks: each side is
    packed into rows of some points, and Spark pairs the sides' partitions. Pairs themselves are never shuffled. A task has
    the best k of the block of sources that it is at, whose last is a bound for the targets to come; what is shuffled is k
    rows for each source and partition of targets, which has about PART points. block: points of a block of targets in small
    tables; as a table grows it has more, up to MOST, since every block is sent along with every one of the other side.
    """
    width, cores = len(axes) + (len(axes) ** 2 if metric else 0), sources.sparkSession.sparkContext.defaultParallelism
    n, m = sources.count(), targets.count()
    mine, theirs = (max(least, min(MOST, -(-rows // blocks))) for rows, least, blocks in ((n, ROWS, 4 * cores), (m, block, BLOCKS)))
    left = _packed(sources, "row_id", axes, metric, mine, max(1, min(-(-n // mine), max(4 * cores, n // PART))), "a")
    right = _packed(targets, "row_id", axes, metric, theirs, -(-m // PART) or 1, "b")

    def values(column: pa.Array, i: int, kind: type = float) -> np.ndarray:
        return np.frombuffer(column[i].as_buffer(), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, best = None, None

        def done() -> pa.RecordBatch:
            rows, ids, q = best
            return pa.RecordBatch.from_arrays([pa.array(mine[rows]), pa.array(ids), pa.array(q)], names=["source", "target", "weight"])

        for b in batches:
            for i in range(b.num_rows):
                a = values(b.column(0), i, np.int64)
                if mine is None or not np.array_equal(a, mine):  # rows come block of sources by block of sources
                    if best is not None:
                        yield done()
                    mine, x, best, bound = a.copy(), values(b.column(1), i).reshape(-1, width).copy(), None, np.full(len(a), np.inf)
                ids, y = values(b.column(2), i, np.int64), values(b.column(3), i).reshape(-1, width)
                order = np.argsort(ids, kind="stable")
                ids, y = ids[order], y[order]
                for at in range(0, len(y), TILE):
                    best = _better(best, compare(x, ids[at : at + TILE], y[at : at + TILE], k, len(axes), bound), bound, k)
        if best is not None:
            yield done()

    found = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(run, "source long, target long, weight double")
    order = Window.partitionBy("source").orderBy("weight", "target")
    # graphs read the rows twice, for both directions
    return Stored(sources.sparkSession).put("near", found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"))


def _better(best: tuple | None, found: tuple, bound: np.ndarray, k: int) -> tuple:
    """The first k of each row among both; bounds of rows that have k come down to the last of them."""
    if best is None:
        new, old = found, None
    else:
        touched = np.zeros(len(bound), bool)
        touched[found[0]] = True
        again = touched[best[0]]
        new, old = first(*(np.concatenate([o[again], f]) for o, f in zip(best, found)), k), tuple(o[~again] for o in best)
    n = np.bincount(new[0], minlength=len(bound))
    full = np.flatnonzero(n == k)
    bound[full] = new[2][np.cumsum(n)[full] - 1]
    return new if old is None else tuple(np.concatenate(p) for p in zip(old, new))
