"""A force-directed layout of a graph in the plane, after ForceAtlas2 (Jacomy et al., 2014)."""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vertices whose positions a task may hold.
MOST_VERTICES = 4_000_000
#: Vertices of a square that is cut no further, times that one is cut at most, terms of a series, and pairs that meet at once.
LEAF, DEEP, TERMS, TOGETHER = 16, 20, 8, 1 << 16
#: Radii of two squares beside their distance up to which they meet as wholes.
APART = 0.5
CHOOSE = np.array([[math.comb(i, j) for j in range(TERMS)] for i in range(TERMS)], float)
SERIES = np.array([[(-1) ** j * math.comb(i + j, j) for j in range(TERMS)] for i in range(TERMS)], float)


def repulsion(pos: np.ndarray, weight: np.ndarray, at: np.ndarray, scaling: float) -> np.ndarray:
    """Forces on the vertices `at` from all others, pair by pair."""
    out = np.zeros((len(at), 2))
    for i in range(0, len(at), 128):
        out[i : i + 128] = _push(pos[at[i : i + 128]], weight[at[i : i + 128]], pos, weight, scaling)
    return out


def _push(x: np.ndarray, w: np.ndarray, y: np.ndarray, v: np.ndarray, scaling: float) -> np.ndarray:
    dx, dy = x[:, :1] - y[:, 0], x[:, 1:] - y[:, 1]
    f = scaling * w[:, None] * v / np.maximum(dx * dx + dy * dy, 1e-9)
    return np.column_stack([(dx * f).sum(1), (dy * f).sum(1)])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _spaced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^DEEP with a zero before each binary digit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


class Cells:
    """A tree of squares over positions, each cut into four down to LEAF vertices, with the moments of their masses.

    As complex numbers the push on z is the conjugate of a sum of m / (z - z_j). Beyond a square that is a series in 1 / (z - c)
    of the square's moments, and around another centre a series in the distance from it, TERMS of each. So two squares that
    are far apart, beside their radii, meet once as wholes; others are cut, and those that can't be meet vertex by vertex."""

    def __init__(self, pos: np.ndarray, weight: np.ndarray):
        low = pos.min(0)
        xy = np.minimum((pos - low) / max(float((pos.max(0) - low).max()), 1e-300) * 2**DEEP, 2**DEEP - 1).astype(np.int64)
        code = _spaced(xy[:, 0]) << 1 | _spaced(xy[:, 1])
        self.order = np.argsort(code, kind="stable")
        code, self.z, self.m = code[self.order], pos[self.order] @ np.array([1, 1j]), weight[self.order]
        start, end, parent, child, levels = [np.zeros(1, int)], [np.array([len(pos)])], [np.array([-1])], [], []
        first, deep = 0, 0
        while len(start[-1]):
            s, e = start[-1], end[-1]
            levels.append(slice(first, first + len(s)))
            cut = np.flatnonzero((e - s > LEAF) & (deep < DEEP))
            deep += 1
            prefix = code >> 2 * (DEEP - deep)
            at = np.r_[0, np.flatnonzero(prefix[1:] != prefix[:-1]) + 1] if len(cut) else np.zeros(0, int)
            of = np.searchsorted(s[cut], at, side="right") - 1
            at, of = (x[(of >= 0) & (at < e[cut][of])] for x in (at, of)) if len(cut) else (at, at)
            last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
            stop = np.where(last, e[cut][of], np.r_[at[1:], 0]) if len(of) else at
            n = np.zeros(len(s), int)
            n[cut] = np.bincount(of, minlength=len(cut))
            child.append(np.column_stack([first + len(s) + np.cumsum(n) - n, n]))
            start.append(at)
            end.append(stop)
            parent.append(first + cut[of])
            first += len(s)
        self.start, self.end, self.parent = (np.concatenate(x) for x in (start, end, parent))
        self.child, self.n = np.concatenate(child).T
        self.levels = levels
        nodes = len(self.start)
        self.leaf = self.n == 0
        leaves = np.flatnonzero(self.leaf)
        leaves = leaves[np.argsort(self.start[leaves])]
        at, size = self.start[leaves], (self.end - self.start)[leaves]
        self.home = np.repeat(leaves, size)
        mass, self.c, self.r, self.a = np.zeros(nodes), np.zeros(nodes, complex), np.zeros(nodes), np.zeros((nodes, TERMS), complex)
        mass[leaves] = np.add.reduceat(self.m, at)
        self.c[leaves] = np.add.reduceat(self.z * self.m, at) / mass[leaves]
        off = self.z - self.c[self.home]
        self.r[leaves] = np.maximum.reduceat(np.abs(off), at)
        power = self.m.astype(complex)
        for i in range(TERMS):
            self.a[leaves, i] = np.add.reduceat(power, at)
            power *= off
        for level in levels[-2::-1]:
            up = np.arange(level.start, level.stop)[self.n[level] > 0]
            if not len(up):
                continue
            k, by = slice(self.child[up[0]], self.child[up[-1]] + self.n[up[-1]]), self.child[up] - self.child[up[0]]
            mass[up] = np.add.reduceat(mass[k], by)
            self.c[up] = np.add.reduceat(self.c[k] * mass[k], by) / mass[up]
            d = self.c[k] - self.c[self.parent[k]]
            self.r[up] = np.maximum.reduceat(np.abs(d) + self.r[k], by)
            d = d[:, None] ** np.arange(TERMS)
            self.a[up] = np.add.reduceat(np.column_stack([sum(self.a[k, j] * CHOOSE[i, j] * d[:, i - j] for j in range(i + 1)) for i in range(TERMS)]), by)

    def _met(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of squares (of vertices that are wanted, of those that push them): that meet as wholes, and vertex by vertex."""
        far, near, a, b = [], [], np.zeros(1, int), np.zeros(1, int)
        while len(a):
            d = np.abs(self.c[a] - self.c[b])
            apart = (self.r[a] + self.r[b] <= APART * d) & (d > 1e-4)  # forces of closer vertices are bounded, one by one
            far.append((a[apart], b[apart]))
            a, b = a[~apart], b[~apart]
            both = self.leaf[a] & self.leaf[b]
            near.append((a[both], b[both]))
            a, b = a[~both], b[~both]
            left = ~self.leaf[a] & (self.leaf[b] | (self.r[a] >= self.r[b]))
            pieces = []
            for cut, kept, mine in ((a[left], b[left], True), (b[~left], a[~left], False)):
                pieces.append([_runs(self.child[cut], self.n[cut]), np.repeat(kept, self.n[cut])][:: 1 if mine else -1])
            a, b = (np.concatenate(x) for x in zip(*pieces))
            some = wanted[a]
            a, b = a[some], b[some]
        return tuple(np.array([np.concatenate(x) for x in zip(*pairs)]) for pairs in (far, near))

    def repulsion(self, pos: np.ndarray, weight: np.ndarray, at: np.ndarray, scaling: float) -> np.ndarray:
        """Forces on the vertices `at`, which cost least where they lie together: from far squares by their moments, from near
        ones vertex by vertex."""
        if not len(at):
            return np.zeros((0, 2))
        asked = np.zeros(len(self.z), bool)
        asked[at] = True
        asked = asked[self.order]
        before = np.r_[0, np.cumsum(asked)]
        (a, b), (p, q) = self._met(before[self.end] > before[self.start])
        local = np.zeros((len(self.c), TERMS), complex)
        for i in range(0, len(a), TOGETHER):
            x, y = a[i : i + TOGETHER], b[i : i + TOGETHER]
            one = 1 / (self.c[x] - self.c[y])
            series = one[:, None] ** np.arange(TERMS)
            series = (self.a[y] * series) @ SERIES * series * one[:, None]
            order = np.argsort(x, kind="stable")
            first = np.flatnonzero(np.diff(x[order], prepend=-1))
            local[x[order][first]] += np.add.reduceat(series[order], first)
        for level in self.levels[1:]:
            mine, up = local[level], self.parent[level]
            d = (self.c[level] - self.c[up])[:, None] ** np.arange(TERMS)
            for i in range(TERMS):
                mine[:, i] += sum(local[up, j] * CHOOSE[j, i] * d[:, j - i] for j in range(i, TERMS))
        rows = np.flatnonzero(asked)
        home = self.home[rows]
        off, g = self.z[rows] - self.c[home], np.zeros(len(rows), complex)
        for i in reversed(range(TERMS)):
            g = g * off + local[home, i]
        # each vertex that is asked for beside each near leaf
        size = (before[self.end] - before[self.start])[p]
        v, q = _runs(before[self.start][p], size), np.repeat(q, size)
        order = np.argsort(v, kind="stable")
        v, q = v[order], q[order]
        ends = np.cumsum((self.end - self.start)[q])
        s = 0
        while s < len(v):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 8 * TOGETHER, side="right")))
            n = (self.end - self.start)[q[s:e]]
            y, i = _runs(self.start[q[s:e]], n), np.repeat(v[s:e], n)
            d = self.z[rows[i]] - self.z[y]
            d *= self.m[y] / np.maximum(d.real**2 + d.imag**2, 1e-9)
            i -= v[s]
            g[v[s] : v[e - 1] + 1] += np.bincount(i, d.real) - 1j * np.bincount(i, d.imag)
            s = e
        out = np.zeros((len(self.z), 2))
        g = scaling * self.m[rows] * np.conj(g)
        out[self.order[rows]] = np.column_stack([g.real, g.imag])
        return out[at]


class Placed:
    """A round's positions, by vertex number, and their tree, which a process makes once for all its tasks."""

    def __init__(self, ids: np.ndarray, pos: np.ndarray, weight: np.ndarray):
        self.ids, self.pos, self.weight = ids, pos, weight

    @cached_property
    def cells(self) -> Cells:
        return Cells(self.pos, self.weight)


def force_layout(vertices: DataFrame, edges: DataFrame, iterations: int = 100, scaling: float = 20.0, gravity: float = 1.0, strong_gravity: bool = True, jitter: float = 1.0, seed: int = 1, exact: bool = True) -> DataFrame:
    """(vertex, x, y) of vertices (id) under edges (source, target, weight), each unordered pair counting once.

    exact: every vertex is pushed by every other; else by those near it, and by far ones through the moments of squares, a
    few hundred pushes a vertex however many there are. Every round is one job: tasks hold some vertices' edges and all
    positions (24 bytes a vertex with weights, at most MOST_VERTICES, checked; their tree takes some hundred more) and give
    their vertices' pulls, others the pushes of vertices that lie together. The start is drawn from seed, so a layout can be
    made again. Repeated ids count once; an empty table gives an empty one.
    """
    spark = vertices.sparkSession
    ids = np.sort(vertices.select(F.col("id").cast("long").alias("id")).distinct().limit(MOST_VERTICES + 1).toArrow().column("id").to_numpy())
    if len(ids) > MOST_VERTICES:
        raise ValueError(f"more than {MOST_VERTICES} vertices")
    one = edges.where("source <> target").groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.min("weight").alias("weight"))
    both = one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    near = both.groupBy("source").agg(F.collect_list("target").alias("targets"))
    parts = 2 * spark.sparkContext.defaultParallelism  # a hundred rounds of small tasks would wait for their workers
    work = vertices.select(F.col("id").cast("long").alias("id")).distinct().join(near, F.col("id") == F.col("source"), "left").select("id", "targets").repartition(parts, "id").persist()
    degree = work.select("id", F.coalesce(F.size("targets"), F.lit(0)).alias("n")).toArrow()
    weight = np.ones(len(ids))
    weight[np.searchsorted(ids, degree.column("id").to_numpy())] = 1 + np.maximum(degree.column("n").to_numpy(), 0)
    pos = np.random.default_rng(seed).normal(0, 10 * np.sqrt(max(1, len(ids))), (len(ids), 2))
    before, speed = np.zeros_like(pos), 1.0
    try:
        for _ in range(iterations if len(ids) else 0):
            shared = spark.sparkContext.broadcast(Placed(ids, pos, weight))

            def given(at: np.ndarray, force: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(at), pa.array(force[:, 0]), pa.array(force[:, 1])], names=["at", "fx", "fy"])

            def pulls(batches, shared=shared):
                ids, pos, weight = shared.value.ids, shared.value.pos, shared.value.weight
                for b in batches:
                    at = np.searchsorted(ids, b.column(0).to_numpy(zero_copy_only=False))
                    force = repulsion(pos, weight, at, scaling) if exact else np.zeros((len(at), 2))
                    sizes = np.nan_to_num(pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)).astype(int)
                    mine, other = np.repeat(np.arange(len(at)), sizes), np.searchsorted(ids, b.column(1).flatten().to_numpy(zero_copy_only=False))
                    pull = pos[at[mine]] - pos[other]
                    force -= np.column_stack([np.bincount(mine, pull[:, j], len(at)) for j in (0, 1)])
                    away = 1.0 if strong_gravity else 1 / np.maximum(np.hypot(*pos[at].T), 1e-9)[:, None]
                    force -= gravity * weight[at][:, None] * pos[at] * away
                    yield given(at, force)

            def pushes(batches, shared=shared):
                placed = shared.value
                for b in batches:
                    for i in b.column(0).to_pylist():
                        at = placed.cells.order[i * len(placed.ids) // parts : (i + 1) * len(placed.ids) // parts]
                        yield given(at, placed.cells.repulsion(placed.pos, placed.weight, at, scaling))

            found = work.mapInArrow(pulls, "at long, fx double, fy double")
            if not exact:
                found = found.unionByName(spark.range(0, parts, 1, parts).mapInArrow(pushes, "at long, fx double, fy double"))
            rows = found.toArrow()
            force = np.column_stack([np.bincount(rows.column("at").to_numpy(), rows.column(c).to_numpy(), len(ids)) for c in ("fx", "fy")])
            swing, pull = np.hypot(*(force - before).T), np.hypot(*(force + before).T) / 2
            speed = min(jitter**2 * (weight * pull).sum() / max((weight * swing).sum(), 1e-9), 1.5 * speed)
            step = speed / (1 + speed * np.sqrt(weight * swing))
            pos, before = pos + force * np.minimum(step, 10 / np.maximum(np.hypot(*force.T), 1e-9))[:, None], force
            shared.unpersist()
    finally:
        work.unpersist()
    return spark.createDataFrame(pa.table({"vertex": ids, "x": pos[:, 0], "y": pos[:, 1]}), "vertex long, x double, y double")
