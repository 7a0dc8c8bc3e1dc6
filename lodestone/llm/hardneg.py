"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by norm and cut into buckets; a bucket is one row with its vectors, and so is a block of anchors. The
inner product of two vectors is at most the product of their norms (Cauchy-Schwarz), so a bucket can't change what a
window of an anchor has once that product, taken with the bucket's longest vector, is below the window's lower limit or
below the score that is last among those the window has so far. Pairs of a block and a bucket in which no window is open
are left out by the join's condition; in what is left, anchors whose windows are all closed are left out of the product.

Two searches are made: for each anchor its nearest rows with the same label, its positives, whose scores give the windows;
then for each window the first rows with another label. Each deals the buckets into splits: a block of anchors meets the
buckets of a split in one task, which keeps so many rows a window and gives them out at the end, and only those are
shuffled. Work grows with anchors times candidates, as the search is exact; a row is held in one bucket only.

Products of integers are exact in float32 below 2^24 and in float64 below 2^53, which the norms tell beforehand; beyond that
they are 64-bit integers, and a product that may not fit those is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Stored, trimmed

#: Vectors in a bucket and in a block of anchors, columns of a product at once, and blocks that a task has open.
BUCKET, ANCHORS, COLUMNS, OPEN = 2048, 1024, 512, 16
PACKED = "top double, ids array<bigint>, labels array<bigint>, norms array<double>, kind int, width int, vectors binary"
NONE = -(1 << 63)
SLACK = 1 + 1e-9  # norms and their products are rounded


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of PACKED with up to `most` vectors each, by falling norm. rows: (id, label, vector: array of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, most - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == most:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sorted_rows = rows.select("id", F.col("label").cast("long").alias("label"), norm.alias("norm"), "vector")
    sorted_rows = sorted_rows.repartitionByRange(F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id"))
    return sorted_rows.mapInArrow(trimmed(run), PACKED)


def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    lists = t.column("vector").combine_chunks() if t.column("vector").num_chunks != 1 else t.column("vector").chunk(0)
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    v = np.zeros((len(sizes), width), np.int64)
    v[np.arange(width) < sizes[:, None]] = flat
    kind = next(k for k in (1, 2, 4, 8) if not v.size or -(1 << 8 * k - 1) <= v.min() and v.max() < 1 << 8 * k - 1)
    norms = t.column("norm").to_numpy()
    one = [float(norms.max()), t.column("id").to_numpy(), t.column("label").to_numpy(), norms, kind, width, v.astype(f"<i{kind}").tobytes()]
    kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one, kinds)], names=["top", "ids", "labels", "norms", "kind", "width", "vectors"])


class Block:
    """Vectors of a packed row, as numbers in which their products with vectors of norms up to `other` are exact."""

    def __init__(self, ids, labels, norms, kind: int, width: int, vectors: bytes):
        self.ids, self.labels, self.norms = ids, labels, norms
        self.raw = np.frombuffer(vectors, f"<i{kind}").reshape(len(ids), width)
        self.top = float(norms.max(initial=0))
        self.as_type: dict = {}

    def of(self, kind) -> np.ndarray:
        if kind not in self.as_type:
            self.as_type[kind] = self.raw.astype(kind)
        return self.as_type[kind]


def exact_type(bound: float):
    if bound < 1 << 24:
        return np.float32
    if bound < 1 << 53:
        return np.float64
    if bound < (1 << 63) / SLACK:
        return np.int64
    raise OverflowError("inner products may not fit 64 bits")


class Search:
    """What windows of a block of anchors have found so far: up to k rows each, by falling score, then id.

    of: the anchor of each window; low, high: scores of its ends; same: whether labels are to be the same or different."""

    def __init__(self, anchors: Block, k: int, same: bool, of: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None):
        n = len(anchors.ids) if of is None else len(of)
        self.anchors, self.k, self.same = anchors, k, same
        self.of = np.arange(n) if of is None else of
        self.low = np.full(n, NONE) if low is None else low
        self.high = np.full(n, (1 << 63) - 1) if high is None else high
        self.last, self.last_id = self.low.copy(), np.full(n, (1 << 63) - 1)  # what a row must reach to count
        self.rows, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.compared = 0  # products formed

    def meet(self, c: Block) -> None:
        # a window that is open may still get something from this bucket
        reach = self.anchors.norms[self.of] * c.top * SLACK
        open_ = np.flatnonzero(reach >= self.last.astype(float))
        if not len(open_):
            return
        a = self.anchors
        kind = exact_type(a.top * c.top * SLACK)
        x, y = a.of(kind), c.of(kind)
        width = min(x.shape[1], y.shape[1])  # what a shorter vector lacks counts as zero
        if self.same:
            for label in np.intersect1d(a.labels[self.of[open_]], c.labels):
                mine = open_[a.labels[self.of[open_]] == label]
                self._some(mine, x, y, width, np.flatnonzero(c.labels == label), c)
        else:
            self._some(open_, x, y, width, np.arange(len(c.ids)), c)

    def _some(self, windows: np.ndarray, x, y, width: int, columns: np.ndarray, c: Block) -> None:
        at, step = 0, 64 if np.any(self.last_id[windows] == (1 << 63) - 1) else COLUMNS
        rows, place = np.unique(self.of[windows], return_inverse=True)
        # windows of an anchor are taken in turn, so that each turn has an anchor once
        turn = np.zeros(len(windows), np.int64)
        order = np.argsort(place, kind="stable")
        turn[order] = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        turns = [np.flatnonzero(turn == t) for t in range(int(turn.max(initial=-1)) + 1)]
        while at < len(columns):
            cols = columns[at : at + step]
            at, step = at + step, min(COLUMNS, step * 2)
            scores = x[rows, :width] @ y[cols, :width].T
            self.compared += scores.size
            apart = self.anchors.ids[rows][:, None] != c.ids[cols] if self.same else self.anchors.labels[rows][:, None] != c.labels[cols]
            found = []
            for t in turns:
                w = windows[t]
                s, ok = (scores, apart) if len(t) == len(rows) and np.array_equal(place[t], np.arange(len(rows))) else (scores[place[t]], apart[place[t]])
                hit = ok & (s >= self.last[w].astype(s.dtype)[:, None])
                if not self.same:
                    hit &= s <= self.high[w].astype(s.dtype)[:, None]
                r, j = np.nonzero(hit)
                if len(r):
                    v, ids, who = s[r, j].astype(np.int64), c.ids[cols[j]], w[r]
                    new = (v > self.last[who]) | (ids < self.last_id[who])
                    found.append((who[new], v[new], ids[new]))
            if found:
                self._keep(*(np.concatenate(p) for p in zip((self.rows, self.scores, self.ids), *found)))

    def _keep(self, rows, scores, ids) -> None:
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.rows, self.scores, self.ids = rows[kept], scores[kept], ids[kept]
        full = place == self.k - 1
        self.last[rows[full]], self.last_id[rows[full]] = scores[full], ids[full]


def _block(b: pa.RecordBatch, i: int, prefix: str) -> Block:
    lists = (b.column(f"{prefix}{n}")[i].values.to_numpy(zero_copy_only=False).copy() for n in ("ids", "labels", "norms"))
    return Block(*lists, b.column(f"{prefix}kind")[i].as_py(), b.column(f"{prefix}width")[i].as_py(), b.column(f"{prefix}vectors")[i].as_py())


def _dealt(anchors: DataFrame, buckets: DataFrame, splits: int, open_: bool) -> DataFrame:
    """Every block of anchors beside every bucket in which it has a window open, split by split."""
    left = anchors.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    right = buckets.select(F.expr(f"CAST(((block & 8589934591) + (block >> 33)) % {splits} AS INT)").alias("split"), *(F.col(c).alias(f"c_{c}") for c in buckets.columns if c != "block"))
    joined = left.join(right, "split")
    return joined.where(F.col("c_top") * SLACK >= F.col("need")) if open_ else joined


def _searched(pairs: DataFrame, start, kept: str, give) -> DataFrame:
    """What start(block, batch, i) finds among the buckets beside each block of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, Search] = {}
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                s = searches.get(block)
                if s is None:
                    if len(searches) >= OPEN:  # what a search has is right for the buckets it has met
                        yield give(*searches.popitem())
                    s = searches[block] = start(_block(b, i, ""), b, i)
                s.meet(_block(b, i, "c_"))
        while searches:
            yield give(*searches.popitem())

    return pairs.mapInArrow(trimmed(run), kept)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, scale: float = 256.0, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), bucket: int = BUCKET, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (id, label, vector) that
    are anchors: of each of its first `positives` rows with the same label, the first `negatives` rows with another label
    whose score is from low to high, two fractions, of the positive's. Scores are inner products of floor(scale * x);
    greater ones come first, ties by smaller id.

    Rows without id, label or vector and rows with a null or non-finite component take no part. Of vectors of different
    lengths the shorter one is filled with zeros; an empty one scores 0. An anchor without positives or without rows in a
    window gives none; a negative positive score makes an empty window. Rows with an id of their own each count, also if they
    are equal; of rows that share an id each counts too, save that none is a positive of its own id. Other columns are
    ignored; an empty table gives an empty one."""
    spark, store = rows.sparkSession, Stored(rows.sparkSession)
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    good = good.select(F.col("id").cast("long").alias("id"), "label", quantized(F.col("vector"), scale).alias("vector"))
    numbered = lambda df: df.withColumn("block", F.monotonically_increasing_id())
    buckets = store.put("buckets", numbered(packed(good, bucket)))
    anchors = store.put("anchors", numbered(packed(good.where(anchor), block)))
    count = buckets.count()
    splits = max(1, min(count, max(2 * spark.sparkContext.defaultParallelism, count // 256)))

    def near(b: int, s: Search) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(s.rows), b)), pa.array(s.rows.astype(np.int32)), pa.array(s.ids), pa.array(s.scores)], names=["block", "row", "positive_id", "positive_score"])

    found = _searched(_dealt(anchors, buckets, splits, False), lambda a, b, i: Search(a, positives, True), "block long, row int, positive_id long, positive_score long", near)
    first = Window.partitionBy("block", "row").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives)
    # an anchor's windows: a few a row, so a block's are some thousands
    windows = store.put("positives", found.where("positive_score >= 0").groupBy("block").agg(F.collect_list(F.struct("row", "at", "positive_id", "positive_score")).alias("windows")))
    least = F.array_min(F.transform("windows", lambda w: w["positive_score"] * F.lit(low[0] / low[1]) / F.greatest(F.element_at("norms", w["row"] + 1), F.lit(1e-300))))
    asked = store.put("asked", anchors.join(windows, "block").withColumn("need", F.when(least > 0, least / SLACK).otherwise(F.lit(0.0))))

    def start(a: Block, b: pa.RecordBatch, i: int) -> Search:
        w = b.column("windows")[i].values
        get = lambda name: w.field(name).to_numpy(zero_copy_only=False).copy()
        score = get("positive_score").astype(object)  # products with fractions may go beyond 64 bits
        limits = [-(-low[0] * score // low[1]), high[0] * score // high[1]]
        s = Search(a, negatives, False, get("row").astype(np.int64), *(x.astype(np.int64) for x in limits))
        s.windows = get("at"), get("positive_id"), get("positive_score")
        return s

    def hard(b: int, s: Search) -> pa.RecordBatch:
        at, pid, score = (x[s.rows] for x in s.windows)
        row = s.of[s.rows]
        columns = [pa.array(np.full(len(row), b)), pa.array(row.astype(np.int32)), pa.array(at), pa.array(s.anchors.ids[row]), pa.array(pid), pa.array(s.ids), pa.array(score), pa.array(s.scores)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "row", "at", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    out = _searched(_dealt(asked, buckets, splits, True), start, "block long, row int, at int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", hard)
    first = Window.partitionBy("block", "row", "at").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
