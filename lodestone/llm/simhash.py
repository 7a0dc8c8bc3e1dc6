"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most three bits have a
segment in which they differ in at most one, so blanking that bit (one of 32 one-wildcard variants of the segment)
makes the segments equal: an equality join on (segment, wildcard, rest) misses no pair. Candidates are verified on
all 64 bits.

Buckets: sorted by key inside shuffle partitions and read as a stream. Up to `bucket` fingerprints are compared
directly, and only a spanning forest of their links leaves. A larger bucket is dealt anew by the bits it does not yet
share: of four blocks of the other segment at least one is equal in any pair sought. That repeats, without a cap,
until a bucket is small; with all bits used no bucket holds more than 16 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stored, trimmed
from lodestone.llm.components import components

LOW = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        part = words[at : min(at + (1 << 16), n) + shingle - 1]
        parts = zip(*(part[k:] for k in range(shingle)))
        hashes = np.array([digest(b" ".join(x), seed) for x in parts], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp as signed long, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), "doc_id long, fp long")


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: breadth first, each is compared once as a centre."""
    left, out = fps, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _close(left, x, bits)
            if near.any():
                found, left = left[near], left[~near]
                out += [(x, y) for y in found]
                todo += list(found)
    return out


def _matcher(bits: int, bucket: int):
    """Stream sorted (key, fp, mask) rows; give edges (kind 0: a, b) and the rows of overfull buckets (kind 1: key, fp, mask)."""

    def rows(kind: int, a, b, mask) -> pa.RecordBatch:
        a, b, mask = (np.asarray(x, np.uint64).view(np.int64) for x in (a, b, mask))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(mask)], names=["kind", "a", "b", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fps = mask = np.zeros(0, np.uint64)  # the open run, at most bucket rows and one batch
        hot = None  # the key of a run that has overflowed
        for part in _with_end(batches):
            if part is not None:
                k, f, m = (part.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
                key, fps, mask = np.concatenate([key, k]), np.concatenate([fps, f]), np.concatenate([mask, m])
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            if part is not None:  # the last run may go on in the next batch
                last = starts[-1]
                if hot is not None and key[last] == hot or len(key) - last > bucket:
                    hot = key[last]
                    yield rows(1, key[last:], fps[last:], mask[last:])
                    keep = len(key)
                else:
                    keep = last
                starts, ends = starts[:-1], ends[:-1]
            else:
                keep = len(key)
            sizes = ends - starts
            two = starts[sizes == 2]
            if len(two):
                near = _close(fps[two], fps[two + 1], bits) & (key[two] != hot if hot is not None else True)
                if near.any():
                    yield rows(0, fps[two][near], fps[two + 1][near], np.zeros(near.sum()))
            is_hot = np.zeros(len(starts), bool) if hot is None else key[starts] == hot
            for s, e, over in zip(*(x[(sizes > 2) | is_hot] for x in (starts, ends, is_hot))):
                if over or e - s > bucket:
                    yield rows(1, key[s:e], fps[s:e], mask[s:e])
                elif found := forest(np.unique(fps[s:e]), bits):
                    a, b = zip(*found)
                    yield rows(0, a, b, np.zeros(len(a)))
            key, fps, mask = key[keep:], fps[keep:], mask[keep:]

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _bits(mask: int) -> list[int]:
    return [i for i in range(64) if mask >> i & 1]


def _subdivide(hot: DataFrame, pieces: int) -> DataFrame:
    """Deal overfull buckets anew: one row for each of `pieces` blocks of the bits that the bucket does not share yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            key, fps, mask = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for m in np.unique(mask):
                mine, free = mask == m, _bits(int(m))
                for i in range(pieces):
                    block = np.uint64(sum(1 << x for x in free[i::pieces]))
                    new = [xxhash.xxh64_intdigest(np.array([k, v, i], np.uint64).tobytes()) for k, v in zip(key[mine], fps[mine] & block)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(new, np.uint64).view(np.int64)), pa.array(fps[mine].view(np.int64)), pa.array(np.full(mine.sum(), m & ~block, np.uint64).view(np.int64))], names=["key", "fp", "mask"])

    return hot.select(F.col("a").alias("key"), F.col("b").alias("fp"), "mask").mapInArrow(trimmed(run), "key long, fp long, mask long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp, mask): the 64 one-wildcard segment variants of each fingerprint; mask has the bits of the other segment."""
    low, high = F.col("fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("fp", 32)
    k = F.col("k")
    blank = lambda half, at: half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), at)))
    value = F.when(k < 32, blank(low, k)).otherwise(blank(high, k - 32))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(
        F.call_function("shiftleft", k.cast("long"), F.lit(32)).bitwiseOR(value).alias("key"), "fp", F.when(k < 32, F.lit(-1 << 32)).otherwise(F.lit(LOW)).cast("long").alias("mask")
    )


def links(fps: DataFrame, store: Stored, bits: int = 3, bucket: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span what links at `bits` or fewer differing bits."""
    if bits > 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    dealt, level, edges = variants(fps), 0, None
    while True:
        found = store.put(f"match{level}", dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(trimmed(_matcher(bits, bucket)), "kind int, a long, b long, mask long"))
        new = found.where("kind = 0").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        hot = found.where("kind = 1")
        if hot.isEmpty():
            return edges
        dealt, level = _subdivide(hot, bits + 1), level + 1


def classes(docs: DataFrame, store: Stored, shingle: int = 3, bits: int = 3, bucket: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (doc_id, fp) of every row, and (fp, root, least) of every fingerprint: the class's smallest
    fingerprint and smallest doc_id."""
    fps = store.put("fps", fingerprints(docs, shingle))
    distinct = store.put("distinct", fps.groupBy("fp").agg(F.min("doc_id").alias("low")), fps.count())
    roots = components(links(distinct.select("fp"), store, bits, bucket), store).withColumnRenamed("node", "fp")
    linked = store.put("linked", roots.join(distinct, "fp"), roots.count())
    least = linked.groupBy("root").agg(F.min("low").alias("least"))
    ids = distinct.join(linked.join(least, "root").select("fp", "root", "least"), "fp", "left")
    return fps, ids.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, bucket: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have fingerprint zero and link like any other; equal texts always share a component; repeated
    rows come back as often; an empty table gives an empty result. A null doc_id is kept and is nobody's smallest. A text of
    any length is one row's work, hashed some shingles at a time; doc_id is a long or casts to one.
    """
    fps, ids = classes(docs, Stored(docs.sparkSession), shingle, bits, bucket)
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3, bucket: int = 2048) -> DataFrame:
    """docs with one row of each class of near copies: that of the smallest doc_id (a null one only without others).

    Of repeated rows one stays. Only rows whose doc_id is null or repeated have their fingerprint taken again."""
    store = Stored(docs.sparkSession)
    fps, ids = classes(docs, store, shingle, bits, bucket)
    # copies come down to one row a fingerprint before anything is joined
    each = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("s"))
    first = F.min(F.struct("s.none", "s.doc_id", "fp"))
    kept = each.join(ids, "fp").groupBy("root").agg(first.alias("s")).select("s.doc_id", "s.fp")
    many = fps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    kept = store.put("kept", kept.join(many, kept.doc_id.eqNullSafe(many.doc_id), "left").select(kept.doc_id.alias("_id"), "fp", F.col("n").isNotNull().alias("unsure")))
    plain = kept.where("not unsure").select("_id")
    out = docs.join(plain, F.col("doc_id").cast("long") == plain["_id"], "left_semi")
    unsure = kept.where("unsure")
    if unsure.isEmpty():
        return out
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    some = row.join(unsure.select("_id").distinct(), F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["row", "_fp"])

    some = some.select("row", F.col("row.text").cast("string").alias("_text")).mapInArrow(trimmed(run), row.schema.add("_fp", "long"))
    some = some.join(unsure, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("fp")), "left_semi")
    some = some.withColumn("_id", F.col("row.doc_id")).dropDuplicates(["_id", "_fp"])
    return out.unionByName(some.select("row.*"))
