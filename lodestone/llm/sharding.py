"""Sharding by sampled splitters: rows go to one of `shards` shards of near equal bytes.

Rows are ordered by key: 60 bits of the text's MD5, then doc_id, then a number of their own, so equal texts lie together.
Keys are drawn with a chance in proportion to a row's share of the bytes and of the rows; their quantiles cut the order
into many more ranges than shards. Ranges that come out overfull are all sampled again in one job and subdivided, round
by round until none is left. Ranges are what tasks work on: each is sorted and numbered by itself.

Whole groups (cut_heavy=False): splitters lie between groups of equal texts only and a range goes to one shard as a
whole, by where its middle falls in the shards' quantiles of the bytes; so no group is ever split. Groups that weigh over
`heavy` of a shard have ranges of their own and are placed first, each in the shard that has least; the shards' quantiles
are of what room is left. Shards then differ by a range, or by what a group exceeds an equal share.

Cut groups (cut_heavy=True): a row's exact offset in bytes gives its shard, so that shards differ by a light group at
most; light groups stay where they start and those over `heavy` of a shard are cut by doc_id.

The driver holds one row a range and the sampled keys, both with a stated bound.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Stored

#: The most ranges that are asked for, sampled keys for each, and ranges a shard at least.
MOST_RANGES, PER_RANGE, EACH_SHARD = 65_536, 16, 128
LOW = -(1 << 63)


def text_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key: hash of the text, doc_id, row number) of docs (doc_id, text). A null text has no
    bytes; every row weighs one more. Row numbers hold once the table is stored."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    doc_id = F.col("doc_id").cast("long")
    key = F.struct(text_hash(text).alias("h"), F.coalesce(doc_id, F.lit(LOW)).alias("d"), F.monotonically_increasing_id().alias("u"))
    return docs.select(doc_id.alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), key.alias("key"))


def _chance() -> Column:
    """A row's fixed uniform number."""
    return (F.pmod(F.xxhash64(F.lit("splitter"), "key"), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _range_of(rows: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """rows with range: how many bounds are at or before the key, by bisection of a constant."""
    if not bounds:
        return rows.withColumn("range", F.lit(0))
    table = F.from_json(F.lit(json.dumps([dict(zip("hdu", b)) for b in bounds])), "array<struct<h:bigint,d:bigint,u:bigint>>")
    steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(bounds)) & (F.get(table, p + s - 1) <= F.col("key")), p + s).otherwise(p))
    return rows.withColumn("range", at)


def splitters(rows: DataFrame, ranges: int, inner: set[int], per_range: int = PER_RANGE) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """rows with range, and the bounds of the ranges, none of which weighs over twice its share unless it holds one group.

    Groups in `inner` have bounds before and behind them and may be cut inside; other bounds are at groups' starts."""
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    weight = F.col("size") / F.lit(2.0 * total) + F.lit(0.5 / count)
    start = lambda h: (h, LOW, LOW)
    clean = lambda k: k if k[0] in inner else start(k[0])
    after = lambda k: (k[0], k[1], k[2] + 1) if k[0] in inner else start(k[0] + 1)
    got = rows.where(_chance() < weight * (per_range * ranges)).select("key.*").collect()
    sample = sorted((r.h, r.d, r.u) for r in got)
    bounds = {clean(sample[i * len(sample) // ranges]) for i in range(1, ranges)} if sample else set()
    bounds |= {start(x) for h in inner for x in (h, h + 1)}
    fair = 2.0 / ranges
    while True:
        placed = _range_of(rows, sorted(bounds))
        ends = placed.groupBy("range").agg(F.sum(weight).alias("weight"), F.min("key").alias("low"), F.max("key").alias("high"))
        one = (F.col("low.h") == F.col("high.h")) if not inner else F.when(F.col("low.h").isin(sorted(inner)), F.col("low") == F.col("high")).otherwise(F.col("low.h") == F.col("high.h"))
        over = {r.range: r for r in ends.where((F.col("weight") > fair) & ~one).collect()}
        if not over:
            return placed, sorted(bounds)
        asked = rows.sparkSession.createDataFrame([(r, x.weight, -int(-2 * x.weight // fair)) for r, x in over.items()], "range int, of double, into int")
        again = placed.join(F.broadcast(asked), "range").where(_chance() < weight / F.col("of") * F.col("into") * per_range)
        found: dict[int, list] = {r: [] for r in over}
        for r in again.select("range", "key.*").collect():
            found[r.range].append((r.h, r.d, r.u))
        for r, x in over.items():
            mine, into = sorted(found[r]), -int(-2 * x.weight // fair)
            picked = {mine[i * len(mine) // into] for i in range(into)} if mine else set()
            picked.add(tuple(x.high))  # at least the last key comes off, so every round gets on
            bounds |= {b for k in picked for b in (clean(k), after(k))}


def placement(sums: list[tuple[int, int, int, int | None]], shards: int) -> dict[int, int]:
    """range -> shard. sums: (range, rows, bytes, heavy group or None) in key order. Heavy groups go first, largest first,
    each to the shard with least; the rest fills what is left of the shards' equal level, in key order."""
    groups: dict[int, int] = {}
    for _, _, size, group in sums:
        if group is not None:
            groups[group] = groups.get(group, 0) + size
    load, of_group = [0] * shards, {}
    for group, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        s = min(range(shards), key=lambda i: (load[i], i))
        of_group[group] = s
        load[s] += size
    light = sum(size for _, _, size, group in sums if group is None)
    # the level to which the light bytes fill the shards
    order, level = sorted(load), 0.0
    for i in range(1, shards + 1):
        level = (light + sum(order[:i])) / i
        if i == shards or level <= order[i]:
            break
    ends = list(accumulate(max(0.0, level - x) for x in load))
    out, at, shard = {}, 0, 0
    for r, _, size, group in sums:
        if group is not None:
            out[r] = of_group[group]
            continue
        while shard < shards - 1 and at + size / 2 >= ends[shard]:
            shard += 1
        out[r], at = shard, at + size
    return out


def shards_by_bytes(docs: DataFrame, shards: int = 8, rows_per_range: int = 20_000, heavy: float = 0.01, cut_heavy: bool = True) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs (doc_id, text; other columns are ignored; doc_id is a
    long or casts to one).

    Slots count from 0 without gaps in each shard, in key order within a range. Null ids come first in their group and
    are told apart by a number of their own, as identical rows are; null and empty texts are one group; an empty table
    gives an empty result. Texts of any length are only measured and hashed.
    """
    store = Stored(docs.sparkSession)
    rows = store.put("keys", keys(docs))
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # groups that weigh over `heavy` of a shard: fewer than shards / heavy of them
    hot = {r.h for r in rows.groupBy("key.h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > heavy * total / shards).select("h").collect()}
    ranges = max(shards * EACH_SHARD, min(MOST_RANGES, -(-count // rows_per_range)))
    placed, _ = splitters(rows, ranges, hot)
    placed = store.put("placed", placed)
    found = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("key.h").alias("h")).collect()
    sums = sorted((r.range, r.n, r.bytes, r.h if r.h in hot else None) for r in found)
    shard_of = placement(sums, shards)
    rows_at = bytes_at = 0
    before, filled = [], [0] * shards
    for r, n, size, _ in sums:
        s = shard_of[r]
        before.append((r, rows_at, bytes_at, s, filled[s]))
        rows_at, bytes_at, filled[s] = rows_at + n, bytes_at + size, filled[s] + n
    offsets = docs.sparkSession.createDataFrame(before, "range int, rows_before long, bytes_before long, shard int, slots_before long")
    inside = Window.partitionBy("range").orderBy("key")
    out = placed.join(F.broadcast(offsets), "range")  # one row a range
    if not cut_heavy:
        return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slots_before") + F.row_number().over(inside) - 1).alias("slot"))
    out = out.drop("shard").withColumn("index", F.col("rows_before") + F.row_number().over(inside) - 1)
    out = out.withColumn("offset", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    together = F.min("offset").over(Window.partitionBy("range", "key.h"))
    begins = F.when(F.col("key.h").isin(sorted(hot)), F.col("offset")).otherwise(together) if hot else together
    out = out.withColumn("start", begins).withColumn("shard", F.expr(f"CAST(least((start * {shards}) DIV {total}, {shards - 1}) AS INT)"))
    out = store.put("out", out.select("doc_id", "size", "text_crc32", "shard", "index"))
    first = out.groupBy("shard").agg(F.min("index").alias("first"))  # one row a shard
    return out.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write docs' rows (doc_id, text, ...) as Parquet under path/shard=N, in slot order inside each file.

    doc_id must be set and unique: it joins rows to their shards."""
    placed = shards_by_bytes(docs, shards).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
