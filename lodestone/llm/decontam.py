"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of `window` consecutive words (an item with fewer is one window); a window is sought whole,
so its overlap bound is all of its word shingles and its necessary prefix is a single one: the rarest. One pass over the
texts finds where shingles of windows stand in them, word by word; shingles are ordered by how many such places they
have. Places of a window's rarest shingle, less its offset, are the window's candidate places; those that would begin
before the text or end after it fall to the positional and length bounds, and at the rest every other shingle of the
window must stand at its own offset, which makes the containment exact.

Windows and shingles go by number and the ids of items are joined last, once for each set of windows that texts share,
so a window that a million items have is one row until then. What leaves the pass over the texts is places of shingles,
never texts. The shingles are sent to every task up to `block` of them; beyond, a bitmap of their hashes (its size
bounded by MOST_BITS) thins out the places first and what passes is joined as Spark sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stored, text_key, words

SHINGLE = 3
KEY = "_text_key"
#: Bits of the bitmap for each shingle, and at most.
BITS_EACH, MOST_BITS = 32, 1 << 27


def _hash(array: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(array, at + i) for i in range(k)))


def windows(items: DataFrame, store: Stored, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (wid, window: array of words, n: its length, k: words in its shingles) of each distinct window,
    and (wid, item_id as string) of those that have it.

    Items without words have no windows; a null item_id marks words but isn't listed."""
    w, n = F.col("w"), F.size("w")
    each = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(n > 0)
    each = each.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("at"))
    each = each.select("item_id", F.slice(w, F.col("at") + 1, F.lit(window)).alias("window")).distinct()
    size = F.size("window")
    wins = store.put("windows", each.select("window").distinct().select(F.monotonically_increasing_id().alias("wid"), "window", size.alias("n"), F.least(size, F.lit(SHINGLE)).alias("k")))
    return wins, store.put("owners", each.where("item_id is not null").join(wins, "window").select("wid", "item_id"))


def _bitmap(grams: DataFrame, count: int) -> tuple[DataFrame, int]:
    """One row with an array of longs: the bits at the shingles' hashes; and how many bits there are."""
    bits = 1 << min(MOST_BITS, max(1024, BITS_EACH * count)).bit_length() - 1
    at = F.pmod("shingle", F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    longs = grams.groupBy((at / 64).cast("long").alias("id")).agg(F.bit_or(bit).alias("v"))
    whole = grams.sparkSession.range(bits // 64).join(longs, "id", "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("bits")), bits


def places(docs: DataFrame, grams: DataFrame, sizes: list[int], count: int, block: int) -> DataFrame:
    """(_text_key, at, length: the text's words, gid): where shingles (gid, gram, shingle: its hash) stand in docs (_text_key, text)."""
    w = docs.select(KEY, words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select(KEY, "w", F.explode(F.sequence(F.lit(0), F.size("w") - min(sizes))).alias("at")).where(F.col("at") >= 0)  # too short: 0, -1
    if len(sizes) == 1:
        w = w.withColumn("k", F.lit(sizes[0])).withColumn("shingle", _hash(F.col("w"), F.col("at"), sizes[0]))
    else:
        each = F.array(*(F.struct(F.lit(k).alias("k"), _hash(F.col("w"), F.col("at"), k).alias("shingle")) for k in sizes))
        w = w.select(KEY, "w", "at", F.explode(each).alias("s")).select(KEY, "w", "at", "s.k", "s.shingle")
    here = F.slice("w", F.col("at") + 1, F.col("k"))
    if count <= block:
        found = w.join(F.broadcast(grams), "shingle").where(here == F.col("gram"))
        return found.select(KEY, "at", F.size("w").alias("length"), "gid")
    bitmap, bits = _bitmap(grams, count)
    at = F.pmod("shingle", F.lit(bits))
    passed = F.call_function("shiftrightunsigned", F.get("bits", (at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    some = w.crossJoin(F.broadcast(bitmap)).where(passed).select(KEY, "at", F.size("w").alias("length"), "shingle", here.alias("here"))
    return some.join(grams, "shingle").where(F.col("here") == F.col("gram")).select(KEY, "at", "length", "gid")


def occurrences(docs: DataFrame, items: DataFrame, store: Stored, window: int = 10, block: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(_text_key, at, n, wid): where windows stand in docs (_text_key, text), whose rows with equal keys have equal texts;
    and (wid, item_id)."""
    wins, owners = windows(items, store, window)
    each = wins.select("wid", "window", "n", "k", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("off"))
    each = each.select("wid", "n", "k", "off", F.slice("window", F.col("off") + 1, F.col("k")).alias("gram"))
    grams = each.select("k", "gram").distinct().withColumn("shingle", F.xxhash64("k", *(F.get("gram", F.lit(i)) for i in range(SHINGLE))))
    grams = store.put("grams", grams.withColumn("gid", F.monotonically_increasing_id()))
    shingles = store.put("shingles", each.join(grams.select("gram", "gid"), "gram").select("wid", "n", "k", "off", "gid"))
    sizes = sorted((r.k, r["count"]) for r in grams.groupBy("k").count().collect())  # three rows at most
    if not sizes:
        return docs.limit(0).select(KEY, F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("wid")), owners
    hits = places(docs, grams.select("shingle", "gram", "gid"), [k for k, _ in sizes], sum(n for _, n in sizes), block)
    hits = store.put("hits", hits.distinct())  # equal texts once
    # a shingle that stands nowhere is the rarest of all: so does its window
    seen = hits.groupBy("gid").agg(F.count(F.lit(1)).alias("seen"))
    first = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gid", "off"))
    prefix = store.put("prefix", shingles.join(seen, "gid", "left").groupBy("wid", "n").agg(first.alias("first")).where("first.seen > 0").select("wid", "n", "first.gid", "first.off"))
    start = F.col("at") - F.col("off")
    maybe = hits.join(prefix, "gid").where((start >= 0) & (start + F.col("n") <= F.col("length"))).select(KEY, "wid", start.alias("start"))
    asked = maybe.join(shingles, "wid").select(KEY, "wid", "n", "k", "start", (F.col("start") + F.col("off")).alias("at"), "gid")
    held = asked.join(hits.select(KEY, "at", "gid"), [KEY, "at", "gid"]).groupBy(KEY, "wid", "start", "n", "k").agg(F.count(F.lit(1)).alias("held"))
    return held.where(F.col("held") == F.col("n") - F.col("k") + 1).select(KEY, F.col("start").alias("at"), "n", "wid"), owners


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block: int = 500_000, spans: bool = False, items_too: bool = False) -> DataFrame:
    """docs' columns with n_words, n_hit (words inside any occurrence of a window), n_items (ids with occurring windows),
    items_sha256 (of those ids, sorted as strings and joined by commas) and, if asked for, items (the ids) and spans (array
    of [start, length) in words, merged).

    The number and digest of a set of windows' items are made once and joined to the texts that have the set; the ids
    themselves only go along if asked for.

    Null and empty texts have no words and no hits; items without words, or an empty benchmark, hit nothing; repeated
    rows each get their result; columns of docs with these names are replaced. Texts are known by a 128-bit hash, so a
    null or repeated doc_id doesn't matter. Texts of any length are one row's work in the pass over the texts; the places
    found in one are gathered for that text alone. Ties among equally rare shingles go by their number.
    """
    store = Stored(docs.sparkSession)
    text = F.col("text").cast("string")
    found, owners = occurrences(docs.select(text_key(text).alias(KEY), text.alias("text")), items, store, window, block)
    # sets, pre-aggregated in each task: their size is bounded by one text's places
    found = store.put("places", found.groupBy(KEY).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("at"), F.sort_array(F.collect_set("wid")).alias("wids")))
    # the ids of a set of windows are gathered once, however many texts have that set
    ids = found.select("wids").distinct().select("wids", F.explode("wids").alias("wid")).join(owners, "wid").groupBy("wids").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    sets = store.put("sets", ids.select("wids", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), *(["items"] if items_too else [])))
    found = found.join(sets, "wids", "left").drop("wids")
    zero = F.lit(0).cast("long")
    merged = F.aggregate(
        "at",
        F.struct(zero.alias("hit"), zero.alias("end")),
        lambda a, x: F.struct((a["hit"] + F.greatest(zero, x["at"] + x["n"] - F.greatest(a["end"], x["at"].cast("long")))).alias("hit"), F.greatest(a["end"], (x["at"] + x["n"]).cast("long")).alias("end")),
        lambda a: a["hit"],
    )
    found = store.put("found", found.select(KEY, merged.alias("n_hit"), "n_items", "items_sha256", *(["items"] if items_too else []), *(["at"] if spans else [])))
    extra = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["items"] if items_too else []), *(["spans"] if spans else [])]
    own = [c for c in docs.columns if c not in extra]
    # columns by number: their names clash with none here, and those that nobody reads aren't moved with the join
    left = docs.select(*(F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(own)), text_key(text).alias(KEY), F.size(words(text)).cast("long").alias("n_words"))
    out = left.join(found, KEY, "left").withColumn("n_hit", F.coalesce("n_hit", zero))
    out = out.select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(own)), "n_words", "n_hit", F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *([F.coalesce("items", F.array().cast("array<string>")).alias("items")] if items_too else []), *(["at"] if spans else []))
    return out.withColumnRenamed("at", "spans") if spans else out


def keep_clean(docs: DataFrame, items: DataFrame, most: float = 0.0) -> DataFrame:
    """docs without those in which windows of benchmark items cover more than the share `most` of the words."""
    columns = docs.columns
    own = [c for c in columns if c != "text"]
    marked = contamination(docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), "text"), items)
    marked = marked.where(F.col("n_hit") <= most * F.col("n_words") if most > 0 else F.col("n_hit") == 0)  # without a share no words are counted
    return marked.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns))
