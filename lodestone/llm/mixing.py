"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source has a target, in words: its weight's part of a share of all words, at most `most` times its own size; what that
cuts off goes to the sources below, by their weights, until none is above. A document's expected copies are its source's
target over its source's size. Documents are ordered in their source by size; expected copies are summed up along that
order from one random offset a source, and a document is emitted once for each integer that the sum crosses. The sum at a
document's place never strays from what is expected by as much as one copy, and sizes grow along the order, so the words
taken from a source differ from its target by less than two of its longest documents.

Sums are exact: expected copies are whole numbers of 1 / UNIT, so a sum is a place in the order times that number, and
only places have to be found. Rows are sorted by range; a row's place is its number in its partition and the rows of its
source in the partitions before. What is summed for that is one row a source and partition, so a source of any size is
spread over as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Stored

#: Parts of a copy that are counted in; places in a source go up to 2^38.
UNIT = 1 << 24
SPACE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; a null text has none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE[1:], " " * (len(SPACE) - 1))
    # a word starts where a space, or the start, comes before something else
    return F.regexp_count(F.concat(F.lit(" "), plain), F.lit(" [^ ]")).cast("long")


def places(store: Stored, name: str, rows: DataFrame, order: Sequence[str], group: str | None = None) -> DataFrame:
    """rows, stored in order, with place: how many rows of the same group (or all) come before.

    order starts with the group. A partition is a range of the order; in it, rows are numbered."""
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    kept = store.put(name, numbered)
    part = F.shiftright("_m", 33)
    by = [group] if group else []
    tallies = kept.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    tallies = store.put(f"{name}_tallies", tallies.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return kept.withColumn("_part", part).join(tallies, [*by, "_part"]).withColumn("place", F.col("_before") + F.col("_m") - F.col("_first")).drop("_m", "_part", "_first", "_before")


def targets(sources: DataFrame, store: Stored, share: float, most: float) -> DataFrame:
    """sources (_source, weight, source_size) with target: share of all words by weight, at most `most` times the source's
    size, the excess shared by weight among those below until none is above.

    Each round is one aggregate over the sources; those at their bound stay there, so rounds end."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    bound = F.lit(float(most)) * F.col("source_size")
    level = -1.0
    while True:
        full = bound < F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(~full, F.col("weight"))), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.count(F.when(full, 1))).first()
        if not row[0]:  # every source is at its bound
            return sources.withColumn("target", bound)
        new = (share * total - most * row[1]) / row[0]
        if new == level:
            return sources.withColumn("target", F.when(full, bound).otherwise(F.least(bound, F.lit(level) * F.col("weight"))))
        level = new


def offset(source: Column, seed: str) -> Column:
    """A source's random offset, as a number of units below one copy."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), source).cast("binary")), 1, 6), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, source: str = "source", seed: str = "mix", keep_text: bool = False) -> DataFrame:
    """docs' columns (text only if keep_text) with size (words), source_size, target, copies and taken (copies * size).

    weights: of the sources in order of their names' code points, null last, repeating. A null text has no words. A source
    without words has a target of 0 and its documents no copies. Equal sizes are ordered by doc_id (null first) and a hash
    of the text, so reruns agree however rows are partitioned; rows equal in all that are exchangeable, repeated rows
    count each. No document gets more than ceil(most) copies. Columns of docs named as the new ones are replaced, any other
    name may occur; an empty table gives an empty one. Texts of any length are only counted and hashed."""
    new = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    store = Stored(docs.sparkSession)
    text = F.col("text").cast("string")
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("~"))  # "~" is behind "="
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), name.alias("_source"), F.col("doc_id").alias("_id"), n_words(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"))
    rows = store.put("counted", rows)  # the sort samples its input first, so words would be counted twice
    rows = places(store, "rows", rows, ["_source", "size", "_id", "_h"], "_source")
    sources = store.put("sizes", store.read("rows").groupBy("_source").agg(F.sum("size").alias("source_size")))
    sources = places(store, "sources", sources, ["_source"])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = store.put("weights", sources.select("_source", "source_size", weight.alias("weight")))
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0)).cast("long")
    sources = store.put("targets", targets(sources, store, share, most).select("_source", "source_size", "target", each.alias("_each"), offset(F.col("_source"), seed).alias("_offset")))
    at = lambda place: F.shiftright(place * F.col("_each") + F.col("_offset"), UNIT.bit_length() - 1)
    copies = at(F.col("place") + 1) - at(F.col("place"))
    out = rows.join(sources, "_source").withColumn("copies", copies)
    return out.select(*(F.col(f"row.`{c}`") for c in own), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of a mixture: those of mix(), each as often as its copies say, with copy (from 0)."""
    rest = [c for c in mixed.columns if c != "copy"]
    return mixed.where("copies > 0").select(*(F.col(f"`{c}`") for c in rest), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
