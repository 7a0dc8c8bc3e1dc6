"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host; a line is boilerplate if more than `ratio` of the host's other pages have it too: with n pages that
contain it of N, (n - 1) / (N - 1). So the line of a single page never is, a line on both pages of a host of two always is,
and no other switch is needed. Pages of a host with the same text count once: copies of an article are no frame.
Boilerplate leaves every page of its host.

Counts are pre-aggregated in each task before the shuffle, so a hot host is spread over its lines. What comes out is small:
a host has at most (mean lines of a page) / ratio such lines, whatever its pages. It is stored, so Spark knows its size
and broadcasts it only below its threshold; beyond it the join with the pages is one that Spark may split where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stored, text_key

#: White space that is taken off lines.
BLANK = " \t\r\x0b\x0c"


def _trimmed(x: Column) -> Column:
    """A line without ASCII white space around it."""
    return F.btrim(x, F.lit(BLANK))


def _line(x: Column) -> Column:
    """A trimmed line's digest, a string: arrays of them are compared through hash sets."""
    return F.md5(_trimmed(x).cast("binary"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def frequent_lines(pages: DataFrame, ratio: float) -> DataFrame:
    """(_host, _line) of lines that more than `ratio` of the other pages of a page's host have. pages: (_host, text)."""
    key = text_key(F.col("text"))
    total = pages.groupBy("_host").agg(F.count_distinct(key).alias("pages"))
    own = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda x: x != ""))  # a page counts once
    each = pages.select("_host", key.alias("_page"), F.explode(own).alias("line")).select("_host", "_page", _line(F.col("line")).alias("_line"))
    n = each.groupBy("_host", "_line").agg(F.count_distinct("_page").alias("n")).where("n > 1")
    return n.join(total, "_host").where(F.col("n") - 1 > ratio * (F.col("pages") - 1)).select("_host", "_line")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.05) -> DataFrame:
    """docs with boilerplate lines taken out of text; columns, rows and line order stay, and n_lines_dropped is added.

    Lines compare without ASCII white space around them; blank lines are never dropped and don't count. A page made of
    boilerplate only keeps its blank lines. Null hosts form one host; null and empty texts stay as they are and are one
    page; ties, lines at exactly the ratio, stay; repeated rows are one page and each lose their lines; a column named
    n_lines_dropped is replaced; an empty table gives an empty one. A text of any length is one row's work: its lines are
    looked up in one pass."""
    store = Stored(docs.sparkSession)
    rest = [c for c in docs.columns if c != "n_lines_dropped"]
    pages = docs.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("")).alias("_host"), F.col("text").cast("string").alias("text"))
    lines = store.put("frequent", frequent_lines(pages, ratio))
    sets = store.put("sets", lines.groupBy("_host").agg(F.collect_set("_line").alias("_drop")))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("")).alias("_host"))
    row = row.join(sets, "_host", "left")
    all_lines = _lines(F.col("row.text"))
    # one lookup in the host's set a page; what it finds is few
    row = row.withColumn("_mine", F.when(F.col("row.text").isNotNull(), F.array_intersect(F.transform(all_lines, _line), "_drop")))
    kept = F.filter(all_lines, lambda x: ~F.array_contains("_mine", _line(x)))
    row = row.withColumn("_kept", F.when(F.size("_mine") > 0, kept))
    whole = F.col("_kept").isNull()
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join("_kept", "\n"))
    dropped = F.when(whole, F.lit(0)).otherwise(F.size(all_lines) - F.size("_kept"))
    return row.select(*((text.alias("text") if c == "text" else F.col(f"row.`{c}`")) for c in rest), dropped.cast("long").alias("n_lines_dropped"))
