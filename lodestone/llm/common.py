"""Helpers that the corpus operators share: table reading, word splitting, text keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import ship
from lodestone.sources.scratch import Stored, shared_dir

__all__ = ["Stored", "lower_ascii", "shared_dir", "spread", "table", "text_key", "trimmed", "words"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is not part of a word: ASCII other than digits and letters.
WORD_GAPS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores is dealt out; a larger one stays as it is, without a shuffle."""
    ship(docs.sparkSession)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Run) -> Run:
    """A function for mapInArrow that gives freed memory back to the system at its end: Python workers outlive their
    tasks, beside the executor's heap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return task


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + WORD_GAPS, LOWER + " " * len(WORD_GAPS))
    return F.array_remove(F.split(plain, " "), "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: rows with equal texts share one result."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))
