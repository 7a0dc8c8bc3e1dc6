"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

AXES = ("tau", "p", "d", "alpha")


def points(axes: tuple[str, ...] = AXES) -> T.StructType:
    """A parameter grid: explicit row ids, one double an axis."""
    return T.StructType([T.StructField("row_id", T.LongType(), False), *(T.StructField(a, T.DoubleType()) for a in axes)])
