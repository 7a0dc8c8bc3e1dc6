"""The search through boxes against the one that compares all pairs: the same rows, bit by bit, and work that doesn't grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import boxes, graph
from lodestone.operators.nearest import nearest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, x, step=3):
    return spark.createDataFrame([(i * step, *map(float, v)) for i, v in enumerate(x)], ["row_id", *"abcd"[: x.shape[1]]])


@pytest.mark.parametrize("heavy", [1 << 18, 40])
def test_copies_ties_and_two_tables(spark, monkeypatch, heavy):
    """Many boxes; also where a point is so often that no plane parts it."""
    monkeypatch.setattr(boxes, "FEW", 25)
    monkeypatch.setattr(boxes, "HEAVY", heavy)
    r = np.random.default_rng(3)
    x = np.r_[r.normal(0, 4, (300, 3)), r.integers(0, 4, (200, 3)), np.ones((90, 3))]
    t, s = table(spark, x), table(spark, np.r_[r.normal(0, 9, (60, 3)), x[250:320], [[1e9, -1e9, 0]]], 5)
    assert rows(boxes.nearest_in_boxes(t, t, 7, "abc")) == rows(nearest(t, t, 7, "abc"))
    assert rows(boxes.nearest_in_boxes(s, t, 7, "abc")) == rows(nearest(s, t, 7, "abc"))
    odd = t.union(spark.createDataFrame([(9000, None, 1.0, 1.0), (9001, float("nan"), 1.0, 1.0), (9002, float("inf"), 1.0, 1.0)], t.schema))
    assert rows(boxes.nearest_in_boxes(odd, odd, 3, "abc")) == rows(nearest(t, t, 3, "abc"))


def test_few_points(spark, monkeypatch):
    monkeypatch.setattr(boxes, "FEW", 4)
    t = table(spark, np.random.default_rng(5).normal(size=(30, 2)))
    assert rows(boxes.nearest_in_boxes(t, t, 50, "ab")) == rows(nearest(t, t, 50, "ab"))  # fewer than neighbours
    assert boxes.nearest_in_boxes(t.limit(0), t, 3, "ab").count() == boxes.nearest_in_boxes(t, t.limit(0), 3, "ab").count() == 0
    assert rows(graph.nearest_pairs(t, 2, "ab", metric=None, search="cells")) == rows(nearest(t, t, 3, "ab"))


def test_work_of_a_point_does_not_grow(spark):
    """Eight times the points, at the same distances, cost a point about the same."""
    at = lambda name, most: F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(1_000_003)) * (most / 1_000_003)
    each = []
    for n in (8_000, 64_000):
        p = spark.range(n).select(F.col("id").alias("row_id"), at("a", 20.0).alias("a"), at("b", 20.0).alias("b"), at("c", n / 400).alias("c"))
        pairs = spark.sparkContext.accumulator(0)
        assert boxes.nearest_in_boxes(p, p, 7, "abc", counted=pairs).count() == 7 * n
        each.append(pairs.value / n)
    assert each[1] < 1.5 * each[0] and each[1] < 3000, each
