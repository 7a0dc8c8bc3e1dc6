import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hardneg

DDL = "id long, label int, vector array<float>, block int, at string"


def brute(rows, positives=5, negatives=10, scale=256.0):
    """(anchor, positive, rank, negative, scores) with Python's whole numbers."""
    good = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in good:
        if i % 100:
            continue
        near = sorted((-dot(v, w), j) for j, z, w in good if z == y and j != i)[:positives]
        far = sorted((-dot(v, w), j) for j, z, w in good if z != y)
        for s, j in near:
            fit = [(t, k) for t, k in far if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*x, 1, "t") for x in rows], DDL).repartition(5)
    return sorted((x.anchor_id, x.positive_id, x.rank, x.negative_id, x.positive_score, x.negative_score) for x in hardneg.mine(df, F.col("id") % 100 == 0, **more).collect())


def test_brute_force(spark):
    r = np.random.default_rng(2)
    x = (r.normal(0.4, 1, (900, 6)) * r.choice([0.01, 0.3, 1, 4], (900, 1))).round(2)
    x[100:350] = x[0]  # a third of all are one vector
    rows = [(i, int(r.integers(0, 3)), [float(v) for v in x[i]]) for i in range(900)]
    rows += [(5000, 1, None), (None, 1, [1.0] * 6), (5100, None, [1.0] * 6), (5200, 1, [None] * 6), (5300, 1, [float("nan")] * 6), (5400, 0, [float("inf")] * 6), (5500, 0, []), (5600, 2, [1.0, 2.0]), (5700, 9, [0.5] * 6), (901, 1, rows[7][2]), (902, 1, rows[7][2])]
    want = brute(rows)
    assert len(want) > 300
    assert found(spark, rows) == want
    assert found(spark, rows, bucket=7, block=3) == want  # many buckets and blocks


def test_larger_numbers(spark):
    r = random.Random(3)
    rows = [(i * 50, i % 2, [r.uniform(0, 1) * 10.0 ** r.choice([1, 4]) for _ in range(4)]) for i in range(60)]
    rows = [(i, y, [float(np.float32(v)) for v in x]) for i, y, x in rows]
    assert found(spark, rows, bucket=8) == brute(rows)  # float32, float64 and 64-bit products
    huge = [(i, y, [float(np.float32(v * 1e4)) for v in x]) for i, y, x in rows]
    with pytest.raises(Exception, match="64 bits"):
        found(spark, huge)


def test_empty_and_alone(spark):
    assert found(spark, [(100, 1, [1.0]), (200, 2, [1.0]), (300, 3, None)]) == []
    df = spark.createDataFrame([], DDL)
    assert hardneg.mine(df, F.col("id") % 100 == 0).count() == 0


def test_short_buckets_are_pruned():
    """Of vectors whose norms fall by half a bucket, an anchor meets only the long ones."""
    r = np.random.default_rng(5)
    block = lambda ids, v: hardneg.Block(np.array(ids), np.array(ids) % 2, np.sqrt((v.astype(float) ** 2).sum(1)), 8, v.shape[1], v.astype("<i8").tobytes())
    a = block(range(0, 800, 100), r.integers(50, 200, (8, 5)))
    s = hardneg.Search(a, 10, False, np.arange(8), np.full(8, 40_000), np.full(8, 90_000))
    for i in range(12):
        s.meet(block(range(1001 + 100 * i, 1101 + 100 * i), r.integers(1, 200, (100, 5)) >> i))
    assert 0 < s.compared < 8 * 400
