"""Nearest of long vectors: few distances are summed term by term, and the results are the same bits."""

import numpy as np
import pytest

from lodestone.functions import distance as D
from lodestone.operators import nearest


@pytest.mark.parametrize("shift", [0.0, 100.0, 1e6])
def test_few_pairs_are_summed(monkeypatch, shift):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(150, 64)) + shift, r.normal(size=(600, 64)) + shift
    y[300:310], y[5] = x[7], y[6]  # copies and ties
    ids, summed, exact = np.arange(600) * 3, [], D.ploss
    q = exact(list(y.T), [v[:, None] for v in x.T])
    monkeypatch.setattr(D, "ploss", lambda c, s: summed.append(np.broadcast(c[0], s[0]).size) or exact(c, s))
    rows, found, w = nearest.compare(x, ids, y, 7, 64)
    want = [(i, ids[j], q[i, j]) for i in range(150) for j in np.lexsort((ids, q[i]))[:7]]
    assert list(zip(rows, found, w)) == want
    assert shift == 1e6 or sum(summed) < 150 * 600 / 4  # far from the origin rounding leaves all pairs open


@pytest.mark.parametrize("odd", [np.nan, np.inf, 1e200])
def test_odd_numbers(odd):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(20, 20)), r.normal(size=(50, 20))
    y[3, 4] = odd
    with np.errstate(over="ignore", invalid="ignore"):
        q = D.ploss(list(y.T), [v[:, None] for v in x.T])
        rows, found, w = nearest.compare(x, np.arange(50), y, 3, 20)
    if not np.isnan(odd):
        assert list(zip(rows, found)) == [(i, j) for i in range(20) for j in np.lexsort((np.arange(50), q[i]))[:3]]
    assert nearest._close(x, y, 3) is None


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_known_bounds_leave_few_pairs(monkeypatch, shift):
    """What is farther than a source's bound isn't summed, also far from the origin."""
    r = np.random.default_rng(6)
    x, y = r.normal(size=(150, 64)) + shift, r.normal(size=(900, 64)) + shift
    summed, exact = [], D.ploss
    q = exact(list(y.T), [v[:, None] for v in x.T])
    bound = np.sort(q, axis=1)[:, 6]
    monkeypatch.setattr(D, "ploss", lambda c, s: summed.append(np.broadcast(c[0], s[0]).size) or exact(c, s))
    got = [nearest.compare(x, np.arange(at, at + 300), y[at : at + 300], 7, 64, bound) for at in (0, 300, 600)]
    assert sum(summed) < 2 * 7 * 150
    want = [(i, j, q[i, j]) for i in range(150) for j in np.lexsort((np.arange(900), q[i]))[:7]]
    assert list(zip(*nearest.first(*map(np.concatenate, zip(*got)), 7))) == want


@pytest.mark.parametrize("scale", [1.0, 1e-30])
def test_many_blocks_and_partitions(spark, monkeypatch, scale):
    """Blocks grow with the table, and bounds go from block to block: the rows are those of all pairs."""
    r = np.random.default_rng(7)
    x = r.normal(size=(700, 20)) * scale
    x[300:320], x[10:400:40] = x[5], x[6]
    monkeypatch.setattr(nearest, "PART", 250)
    monkeypatch.setattr(nearest, "MOST", 100)
    t = spark.createDataFrame([(i * 3, *map(float, v)) for i, v in enumerate(x)], ["row_id", *(f"e{i}" for i in range(20))])
    got = sorted(tuple(w) for w in nearest.nearest(t, t, 4, [f"e{i}" for i in range(20)], block=16).collect())
    q = D.ploss(list(x.T), [v[:, None] for v in x.T])
    assert got == sorted((i * 3, int(j) * 3, q[i, j]) for i in range(700) for j in np.lexsort((np.arange(700), q[i]))[:4])
