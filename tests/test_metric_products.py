"""Nearest under metrics: a matrix product finds the pairs that are summed term by term, and the results are the same bits."""

import numpy as np
import pytest

from lodestone.functions import distance as D
from lodestone.operators import nearest


@pytest.mark.parametrize("both", [True, False])
@pytest.mark.parametrize("shift", [0.0, 100.0, 1e7])
@pytest.mark.parametrize("known", [False, True])
def test_few_pairs_are_summed(monkeypatch, both, shift, known):
    r = np.random.default_rng(6)
    g = r.normal(size=(800, 3, 4))  # rank 3 over 4 axes; one metric that isn't symmetric, one with a negative eigenvalue
    m = np.einsum("nja,njb->nab", g, g)
    m[9, 0, 1] += 0.25
    m[11] -= 0.5 * np.eye(4)
    rows = np.column_stack([r.normal(size=(800, 4)) + shift, m.reshape(800, 16)])
    x, y, ids, summed = rows[:150] if both else rows[:150, :4], rows[150:], np.arange(650) * 3, []
    y[300:310], y[5, :4] = rows[7], rows[8, :4]  # copies and ties
    name = "symmetric_pnp" if both else "pnp"
    exact, col = getattr(D, name), lambda a: list(a.T)
    cross = [v[:, None] for v in x.T]
    q = exact(col(y[:, :4]), cross[:4], col(y[:, 4:]), cross[4:]) if both else exact(cross[:4], col(y[:, :4]), col(y[:, 4:]))
    bound = np.sort(q, axis=1)[:, 6] if known else None
    monkeypatch.setattr(D, name, lambda a, b, *m: summed.append(np.broadcast(a[0], b[0]).size) or exact(a, b, *m))
    at, found, w = nearest.compare(x, ids, y, 7, 4, bound)
    want = [(i, ids[j], q[i, j]) for i in range(150) for j in np.lexsort((ids, q[i]))[:7]]
    assert list(zip(at, found, w)) == want
    assert shift == 1e7 or sum(summed) < 150 * 650 / 4  # far from the origin rounding may leave all pairs open


@pytest.mark.parametrize("odd", [np.nan, np.inf, 1e200])
def test_odd_numbers(odd):
    r = np.random.default_rng(7)
    y = r.normal(size=(50, 20))
    y[3, 1] = odd
    assert nearest.Terms(y, 4, True).close(r.normal(size=(20, 20)), 3, None, None) is None
