"""Distances hold one term at a time."""

import tracemalloc

import numpy as np

from lodestone.functions import distance as D


def test_distances_hold_one_term_at_a_time():
    r = np.random.default_rng(1)
    x, y, m = [[v for v in r.normal(size=s)] for s in ((4, 256, 1), (4, 256), (16, 256))]
    tracemalloc.start()
    D.pnp(x, y, m)
    D.symmetric_pnp(x, y, m, [v[:, None] for v in r.normal(size=(16, 256))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 256 * 256 * 8
