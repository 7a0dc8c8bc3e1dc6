"""Squared distances between points, feature vectors and points under a local metric, as columns and as array blocks.

Low dimensions are unrolled into scalar arithmetic, which Spark compiles; vectors of any length go through Arrow and
numpy. Sums run from the first to the last term in both, so their results are the same bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(terms: Iterable):
    """The sum from the first to the last, which holds one term at a time."""
    terms = iter(terms)
    out = next(terms)
    for t in terms:
        out = out + t
    return out


def ploss(c: Sequence, r: Sequence):
    """Sum of squared differences of the axes; for columns or arrays."""
    return _total((b - a) * (b - a) for a, b in zip(c, r))


def pnp(c: Sequence, r: Sequence, m: Sequence):
    """Differences in the quadratic form m (row-major, of the reference)."""
    d = [b - a for a, b in zip(c, r)]
    return _total(m[i * len(d) + j] * d[i] * d[j] for i in range(len(d)) for j in range(len(d)))


def symmetric_pnp(c: Sequence, r: Sequence, mc: Sequence, mr: Sequence):
    """The mean of both points' quadratic forms."""
    d = [b - a for a, b in zip(c, r)]
    return _total((mc[i * len(d) + j] + mr[i * len(d) + j]) / 2 * d[i] * d[j] for i in range(len(d)) for j in range(len(d)))


def bruteforce(c: Column, r: Column) -> Column:
    """Squared distance of two array columns of any length."""
    return F.aggregate(F.zip_with(c, r, lambda a, b: (b.cast("double") - a.cast("double")) * (b.cast("double") - a.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def block(c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared distances of rows of c to one vector r, summed in the order of coefficients."""
    d = r[:, None] - np.ascontiguousarray(c.T, dtype=float)
    return np.add.reduce(d * d, axis=0)


METHODS = {"P-loss": ploss, "PNP": pnp, "Bruteforce": bruteforce}


def distance(method: str):
    """The distance of a method's name."""
    if method not in METHODS:
        raise ValueError(f"unknown distance {method!r}: one of {', '.join(METHODS)}")
    return METHODS[method]
