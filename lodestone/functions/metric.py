"""Local metrics M = G'G from the exact derivatives of a feature map of the synthesizer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestone.functions.drum import Drum, synth, synth_tangents
from lodestone.functions.features import FeatureMap


@dataclass(frozen=True)
class Chain:
    """Features of a parameter vector: the map of the drum's waveform. how: omega, log, as_written of the synthesizer."""

    features: FeatureMap
    drum: Drum = Drum()
    how: tuple = ()

    def signal(self, theta: np.ndarray) -> np.ndarray:
        return synth(np.asarray(theta, float), self.drum, **dict(self.how))

    def s(self, theta: np.ndarray) -> np.ndarray:
        return self.features.apply(self.signal(theta))

    def jacobian(self, theta: np.ndarray) -> np.ndarray:
        """Rows: coefficients; columns: parameters."""
        y, dy = synth_tangents(theta, self.drum, **dict(self.how))
        return self.features.jvp(y, dy)[1].T

    def metric(self, theta: np.ndarray) -> np.ndarray:
        g = self.jacobian(theta)
        return g.T @ g


@dataclass(frozen=True)
class Quadratic:
    """A closed-form chain that SQL can follow: coefficient j is sum_i theta_i / (i + j + 1) + theta_i^2 / (2 + 2i + 4j)."""

    coefficients: int = 3

    def s(self, theta: np.ndarray) -> np.ndarray:
        t, i = np.asarray(theta, float), np.arange(len(theta))
        return np.array([(t / (i + j + 1) + t * t / (2 + 2 * i + 4 * j)).sum() for j in range(self.coefficients)])

    def jacobian(self, theta: np.ndarray) -> np.ndarray:
        t, i = np.asarray(theta, float), np.arange(len(theta))
        return np.array([1.0 / (i + j + 1) + t / (1.0 + i + 2 * j) for j in range(self.coefficients)])

    def metric(self, theta: np.ndarray) -> np.ndarray:
        g = self.jacobian(theta)
        return np.array([[sum(g[k, a] * g[k, b] for k in range(len(g))) for b in range(g.shape[1])] for a in range(g.shape[1])])
