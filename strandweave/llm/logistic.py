"""A small logistic regression for calibrating scores on a bounded number of rows (driver side, a few columns)."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Weighted, lightly ridged, fitted by Newton steps; picklable, so tasks can score with it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 40):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = self._squash(z @ self.w)
            h = (z.T * (weight * p * (1 - p) + 1e-9)) @ z + ridge * np.eye(len(self.w))
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * self.w)
            self.w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break

    @staticmethod
    def _squash(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._squash(self.w[0] + (x - self.mean) / self.scale @ self.w[1:])


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """A weight for each sampled row that restores the classes' shares in all labelled rows."""
    total = max(1, sum(counts.values()))
    return np.array([counts.get(int(v), 0) / total * len(y) / max(1, int((y == v).sum())) for v in y])
