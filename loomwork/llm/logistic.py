"""Logistic regression by Newton steps, for the few features of a bounded sample."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Standardized features, a small ridge, and a fall-back to the base rate for constant labels."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> None:
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, signed: bool = True) -> "Logistic":
        """Unless `signed`, no coefficient is negative: features that would get one are taken out, the most negative first."""
        model = cls._fit(x, y, ridge, steps, np.ones(x.shape[1], dtype=bool))
        use = np.ones(x.shape[1], dtype=bool)
        while not signed and model.weights[:-1].min(initial=0.0) < 0:
            use[int(model.weights[:-1].argmin())] = False
            model = cls._fit(x, y, ridge, steps, use)
        return model

    @classmethod
    def _fit(cls, x: np.ndarray, y: np.ndarray, ridge: float, steps: int, use: np.ndarray) -> "Logistic":
        if not len(x):
            return cls(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1))
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([(x - mean) / scale * use, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        rate = (y.sum() + 0.5) / (len(y) + 1)
        w[-1] = np.log(rate / (1 - rate))
        if y.min() == y.max():
            return cls(mean, scale, w)
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))
