"""A small ridge logistic regression for calibration, fitted on the driver from bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Curve:
    """Means, scales and weights (intercept first) of standardised features."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float) - np.array(self.mean)) / np.array(self.scale)
        logit = self.weights[0] + z @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Curve | None:
    """Newton steps with backtracking; None unless both labels occur."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    pull = ridge * np.r_[1e-6, np.ones(z.shape[1] - 1)]

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float(np.mean(np.logaddexp(0, t) - y * t) + 0.5 * (pull * w * w).sum())

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + pull * w
        hessian = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z / len(y) + np.diag(pull + 1e-12)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-10:
            break
    return Curve(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)))
