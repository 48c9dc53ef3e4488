"""Gaussian-process regression on few rows (a cluster, a fold): NumPy, on the driver or inside applyInPandas."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def rbf(a: np.ndarray, b: np.ndarray, scale: float = 1.0) -> np.ndarray:
    return np.exp(-0.5 * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0) / scale**2)


@dataclass
class FixedGP:
    """Unit RBF kernel with a tiny nugget: closed form."""

    nugget: float = 1e-10

    def fit(self, x: np.ndarray, y: np.ndarray) -> FixedGP:
        self.x = x
        self.alpha = np.linalg.solve(rbf(x, x) + self.nugget * np.eye(len(x)), y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.x) @ self.alpha


@dataclass
class GP:
    """RBF plus noise; variance, length and noise maximise the marginal likelihood from several starts.

    Gradient ascent on the logarithms with backtracking. normalize: outputs are standardised for the fit. Rows of equal
    points are worked with as their mean and number, which gives the same likelihood and predictions.
    """

    normalize: bool = True
    noise: float = 1.0
    restarts: int = 10
    seed: int = 0
    steps: int = 30

    def _nll(self, h: np.ndarray, d2: np.ndarray, y: np.ndarray, n: np.ndarray, within: float) -> tuple[float, np.ndarray]:
        """y: means of n rows each; within: squares of the rows about them."""
        var, length, noise = np.exp(h)
        k = var * np.exp(-0.5 * d2 / length**2)
        s = noise + 1e-8
        try:
            chol = np.linalg.cholesky(k + np.diag(s / n))
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(3)
        inv = np.linalg.inv(k + np.diag(s / n))
        alpha = inv @ y
        d = y.shape[1]
        inner = d * inv - alpha @ alpha.T
        grads = (k, k * d2 / length**2, np.diag(noise / n))
        more = n.sum() - len(n)
        value = 0.5 * (y * alpha).sum() + d * np.log(np.diag(chol)).sum() + 0.5 * (d * more * np.log(s) + d * np.log(n).sum() + within / s)
        return float(value), np.array([0.5 * (inner * g).sum() for g in grads]) + [0, 0, 0.5 * noise * (d * more / s - within / s**2)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> GP:
        y = np.asarray(y, float).reshape(len(x), -1)
        self.mean, self.scale = (y.mean(0), np.where(y.std(0) > 0, y.std(0), 1.0)) if self.normalize else (np.zeros(y.shape[1]), np.ones(y.shape[1]))
        z, rng = (y - self.mean) / self.scale, np.random.default_rng(self.seed)
        n, within = np.ones(len(x)), 0.0
        points, at = np.unique(x, axis=0, return_inverse=True)
        if len(points) < len(x):
            n, rows, x = np.bincount(at.ravel()).astype(float), z, points
            z = np.column_stack([np.bincount(at.ravel(), c) for c in rows.T]) / n[:, None]
            within = float(((rows - z[at.ravel()]) ** 2).sum())
        d2 = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0)
        best = (np.inf, np.array([0.0, 0.0, np.log(self.noise)]))
        for r in range(self.restarts + 1):
            h = np.array([0.0, 0.0, np.log(self.noise)]) if r == 0 else rng.normal(0, 1.5, 3)
            value, grad = self._nll(h, d2, z, n, within)
            rate = 0.1
            for _ in range(self.steps):
                if not np.isfinite(value) or np.abs(grad).max() < 1e-4:
                    break
                trial = np.clip(h - rate * grad / max(1.0, np.abs(grad).max()), -12, 12)
                v, g = self._nll(trial, d2, z, n, within)
                if v < value:
                    h, value, grad, rate = trial, v, g, min(rate * 1.6, 2.0)
                else:
                    rate /= 3
                    if rate < 1e-6:
                        break
            if value < best[0]:
                best = (value, h)
        self.log_likelihood, (var, length, noise) = -best[0], np.exp(best[1])
        self.x, self.params = x, (var, length, noise)
        self.alpha = np.linalg.solve(var * np.exp(-0.5 * d2 / length**2) + np.diag((noise + 1e-8) / n), z)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        var, length, _ = self.params
        return var * rbf(x, self.x, length) @ self.alpha * self.scale + self.mean

    def gradient(self, x: np.ndarray) -> np.ndarray:
        """(n, outputs, m) derivatives of the mean."""
        var, length, _ = self.params
        k = var * rbf(x, self.x, length)
        return np.einsum("nt,ntm,td->ndm", k, -(x[:, None] - self.x[None]) / length**2, self.alpha) * self.scale[None, :, None]


def r2(truth: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Coefficient of determination by output."""
    t, p = np.asarray(truth, float).reshape(len(truth), -1), np.asarray(predicted, float).reshape(len(truth), -1)
    spread = ((t - t.mean(0)) ** 2).sum(0)
    left = ((t - p) ** 2).sum(0)
    return np.where(spread > 0, 1 - left / np.where(spread > 0, spread, 1), np.where(left > 0, 0.0, 1.0))


def clipped_r2(truth: np.ndarray, predicted: np.ndarray) -> float:
    return float(np.clip(r2(truth, predicted), 0, 1).mean())
