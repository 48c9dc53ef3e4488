"""Random feature maps: spectral distributions, Fourier features, and tuning of their parameters."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: name -> (rng, parameters m, features D, params) -> (D, m) matrix.
DISTRIBUTIONS: dict[str, Callable] = {
    "beta": lambda rng, m, d, p: rng.beta(p[0], p[1], (d, m)),
    "cauchy": lambda rng, m, d, p: rng.standard_cauchy((d, m)) / p[0],
    "dirichlet": lambda rng, m, d, p: rng.dirichlet(np.full(m, p[0]), d),
    "laplace": lambda rng, m, d, p: rng.laplace(0.0, p[0], (d, m)),
    "multivariate_normal": lambda rng, m, d, p: rng.multivariate_normal(np.zeros(m), np.diag(np.broadcast_to(p, m)), d),
    "normal": lambda rng, m, d, p: rng.normal(0.0, p[0], (d, m)),
    "uniform": lambda rng, m, d, p: rng.uniform(p[0], p[1], (d, m)),
}


def distribution(name: str) -> Callable:
    if name not in DISTRIBUTIONS:
        raise NameError(f"no distribution {name}; there are {', '.join(DISTRIBUTIONS)}")
    return DISTRIBUTIONS[name]


def fourier(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, sigma_f: float) -> np.ndarray:
    return math.sqrt(2.0 / len(weights)) * sigma_f * np.cos(x @ weights.T + np.ravel(bias))


def fourier_jacobian(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, sigma_f: float) -> np.ndarray:
    return (-math.sqrt(2.0 / len(weights)) * sigma_f * np.sin(x @ weights.T + np.ravel(bias)))[:, :, None] * weights[None]


@dataclass
class FeatureMap:
    """phi(x), with a matrix that is drawn once on the driver. distr: a name, or a function like those in DISTRIBUTIONS."""

    distr: str | Callable
    bias: np.ndarray
    input_dim: int
    n_features: int
    params: np.ndarray
    sigma_f: float = 1.0
    fmap: Callable = fourier
    fmap_jac: Callable = fourier_jacobian
    seed: int | np.random.RandomState = 42
    _matrix: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not isinstance(self.distr, str) and not callable(self.distr):
            raise TypeError("distr is a name or a function")
        self._draw = distribution(self.distr) if isinstance(self.distr, str) else self.distr
        self._rng = self.seed if isinstance(self.seed, np.random.RandomState) else np.random.RandomState(self.seed)

    def draw(self, params=None) -> np.ndarray:
        return self._draw(self._rng, self.input_dim, self.n_features, np.atleast_1d(self.params if params is None else params))

    @property
    def matrix(self) -> np.ndarray:
        if self._matrix is None:
            self._matrix = self.draw()
        return self._matrix

    @matrix.setter
    def matrix(self, value: np.ndarray) -> None:
        self._matrix = value

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.fmap(x, self.matrix, self.bias, self.sigma_f)

    def jacobian(self, x: np.ndarray) -> np.ndarray:
        return self.fmap_jac(x, self.matrix, self.bias, self.sigma_f)

    def tune(self, score: Callable[[np.ndarray, np.ndarray], float], bounds: list, method: str = "grid", maxiter: int = 50, seed: int = 0, save: Callable | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Least score(matrix, params) over params = 10 ** h; sets and returns (score, params, matrix).

        bounds: a slice (lo, hi, step) a parameter for the grid, (lo, hi) otherwise. Methods: grid, annealing, bayes.
        """
        best: list = [np.inf, None, None]

        def objective(h) -> float:
            params = 10.0 ** np.atleast_1d(h)
            matrix = self.draw(params)
            value = float(score(matrix, params))
            if value < best[0]:
                best[:] = [value, params, matrix]
            return value

        if method == "grid":
            axes = [np.arange(b.start, b.stop, b.step) if isinstance(b, slice) else np.arange(*b) for b in bounds]
            for h in itertools.product(*axes):
                objective(h)
        elif method == "annealing":
            anneal(objective, bounds, maxiter, seed)
        elif method == "bayes":
            bayes_search(objective, bounds, maxiter, seed)
        else:
            raise ValueError(f"no method {method}")
        if best[2] is None:
            raise RuntimeError("no finite score")
        self.params, self.matrix = best[1], best[2]
        if save:
            save(self.matrix)
        return tuple(best)


def anneal(objective: Callable, bounds: list, maxiter: int, seed: int) -> tuple[float, np.ndarray]:
    """Simulated annealing in a box with geometric cooling, restarted from the best point every quarter."""
    rng = np.random.default_rng(seed)
    lo, hi = np.array([(b.start, b.stop) if isinstance(b, slice) else b[:2] for b in bounds], float).T
    x = best_x = rng.uniform(lo, hi)
    fx = best = objective(x)
    for k in range(maxiter):
        if k and k % max(1, maxiter // 4) == 0:
            x, fx = best_x, best
        heat = 0.95**k
        y = np.clip(x + heat * (hi - lo) * rng.standard_cauchy(len(x)) * 0.1, lo, hi)
        fy = objective(y)
        if fy < fx or rng.random() < math.exp(-(fy - fx) / max(heat * max(abs(best), 1e-12), 1e-300)):
            x, fx = y, fy
        if fy < best:
            best, best_x = fy, y
    return best, best_x


def bayes_search(objective: Callable, bounds: list, maxiter: int, seed: int, start: int = 5) -> tuple[float, np.ndarray]:
    """Gaussian-process surrogate with expected improvement over random candidates."""
    rng = np.random.default_rng(seed)
    lo, hi = np.array([(b.start, b.stop) if isinstance(b, slice) else b[:2] for b in bounds], float).T
    xs = [rng.uniform(lo, hi) for _ in range(start)]
    ys = [objective(x) for x in xs]
    for _ in range(maxiter):
        u, y = (np.array(xs) - lo) / (hi - lo), np.array(ys)
        finite = np.where(np.isfinite(y), y, np.nanmax(np.where(np.isfinite(y), y, np.nan)) if np.isfinite(y).any() else 0.0)
        mean, scale = finite.mean(), finite.std() or 1.0
        kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * 0.2**2))
        inv = np.linalg.inv(kernel(u, u) + 1e-6 * np.eye(len(u)))
        c = rng.random((512, len(lo)))
        cross = kernel(c, u)
        mu = cross @ inv @ ((finite - mean) / scale)
        sd = np.sqrt(np.clip(1 - np.einsum("ij,jk,ik->i", cross, inv, cross), 1e-12, None))
        gain = ((finite.min() - mean) / scale) - mu
        z = gain / sd
        ei = gain * 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2))) + sd * np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
        xs.append(lo + c[int(ei.argmax())] * (hi - lo))
        ys.append(objective(xs[-1]))
    k = int(np.argmin(ys))
    return ys[k], xs[k]
