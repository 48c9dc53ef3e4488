"""Small dense linear algebra for the driver: what is left once Spark has reduced rows to a matrix of parameters."""

from __future__ import annotations

import numpy as np


class NotFitted(TypeError):
    """A model is asked for results before fit."""


def canonical_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns with their first component made non-negative."""
    return vectors * np.where(vectors[:1] < 0, -1.0, 1.0)


def sorted_eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Absolute eigenvalues in falling order, as a column, and their vectors with canonical signs."""
    values, vectors = np.linalg.eigh(np.asarray(matrix, float))
    values = np.abs(values)
    order = np.argsort(-values, kind="stable")
    return values[order].reshape(-1, 1), canonical_signs(vectors[:, order])


def spectral_gap_dim(evals: np.ndarray) -> int:
    """Number of eigenvalues before the widest gap; of equal gaps the first."""
    values = np.ravel(evals)
    if len(values) < 2:
        return len(values)
    return int(np.argmax(values[:-1] - values[1:])) + 1


def residual_energy_index(evals: np.ndarray, share: float = 0.99) -> int:
    """First index whose cumulative share of squared eigenvalues reaches `share` (0-based)."""
    energy = np.ravel(evals) ** 2
    return int(np.searchsorted(np.cumsum(energy / energy.sum()), share))


def residual_energy_dim(evals: np.ndarray, share: float = 0.99) -> int:
    """How many eigenvalues hold `share` of the squared spectrum."""
    return min(len(np.ravel(evals)), residual_energy_index(evals, share) + 1)


def choose_dim(dim: int | float, evals: np.ndarray | None) -> int:
    """0: spectral gap; a share in (0, 1): residual energy; a positive int: itself."""
    if isinstance(dim, bool) or not isinstance(dim, (int, float)):
        raise ValueError("dim is a number")
    if isinstance(dim, int) and dim >= 1:
        return dim
    automatic = isinstance(dim, int) and dim == 0 or isinstance(dim, float) and 0 < dim < 1
    if not automatic:
        raise ValueError("dim is 0, a share between 0 and 1, or a positive int")
    if evals is None:
        raise ValueError("the spectrum is needed to choose a dimension")
    return spectral_gap_dim(evals) if dim == 0 else residual_energy_dim(evals, dim)


def split(vectors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Active and inactive columns; the inactive ones are None where the basis is not complete."""
    if not isinstance(dim, (int, np.integer)) or isinstance(dim, bool):
        raise TypeError("dim is an int")
    rows, cols = vectors.shape
    if cols > rows:
        raise ValueError("more vectors than parameters")
    if not 0 <= dim <= cols:
        raise ValueError(f"dim is between 0 and {cols}")
    return vectors[:, :dim], vectors[:, dim:] if rows == cols else None


def complement(active: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what is orthogonal to the columns."""
    rows, cols = active.shape
    q, _ = np.linalg.qr(active, mode="complete")
    return q[:, cols:] if cols < rows else np.empty((rows, 0))


def cumulative_dim(evals: np.ndarray, max_dim: int, share: float = 0.95) -> int:
    """Smallest dimension up to max_dim whose share of the eigenvalues reaches `share`, else max_dim."""
    values = np.ravel(evals)
    enough = np.flatnonzero(np.cumsum(values[:max_dim]) >= share * values.sum())
    return int(enough[0]) + 1 if len(enough) else max_dim


def gap_dim(evals: np.ndarray, max_dim: int) -> int:
    """Dimension before the widest of the first max_dim gaps."""
    values = np.ravel(evals)
    if max_dim >= len(values):
        raise AssertionError("max_dim is below the number of parameters")
    return int(np.argmax(values[:max_dim] - values[1 : max_dim + 1])) + 1


def sqrt_pair(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric square root of a covariance, and its pseudo-inverse."""
    values, vectors = np.linalg.eigh(np.atleast_2d(cov))
    root = np.sqrt(np.clip(values, 0, None))
    inverse = np.divide(1.0, root, out=np.zeros_like(root), where=root > 1e-12 * max(root.max(), 1e-300))
    return (vectors * root) @ vectors.T, (vectors * inverse) @ vectors.T


def prefers_randomized(n: int, p: int, dim: int | float) -> bool:
    """Whether a randomized SVD of an n x p matrix costs less than the exact one; only for large matrices and a set dim."""
    if not isinstance(dim, int) or dim < 1 or max(n, p) <= 10_000:
        return False
    return n * p * dim > n * p * np.log(dim) + (n + p) * dim**2


def randomized_svd(matrix: np.ndarray, dim: int, oversample: int = 10, power: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right vectors by a random range finder with power iterations."""
    rng = np.random.default_rng(seed)
    width = min(dim + oversample, *matrix.shape)
    q = np.linalg.qr(matrix @ rng.standard_normal((matrix.shape[1], width)))[0]
    for _ in range(power):
        q = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ q)[0])[0]
    _, sigma, vt = np.linalg.svd(q.T @ matrix, full_matrices=False)
    return sigma[:dim], canonical_signs(vt[:dim].T)


def linear_program(c: np.ndarray, a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Minimises c.x subject to a x >= b with free x. RuntimeError if infeasible or unbounded.

    Two-phase simplex on the standard form x = u - v, a(u - v) - s = b, with Bland's rule, so it cannot cycle.
    """
    a, b, c = np.atleast_2d(np.asarray(a, float)), np.ravel(b).astype(float), np.ravel(c).astype(float)
    m, n = a.shape
    body = np.hstack([a, -a, -np.eye(m)])
    sign = np.where(b < 0, -1.0, 1.0)
    body, rhs = body * sign[:, None], b * sign
    width = 2 * n + m
    table = np.hstack([body, np.eye(m), rhs[:, None]])
    basis = list(range(width, width + m))

    def pivots(cost: np.ndarray, allowed: int) -> None:
        for _ in range(20_000):
            reduced = cost[:allowed] - cost[basis] @ table[:, :allowed]
            enter = next((j for j in range(allowed) if reduced[j] < -tol), None)
            if enter is None:
                return
            column = table[:, enter]
            rows = np.flatnonzero(column > tol)
            if not len(rows):
                raise RuntimeError("the linear program is unbounded")
            ratio = table[rows, -1] / column[rows]
            ties = rows[ratio <= ratio.min() + tol]
            leave = min(ties, key=lambda r: basis[r])
            table[leave] /= table[leave, enter]
            for r in range(m):
                if r != leave:
                    table[r] -= table[r, enter] * table[leave]
            basis[leave] = enter
        raise RuntimeError("the linear program did not end")

    pivots(np.concatenate([np.zeros(width), np.ones(m)]), width + m)
    if sum(table[r, -1] for r in range(m) if basis[r] >= width) > 1e-7:
        raise RuntimeError("the linear program is infeasible")
    for r in range(m):  # artificial variables at zero leave the basis where a pivot exists
        if basis[r] >= width:
            col = next((j for j in range(width) if abs(table[r, j]) > 1e-8), None)
            if col is not None:
                table[r] /= table[r, col]
                for q in range(m):
                    if q != r:
                        table[q] -= table[q, col] * table[r]
                basis[r] = col
    pivots(np.concatenate([c, -c, np.zeros(m), np.full(m, 1e30)]), width)
    x = np.zeros(width + m)
    x[basis] = table[:, -1]
    return x[:n] - x[n : 2 * n]
