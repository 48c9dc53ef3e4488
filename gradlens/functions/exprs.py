"""Row-wise operators as Column expressions: they stay in generated code and never leave the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many terms an expression is written out term by term; longer ones go over literal arrays.
UNROLL = 64


def array_of(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.ravel(values)])


def dot(column: str | Column, weights: Sequence[float], size: int | None = None) -> Column:
    """Sum of array elements times fixed weights."""
    c = F.col(column) if isinstance(column, str) else column
    w = np.ravel(weights)
    if len(w) <= UNROLL:
        out = F.lit(0.0)
        for i, v in enumerate(w):
            out = out + F.get(c, F.lit(i)) * F.lit(float(v))
        return out
    return F.aggregate(F.zip_with(c, array_of(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def project(column: str | Column, matrix: np.ndarray) -> Column:
    """The row vector times a (parameters, k) matrix, as an array of k."""
    return F.array(*[dot(column, matrix[:, j]) for j in range(matrix.shape[1])])


@dataclass(frozen=True)
class Normalizer:
    """Maps a box to [-1, 1] in each parameter, and back."""

    lower: tuple[float, ...]
    upper: tuple[float, ...]

    @classmethod
    def of(cls, lower, upper) -> Normalizer:
        return cls(tuple(float(v) for v in np.ravel(lower)), tuple(float(v) for v in np.ravel(upper)))

    @classmethod
    def fit(cls, df: DataFrame, column: str = "x") -> Normalizer:
        """Bounds of the data in one aggregation."""
        width = df.select(F.size(column)).head()
        if width is None:
            raise ValueError("no rows")
        m = width[0]
        row = df.agg(*[F.min(F.get(column, F.lit(i))).alias(f"l{i}") for i in range(m)], *[F.max(F.get(column, F.lit(i))).alias(f"u{i}") for i in range(m)]).head()
        return cls.of([row[f"l{i}"] for i in range(m)], [row[f"u{i}"] for i in range(m)])

    def forward(self, column: str | Column = "x") -> Column:
        """2 (x - lower) / (upper - lower) - 1; null where a parameter has no range."""
        c = F.col(column) if isinstance(column, str) else column
        return F.array(*[F.try_divide(2.0 * (F.get(c, F.lit(i)) - F.lit(a)), F.lit(b - a)) - 1.0 for i, (a, b) in enumerate(zip(self.lower, self.upper))])

    def inverse(self, column: str | Column = "x") -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return F.array(*[F.lit(b - a) * (F.get(c, F.lit(i)) + 1.0) / 2.0 + F.lit(a) for i, (a, b) in enumerate(zip(self.lower, self.upper))])

    def gradient(self, column: str | Column = "g") -> Column:
        """Gradients with respect to the normalised parameters."""
        c = F.col(column) if isinstance(column, str) else column
        return F.array(*[F.get(c, F.lit(i)) * F.lit((b - a) / 2.0) for i, (a, b) in enumerate(zip(self.lower, self.upper))])

    def forward_np(self, x: np.ndarray) -> np.ndarray:
        lo, hi = np.array(self.lower), np.array(self.upper)
        return 2.0 * (np.asarray(x) - lo) / (hi - lo) - 1.0

    def inverse_np(self, x: np.ndarray) -> np.ndarray:
        lo, hi = np.array(self.lower), np.array(self.upper)
        return (hi - lo) * (np.asarray(x) + 1.0) / 2.0 + lo


def rff_map(column: str | Column, weights: np.ndarray, bias: np.ndarray, sigma_f: float = 1.0) -> Column:
    """Random Fourier features sqrt(2/D) sigma cos(W x + b)."""
    d, b = len(weights), np.ravel(bias)
    return F.array(*[F.lit(float(np.sqrt(2.0 / d) * sigma_f)) * F.cos(dot(column, weights[k]) + F.lit(float(b[k % len(b)]))) for k in range(d)])


def rff_jacobian(column: str | Column, weights: np.ndarray, bias: np.ndarray, sigma_f: float = 1.0) -> Column:
    """Jacobian of rff_map, an array of D rows of m."""
    d, b = len(weights), np.ravel(bias)
    rows = []
    for k in range(d):
        slope = F.lit(float(-np.sqrt(2.0 / d) * sigma_f)) * F.sin(dot(column, weights[k]) + F.lit(float(b[k % len(b)])))
        rows.append(F.array(*[slope * F.lit(float(w)) for w in weights[k]]))
    return F.array(*rows)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def weighted_square(column: str | Column, weights: np.ndarray) -> Column:
    """Squared length after scaling each coordinate."""
    c = F.col(column) if isinstance(column, str) else column
    return sum((F.get(c, F.lit(i)) * F.lit(float(w))) ** 2 for i, w in enumerate(np.ravel(weights)))
