"""Second moments of gradients: C = sum of w g g^T, or of w J^T R J for vector outputs.

The strategy depends on the number of parameters only. Few: one SQL aggregate per matrix entry, map-side combined and
in generated code. Many: each partition adds up its own matrix in NumPy and Spark sums the partial matrices by
entry. Very many: a deterministic sketch (frequent directions) per partition, merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradlens.functions.linalg import canonical_signs, randomized_svd, sorted_eigenpairs

#: Parameters up to which the matrix is a set of SQL aggregates.
SQL_PARAMETERS = 24
#: Parameters up to which the whole matrix is formed.
DENSE_PARAMETERS = 3000


def width(df: DataFrame, column: str) -> int:
    row = df.select(F.size(column)).head()
    if row is None:
        raise ValueError("no rows")
    return row[0]


def entries(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def moment_aggregates(column: str, m: int, weight: Column | None = None) -> list[Column]:
    """Aggregates c_i_j of the upper triangle: averages, or weighted sums."""
    out = []
    for i, j in entries(m):
        product = F.get(column, F.lit(i)) * F.get(column, F.lit(j))
        out.append((F.avg(product) if weight is None else F.sum(weight * product)).alias(f"c_{i}_{j}"))
    return out


def from_row(row, m: int) -> np.ndarray:
    out = np.zeros((m, m))
    for i, j in entries(m):
        out[i, j] = out[j, i] = row[f"c_{i}_{j}"] or 0.0
    return out


def moment_matrix(df: DataFrame, column: str = "g", weight: str | None = None, metric: np.ndarray | None = None) -> np.ndarray:
    """The moment matrix of scalar gradients (array) or Jacobians (array of arrays, with an optional output metric).

    Without weights every row counts 1/n. Rows whose gradient is null are left out.
    """
    df = df.filter(F.col(column).isNotNull())
    nested = df.schema[column].dataType.simpleString().startswith("array<array")
    m = width(df.select(F.get(column, F.lit(0)).alias(column)) if nested else df, column)
    if not nested and m <= SQL_PARAMETERS:
        return from_row(df.agg(*moment_aggregates(column, m, F.col(weight) if weight else None)).head(), m)
    w = F.col(weight) if weight else F.lit(1.0)
    total, rows = _dense(df.select(F.col(column).alias("g"), w.cast("double").alias("w")), m, metric)
    return total if weight else total / max(rows, 1)


def _dense(df: DataFrame, m: int, metric: np.ndarray | None) -> tuple[np.ndarray, int]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((m, m)), 0
        for pdf in frames:
            if not len(pdf):
                continue
            g = np.array([np.array([np.asarray(r, float) for r in x]) if metric is not None or _is_nested(x) else np.asarray(x, float) for x in pdf["g"]])
            w = pdf["w"].to_numpy()
            if g.ndim == 2:
                total += (g * w[:, None]).T @ g
            else:
                r = np.eye(g.shape[1]) if metric is None else metric
                total += np.einsum("n,nai,ab,nbj->ij", w, g, r, g, optimize=True)
            n += len(pdf)
        if n:
            yield pd.DataFrame({"at": np.arange(m * m + 1), "v": np.append(total.ravel(), n)})

    # The sum is by entry, so what reaches the driver is one matrix, whatever the number of partitions.
    rows = df.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    if not len(rows):
        raise ValueError("no rows")
    v = rows["v"].to_numpy()
    return v[:-1].reshape(m, m), int(v[-1])


def _is_nested(x) -> bool:
    return len(x) > 0 and np.ndim(x[0]) > 0


def grouped_moments(df: DataFrame, group: str, column: str = "g", m: int | None = None) -> DataFrame:
    """One row a group with n and the averages c_i_j: all groups' matrices in a single aggregation."""
    m = m or width(df, column)
    return df.groupBy(group).agg(F.count("*").alias("n"), *moment_aggregates(column, m))


def eigenpairs(df: DataFrame, column: str = "g", weight: str | None = None, metric: np.ndarray | None = None, n_rows: int | None = None, randomized_dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (a column) and vectors of the moment matrix; no more pairs than rows for scalar gradients.

    randomized_dim: only the leading pairs, by a randomized decomposition of the moment matrix.
    """
    matrix = moment_matrix(df, column, weight, metric)
    if randomized_dim:
        sigma, vectors = randomized_svd(matrix, randomized_dim)
        return sigma.reshape(-1, 1), vectors
    values, vectors = sorted_eigenpairs(matrix)
    if metric is None and not df.schema[column].dataType.simpleString().startswith("array<array"):
        n = n_rows if n_rows is not None else df.limit(len(matrix)).count()
        values, vectors = values[: min(n, len(matrix))], vectors[:, : min(n, len(matrix))]
    return values, vectors


class FrequentDirections:
    """A sketch B of `size` rows of a stream of rows G, with |G^T G - B^T B| <= |G|_F^2 / size. Sketches merge."""

    def __init__(self, size: int, m: int) -> None:
        self.size, self.m = size, m
        self.buffer = np.zeros((2 * size, m))
        self.used = 0

    def add(self, rows: np.ndarray) -> FrequentDirections:
        for r in np.atleast_2d(np.asarray(rows, float)):
            if self.used == len(self.buffer):
                self._shrink()
            self.buffer[self.used] = r
            self.used += 1
        return self

    def _shrink(self) -> None:
        _, s, vt = np.linalg.svd(self.buffer[: self.used], full_matrices=False)
        low = s[self.size - 1] ** 2 if len(s) >= self.size else 0.0
        s = np.sqrt(np.clip(s[: self.size] ** 2 - low, 0, None))
        self.buffer[:] = 0
        self.buffer[: len(s)] = s[:, None] * vt[: len(s)]
        self.used = min(self.size - 1, len(s)) if low else len(s)

    def merge(self, other: FrequentDirections) -> FrequentDirections:
        return self.add(other.rows())

    def rows(self) -> np.ndarray:
        return self.buffer[: self.used]

    def eigenpairs(self) -> tuple[np.ndarray, np.ndarray]:
        _, s, vt = np.linalg.svd(self.rows(), full_matrices=False)
        k = min(self.size, len(s))
        return (s[:k] ** 2).reshape(-1, 1), canonical_signs(vt[:k].T)


def classic_frequent_directions(rows, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-at-a-time variant: every new row replaces the smallest direction; the last row is not decomposed any more."""
    stream = iter(rows)
    sketch = np.array([next(stream) for _ in range(size)], float)
    values = np.zeros(size)
    vectors = np.zeros((sketch.shape[1], 0))
    for row in stream:
        _, s, vt = np.linalg.svd(sketch, full_matrices=False)
        values, vectors = s**2, vt.T
        sketch = np.sqrt(np.clip(s**2 - s[-1] ** 2, 0, None))[:, None] * vt
        sketch[-1] = row
    return values.reshape(-1, 1), canonical_signs(vectors)


def sketch(df: DataFrame, size: int, column: str = "g", fan: int = 16) -> FrequentDirections:
    """Sketches of the partitions, merged in rounds of `fan` by Spark until few are left; each is size x m numbers."""
    m = width(df, column)
    schema = "at long, b array<array<double>>"

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fd = FrequentDirections(size, m)
        for pdf in frames:
            if len(pdf):
                fd.add(np.array(pdf["g"].tolist(), float))
        if fd.used:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "b": [fd.rows().tolist()]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fd = FrequentDirections(size, m)
        for b in pdf["b"]:
            fd.add(np.array([np.asarray(r) for r in b]))
        return pd.DataFrame({"at": [pdf["at"].iloc[0] // fan], "b": [fd.rows().tolist()]})

    out = df.select(F.col(column).alias("g")).mapInPandas(first, schema)
    parts = df.rdd.getNumPartitions()
    while parts > fan:
        out = out.groupBy(F.expr(f"at div {fan}")).applyInPandas(join, schema)
        parts = -(-parts // fan)
    fd = FrequentDirections(size, m)
    for r in out.collect():  # at most `fan` sketches
        fd.add(np.array(r["b"], float))
    return fd
