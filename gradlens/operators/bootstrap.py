"""Bootstrap ranges of eigenvalues and subspace errors.

Drawing rows with replacement is counting rows: a replica's moment matrix is the count-weighted one. One pass draws the
counts of all replicas for each row and adds up all their matrices; the driver decomposes `replicas` small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.functions.linalg import sorted_eigenpairs


def replicate_counts(n: int, replicas: int, seed: int) -> np.ndarray:
    """(replicas, n) multiplicities of n draws with replacement."""
    rng = np.random.RandomState(seed)
    return np.array([np.bincount(rng.randint(n, size=n), minlength=n) for _ in range(replicas)])


#: Distribution function of Poisson(1) at 0, 1, ..
POISSON = np.cumsum([np.exp(-1.0) / factorial(k) for k in range(20)])


def poisson_counts(keys: np.ndarray, replicas: int, seed: int) -> np.ndarray:
    """(replicas, rows) Poisson(1) draws that depend on nothing but the row's key, the replica and the seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[None] + (np.arange(1, replicas + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)) * 2.0**-53, "right").astype(float)


def matrices_of(gradients: np.ndarray, weights: np.ndarray, counts: np.ndarray, metric: np.ndarray | None = None) -> np.ndarray:
    """Moment matrices by replica from rows in memory."""
    if gradients.ndim == 2:
        return np.einsum("bn,n,ni,nj->bij", counts, np.ravel(weights), gradients, gradients, optimize=True)
    r = np.eye(gradients.shape[1]) if metric is None else metric
    return np.einsum("bn,n,nai,ac,ncj->bij", counts, np.ravel(weights), gradients, r, gradients, optimize=True)


def ranges(matrices: np.ndarray, reference: np.ndarray, keep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(k, 2) least and largest eigenvalues; (k - 1, 3) least, mean and largest distance of the leading subspaces."""
    k = keep or reference.shape[1]
    values, errors = [], []
    for c in matrices:
        e, w = sorted_eigenpairs(c)
        values.append(e[:k, 0])
        errors.append([np.linalg.norm(reference[:, :j].T @ w[:, j:k], 2) for j in range(1, k)])
    values, errors = np.array(values), np.array(errors).reshape(len(matrices), k - 1)
    return np.column_stack([values.min(0), values.max(0)]), np.column_stack([errors.min(0), errors.mean(0), errors.max(0)])


def row_key(df: DataFrame, id_col: str):
    """A 64-bit key of the row's id: the number itself, or a hash of what is no number."""
    return F.col(id_col).cast("long") if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(id_col)


def bootstrap(df: DataFrame, reference: np.ndarray, column: str = "g", weight: str | None = None, replicas: int = 100, seed: int = 42, id_col: str = "row_id", metric: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bootstrap ranges with Poisson(1) counts, which need no global draw and are seeded by the row's id, so that a rerun of a lost task repeats them.

    Rows are told apart by id_col alone: rows with equal gradients are drawn independently, and ValueError says that there
    is no such column. Gradients of vector outputs (arrays of arrays) count by `metric`. Each replica is normalised by
    its own number of draws where rows have no weights.
    """
    if id_col not in df.columns:
        raise ValueError(f"the bootstrap tells rows apart by {id_col}, which is missing")
    nested = dict(df.dtypes)[column].startswith("array<array")
    m = reference.shape[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, drawn = np.zeros((replicas, m, m)), np.zeros(replicas)
        rows, cols = np.triu_indices(m)
        for pdf in frames:
            for at in range(0, len(pdf), 8192):
                part = pdf.iloc[at : at + 8192]
                if nested:
                    g = np.array([np.array([np.asarray(v, float) for v in r]) for r in part["g"]])
                    r = np.eye(g.shape[1]) if metric is None else np.asarray(metric, float)
                    products = np.einsum("nai,ac,ncj->nij", g, r, g, optimize=True)[:, rows, cols]
                else:
                    g = np.array(part["g"].tolist(), float)
                    products = g[:, rows] * g[:, cols]
                counts = poisson_counts(part["k"].to_numpy(), replicas, seed)
                total[:, rows, cols] += (counts * part["w"].to_numpy()) @ products
                drawn += counts.sum(1)
        total[:, cols, rows] = total[:, rows, cols]
        yield pd.DataFrame({"at": np.arange(replicas * (m * m + 1)), "v": np.concatenate([total.ravel(), drawn])})

    rows = df.select(F.col(column).alias("g"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), row_key(df, id_col).alias("k")).mapInPandas(run, "at int, v double")
    v = rows.groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
    matrices = v[: replicas * m * m].reshape(replicas, m, m)
    if not weight:
        matrices = matrices / np.maximum(v[replicas * m * m :], 1)[:, None, None]
    return ranges(matrices, reference)
