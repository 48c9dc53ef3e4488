"""Kernel-based active subspaces: active directions among random features instead of the parameters themselves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.functions.linalg import sorted_eigenpairs
from gradlens.operators.active import Subspace
from gradlens.operators.bootstrap import matrices_of, ranges, replicate_counts
from gradlens.operators.features import FeatureMap


def as_jacobians(g) -> np.ndarray:
    """(rows, outputs, m) from gradients or Jacobians."""
    a = np.array([np.array([np.asarray(r, float) for r in x]) if np.ndim(x[0]) else np.asarray(x, float)[None] for x in g])
    return a


def pseudo_gradients(jacobian: np.ndarray, gradients: np.ndarray) -> np.ndarray:
    """Minimum-norm gradients in feature space: J' g~ = g for each row. (n, D, m), (n, outputs, m) -> (n, outputs, D)."""
    return np.einsum("ndm,nom->nod", np.linalg.pinv(np.transpose(jacobian, (0, 2, 1))), gradients)


@dataclass
class KernelActiveSubspaces(Subspace):
    feature_map: FeatureMap | None = None
    n_features: int | None = None
    n_boot: int | None = None
    #: Rows that the bootstrap draws from, at most: those whose ids hash lowest.
    boot_rows: int = 5000

    def fit(self, df: DataFrame, x_col: str = "x", g_col: str = "g", weight_col: str | None = None, metric: np.ndarray | None = None, seed: int = 42) -> KernelActiveSubspaces:
        """Jacobian of the features, pseudo-gradients and their moments in one pass over the rows; only D x D sums move."""
        if self.n_boot and self.n_boot > 50:
            raise ValueError("n_boot is at most 50 here")
        missing = [c for c in (x_col, g_col) if c not in df.columns]
        if missing:
            raise TypeError(f"inputs and gradients are needed: {missing}")
        m = len(df.select(x_col).head()[0])
        self.n_features = self.n_features or (self.feature_map.n_features if self.feature_map else m)
        if self.feature_map is None:
            self.feature_map = FeatureMap("multivariate_normal", np.ones((1, self.n_features)), m, self.n_features, np.ones(m), 1.0, seed=seed)
        fm = self.feature_map
        fm.matrix  # drawn here, not on the executors
        w, size = F.col(weight_col) if weight_col else F.lit(1.0), self.n_features

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            d, n = size, 0
            total = np.zeros((d, d))
            for pdf in frames:
                if len(pdf):
                    g = pseudo_gradients(fm.jacobian(np.array(pdf["x"].tolist(), float)), as_jacobians(pdf["g"]))
                    r = np.eye(g.shape[1]) if metric is None else np.asarray(metric, float)
                    total += np.einsum("n,nai,ac,ncj->ij", pdf["w"].to_numpy(), g, r, g, optimize=True)
                    n += len(pdf)
            yield pd.DataFrame({"at": np.arange(d * d + 1), "v": np.append(total.ravel(), n)})

        rows = df.select(F.col(x_col).alias("x"), F.col(g_col).alias("g"), w.cast("double").alias("w"))
        sums = rows.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
        total, n = sums[:-1].reshape(self.n_features, self.n_features), sums[-1]
        evals, evects = sorted_eigenpairs(total if weight_col else total / n)
        if self.n_boot:
            known = [F.xxhash64("row_id")] if "row_id" in df.columns else []
            few = df.orderBy(*known, F.xxhash64(x_col), x_col).limit(self.boot_rows).select(F.col(x_col).alias("x"), F.col(g_col).alias("g"), w.cast("double").alias("w")).toPandas()
            g = pseudo_gradients(fm.jacobian(np.array(few["x"].tolist(), float)), as_jacobians(few["g"]))
            weights = few["w"].to_numpy() if weight_col else np.full(len(few), 1.0 / len(few))
            self.evals_br, self.subs_br = ranges(matrices_of(g, weights, replicate_counts(len(few), self.n_boot, seed), metric), evects)
        return self.set_spectrum(evals, evects)

    def transform(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        """df with `active` and `inactive` coordinates of the features."""
        self.require_fit()
        fm, w1, w2 = self.feature_map, self.W1, self.W2

        @F.pandas_udf("struct<active:array<double>,inactive:array<double>>")
        def reduced(x: pd.Series) -> pd.DataFrame:
            phi = fm.features(np.array(x.tolist(), float))
            return pd.DataFrame({"active": (phi @ w1).tolist(), "inactive": (phi @ w2).tolist() if w2 is not None else [None] * len(phi)})

        return df.withColumn("_r", reduced(x_col)).select("*", "_r.active", "_r.inactive").drop("_r")

    def inverse_transform(self, *args, **kwargs):
        raise NotImplementedError("features have no inverse map")
