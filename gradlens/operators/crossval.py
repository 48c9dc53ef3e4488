"""Cross validation of subspace and response surface, and tuning of feature maps by it.

Folds are a column (a hash of the row's key), so all folds of a fit read the same table; a response surface is
fitted on at most `surface_rows` rows of a fold, since a Gaussian process costs the cube of its rows. Errors are over
every validation row: predictions are an Arrow UDF and their sums SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.functions.metrics import rrmse
from gradlens.operators.gp import FixedGP
from gradlens.operators.kernel import KernelActiveSubspaces


def with_folds(df: DataFrame, folds: int, id_col: str = "row_id", seed: int | None = 42) -> DataFrame:
    """fold in 0..folds-1, from the key alone: its hash, or (seed None) the key modulo folds."""
    if seed is None:
        return df.withColumn("fold", F.pmod(F.col(id_col), F.lit(folds)).cast("int"))
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)).cast("int"))


@dataclass
class CrossValidation:
    df: DataFrame
    subspace: Any
    folds: int = 5
    id_col: str = "row_id"
    seed: int = 42
    surface_rows: int = 2000

    def __post_init__(self) -> None:
        if self.df is None or self.subspace is None:
            raise ValueError("rows and a subspace are needed")
        missing = [c for c in ("x", "f", "g", self.id_col) if c not in self.df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")

    def fit(self, train: DataFrame) -> CrossValidation:
        self.subspace.fit(train)
        self.surface = FixedGP().fit(*self._sample(train))
        return self

    def _sample(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        few = df.orderBy(F.xxhash64(self.id_col), self.id_col).limit(self.surface_rows)
        pdf = self.subspace.transform(few).select("active", "f").toPandas()
        return np.array(pdf["active"].tolist(), float), np.array(pdf["f"].tolist(), float).reshape(len(pdf), -1)

    def predict(self, df: DataFrame) -> DataFrame:
        """f and prediction of every row."""
        surface, many = self.surface, dict(df.dtypes)["f"].startswith("array")

        def run(y: pd.Series) -> pd.Series:
            out = surface.predict(np.array(y.tolist(), float))
            return pd.Series(out.tolist() if many else out[:, 0])

        return self.subspace.transform(df).select("f", F.pandas_udf(run, "array<double>" if many else "double")("active").alias("prediction"))

    def score(self, df: DataFrame) -> float:
        return rrmse(self.predict(df), "prediction", "f")

    def run(self) -> tuple[float, float]:
        """Mean and standard deviation of the folds' errors."""
        rows = with_folds(self.df, self.folds, self.id_col, self.seed).persist()
        errors = []
        for k in range(self.folds):
            self.fit(rows.filter(F.col("fold") != k))
            errors.append(self.score(rows.filter(F.col("fold") == k)))
        rows.unpersist()
        return float(np.mean(errors)), float(np.std(errors))


def mirrored_folds(n: int, folds: int, rng: np.random.RandomState):
    """(train, validation) positions by a known convention: the training rows mirror the validation rows."""
    order = np.arange(n)
    rng.shuffle(order)
    for v in np.array_split(order, folds):
        yield -v - 1, v


def average_rrmse(log_params, cv: CrossValidation, best: list, resample: int = 5, give_up: float = 0.8, log_path: str | None = None) -> float:
    """Least mean error over fresh draws of the feature matrix with params 10 ** log_params.

    Stops at a draw whose error exceeds give_up; best = [score, matrix] is kept up to date. log_path: a file of the driver
    that gets a line (params, mean, standard deviation) a draw.
    """
    fm = cv.subspace.feature_map
    fm.params = 10.0 ** np.atleast_1d(log_params)
    least = np.inf
    for _ in range(resample):
        fm.matrix = fm.draw()
        model = KernelActiveSubspaces(dim=cv.subspace.dim, feature_map=fm, n_features=fm.n_features)
        mean, std = CrossValidation(cv.df, model, cv.folds, cv.id_col, cv.seed, cv.surface_rows).run()
        if log_path:
            with open(log_path, "a", encoding="utf-8") as log:
                log.write(",".join(map(repr, [*map(float, fm.params), mean, std])) + "\n")
        least = min(least, mean)
        if mean <= best[0]:
            best[0], best[1] = mean, fm.matrix.copy()
        if mean > give_up:
            break
    return least
