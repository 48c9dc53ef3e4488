"""Regression scores as SQL aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rrmse(df: DataFrame, predicted: str, target: str) -> float:
    """Frobenius norm of the error over that of the centred targets; for number or array columns. One aggregation."""
    if dict(df.dtypes)[target].startswith("array"):
        rows = df.select(F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"))).alias("at", "v")).select("at", F.col("v.p").alias("p"), F.col("v.t").alias("t"))
        parts = rows.groupBy("at").agg(F.sum((F.col("p") - F.col("t")) ** 2).alias("e"), (F.count("t") * F.var_pop("t")).alias("s")).agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    else:
        parts = df.agg(F.sum((F.col(predicted) - F.col(target)) ** 2).alias("e"), (F.count(target) * F.var_pop(target)).alias("s"))
    r = parts.head()
    return float(np.sqrt(r["e"] / r["s"]))


def rrmse_np(predictions: np.ndarray, targets: np.ndarray) -> float:
    p, t = np.asarray(predictions, float), np.asarray(targets, float)
    if len(p) != len(t):
        raise ValueError("as many predictions as targets")
    p = p.reshape(t.shape)
    return float(np.linalg.norm(p - t) / np.linalg.norm(t - t.mean(0)))


def r2_expr(predicted: str, target: str) -> Column:
    return 1.0 - F.sum((F.col(target) - F.col(predicted)) ** 2) / (F.count(target) * F.var_pop(target))


def mae_expr(predicted: str, target: str) -> Column:
    return F.avg(F.abs(F.col(target) - F.col(predicted)))


def scores(df: DataFrame, full: str, local: str, target: str) -> DataFrame:
    """r2_full, r2_local, mae_full, mae_local in one row."""
    return df.agg(r2_expr(full, target).alias("r2_full"), r2_expr(local, target).alias("r2_local"), mae_expr(full, target).alias("mae_full"), mae_expr(local, target).alias("mae_local"))
