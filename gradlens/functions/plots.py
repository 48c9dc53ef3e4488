"""What plots of a model show, as DataFrames: any front end can draw them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradlens.functions.exprs import project


def eigenvalue_data(model, spark: SparkSession, n: int | None = None) -> DataFrame:
    """idx (from 1), eval, lo, hi. TypeError if there are fewer than n."""
    model.require_fit()
    n = n or len(model.evals)
    if n > len(model.evals):
        raise TypeError(f"there are {len(model.evals)} eigenvalues")
    band = model.evals_br
    rows = [(i + 1, float(model.evals[i, 0]), float(band[i, 0]) if band is not None else None, float(band[i, 1]) if band is not None else None) for i in range(n)]
    return spark.createDataFrame(rows, "idx int, eval double, lo double, hi double")


def eigenvector_data(model, spark: SparkSession, n: int | None = None, labels: list[str] | None = None) -> DataFrame:
    """evect (from 1), param, component. ValueError if there are fewer than n."""
    model.require_fit()
    n = n or model.dim
    if n > model.evects.shape[1]:
        raise ValueError(f"there are {model.evects.shape[1]} eigenvectors")
    names = labels or [f"x{i}" for i in range(model.evects.shape[0])]
    rows = [(j + 1, names[i], float(model.evects[i, j])) for j in range(n) for i in range(len(names))]
    return spark.createDataFrame(rows, "evect int, param string, component double")


def summary_data(model, df: DataFrame, x_col: str = "x", f_col: str = "f") -> DataFrame:
    """y0 [, y1], f: outputs along one or two active variables; ValueError for more."""
    model.require_fit()
    if model.dim not in (1, 2):
        raise ValueError("one or two active variables are plotted")
    reduced = model.transform(df, x_col) if getattr(model, "feature_map", None) else df.withColumn("active", project(x_col, model.W1))
    return reduced.select(*[F.get("active", F.lit(i)).alias(f"y{i}") for i in range(model.dim)], F.col(f_col).alias("f"))


def subspace_error_data(model, spark: SparkSession) -> DataFrame:
    """dim, lo, mean, hi of the bootstrap distances."""
    model.require_fit()
    rows = [(j + 1, *map(float, r)) for j, r in enumerate(model.subs_br if model.subs_br is not None else [])]
    return spark.createDataFrame(rows, "dim int, lo double, mean double, hi double")


def cluster_score_data(spark: SparkSession, clusters: list[int], scores: list[tuple[float, float, float, float]]) -> DataFrame:
    """clusters, r2_full, r2_local, mae_full, mae_local and the reductions in percent."""
    df = spark.createDataFrame([(c, *map(float, s)) for c, s in zip(clusters, scores)], "clusters int, r2_full double, r2_local double, mae_full double, mae_local double")
    return df.withColumn("mae_reduction", (F.col("mae_full") - F.col("mae_local")) * 100 / F.col("mae_full")).withColumn("r2_reduction", (F.col("r2_local") - F.col("r2_full")) * 100 / F.col("r2_full"))
