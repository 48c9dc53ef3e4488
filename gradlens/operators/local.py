"""Local active subspaces: cluster the rows, then one subspace and one response surface a cluster."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.functions.linalg import cumulative_dim, gap_dim, sorted_eigenpairs, sqrt_pair
from gradlens.functions.metrics import scores
from gradlens.operators.gp import GP
from gradlens.operators.moments import SQL_PARAMETERS, from_row, grouped_moments
from gradlens.operators.neighbors import local_linear_gradients


#: Groups whose normalisers (vectors, and matrices up to SQL_PARAMETERS) go to every task; with more, rows and normalisers meet by group.
BROADCAST_GROUPS = 10_000
#: Rows of a partition that is kept in memory, about: files are cut by bytes, and a kept row is far larger than its part of a file.
PART_ROWS = 1_000_000


@dataclass
class ClusterConfig:
    max_clusters: int = 4
    as_dim: int = 1
    #: Rows of a cluster that its response surface is fitted on, at most.
    surface_rows: int = 500
    restarts: int = 2
    seed: int = 0


@dataclass
class LocalModel:
    label: int
    n: int
    evals: np.ndarray
    evects: np.ndarray
    dim: int
    surface: GP | None = None

    def reduce(self, x: np.ndarray) -> np.ndarray:
        return x @ self.evects[:, : self.dim]


def by_row() -> list:
    """Order of samples: by a hash of the row's key. By one of x, a sample would be the rows of a single x where these are many."""
    return [F.xxhash64("row_id"), "row_id", "x"]


def _with_groups(df: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """df joined with a row a group. Few groups hold many rows each, so these stay where they are."""
    known = known.persist()
    if known.count() <= BROADCAST_GROUPS:
        return df.join(F.broadcast(known), group)
    known.unpersist()
    return df.join(known, group)


def spread(df: DataFrame, by: str = "row_id") -> DataFrame:
    """df in partitions of about PART_ROWS rows; as it is where the cores alone make them so small."""
    n = -(-df.count() // PART_ROWS)
    return df.repartition(n, by) if n > df.sparkSession.sparkContext.defaultParallelism else df


def group_normalize(df: DataFrame, kind: str, group: str = "label", x_col: str = "x", g_col: str = "g") -> DataFrame:
    """x and g normalised within each group: `uniform` by its box, `gaussian` by mean and covariance, `root` as they are."""
    if kind == "root":
        return df
    if kind not in ("uniform", "gaussian"):
        raise ValueError(f"no normaliser {kind}")
    m = len(df.select(x_col).head()[0])
    at = lambda i: F.get(x_col, F.lit(i))
    if kind == "uniform":
        box = df.groupBy(group).agg(F.array(*[F.min(at(i)) for i in range(m)]).alias("_lo"), F.array(*[F.max(at(i)) for i in range(m)]).alias("_hi"))
        out = _with_groups(df, box, group)
        x = F.transform(F.arrays_zip(F.col(x_col).alias("x"), "_lo", "_hi"), lambda v: F.try_divide(2.0 * (v["x"] - v["_lo"]), v["_hi"] - v["_lo"]) - 1.0)
        g = F.transform(F.arrays_zip(F.col(g_col).alias("g"), "_lo", "_hi"), lambda v: v["g"] * (v["_hi"] - v["_lo"]) / 2.0)
        return out.withColumn(x_col, x).withColumn(g_col, g).drop("_lo", "_hi")
    stats = df.groupBy(group).agg(*[F.avg(at(i)).alias(f"u{i}") for i in range(m)], *[F.covar_samp(at(i), at(j)).alias(f"c_{i}_{j}") for i in range(m) for j in range(i, m)])

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        root, inverse = sqrt_pair(from_row(r, m))
        return pd.DataFrame({group: [r[group]], "_mu": [[r[f"u{i}"] for i in range(m)]], "_root": [root.tolist()], "_inv": [inverse.tolist()]})

    kinds = dict(df.dtypes)
    moments = stats.groupBy(group).applyInPandas(roots, f"{group} {kinds[group]}, _mu array<double>, _root array<array<double>>, _inv array<array<double>>")
    if m <= SQL_PARAMETERS:  # sums written out: generated code instead of interpreted lambdas
        z = [at(i) - F.get("_mu", F.lit(i)) for i in range(m)]
        times = lambda matrix, v: F.array(*[sum(v[j] * F.get(F.get(matrix, F.lit(i)), F.lit(j)) for j in range(m)) for i in range(m)])
        g = [F.get(g_col, F.lit(i)) for i in range(m)]
        return _with_groups(df, moments, group).select("*", times("_inv", z).alias("_x"), times("_root", g).alias("_g")).drop("_mu", "_root", "_inv", x_col, g_col).withColumnsRenamed({"_x": x_col, "_g": g_col})
    dot = lambda v, row: F.aggregate(F.zip_with(v, row, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    out = _with_groups(df, moments, group).withColumn("_z", F.zip_with(x_col, "_mu", lambda a, b: a - b))
    return out.withColumn(x_col, F.transform("_inv", lambda row: dot(F.col("_z"), row))).withColumn(g_col, F.transform("_root", lambda row: dot(F.col(g_col), row))).drop("_mu", "_root", "_inv", "_z")


def fit_groups(df: DataFrame, config: ClusterConfig, group: str = "label") -> dict[int, LocalModel]:
    """A subspace a group from one grouped aggregation, and a response surface a group from its own bounded task."""
    m = len(df.select("x").head()[0])
    if m > SQL_PARAMETERS:
        raise ValueError(f"local subspaces take up to {SQL_PARAMETERS} parameters")
    models = {}
    for r in grouped_moments(df, group, "g", m).collect():  # a row a cluster
        evals, evects = sorted_eigenpairs(from_row(r, m))
        models[r[group]] = LocalModel(r[group], r["n"], evals, evects, min(config.as_dim, m))
    few = _capped(df, group, config.surface_rows).select(group, "x", "f").toPandas()  # clusters x surface_rows
    for label, pdf in few.groupby(group):
        x, f = np.array(pdf["x"].tolist(), float), np.array(pdf["f"].tolist(), float).reshape(len(pdf), -1)
        models[label].surface = GP(restarts=config.restarts, seed=config.seed).fit(models[label].reduce(x), f)
    return models


def _capped(df: DataFrame, group: str, rows: int) -> DataFrame:
    """A fixed sample of at most `rows` rows a group: surfaces are fitted on samples by design."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(group).orderBy(*by_row()))
    return df.withColumn("_n", rank).filter(F.col("_n") <= rows).drop("_n")


@dataclass
class ClusterAS:
    """Shared steps; subclasses assign clusters. df: row_id, x, f and, for exact gradients, g."""

    config: ClusterConfig = field(default_factory=ClusterConfig)
    whole: LocalModel | None = field(default=None, init=False)
    models: dict[int, LocalModel] = field(default_factory=dict, init=False)

    def assign(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__}.assign")

    def train(self, df: DataFrame) -> None:
        raise NotImplementedError(f"{type(self).__name__}.train")

    def fit(self, df: DataFrame) -> ClusterAS:
        for c in ("x", "f"):
            if c not in df.columns:
                raise TypeError(f"{c} is needed")
        if "g" not in df.columns:
            near = local_linear_gradients(df).select(F.col("sample").cast("long").alias("row_id"), "x", "g")
            surface = GP(restarts=self.config.restarts)
            few = df.orderBy(*by_row()).limit(self.config.surface_rows).toPandas()
            surface.fit(np.array(few["x"].tolist(), float), np.array(few["f"].tolist(), float))
            predict = F.pandas_udf(lambda x: pd.Series(surface.predict(np.array(x.tolist(), float))[:, 0]), "double")
            df = near.withColumn("f", predict("x"))
        else:
            df = spread(df)
        df = df.persist()
        self.whole = fit_groups(df.withColumn("label", F.lit(0)), self.config)[0]
        self.train(df)
        self.models = fit_groups(self.assign(df), self.config)
        df.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with label, full and local predictions (first output)."""
        whole, models = self.whole, self.models

        def by_model(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            out = np.empty(len(x))
            for k in np.unique(label):
                on = label == k
                model = models.get(int(k), whole)
                out[on] = model.surface.predict(model.reduce(x[on]))[:, 0]
            return out

        full = F.pandas_udf(lambda x: pd.Series(whole.surface.predict(whole.reduce(np.array(x.tolist(), float)))[:, 0]), "double")
        local = F.pandas_udf(lambda x, k: pd.Series(by_model(np.array(x.tolist(), float), k.to_numpy())), "double")
        return self.assign(df).withColumn("full", full("x")).withColumn("local", local("x", "label"))

    def compute_scores(self, test: DataFrame) -> DataFrame:
        return scores(self.predict(test), "full", "local", "f")

    def plot_data(self, df: DataFrame) -> DataFrame:
        """x0, x1, label of each row."""
        return self.assign(df).select(F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"), "label")


@dataclass
class KMeansAS(ClusterAS):
    """Euclidean k-means by Spark ML."""

    def train(self, df: DataFrame) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        data = df.select(array_to_vector("x").alias("features"))
        self.km = KMeans(k=self.config.max_clusters, seed=self.config.seed).fit(data)

    def assign(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        out = self.km.setFeaturesCol("_v").setPredictionCol("label").transform(df.withColumn("_v", array_to_vector("x")))
        return out.drop("_v")

    def silhouette(self, df: DataFrame) -> float:
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.functions import array_to_vector

        return ClusteringEvaluator(predictionCol="label", featuresCol="_v").evaluate(self.assign(df).withColumn("_v", array_to_vector("x")))


def k_medoids(points: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    """Indices of k medoids: spread-out starts, then alternating assignment and best member. Ties to the lower index."""
    d = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(2), 0))
    rng = np.random.default_rng(seed)
    chosen = [int(d.sum(1).argmin())]
    while len(chosen) < min(k, len(points)):
        near = d[:, chosen].min(1) ** 2
        chosen.append(int(rng.choice(len(points), p=near / near.sum())) if near.sum() > 0 else next(i for i in range(len(points)) if i not in chosen))
    medoids = np.array(chosen)
    for _ in range(rounds):
        label = d[:, medoids].argmin(1)
        new = np.array([np.flatnonzero(label == j)[d[np.ix_(label == j, label == j)].sum(1).argmin()] if (label == j).any() else medoids[j] for j in range(len(medoids))])
        if (new == medoids).all():
            break
        medoids = new
    return medoids


@dataclass
class KMedoidsAS(ClusterAS):
    """k-medoids in the metric of the global subspace: coordinates along its vectors, scaled by the eigenvalues.

    Medoids are found on a sample of at most sample_rows rows; every row goes to its nearest medoid.
    """

    sample_rows: int = 2000
    metric: Callable[[np.ndarray], np.ndarray] | None = None

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return self.metric(x) if self.metric else (x @ self.whole.evects) * self.whole.evals[:, 0]

    def train(self, df: DataFrame) -> None:
        few = df.orderBy(*by_row()).limit(self.sample_rows).select("x").toPandas()
        z = self.coordinates(np.array(few["x"].tolist(), float))
        self.medoids = z[k_medoids(z, self.config.max_clusters, self.config.seed)]

    def assign(self, df: DataFrame) -> DataFrame:
        medoids, coordinates = self.medoids, self.coordinates

        def nearest(x: pd.Series) -> pd.Series:
            z = coordinates(np.array(x.tolist(), float))
            return pd.Series(((z[:, None] - medoids[None]) ** 2).sum(2).argmin(1))

        return df.withColumn("label", F.pandas_udf(nearest, "int")("x"))


def as_dim(evals: np.ndarray, max_dim: int, threshold: float = 0.95) -> int:
    return cumulative_dim(evals, max_dim, threshold)


def as_dim_gap(evals: np.ndarray, max_dim: int) -> int:
    return gap_dim(evals, max_dim)
