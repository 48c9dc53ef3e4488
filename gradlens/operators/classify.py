"""Classification of rows by the dimension of their local active subspace, over a nearest-neighbour graph."""

from __future__ import annotations

import itertools
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.operators.neighbors import components, k_nearest, neighbour_graph


def local_dims(df: DataFrame, k: int, threshold: float = 0.999999, subset: int = 5, criterion: str = "min") -> DataFrame:
    """row_id, as_dim: from the gradients of the k nearest rows.

    Each subset of `subset` of them gives the first dimension whose share of the spectrum exceeds the threshold; their
    minimum counts, or their sum over k (`mean`), rounded.
    """
    if criterion not in ("min", "mean"):
        raise ValueError(f"no criterion {criterion}")
    if not 0 < threshold <= 1 or k < subset:
        raise AssertionError("threshold is in (0, 1], and k at least the subset size")
    near = k_nearest(df, df, k)
    rows = near.join(df.select(F.col("row_id").alias("neighbour_id"), "g"), "neighbour_id")

    def dims(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.array(pdf.sort_values("rank")["g"].tolist(), float)
        picks = np.array(list(itertools.combinations(range(len(g)), min(subset, len(g)))))
        energy = np.linalg.svd(g[picks], compute_uv=False) ** 2
        share = np.cumsum(energy, 1) / np.maximum(energy.sum(1, keepdims=True), 1e-300)
        found = np.where((share > threshold).any(1), (share > threshold).argmax(1), share.shape[1] - 1) + 1
        value = found.min() if criterion == "min" else round(found.sum() / k)
        return pd.DataFrame({"row_id": [pdf["query_id"].iloc[0]], "as_dim": [int(value)]})

    return rows.groupBy("query_id").applyInPandas(dims, "row_id long, as_dim int")


class GraphClassification(ABC):
    """Classes are the components of a neighbour graph; subclasses say what neighbours are."""

    @abstractmethod
    def graph(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges (src, dst) and the rows with what the classification found out about them."""

    def fit(self, df: DataFrame) -> tuple[int, DataFrame]:
        edges, rows = self.graph(df)
        label = components(edges, rows.select(F.col("row_id").alias("node")))
        self.result = rows.join(label.withColumnRenamed("node", "row_id"), "row_id")
        return label.select("label").distinct().count(), self.result


@dataclass
class ClassifyAS(GraphClassification):
    n_neighbours: int
    threshold: float = 0.999999
    subset: int = 5
    criterion: str = "min"
    graph_neighbours: int | None = None

    def graph(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = df.join(local_dims(df, self.n_neighbours, self.threshold, self.subset, self.criterion), "row_id").persist()
        return neighbour_graph(rows, self.graph_neighbours or self.n_neighbours, "as_dim"), rows

    def plot_data(self) -> DataFrame:
        """x, label, as_dim."""
        return self.result.select("x", "label", "as_dim")


def decision_boundaries(df: DataFrame, axes: tuple[int, int] = (0, 1), step: float = 0.02, classifier=None, seed: int = 42, truth_col: str | None = None) -> tuple[float, DataFrame] | tuple[float, DataFrame, float]:
    """Test accuracy of a classifier of label by x (80 / 20 split), and its predictions over a mesh of two axes (others 0).

    truth_col: the known classes; then also the share of all rows whose prediction equals them.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), *([F.col(truth_col).cast("double").alias("truth")] if truth_col else []))
    m, classes = len(df.select("x").head()[0]), int(df.agg(F.max("label")).head()[0]) + 1
    train, test = data.randomSplit([0.8, 0.2], seed=seed)
    model = (classifier or MultilayerPerceptronClassifier(layers=[m, 100, max(classes, 2)], maxIter=1000, seed=seed)).fit(train)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(test))
    lo_hi = df.agg(*[f(F.get("x", F.lit(a))).alias(f"{n}{i}") for i, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max))]).head()
    spark = df.sparkSession
    ranges = [np.arange(lo_hi[f"lo{i}"] - 0.5, lo_hi[f"hi{i}"] + 0.5, step) for i in range(2)]
    mesh = spark.range(len(ranges[0])).withColumn("u", F.lit(float(ranges[0][0])) + F.col("id") * step).withColumn("v", F.explode(F.expr(f"transform(sequence(0, {len(ranges[1]) - 1}), i -> {float(ranges[1][0])}D + i * {step}D)")))
    full = F.array(*[F.col("u") if i == axes[0] else F.col("v") if i == axes[1] else F.lit(0.0) for i in range(m)])
    drawn = model.transform(mesh.withColumn("features", array_to_vector(full))).select("u", "v", F.col("prediction").cast("int").alias("label"))
    if truth_col:
        right = model.transform(data).agg(F.avg((F.col("prediction") == F.col("truth")).cast("double"))).head()[0]
        return accuracy, drawn, float(right)
    return accuracy, drawn
