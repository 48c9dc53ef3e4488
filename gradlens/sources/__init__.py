"""Reading and writing: arrays, CSV, appended .npy streams, models and matrices."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_arrays(spark: SparkSession, x: np.ndarray | None = None, f: np.ndarray | None = None, g: np.ndarray | None = None, w: np.ndarray | None = None) -> DataFrame:
    """Arrays in memory as rows with an explicit row_id."""
    cols, kinds = {}, []
    for name, a in (("x", x), ("f", f), ("g", g), ("w", w)):
        if a is not None:
            a = np.asarray(a, float)
            if name in "fw" and a.ndim == 2 and a.shape[1] == 1:
                a = a[:, 0]
            cols[name] = a.tolist()
            kinds.append(f"{name} " + "array<" * (a.ndim - 1) + "double" + ">" * (a.ndim - 1))
    n = len(next(iter(cols.values())))
    return spark.createDataFrame(list(zip(range(n), *cols.values())), ", ".join(["row_id long", *kinds]))


def from_columns(df: DataFrame, id_col: str, x: list[str], f: str | None = None, g: list[str] | None = None) -> DataFrame:
    """Wide tables as row_id, x[, f][, g]: only these columns are read."""
    out = [F.col(id_col).alias("row_id"), F.array(*[F.col(c).cast("double") for c in x]).alias("x")]
    if f:
        out.append(F.col(f).cast("double").alias("f"))
    if g:
        out.append(F.array(*[F.col(c).cast("double") for c in g]).alias("g"))
    return df.select(*out)


def read_samples_csv(spark: SparkSession, path: str, x: range, f: int, g: range) -> DataFrame:
    """A CSV with a header: parameters, output and gradient by column position."""
    with_header = spark.read.csv(path, header=True)
    schema = ", ".join(f"`{c}` double" for c in with_header.columns)
    df = spark.read.schema(schema).csv(path, header=True)
    names = df.columns
    row = F.monotonically_increasing_id().alias("row_id")
    return df.select(row, F.array(*[names[i] for i in x]).alias("x"), F.col(names[f]).alias("f"), F.array(*[names[i] for i in g]).alias("g"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, part, row, values from files into which arrays were saved one after another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"]):
                handle, size, part = io.BytesIO(content), len(content), 0
                while handle.tell() < size:
                    a = np.load(handle, allow_pickle=False)
                    rows = np.atleast_2d(a).reshape(np.atleast_2d(a).shape[0], -1)
                    yield pd.DataFrame({"path": p, "part": part, "row": np.arange(len(rows)), "values": rows.astype(float).tolist()})
                    part += 1

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, part int, row long, values array<double>")


def write_matrix(spark: SparkSession, matrix: np.ndarray, path: str, bias: np.ndarray | None = None) -> None:
    """A projection matrix (and bias) as feature_id, w, b."""
    b = np.broadcast_to(np.ravel(bias) if bias is not None else np.nan, len(matrix))
    spark.createDataFrame([(i, list(map(float, r)), float(v)) for i, (r, v) in enumerate(zip(matrix, b))], "feature_id int, w array<double>, b double").coalesce(1).write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    pdf = spark.read.parquet(path).orderBy("feature_id").toPandas()
    return np.array(pdf["w"].tolist()), pdf["b"].to_numpy()


def write_model(spark: SparkSession, model, path: str) -> None:
    """A fitted subspace: its spectrum, and its dimension in every row."""
    model.spectrum(spark).withColumn("dim", F.lit(int(model.dim))).coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str):
    from gradlens.operators.active import ActiveSubspaces

    pdf = spark.read.parquet(path).orderBy("idx").toPandas()
    model = ActiveSubspaces(dim=int(pdf["dim"].iloc[0]))
    return model.set_spectrum(pdf["eval"].to_numpy().reshape(-1, 1), np.array(pdf["evect"].tolist()).T)


def write_clusters(df: DataFrame, path: str) -> None:
    """Cluster or class dumps: x, label and what else the frame holds."""
    df.write.mode("overwrite").parquet(path)
