"""Nonlinear level-set learning: a reversible network that bends the domain until an output varies along few coordinates.

Layers update one half of the coordinates by the other: y += h Wy' tanh(Wy z + by), then z -= h Wz' tanh(Wz y + bz).
Training is full-batch over all rows: on the driver where they are few (the method's data are some hundred samples), else
with the sums of loss and gradients made by Spark in each epoch; applying a trained map to rows is an Arrow UDF. The loss
perturbs each mapped coordinate, maps back, and takes normalised differences as the columns of the inverse Jacobian. Its
first term's gradient is exact, by reverse mode through the layers; that of its determinant term, which vanishes as rows
grow, is left out (see loss).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 1e-3


@dataclass
class RevNet:
    """Weights by layer: Wy (2h, h), by (2h), Wz, bz. `half` = parameters / 2."""

    half: int
    n_layers: int
    dh: float = 0.25
    layers: list[list[np.ndarray]] = field(default_factory=list)

    def init(self, seed: int = 0) -> RevNet:
        rng, h = np.random.default_rng(seed), self.half
        bound = 1 / np.sqrt(h)
        self.layers = [[rng.uniform(-bound, bound, s) for s in ((2 * h, h), (2 * h,), (2 * h, h), (2 * h,))] for _ in range(self.n_layers)]
        return self

    def forward(self, x: np.ndarray) -> np.ndarray:
        y, z = x[:, : self.half], x[:, self.half :]
        for wy, by, wz, bz in self.layers:
            y = y + self.dh * np.tanh(z @ wy.T + by) @ wy
            z = z - self.dh * np.tanh(y @ wz.T + bz) @ wz
        return np.hstack([y, z])

    def backward(self, mapped: np.ndarray) -> np.ndarray:
        y, z = mapped[:, : self.half], mapped[:, self.half :]
        for wy, by, wz, bz in reversed(self.layers):
            z = z + self.dh * np.tanh(y @ wz.T + bz) @ wz
            y = y - self.dh * np.tanh(z @ wy.T + by) @ wy
        return np.hstack([y, z])

    def parameters(self) -> list[np.ndarray]:
        return [p for layer in self.layers for p in layer]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """layer, name, shape, values: one row a weight array."""
        rows = [(k, name, list(p.shape), p.ravel().tolist()) for k, layer in enumerate(self.layers) for name, p in zip(("wy", "by", "wz", "bz"), layer)]
        return spark.createDataFrame(rows, "layer int, name string, shape array<int>, values array<double>").withColumn("dh", F.lit(self.dh))

    @classmethod
    def from_frame(cls, df: DataFrame) -> RevNet:
        rows = {(r["layer"], r["name"]): np.array(r["values"]).reshape(r["shape"]) for r in df.collect()}
        n = 1 + max(k for k, _ in rows)
        dh = df.select("dh").head()[0]
        return cls(rows[0, "wy"].shape[1], n, dh, [[rows[k, name] for name in ("wy", "by", "wz", "bz")] for k in range(n)])

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RevNet:
        return cls.from_frame(spark.read.parquet(path))


class _Push:
    """p += sign * dh * tanh(q W' + b) W, remembered for the way back."""

    def __init__(self, w: np.ndarray, b: np.ndarray, scale: float) -> None:
        self.w, self.b, self.scale = w, b, scale

    def run(self, q: np.ndarray) -> np.ndarray:
        self.q, self.t = q, np.tanh(q @ self.w.T + self.b)
        return self.scale * self.t @ self.w

    def grad(self, up: np.ndarray, gw: np.ndarray, gb: np.ndarray) -> np.ndarray:
        """Adds the parameters' gradients and returns that of q."""
        up = self.scale * up
        gw += self.t.T @ up
        inner = (up @ self.w.T) * (1 - self.t**2)
        gw += inner.T @ self.q
        gb += inner.sum(0)
        return inner @ self.w


def loss(net: RevNet, x: np.ndarray, g: np.ndarray, active: int, with_grad: bool = True) -> tuple[float, list[np.ndarray] | None]:
    """sqrt(mean over rows of sum over inactive j of (J_j . g)^2) + |product over rows of (|det J| - 1)|, and its gradient.

    The second term's product is over samples and each factor lies in [-1, 0], so it vanishes as samples grow; its
    gradient is left out, the value is kept.
    """
    sums = _sums(net, x, g, active, with_grad)
    return _value(sums[:3]), _gradients(net, sums) if with_grad else None


def _value(sums: np.ndarray) -> float:
    n, squares, log_product = sums
    return float(np.sqrt(squares / n) + np.exp(log_product))


def _gradients(net: RevNet, sums: np.ndarray) -> list[np.ndarray]:
    """By weight array, of the first term."""
    n, squares, at, out = sums[0], sums[1], 3, []
    scale = 1 / (n * np.sqrt(squares / n)) if squares > 0 else 0.0
    for p in net.parameters():
        out.append(sums[at : at + p.size].reshape(p.shape) * scale)
        at += p.size
    return out


def _sums(net: RevNet, x: np.ndarray, g: np.ndarray, active: int, with_grad: bool = True) -> np.ndarray:
    """What is added up over rows: 1, sum of the inactive slopes' squares, logarithm of | |det J| - 1 |, and half the second's gradients."""
    n, m = x.shape
    h = net.half
    y, z, tape = x[:, :h], x[:, h:], []
    for wy, by, wz, bz in net.layers:
        a, b = _Push(wy, by, net.dh), _Push(wz, bz, -net.dh)
        y = y + a.run(z)
        z = z + b.run(y)
        tape.append((a, b))
    mapped = np.hstack([y, z])
    moved = (mapped[None] + STEP * np.eye(m)[:, None]).reshape(m * n, m)
    y, z, back = moved[:, :h], moved[:, h:], []
    for wy, by, wz, bz in reversed(net.layers):
        b, a = _Push(wz, bz, net.dh), _Push(wy, by, -net.dh)
        z = z + b.run(y)
        y = y + a.run(z)
        back.append((a, b))
    diff = np.hstack([y, z]).reshape(m, n, m) - x[None]
    length = np.maximum(np.linalg.norm(diff, axis=2, keepdims=True), 1e-300)
    jac = diff / length
    slope = np.einsum("jnm,nm->jn", jac, g)
    dets = np.abs(np.linalg.det(np.transpose(jac, (1, 2, 0))))
    with np.errstate(divide="ignore"):
        sums = [n, (slope[active:] ** 2).sum(), np.log(np.abs(dets - 1)).sum()]
    if not with_grad:
        return np.array(sums)
    up_slope = np.zeros_like(slope)
    up_slope[active:] = slope[active:]
    up_jac = up_slope[:, :, None] * g[None]
    up = (up_jac - jac * (up_jac * jac).sum(2, keepdims=True)) / length
    up = up.reshape(m * n, m)
    grads = [[np.zeros_like(p) for p in layer] for layer in net.layers]
    uy, uz = up[:, :h], up[:, h:]
    for k, (a, b) in enumerate(reversed(back)):
        gw = grads[k]
        uz = uz + a.grad(uy, gw[0], gw[1])
        uy = uy + b.grad(uz, gw[2], gw[3])
    whole = np.hstack([uy, uz]).reshape(m, n, m).sum(0)
    uy, uz = whole[:, :h], whole[:, h:]
    for k in range(net.n_layers - 1, -1, -1):
        a, b = tape[k]
        uy = uy + b.grad(uz, grads[k][2], grads[k][3])
        uz = uz + a.grad(uy, grads[k][0], grads[k][1])
    return np.concatenate([sums, *[p.ravel() for layer in grads for p in layer]])


def _partials(df: DataFrame, way: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.DataFrame:
    """v, most: sums and maxima by entry of what way(x, g) gives for all rows, added up by partition and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = None, None
        for batch in batches:
            if batch.num_rows:
                x, g = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for c in ("x", "g"))
                v = way(x, g)
                total, most = (v, v) if total is None else (total + v, np.maximum(most, v))
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype="i4")), pa.array(total), pa.array(most)], names=["at", "v", "most"])

    return df.mapInArrow(run, "at int, v double, most double").groupBy("at").agg(F.sum("v").alias("v"), F.max("most").alias("most")).toPandas().sort_values("at")


class Adam:
    def __init__(self, params: list[np.ndarray], lr: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> None:
        self.params, self.lr, self.betas, self.eps, self.t = params, lr, betas, eps, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        a, b = self.betas
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m *= a
            m += (1 - a) * g
            v *= b
            v += (1 - b) * g * g
            p -= self.lr * (m / (1 - a**self.t)) / (np.sqrt(v / (1 - b**self.t)) + self.eps)


class SGD:
    def __init__(self, params: list[np.ndarray], lr: float, momentum: float = 0.0) -> None:
        self.params, self.lr, self.momentum = params, lr, momentum
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        for p, g, v in zip(self.params, grads, self.v):
            v *= self.momentum
            v += g
            p -= self.lr * v


class StepLR:
    """Divides the rate every step_size epochs."""

    def __init__(self, optimizer, step_size: int = 100, gamma: float = 0.1) -> None:
        self.optimizer, self.step_size, self.gamma, self.t = optimizer, step_size, gamma, 0

    def step(self) -> None:
        self.t += 1
        if self.t % self.step_size == 0:
            self.optimizer.lr *= self.gamma


@dataclass
class NonlinearLevelSet:
    n_layers: int
    active_dim: int
    lr: float
    epochs: int
    dh: float = 0.25
    optimizer: type = Adam
    scheduler: type | None = None
    seed: int = 0
    net: RevNet | None = field(default=None, init=False)
    history: list[tuple[int, float]] = field(default_factory=list, init=False)

    def train(self, df: DataFrame, target_loss: float = 1e-4, optim_args: dict | None = None, scheduler_args: dict | None = None, driver_rows: int = 5000) -> NonlinearLevelSet:
        """df: x, g; all rows are used. Over driver_rows of them stay in Spark, a job an epoch. history: (epoch, loss) every 10 epochs and at the end."""
        rows = df.select("x", "g").persist()
        pdf = rows.orderBy(F.xxhash64("x"), "x").limit(driver_rows + 1).toPandas()
        if len(pdf) <= driver_rows:
            rows.unpersist()
            return self.train_arrays(np.array(pdf["x"].tolist(), float), np.array(pdf["g"].tolist(), float), target_loss, optim_args, scheduler_args)
        active = self.active_dim

        def step(net: RevNet) -> tuple[float, list[np.ndarray]]:
            sums = _partials(rows, lambda x, g: _sums(net, x, g, active))["v"].to_numpy()
            return _value(sums[:3]), _gradients(net, sums)

        def reconstruct(net: RevNet) -> float:
            return float(_partials(rows, lambda x, g: np.array([np.abs(net.backward(net.forward(x)) - x).max()]))["most"].iloc[0])

        self._descend(len(pdf["x"].iloc[0]), step, reconstruct, target_loss, optim_args, scheduler_args)
        rows.unpersist()
        return self

    def train_arrays(self, x: np.ndarray, g: np.ndarray, target_loss: float = 1e-4, optim_args: dict | None = None, scheduler_args: dict | None = None) -> NonlinearLevelSet:
        self._descend(x.shape[1], lambda net: loss(net, x, g, self.active_dim), lambda net: float(np.abs(net.backward(net.forward(x)) - x).max()), target_loss, optim_args, scheduler_args)
        return self

    def _descend(self, m: int, step: Callable[[RevNet], tuple[float, list[np.ndarray]]], reconstruct: Callable[[RevNet], float], target_loss: float, optim_args: dict | None, scheduler_args: dict | None) -> None:
        if m % 2:
            raise ValueError("the number of parameters is even")
        self.net = RevNet(m // 2, self.n_layers, self.dh).init(self.seed)
        optimizer = self.optimizer(self.net.parameters(), self.lr, **(optim_args or {}))
        scheduler = self.scheduler(optimizer, **(scheduler_args or {})) if self.scheduler else None
        self.history = []
        for epoch in range(1, self.epochs + 1):
            value, grads = step(self.net)
            if epoch % 10 == 1 or epoch == self.epochs:
                self.history.append((epoch, value))
                if value < target_loss:
                    break
            optimizer.step(grads)
            if scheduler:
                scheduler.step()
        self.reconstruction = reconstruct(self.net)

    def _apply(self, column: str, way: str):
        net = self.net

        @F.pandas_udf("array<double>")
        def apply(x: pd.Series) -> pd.Series:
            return pd.Series(getattr(net, way)(np.array(x.tolist(), float)).tolist())

        return apply(column)

    def forward(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        return df.withColumn("mapped", self._apply(x_col, "forward"))

    def backward(self, df: DataFrame, y_col: str = "mapped") -> DataFrame:
        return df.withColumn("x_back", self._apply(y_col, "backward"))

    def summary_data(self, df: DataFrame) -> DataFrame:
        """y0, f along the first mapped coordinate."""
        if self.active_dim != 1:
            raise ValueError("one active coordinate is plotted")
        return self.forward(df).select(F.get("mapped", F.lit(0)).alias("y0"), "f")

    def loss_data(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, loss double")


def describe(net: RevNet) -> str:
    return json.dumps({"half": net.half, "layers": net.n_layers, "dh": net.dh})
