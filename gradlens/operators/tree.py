"""Top-down hierarchical local active subspaces.

A tree of clusters is refined breadth first. Rows stay in Spark: membership is a small routing function (the tree) that
maps a point to its leaf. What a node knows of its rows (number, normaliser, moments, score) are aggregates over all of
them; its Gaussian process is fitted, and the centres of its splits are looked for, on a bounded sample of the rows
(node_rows), which is a documented parameter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradlens.functions.linalg import canonical_signs, cumulative_dim, gap_dim, sorted_eigenpairs, sqrt_pair
from gradlens.operators.gp import GP
from gradlens.operators.local import k_medoids, spread
from gradlens.operators.neighbors import nearest_label

#: What a refinement ended with. Larger is worse; FULL stops the whole tree.
OPEN, TOO_SMALL, DONE, FULL, SPLIT, FEW_ROWS, REFINED, NO_SPLIT = range(8)
STATES = ("open", "a cluster is too small", "score reached", "cluster budget used up", "to be split", "too few rows", "refined", "cannot be split")


class MaximumDimensionReached(Exception):
    """No leaf can take a larger dimension."""


@dataclass
class TreeConfig:
    max_clusters: int
    max_children: int
    min_children: int
    max_red_dim: int
    score_tol: float
    min_local: int
    dim_cut: float
    dim_criterion: str
    normalization: str
    metric: str
    refinement: str
    minimum_score: float | None = None
    max_dim_refine_further: int | None = None
    node_rows: int = 400
    restarts: int = 1
    seed: int = 0

    @classmethod
    def of(cls, given: dict) -> TreeConfig:
        """From a dict; KeyError names a mandatory key that is missing."""
        must = ("max_clusters", "max_children", "min_children", "max_red_dim", "score_tol", "min_local", "dim_cut", "dim_criterion", "normalization", "metric", "refinement")
        for k in must:
            if k not in given:
                raise KeyError(k)
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})


@dataclass
class Totals:
    """Over all rows of a node: their number, box, mean and covariance, and the moments of their gradients."""

    n: int
    lo: np.ndarray
    hi: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    moments: np.ndarray


@dataclass
class Errors:
    """By output, over all rows that a node is scored on: squared errors, sums of outputs less a shift and of their squares."""

    n: float
    left: np.ndarray
    f: np.ndarray
    ff: np.ndarray

    def __add__(self, other: Errors) -> Errors:
        return Errors(self.n + other.n, self.left + other.left, self.f + other.f, self.ff + other.ff)

    def r2(self) -> np.ndarray:
        spread = self.ff - self.f**2 / max(self.n, 1)
        some = spread > 1e-12 * self.ff
        return np.where(some, 1 - self.left / np.where(some, spread, 1), np.where(self.left > 0, 0.0, 1.0))

    def clipped_r2(self) -> float:
        return float(np.clip(self.r2(), 0, 1).mean())


class NodeNormalizer:
    """Maps a node's rows to a standard domain, with gradients."""

    def __init__(self, kind: str, rows: Totals) -> None:
        m = len(rows.mean)
        self.shift, self.forward, self.back = np.zeros(m), np.eye(m), np.eye(m)
        if kind == "uniform":
            lo, hi = rows.lo, rows.hi
            half = np.where(hi > lo, (hi - lo) / 2, 1.0)
            self.shift, self.forward, self.back = (lo + hi) / 2, np.diag(1 / half), np.diag(half)
        elif kind == "gaussian":
            self.shift = rows.mean
            self.back, self.forward = sqrt_pair(rows.cov)
        elif kind != "root":
            raise ValueError(f"no normaliser {kind}")

    def __call__(self, x: np.ndarray, g: np.ndarray | None = None):
        z = (x - self.shift) @ self.forward
        return z if g is None else (z, g @ self.back)


@dataclass
class Node:
    #: The sample's rows in the node; totals and errors are over all rows.
    rows: np.ndarray
    x: np.ndarray
    f: np.ndarray
    g: np.ndarray
    totals: Totals
    config: TreeConfig
    kind: str
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    label: int = -1
    state: int = OPEN
    errors: Errors | None = None

    def __post_init__(self) -> None:
        c = self.config
        self.normalizer = NodeNormalizer(self.kind, self.totals)
        self.evals, self.evects = sorted_eigenpairs(self.normalizer.back.T @ self.totals.moments @ self.normalizer.back)
        self.evals, self.evects = self.evals[:, 0], canonical_signs(self.evects)
        total = self.evals.sum()
        self.weights = self.evals / total if total > 0 else np.full(len(self.evals), 1 / len(self.evals))
        limit = min(c.max_red_dim, len(self.evals) - 1 if c.dim_criterion == "gap" else len(self.evals))
        self.dim = gap_dim(self.evals, limit) if c.dim_criterion == "gap" else cumulative_dim(self.evals, limit, c.dim_cut)
        self.refit()

    @property
    def score(self) -> float:
        return self.errors.clipped_r2()

    def refit(self) -> None:
        """Fits the surface anew; the tree then scores it over all rows."""
        z = self.normalizer(self.x) @ self.evects[:, : self.dim]
        self.surface = GP(normalize=False, restarts=self.config.restarts, seed=self.config.seed).fit(z, self.f)

    def reached(self, x: np.ndarray) -> np.ndarray:
        """Which points the tree routes to this node."""
        if self.parent is None:
            return np.ones(len(x), bool)
        on = self.parent.reached(x)
        on[on] = self.parent.route(x[on]) == next(j for j, c in enumerate(self.parent.children) if c is self)
        return on

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.surface.predict(self.normalizer(x) @ self.evects[:, : self.dim])

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        z = self.normalizer(x)
        return (z @ self.evects) * self.weights if self.config.metric == "as" else z

    def route(self, x: np.ndarray) -> np.ndarray:
        """Which child each point goes to."""
        return _nearest(self.coordinates(x), self.centres)


def _nearest(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of numbers or of arrays of numbers."""
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _once(way: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """way(x), with equal points worked out once."""
    points, at = np.unique(x, axis=0, return_inverse=True)
    return way(points)[at.ravel()]


def _summed(df: DataFrame, way: Callable[[pa.RecordBatch], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> dict[int, pd.DataFrame]:
    """By node: entries that are summed, and lower and upper bounds, over all rows. way gives those of a batch.

    Partitions add up their own entries and Spark those of the partitions: the driver gets one set a node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                for node, (v, lo, hi) in way(batch).items():
                    held[node] = (held[node][0] + v, np.minimum(held[node][1], lo), np.maximum(held[node][2], hi)) if node in held else (v, lo, hi)
        for node, (v, lo, hi) in held.items():
            yield pa.record_batch([pa.array(np.full(len(v), node, "i4")), pa.array(np.arange(len(v), dtype="i4")), pa.array(v), pa.array(lo), pa.array(hi)], names=["node", "at", "v", "lo", "hi"])

    out = df.mapInArrow(run, "node int, at int, v double, lo double, hi double").groupBy("node", "at").agg(F.sum("v").alias("v"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
    return {int(node): part.sort_values("at") for node, part in out.groupby("node")}


class HierarchicalAS:
    def __init__(self) -> None:
        self.root: Node | None = None
        self.total = 1

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("data", "validation")}  # tasks need the nodes only

    def fit(self, df: DataFrame, config: dict | TreeConfig, validation: DataFrame | None = None) -> HierarchicalAS:
        """df: row_id, x, f, g. All rows make up the statistics and scores of the nodes; a sample of node_rows x max_clusters rows (by hash of row_id) their surfaces and the centres of splits."""
        c = self.config = config if isinstance(config, TreeConfig) else TreeConfig.of(config)
        if c.metric not in ("as", "kmeans", "euclidean", "C1"):
            raise ValueError(f"no metric {c.metric}")
        self.data = spread(df.select("row_id", "x", "f", "g")).persist()
        self.validation = validation.select("x", "f").persist() if validation is not None else None
        pdf = self.data.orderBy(F.xxhash64("row_id"), "row_id", "x").limit(c.node_rows * c.max_clusters).toPandas()
        x, f, g = (np.array(pdf[k].tolist(), float) for k in ("x", "f", "g"))
        f = f.reshape(len(f), -1)
        self.shift = x.mean(0), f.mean(0)  # sums are taken about it: fewer digits are lost
        totals = self._totals(lambda x: np.zeros((len(x), 1), int))
        self.root = Node(np.arange(len(x)), x, f, g, totals[0], c, "root")
        self.score([self.root])
        self.total = 1
        queue = deque([self.root] if self.root.score <= c.score_tol else [])
        while queue:
            node = queue.popleft()
            state = self.refine(node)
            node.state = state
            if state == FULL:
                break
            if node.children:
                self.total += len(node.children) - 1
                queue.extend(k for k in node.children if k.score < c.score_tol)
        self.assign_labels()
        if c.minimum_score is not None:
            self.refine_further(c.minimum_score)
        self.data.unpersist()
        if self.validation is not None:
            self.validation.unpersist()
        return self

    def _totals(self, place: Callable[[np.ndarray], np.ndarray]) -> dict[int, Totals]:
        """By number, over all rows. place: numbers of each point, one a column (-1: none)."""
        shift = self.shift[0]
        m = len(shift)

        def way(batch: pa.RecordBatch) -> dict:
            x, g = _matrix(batch.column("x")), _matrix(batch.column("g"))
            number, out = _once(place, x), {}
            for k in np.unique(number[number >= 0]):
                on = (number == k).any(1)
                z, lo, hi = x[on] - shift, np.full(1 + m + 2 * m * m, np.inf), np.full(1 + m + 2 * m * m, -np.inf)
                lo[:m], hi[:m] = x[on].min(0), x[on].max(0)
                out[int(k)] = (np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel(), (g[on].T @ g[on]).ravel()]), lo, hi)
            return out

        totals = {}
        for k, part in _summed(self.data.select("x", "g"), way).items():
            v, n = part["v"].to_numpy(), part["v"].iloc[0]
            mean = v[1 : 1 + m] / n
            cov = (v[1 + m : 1 + m + m * m].reshape(m, m) - n * np.outer(mean, mean)) / max(n - 1, 1)
            totals[k] = Totals(int(n), part["lo"].to_numpy()[:m], part["hi"].to_numpy()[:m], shift + mean, cov, v[1 + m + m * m :].reshape(m, m) / n)
        return totals

    def score(self, nodes: list[Node], place: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        """Sets the errors of nodes over all validation rows routed to them, or all rows of the fit where there are none."""
        shift = self.shift[1]
        place = place or (lambda x: np.max([np.where(node.reached(x), k, -1) for k, node in enumerate(nodes)], 0))
        outputs = len(shift)

        def guess(x: np.ndarray) -> np.ndarray:
            number, out = place(x), np.zeros((len(x), 1 + outputs))
            out[:, 0] = number
            for k in np.unique(number[number >= 0]):
                out[number == k, 1:] = nodes[k].predict(x[number == k])
            return out

        def way(batch: pa.RecordBatch) -> dict:
            x, f = _matrix(batch.column("x")), _matrix(batch.column("f"))
            found, out = _once(guess, x), {}
            for k in np.unique(found[found[:, 0] >= 0, 0]):
                on = found[:, 0] == k
                z = f[on] - shift
                v = np.concatenate([[on.sum()], ((f[on] - found[on, 1:]) ** 2).sum(0), z.sum(0), (z**2).sum(0)])
                out[int(k)] = (v, v, v)
            return out

        sums = _summed(self.validation, way) if self.validation is not None else {}
        if len(sums) < len(nodes):
            sums = _summed(self.data.select("x", "f"), way) | sums
        for k, node in enumerate(nodes):
            v = sums[k]["v"].to_numpy()
            node.errors = Errors(v[0], *v[1:].reshape(3, outputs))

    def refine(self, node: Node) -> int:
        c, best, tried_small = self.config, -np.inf, False
        splits = {k: self._cluster(node, k) for k in range(c.min_children, c.max_children + 1) if self.total + k - 1 <= c.max_clusters and len(node.x) >= k}
        first = dict(zip(splits, np.cumsum([0, *splits])))

        def place(x: np.ndarray) -> np.ndarray:
            on = node.reached(x)
            z = node.coordinates(x[on])
            out = np.full((len(x), len(splits)), -1)
            out[on] = np.column_stack([first[k] + _nearest(z, centres) for k, (centres, _) in splits.items()])
            return out

        totals = self._totals(place) if splits else {}
        for k in range(c.min_children, c.max_children + 1):
            if self.total + k - 1 > c.max_clusters:
                return SPLIT if node.children else FULL if self.total >= c.max_clusters else NO_SPLIT
            if node.totals.n < self.total + k:
                return SPLIT if node.children else FEW_ROWS
            if k not in splits:  # the sample has too few of the node's rows
                tried_small = True
                continue
            centres, label = splits[k]
            parts = [totals.get(first[k] + j) for j in range(k)]
            if any(p is None or p.n < c.min_local for p in parts) or not np.bincount(label, minlength=k).all():
                tried_small = True
                continue
            children = [Node(node.rows[label == j], node.x[label == j], node.f[label == j], node.g[label == j], parts[j], c, c.normalization, node) for j in range(k)]
            self.score(children, lambda x, at=first[k], col=list(splits).index(k): np.where((p := place(x)[:, col]) >= 0, p - at, -1))
            take, stop, best = PRIORITIES[c.refinement](node, children, best, c.score_tol)
            if take:
                node.children, node.centres = children, centres
            if stop:
                return DONE
        return SPLIT if node.children else TOO_SMALL if tried_small else NO_SPLIT

    def _cluster(self, node: Node, k: int) -> tuple[np.ndarray, np.ndarray]:
        z = node.coordinates(node.x)
        if node.config.metric == "kmeans":
            label = lloyd(z, k, node.config.seed)
            centres = np.array([z[label == j].mean(0) for j in range(k)])
            return centres, _nearest(z, centres)
        # C1: medoids by position, outputs and gradients together; new points have a position only, so they go by that.
        data = np.column_stack([z, node.f, node.normalizer(node.x, node.g)[1]]) if node.config.metric == "C1" else z
        medoids = z[k_medoids(data, k, node.config.seed)]
        return medoids, _nearest(z, medoids)

    def walk(self, leaf: Callable[[Node], None], inner: Callable[[Node], None] = lambda n: None) -> None:
        """Visits the nodes breadth first."""
        queue = deque([self.root])
        while queue:
            node = queue.popleft()
            (inner if node.children else leaf)(node)
            queue.extend(node.children)

    def leaves(self) -> list[Node]:
        out: list[Node] = []
        self.walk(out.append)
        return out

    def assign_labels(self) -> None:
        for i, leaf in enumerate(self.leaves()):
            leaf.label = i

    def refine_one_step(self) -> None:
        """One more dimension for the worst leaf that can take one."""
        limit = self.config.max_dim_refine_further or self.config.max_red_dim
        for leaf in sorted(self.leaves(), key=lambda n: n.score):
            if leaf.dim < min(limit, len(leaf.evals)):
                leaf.dim += 1
                leaf.refit()
                self.score([leaf])
                return
        raise MaximumDimensionReached

    def refine_further(self, minimum_score: float) -> None:
        """Raises the leaves' dimensions until the (unclipped) score is reached or the limit is."""
        limit, leaves = self.config.max_dim_refine_further, self.leaves()
        while low := [n for n in leaves if n.dim < min(limit or len(n.evals), len(n.evals)) and float(n.errors.r2().mean()) < minimum_score]:
            for node in low:
                node.dim += 1
                node.refit()
            self.score(low)
        for node in leaves:
            node.state = REFINED

    def reset_surfaces(self) -> None:
        for node in (nodes := list({id(n): n for n in (self.root, *self.leaves())}.values())):
            node.refit()
        self.score(nodes[:1])
        if nodes[1:]:
            self.score(nodes[1:])

    def nodes(self, spark) -> DataFrame:
        """node_id, parent_id, label, state, r_dim, score, n in breadth-first order."""
        order: list[Node] = []
        self.walk(order.append, order.append)
        number = {id(n): i for i, n in enumerate(order)}
        rows = [(i, number.get(id(n.parent)), n.label if not n.children else None, STATES[n.state], n.dim, float(n.score), n.totals.n) for i, n in enumerate(order)]
        return spark.createDataFrame(rows, "node_id int, parent_id int, label int, state string, r_dim int, score double, n long")

    def leaf_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels and predictions (a column an output) of points."""
        label, value = np.empty(len(x), int), np.empty((len(x), self.root.f.shape[1]))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node.children:
                way = node.route(x[at])
                todo += [(child, at[way == j]) for j, child in enumerate(node.children)]
            else:
                label[at], value[at] = node.label, node.predict(x[at])
        return label, value

    def predict(self, df: DataFrame) -> DataFrame:
        """df with label, prediction (first output) and predictions (all): the tree travels with the tasks, rows are routed in Arrow batches."""
        tree = self

        def run(x: pd.Series) -> pd.DataFrame:
            label, value = tree.leaf_of(np.array(x.tolist(), float))
            return pd.DataFrame({"label": label, "prediction": value[:, 0], "predictions": value.tolist()})

        return df.withColumn("_p", F.pandas_udf(run, "struct<label:int,prediction:double,predictions:array<double>>")("x")).select("*", "_p.label", "_p.prediction", "_p.predictions").drop("_p")

    def predict_by_nearest(self, df: DataFrame, train: DataFrame) -> DataFrame:
        """Like predict, but a row belongs to the leaf of the nearest row of train instead of that of its own route. Both: row_id, x."""
        leaves = {leaf.label: leaf for leaf in self.leaves()}

        def run(x: pd.Series, label: pd.Series) -> pd.DataFrame:
            points, own = np.array(x.tolist(), float), label.to_numpy()
            value = np.empty((len(points), next(iter(leaves.values())).f.shape[1]))
            for k in np.unique(own):
                value[own == k] = leaves[k].predict(points[own == k])
            return pd.DataFrame({"prediction": value[:, 0], "predictions": value.tolist()})

        near = nearest_label(df.select("row_id", "x"), self.predict(train.select("row_id", "x")))
        out = df.join(near.withColumnRenamed("query_id", "row_id"), "row_id")
        return out.withColumn("_p", F.pandas_udf(run, "struct<prediction:double,predictions:array<double>>")("x", "label")).select("*", "_p.prediction", "_p.predictions").drop("_p")

    def compute_scores(self, test: DataFrame, custom: Callable[[Column, Column], Column] | None = None, nearest_to: DataFrame | None = None) -> float:
        """Mean over the outputs of R2 of the routed predictions, clipped to [0, 1].

        custom: an aggregate of (truth, predicted) instead, which is averaged over the outputs. nearest_to: rows that
        decide by the smallest distance which leaf a test row belongs to.
        """
        out = self.predict(test) if nearest_to is None else self.predict_by_nearest(test, nearest_to)
        truth = F.col("f") if dict(out.dtypes)["f"].startswith("array") else F.array("f")
        rows = out.select(F.posexplode(F.arrays_zip(truth.alias("f"), F.col("predictions").alias("p"))).alias("output", "v")).select("output", F.col("v.f").alias("f"), F.col("v.p").alias("p"))
        if custom:
            return float(rows.groupBy("output").agg(custom(F.col("f"), F.col("p")).alias("score")).agg(F.avg("score")).head()[0])
        left, spread = F.sum((F.col("f") - F.col("p")) ** 2), F.count("f") * F.var_pop("f")
        r2 = F.when(spread > 0, 1 - left / spread).otherwise(F.when(left > 0, 0.0).otherwise(1.0))
        return float(rows.groupBy("output").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)).alias("score")).agg(F.avg("score")).head()[0])

    def cluster_data(self, df: DataFrame) -> DataFrame:
        """x, label and the leaf's score and dimension: what a plot of the clusters needs."""
        info = [(n.label, float(n.score), n.dim) for n in self.leaves()]
        return self.predict(df).join(F.broadcast(df.sparkSession.createDataFrame(info, "label int, score double, r_dim int")), "label")


def lloyd(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """k-means labels with spread-out starts."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    centres = np.array(centres)
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return label


def _by_pooled(node: Node, children: list[Node], best: float, tol: float) -> tuple[bool, bool, float]:
    """Accepts a split whose pooled predictions beat the best so far."""
    score = sum((c.errors for c in children[1:]), children[0].errors).clipped_r2()
    better = score > max(best, node.score)
    return better, better and score >= tol, max(best, score)


def _by_mean(node: Node, children: list[Node], best: float, tol: float) -> tuple[bool, bool, float]:
    """Accepts a split whose mean score is better, and ends where all children reach the tolerance."""
    score = float(np.mean([c.score for c in children]))
    if all(c.score >= tol for c in children):
        return True, True, score
    return score > max(best, node.score), False, max(best, score)


def _by_force(node: Node, children: list[Node], best: float, tol: float) -> tuple[bool, bool, float]:
    """Like the mean, but the first split is always accepted."""
    score = float(np.mean([c.score for c in children]))
    if all(c.score >= tol for c in children):
        return True, True, score
    return not node.children or score > best, False, max(best, score)


PRIORITIES = {"global": _by_pooled, "mean": _by_mean, "force": _by_force}
