"""Active subspaces: the directions along which an output varies most on average."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.functions import linalg
from gradlens.functions.exprs import project
from gradlens.functions.linalg import NotFitted
from gradlens.operators.bootstrap import bootstrap
from gradlens.operators.moments import eigenpairs, sketch
from gradlens.operators.neighbors import local_linear_gradients


#: Parameters above which the leading pairs may come from a randomized decomposition.
RANDOMIZED_PARAMETERS = 500


@dataclass
class Subspace:
    """What all subspace models have: a spectrum, its vectors and the split into active and inactive ones."""

    dim: int | float = 0
    method: str = "exact"
    n_boot: int | None = 100
    evals: np.ndarray | None = field(default=None, init=False)
    evects: np.ndarray | None = field(default=None, init=False)
    evals_br: np.ndarray | None = field(default=None, init=False)
    subs_br: np.ndarray | None = field(default=None, init=False)
    W1: np.ndarray | None = field(default=None, init=False)
    W2: np.ndarray | None = field(default=None, init=False)

    def fit(self, *args, **kwargs):
        raise NotImplementedError(f"{type(self).__name__}.fit")

    def transform(self, *args, **kwargs):
        raise NotImplementedError(f"{type(self).__name__}.transform")

    def inverse_transform(self, *args, **kwargs):
        raise NotImplementedError(f"{type(self).__name__}.inverse_transform")

    def set_spectrum(self, evals: np.ndarray, evects: np.ndarray):
        self.evals, self.evects = evals, evects
        self.dim = linalg.choose_dim(self.dim, evals)
        self.W1, self.W2 = linalg.split(evects, self.dim)
        return self

    def require_fit(self) -> None:
        if self.evects is None:
            raise NotFitted("fit comes first")

    def spectrum(self, spark) -> DataFrame:
        """idx, eval, evect."""
        self.require_fit()
        rows = [(i, float(self.evals[i, 0]), self.evects[:, i].tolist()) for i in range(self.evects.shape[1])]
        return spark.createDataFrame(rows, "idx int, eval double, evect array<double>")


@dataclass
class ActiveSubspaces(Subspace):
    """fit(df) on gradients (column g), on gradients estimated from x and f (method="local"), or by a sketch (method="sketch")."""

    def fit(self, df: DataFrame, g_col: str = "g", weight_col: str | None = None, metric: np.ndarray | None = None, x_col: str = "x", f_col: str = "f", id_col: str = "row_id", seed: int = 42) -> ActiveSubspaces:
        held = None
        if self.method == "local":
            missing = [c for c in (x_col, f_col) if c not in df.columns]
            if missing:
                raise TypeError(f"inputs and outputs are needed: {missing}")
            held = df = local_linear_gradients(df, seed=seed, id_col=id_col, x_col=x_col, f_col=f_col).persist()
            g_col, weight_col, id_col = "g", None, "sample"
        elif g_col not in df.columns:
            raise TypeError("gradients are needed")
        if self.method == "sketch":  # a sketch has no row left to draw
            if not isinstance(self.dim, int) or self.dim < 1:
                raise ValueError("a sketch has a set size")
            evals, evects = sketch(df, self.dim, g_col).eigenpairs()
            return self.set_spectrum(evals, evects)
        m = len(df.select(g_col).head()[0])
        nested = dict(df.dtypes)[g_col].startswith("array<array")
        # Forming the moment matrix is the cheap part here; only decomposing a large one is worth an approximation.
        randomized = self.dim if not nested and m > RANDOMIZED_PARAMETERS and linalg.prefers_randomized(df.count(), m, self.dim) else None
        evals, evects = eigenpairs(df, g_col, weight_col, metric, randomized_dim=randomized)
        if self.n_boot and evects.shape[0] == evects.shape[1] > 1:
            self.evals_br, self.subs_br = bootstrap(df, evects, g_col, weight_col, self.n_boot, seed, id_col, metric)
        if held is not None:
            held.unpersist()
        return self.set_spectrum(evals, evects)

    @property
    def activity_scores(self) -> np.ndarray:
        """Per parameter: squared components of the active vectors, weighted by their eigenvalues."""
        self.require_fit()
        return (self.W1**2) @ self.evals[: self.dim, 0]

    def transform(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        """df with `active`, and `inactive` (null without a complete basis)."""
        self.require_fit()
        inactive = project(x_col, self.W2) if self.W2 is not None else F.lit(None).cast("array<double>")
        return df.withColumn("active", project(x_col, self.W1)).withColumn("inactive", inactive)

    def inverse_transform(self, df: DataFrame, n_points: int = 1, y_col: str = "active", id_col: str = "row_id", seed: int = 42) -> DataFrame:
        """id, sample, x: n_points points of the box [-1, 1]^m for each reduced point. Seeded by row."""
        self.require_fit()
        w1, w2 = self.W1, self.W2 if self.W2 is not None else linalg.complement(self.W1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in points_of(batches, w1, w2, n_points, seed):
                n, m = len(x), w1.shape[0]
                flat = pa.array(np.ascontiguousarray(x).ravel())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_points * m + 1, m, dtype=np.int32)), flat)
                samples = pa.array(np.tile(np.arange(n_points, dtype=np.int32), n))
                yield pa.record_batch([batch.column("id").take(pa.array(np.repeat(np.arange(n), n_points))), samples, rows], names=[id_col, "sample", "x"])

        kind = dict(df.dtypes)[id_col]
        return self._asked(df, y_col, id_col).mapInArrow(run, f"{id_col} {kind}, sample int, x array<double>")

    def inverse_mean(self, df: DataFrame, value: Callable[[np.ndarray], np.ndarray], n_points: int = 1, y_col: str = "active", id_col: str = "row_id", seed: int = 42) -> DataFrame:
        """id, mean of value (rows of x to numbers) over the points that inverse_transform gives. Points don't leave their task; rows of one id count together."""
        self.require_fit()
        w1, w2 = self.W1, self.W2 if self.W2 is not None else linalg.complement(self.W1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in points_of(batches, w1, w2, n_points, seed):
                v = np.asarray(value(x.reshape(-1, x.shape[2])), float).reshape(len(x), n_points)
                yield pa.record_batch([batch.column("id"), pa.array(np.cumsum(v, axis=1)[:, -1])], names=[id_col, "total"])

        kind = dict(df.dtypes)[id_col]
        sums = self._asked(df, y_col, id_col).mapInArrow(run, f"{id_col} {kind}, total double")
        return sums.groupBy(id_col).agg((F.sum("total") / (F.count("*") * n_points)).alias("mean"))

    @staticmethod
    def _asked(df: DataFrame, y_col: str, id_col: str) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("k"), F.col(y_col).cast("array<double>").alias("y"))


#: Numbers of points that a task holds at once, about.
POINT_NUMBERS = 1_000_000


def points_of(batches: Iterator[pa.RecordBatch], w1: np.ndarray, w2: np.ndarray, n: int, seed: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches (id, k, y) with their points, (rows, n, m)."""
    step = max(1, POINT_NUMBERS // (n * w1.shape[0]))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            keys = batch.column("k").to_numpy() & (2**63 - 1)
            x = interval_points(y, w1, w2, n, seed, keys) if w2.shape[1] == 1 else None
            if x is None:
                x = np.array([full_points(v, w1, w2, n, np.random.default_rng([seed, int(k)])) for v, k in zip(y, keys)])
            yield batch, x


def interval_points(y: np.ndarray, w1: np.ndarray, w2: np.ndarray, n: int, seed: int, keys: np.ndarray) -> np.ndarray:
    """full_points of many rows at once where one coordinate is free, so that points fill an interval: the same numbers, row by row."""
    base = y @ w1.T
    c = w2[:, 0]
    a, b = np.concatenate([c, -c]), np.column_stack([-1 - base, base - 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = b / a
    lower = np.max(ends[:, a > 0], axis=1, initial=-np.inf)
    upper = np.min(ends[:, a < 0], axis=1, initial=np.inf)
    gap = lower - upper
    corner = (gap > 0) & (gap < 1e-9)
    lower = np.where(corner, (lower + upper) / 2, lower)
    upper = np.where(corner, lower, upper)
    z = uniform(seed, keys, n)
    z = (lower[:, None] + (upper - lower)[:, None] * z).clip(lower[:, None], upper[:, None])
    x = base[:, None, :] + z[:, :, None] * c
    for i in np.flatnonzero((lower > upper) | ~np.isfinite(lower) | ~np.isfinite(upper)):  # no point inside: as a single row is treated
        x[i] = full_points(y[i], w1, w2, n, np.random.default_rng([seed, int(keys[i])]))
    return x


def uniform(seed: int, keys: np.ndarray, n: int) -> np.ndarray:
    """np.random.default_rng([seed, key]).random(n) of each key, for all keys at once: NumPy's SeedSequence and PCG64 over arrays."""
    keys = keys.astype(np.uint64)
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    words, seed = [], int(seed)
    while seed or not words:
        words.append(np.full(len(keys), seed & 0xFFFFFFFF, np.uint32))
        seed >>= 32
    # A key below 2 ** 32 is one word: up to four words in all, a missing one counts as zero.
    if len(words) > 2:
        raise ValueError("a seed has up to 64 bits")
    words += [low, high]
    words += [np.zeros(len(keys), np.uint32)] * (4 - len(words))
    const = 0x43B0D7E5

    def hashed(v: np.ndarray) -> np.ndarray:
        nonlocal const
        v = v ^ np.uint32(const)
        const = const * 0x931E8875 & 0xFFFFFFFF
        v = v * np.uint32(const)
        return v ^ (v >> np.uint32(16))

    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = a * np.uint32(0xCA01F9DD) - b * np.uint32(0x4973F715)
        return v ^ (v >> np.uint32(16))

    pool = [hashed(w) for w in words]
    for i in range(4):
        for j in range(4):
            if i != j:
                pool[j] = mixed(pool[j], hashed(pool[i]))
    const, state = 0x8B51F9DD, []
    for i in range(8):
        v = pool[i % 4] ^ np.uint32(const)
        const = const * 0x58F38DED & 0xFFFFFFFF
        v = v * np.uint32(const)
        state.append((v ^ (v >> np.uint32(16))).astype(np.uint64))
    start_high, start_low, way_high, way_low = (state[2 * i] | (state[2 * i + 1] << np.uint64(32)) for i in range(4))
    one, u63 = np.uint64(1), np.uint64(63)
    step_high, step_low = (way_high << one) | (way_low >> u63), (way_low << one) | one

    def add(ah, al, bh, bl):
        out = al + bl
        return ah + bh + (out < al).astype(np.uint64), out

    factor_high, factor_low = np.uint64(2549297995355413924), np.uint64(4865540595714422341)
    mask, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    f0, f1 = factor_low & mask, factor_low >> half

    def turn(h, low):
        a0, a1 = low & mask, low >> half
        p00, p01, p10, p11 = a0 * f0, a0 * f1, a1 * f0, a1 * f1
        middle = (p00 >> half) + (p01 & mask) + (p10 & mask)
        carried = p11 + (p01 >> half) + (p10 >> half) + (middle >> half)
        return add(carried + h * factor_low + low * factor_high, low * factor_low, step_high, step_low)

    h, low = turn(*add(step_high, step_low, start_high, start_low))
    out = np.empty((len(keys), n))
    for j in range(n):
        h, low = turn(h, low)
        v, r = h ^ low, h >> np.uint64(58)
        v = (v >> r) | (v << ((np.uint64(64) - r) & u63))
        out[:, j] = (v >> np.uint64(11)) * (1.0 / 2**53)
    return out


def full_points(y: np.ndarray, w1: np.ndarray, w2: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n points x of the box with W1' x = y: rejection in a bounding box, and hit-and-run where too few are accepted."""
    base = w1 @ np.ravel(y)
    if not w2.shape[1]:
        return np.tile(base, (n, 1))
    a, b = np.vstack([w2, -w2]), np.concatenate([-1 - base, base - 1])
    z = rejection(a, b, n, rng)
    if z is None:
        z = hit_and_run(a, b, n, rng)
    return base + z @ w2.T


def rejection(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator, tries: int = 50) -> np.ndarray | None:
    """n points with a z >= b out of tries * n in the polytope's bounding box, or None if fewer are inside."""
    d = a.shape[1]
    lower, upper = np.empty(d), np.empty(d)
    if d == 1:  # an interval needs no program
        c = a[:, 0]
        lower[0] = np.max(b[c > 0] / c[c > 0], initial=-np.inf)
        upper[0] = np.min(b[c < 0] / c[c < 0], initial=np.inf)
        if 0 < lower[0] - upper[0] < 1e-9:  # a corner, up to rounding
            lower[0] = upper[0] = (lower[0] + upper[0]) / 2
        if lower[0] > upper[0] or not np.isfinite([lower[0], upper[0]]).all():
            return None
        return (lower + (upper - lower) * rng.random((n, 1))).clip(lower, upper)
    for i in range(d):
        e = np.eye(d)[i]
        lower[i] = linalg.linear_program(e, a, b)[i]
        upper[i] = linalg.linear_program(-e, a, b)[i]
    z = lower + (upper - lower) * rng.random((tries * n, d))
    inside = z[(z @ a.T >= b).all(1)]
    return inside[:n] if len(inside) >= n else None


def hit_and_run(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator, eps: float = 2.5e-7) -> np.ndarray:
    """A chain of n points with a z >= b from the centre of the largest ball inside. A chain that is stuck repeats its point."""
    norms = np.linalg.norm(a, axis=1)
    centre = linalg.linear_program(np.append(np.zeros(a.shape[1]), -1.0), np.column_stack([a, -norms]), b)[:-1]
    z, out = centre, []
    for _ in range(n):
        for _ in range(50):
            way = rng.standard_normal(len(z))
            if (a @ (z + eps * way) >= b).all():
                break
        else:
            out += [z] * (n - len(out))
            break
        slack, rate = a @ z - b, a @ way
        tight = slack < np.sqrt(np.finfo(float).eps)
        up = np.where((rate < 0) & ~tight, -slack / np.where(rate < 0, rate, 1), np.inf).min()
        down = np.where((rate > 0) & ~tight, -slack / np.where(rate > 0, rate, 1), -np.inf).max()
        z = z + rng.uniform(down, up) * way
        out.append(z)
    return np.array(out)
