"""Hamiltonian Monte Carlo: independent chains, one task each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def hmc_chain(log_density: Callable[[np.ndarray], float], gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, samples: int, burn_in: int, step: float = 0.1, leaps: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Samples after burn-in, and the share of accepted proposals."""
    rng = np.random.default_rng(seed)
    x, out, accepted = np.asarray(start, float), [], 0
    now = log_density(x)
    for k in range(samples + burn_in):
        p = rng.standard_normal(len(x))
        y, q = x.copy(), p + 0.5 * step * gradient(x)
        for leap in range(leaps):
            y = y + step * q
            q = q + (step if leap + 1 < leaps else 0.5 * step) * gradient(y)
        then = log_density(y)
        if np.log(rng.random()) < then - now - 0.5 * (q @ q - p @ p):
            x, now = y, then
            accepted += 1
        if k >= burn_in:
            out.append(x)
    return np.array(out), accepted / (samples + burn_in)


def hmc(spark: SparkSession, log_density: Callable, gradient: Callable, starts: np.ndarray, samples: int, burn_in: int, step: float = 0.1, leaps: int = 20, seed: int = 0) -> DataFrame:
    """chain, draw, x, accepted of independent chains."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        x, rate = hmc_chain(log_density, gradient, np.array(pdf["start"].iloc[0]), samples, burn_in, step, leaps, seed + chain)
        return pd.DataFrame({"chain": chain, "draw": np.arange(len(x)), "x": x.tolist(), "accepted": rate})

    chains = spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(np.atleast_2d(starts))], "chain int, start array<double>")
    return chains.groupBy("chain").applyInPandas(run, "chain int, draw int, x array<double>, accepted double")
