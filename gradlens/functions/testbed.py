"""Closed-form functions with their gradients, as Column expressions and in NumPy: fixtures for every operator."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(x: str, i: int) -> Column:
    return F.get(x, F.lit(i))


def wave(x: str) -> tuple[Column, Column]:
    """0.5 sin(2 pi (x0 + x1)) + 1: one active direction, (1, 1)."""
    t = 2 * math.pi * (_at(x, 0) + _at(x, 1))
    slope = math.pi * F.cos(t)
    return 0.5 * F.sin(t) + 1.0, F.array(slope, slope)


def bump(x: str) -> tuple[Column, Column]:
    """exp(-(x0 - 0.5)^2 - x1^2)."""
    f = F.exp(-((_at(x, 0) - 0.5) ** 2) - _at(x, 1) ** 2)
    return f, F.array(-2 * (_at(x, 0) - 0.5) * f, -2 * _at(x, 1) * f)


def cubic(x: str) -> tuple[Column, Column]:
    """x0^3 + x1^3 + 0.2 x0 + 0.6 x1."""
    a, b = _at(x, 0), _at(x, 1)
    return a**3 + b**3 + 0.2 * a + 0.6 * b, F.array(3 * a**2 + 0.2, 3 * b**2 + 0.6)


def radial(x: str) -> tuple[Column, Column]:
    """cos(|x|^2): no linear active subspace."""
    r = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    return F.cos(r), F.transform(x, lambda v: -2 * v * F.sin(r))


def quartic(x: str) -> tuple[Column, Column]:
    """x0^4 - x1^4."""
    a, b = _at(x, 0), _at(x, 1)
    return a**4 - b**4, F.array(4 * a**3, -4 * b**3)


def paraboloid(x: str) -> tuple[Column, Column]:
    """Sum of fourth powers, in any number of parameters."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v * v * v), F.transform(x, lambda v: 4 * v * v * v)


FUNCTIONS = {"wave": wave, "bump": bump, "cubic": cubic, "radial": radial, "quartic": quartic, "paraboloid": paraboloid}


def evaluated(df: DataFrame, name: str, x_col: str = "x") -> DataFrame:
    """df with f and g of one of FUNCTIONS."""
    f, g = FUNCTIONS[name](x_col)
    return df.withColumn("f", f).withColumn("g", g)


@dataclass(frozen=True)
class GradientError:
    absolute: float
    relative: float


def gradient_error(df: DataFrame, exact: str, estimated: str) -> GradientError:
    """Mean distance of gradients, and relative to the mean length of the exact ones. One aggregation."""
    off = F.sqrt(F.aggregate(F.zip_with(exact, estimated, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    size = F.sqrt(F.aggregate(exact, F.lit(0.0), lambda s, v: s + v * v))
    r = df.agg(F.avg(off).alias("off"), F.avg(size).alias("size")).head()
    return GradientError(r["off"], r["off"] / r["size"])
