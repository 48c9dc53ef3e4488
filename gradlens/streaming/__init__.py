"""Gradient streams: running moments and a running sketch, one micro-batch after another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.functions.linalg import sorted_eigenpairs
from gradlens.operators.moments import FrequentDirections, entries, from_row, moment_aggregates, sketch


def running_moments(stream: DataFrame, m: int, column: str = "g", window: str | None = None, time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """n and the moment matrix's averages over all of a stream, or by event-time window with a watermark."""
    aggs = [F.count("*").alias("n"), *moment_aggregates(column, m)]
    if window is None:
        return stream.groupBy().agg(*aggs)
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window)).agg(*aggs)


class StreamingSubspace:
    """foreachBatch target. The state is one matrix of sums or one sketch; a batch that comes again is not counted twice."""

    def __init__(self, m: int, column: str = "g", sketch_size: int | None = None) -> None:
        self.m, self.column = m, column
        self.sums, self.n, self.last = np.zeros((m, m)), 0, -1
        self.directions = FrequentDirections(sketch_size, m) if sketch_size else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.last:
            return
        if self.directions is not None:
            if not batch.isEmpty():
                self.directions.merge(sketch(batch, self.directions.size, self.column))
        else:
            r = batch.agg(F.count("*").alias("n"), *moment_aggregates(self.column, self.m, F.lit(1.0))).head()
            self.n += r["n"]
            self.sums += from_row(r, self.m)
        self.last = epoch

    def eigenpairs(self) -> tuple[np.ndarray, np.ndarray]:
        if self.directions is not None:
            return self.directions.eigenpairs()
        return sorted_eigenpairs(self.sums / max(self.n, 1))


__all__ = ["StreamingSubspace", "entries", "running_moments"]
