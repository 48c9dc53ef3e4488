"""Helpers that the text operators share: shared storage, batches, hashing."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as arrays at once.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (tests) gets one of its own; on a cluster that would be a folder of one machine only.
    """
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="gradlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors. Removed by discard, or at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gradlens-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._gradlens_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    _remove(df.sparkSession, df._gradlens_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has gone already
        pass


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about `most` bytes; a longer row is a range of its own."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def trim() -> None:
    """Gives free memory back to the system: a Python worker lives on after its task, beside an executor that needs the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freed(f: Callable) -> Callable:
    """f for applyInArrow (one to three arguments) or, as a generator of batches, for mapInArrow; trims when it is through."""
    if inspect.isgeneratorfunction(f):

        def batches(given):
            try:
                yield from f(given)
            finally:
                trim()

        return batches

    def one(t):
        out = f(t)
        trim()
        return out

    def two(key, t):
        out = f(key, t)
        trim()
        return out

    def three(key, a, b):
        out = f(key, a, b)
        trim()
        return out

    return (one, two, three)[len(inspect.signature(f).parameters) - 1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def null_safe_key(column: str):
    """A join key for an id that may be null: text, with null apart from every number."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))
