"""Arrow and numpy glue for vector columns, and distributed sums of arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

# Rows of partial sums: one row per group and matrix row, summed by Spark.
PARTIAL_SCHEMA = "grp string, i int, v array<double>"
PARTIAL_ARROW = pa.schema([("grp", pa.string()), ("i", pa.int32()), ("v", pa.list_(pa.float64()))])


def matrix_of(array: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a (rows, width) array; NULL entries become NaN, NULL lists are refused."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        raise ValueError("a vector column holds NULL; drop or fill those rows first")
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(array) == 0:
        return np.zeros((0, width or 0))
    return flat.reshape(len(array), -1)


def numbers_of(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


BLOCK = 1_024  # rows whose products stay in a core's cache


def row_blocks(n: int, size: int = BLOCK) -> Iterator[slice]:
    return (slice(a, min(a + size, n)) for a in range(0, n, size))


def list_of(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def vector_to_number(function: Callable[[np.ndarray], np.ndarray], column: str | Column = "x") -> Column:
    """Apply a (rows, p) -> (rows,) numpy function to a vector column."""

    @F.arrow_udf("double")
    def apply(x: pa.Array) -> pa.Array:
        return pa.array(np.asarray(function(matrix_of(x)), dtype=np.float64)) if len(x) else pa.array([], pa.float64())

    return apply(column)


def vector_to_vector(function: Callable[[np.ndarray], np.ndarray], column: str | Column = "x") -> Column:
    """Apply a (rows, p) -> (rows, q) numpy function to a vector column."""

    @F.arrow_udf("array<double>")
    def apply(x: pa.Array) -> pa.Array:
        return list_of(function(matrix_of(x))) if len(x) else pa.array([], pa.list_(pa.float64()))

    return apply(column)


def dot_column(weights: Sequence[float], intercept: float = 0.0, column: str = "x") -> Column:
    """x . w + b on the JVM."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    products = F.zip_with(F.col(column), w, lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(intercept)), lambda s, v: s + v)


def sum_partials(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Reduce per-task matrices by name.

    ``partial`` folds a task's batches into ``{name: matrix}``.  Every matrix row
    travels as one record and rows with the same place are summed by Spark, so
    the reduction is spread over matrix rows and only the result is collected.

    A task sends its whole sums whatever its input size.  For wide matrices on
    very many splits set ``spark.profuse.partialTasks``: the scan then runs in at
    most that many tasks (splits are merged without a shuffle).
    """
    tasks = df.sparkSession.conf.get("spark.profuse.partialTasks", None)
    if tasks is not None:
        df = df.coalesce(int(tasks))

    def emit(batches):
        for name, matrix in partial(batches).items():
            matrix = np.atleast_2d(matrix)
            n = len(matrix)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), list_of(matrix)], schema=PARTIAL_ARROW)

    parts = df.mapInArrow(emit, PARTIAL_SCHEMA)
    total = parts.groupBy("grp", "i").agg(Summarizer.sum(array_to_vector(F.col("v"))).alias("v")).collect()
    found: dict[str, dict[int, np.ndarray]] = {}
    for row in total:
        found.setdefault(row["grp"], {})[row["i"]] = row["v"].toArray()
    return {name: np.vstack([rows[i] for i in sorted(rows)]) for name, rows in found.items()}


def mixed_hash(base: np.ndarray, stream: int) -> np.ndarray:
    """Second hash of 64-bit row hashes (splitmix64 finaliser), one per stream."""
    with np.errstate(over="ignore"):
        z = base.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(stream + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mixed_uniform(base: np.ndarray, stream: int) -> np.ndarray:
    return (mixed_hash(base, stream) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def row_hash(seed, key: str = "sample_id") -> Column:
    return F.xxhash64(F.lit(str(seed)), F.col(key))


def poisson_weights(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from uniforms: bootstrap weights of rows."""
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 18)]))
    return np.searchsorted(steps, u, side="right").astype(np.float64)
