"""Between long cells and dense vectors.

A vector table is ``(sample_id, x array<double>)`` plus the tuple of feature
names that gives the order of ``x``.  The names are metadata, like a schema.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profuse.operators.rank import key_rank

MAX_FEATURES = 65_536


def feature_names(cells: DataFrame) -> tuple[str, ...]:
    """Sorted feature names; refuses a dictionary that would not fit the driver."""
    rows = cells.select("feature").distinct().limit(MAX_FEATURES + 1).collect()
    if len(rows) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features: filter by variance or whitelist first")
    return tuple(sorted(r[0] for r in rows))


def to_vectors(cells: DataFrame, names: Sequence[str], fill: float | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
    """One dense vector per sample; gaps become ``fill`` or stay NULL.

    Every sample of ``cells`` gets a vector, also one without any value or with
    none of the named features.  NaN reads as a gap; the largest of repeated
    cells counts.  (position, value) pairs, at most one per feature, are
    collected and scattered with numpy.
    """
    dictionary = cells.sparkSession.createDataFrame(
        [(n, i) for i, n in enumerate(names)], "feature string, idx int")
    value = F.when(~F.isnan("value"), F.col("value").cast("double"))
    single = cells.withColumn("value", value).join(F.broadcast(dictionary), "feature", "left").groupBy(
        "sample_id", *keep, "idx").agg(F.max("value").alias("value"))  # repeated cells never pile up in a list
    used = F.col("idx").isNotNull() & F.col("value").isNotNull()
    packed = single.groupBy("sample_id", *keep).agg(
        F.collect_list(F.when(used, F.col("idx"))).alias("idx"), F.collect_list(F.when(used, F.col("value"))).alias("val"))
    width, gap = len(names), np.nan if fill is None else float(fill)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, val = batch.column("idx"), batch.column("val")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(idx.offsets.to_numpy()))
            dense = np.full((batch.num_rows, width), gap)
            dense[rows, idx.flatten().to_numpy()] = val.flatten().to_numpy()
            columns = [batch.column(c) for c in ("sample_id", *keep)]
            flat = pa.array(dense.ravel(), from_pandas=fill is None)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, flat)],
                                             ["sample_id", *keep, "x"])

    types = dict(packed.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ("sample_id", *keep)) + ", x array<double>"
    return packed.mapInArrow(scatter, schema)


def to_cells(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named long cells from vectors."""
    labels = F.array(*[F.lit(n) for n in names])
    return vectors.select("sample_id", F.posexplode("x").alias("pos", "value")).select(
        "sample_id", labels[F.col("pos")].alias("feature"), "value"
    )


def fill_grid(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Every sample x feature cell, absent ones as NULL (per profile)."""
    if names is None:
        names = feature_names(cells)
    vectors = to_vectors(cells, names, keep=("profile",))
    labels = F.array(*[F.lit(n) for n in names])
    return vectors.select("profile", "sample_id", F.posexplode("x").alias("pos", "value")).select(
        "profile", "sample_id", labels[F.col("pos")].alias("feature"), "value"
    )


def transpose(cells: DataFrame) -> DataFrame:
    """Swap the two axes: in the long layout only the keys change roles."""
    return cells.select("profile", F.col("feature").alias("sample_id"), F.col("sample_id").alias("feature"), "value")


def stack_response(cells: DataFrame, response: DataFrame, column: str, profile: str) -> DataFrame:
    """The response as one more feature of a profile."""
    extra = response.select(
        F.lit(profile).alias("profile"), "sample_id", F.lit(column).alias("feature"), F.col(column).alias("value"))
    return cells.unionByName(extra)


def renumber(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Replace labels by row numbers 0..n-1 in label order."""
    return key_rank(df, key).withColumn("row", F.col("rank") - 1).drop("rank", "n", key)
