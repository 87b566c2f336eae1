"""Packed bundles: one array of values per sample plus a vector of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def unpack(bundle: DataFrame, symbols: DataFrame, values: str = "embedding", sample: str = "vec_id") -> DataFrame:
    """Named cells from packed arrays.

    ``symbols(pos, feature)`` holds one row per position; the join is an
    ordinary one and Spark broadcasts the side when its size allows.
    """
    cells = bundle.select(F.col(sample).cast("string").alias("sample_id"), F.posexplode(values).alias("pos", "value"))
    return cells.join(symbols, "pos").select("sample_id", "feature", F.col("value").cast("double").alias("value"))


def symbol_table(bundle: DataFrame, values: str = "embedding", stem: str = "dim_") -> DataFrame:
    """Position names for a bundle that carries no symbol vector of its own."""
    width = bundle.agg(F.max(F.size(values)).alias("width"))
    return width.select(F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pos")).select(
        "pos", F.concat(F.lit(stem), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("feature")
    )
