"""Shared feature statistics and the scalers built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from profuse.operators.small import settle

KEYS = ["profile", "feature"]


def feature_stats(cells: DataFrame) -> DataFrame:
    """One aggregate serves the audit, both variance filters and all scalers."""
    v = F.col("value")
    return cells.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop"), F.var_samp(v).alias("var_samp"),
    )


def log_pseudo(value: Column) -> Column:
    return F.log2(value + F.lit(1.0))


def log10(value: Column) -> Column:
    return F.log10(value)


@dataclass
class Scaler:
    """Fitted scaler: a settled table (profile, feature, centre, width)."""

    stats: DataFrame
    lo: float = 0.0
    hi: float = 1.0

    def transform(self, cells: DataFrame) -> DataFrame:
        """Row-wise, so it also applies to a streaming DataFrame.

        Cells of a feature that was not fitted stay, with value NULL.
        """
        scaled = (F.col("value") - F.col("centre")) / F.col("width") * F.lit(self.hi - self.lo) + F.lit(self.lo)
        if (self.lo, self.hi) == (0.0, 1.0):
            scaled = (F.col("value") - F.col("centre")) / F.col("width")
        return cells.join(self.stats, KEYS, "left").withColumn("value", scaled).drop("centre", "width")


def _width(w: Column) -> Column:
    return F.when(w == 0.0, F.lit(1.0)).otherwise(w)


def fit_zscore(cells: DataFrame) -> Scaler:
    """Population standard deviation; a constant feature maps to 0."""
    stats = cells.groupBy(*KEYS).agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("sd"),
                                     F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    return Scaler(settle(stats.select(
        *KEYS, F.when(flat, F.col("lo")).otherwise(F.col("centre")).alias("centre"),
        F.when(flat, F.lit(1.0)).otherwise(_width(F.col("sd"))).alias("width"))))


def fit_minmax(cells: DataFrame, lo: float = 0.0, hi: float = 1.0) -> Scaler:
    """[lo, hi] per feature; a constant feature maps to ``lo``."""
    stats = cells.groupBy(*KEYS).agg(F.min("value").alias("centre"), F.max("value").alias("top"))
    return Scaler(settle(stats.select(*KEYS, "centre", _width(F.col("top") - F.col("centre")).alias("width"))), lo, hi)


def zscore(cells: DataFrame) -> DataFrame:
    return fit_zscore(cells).transform(cells)


def minmax(cells: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    return fit_minmax(cells, lo, hi).transform(cells)


def log_scale(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", log_pseudo(F.col("value")))
