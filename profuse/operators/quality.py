"""Missing-value audit, fills and variance filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from profuse.operators.rank import key_bucket, split_points
from profuse.operators.scale import KEYS
from profuse.operators.small import join_small


def drop_empty_features(cells: DataFrame) -> DataFrame:
    """Remove features without a single value."""
    alive = cells.groupBy(*KEYS).agg(F.count("value").alias("n")).filter(F.col("n") > 0)
    return join_small(cells, alive.select(*KEYS), KEYS, "left_semi")


def audit_missing(cells: DataFrame) -> DataFrame:
    """Missing cells per profile, counting absent cells of the sample x feature grid; repeated cells count once.

    The grid is not built: its size is samples times features.
    """
    samples = cells.select("profile", "sample_id").distinct().groupBy("profile").agg(F.count("*").alias("n_samples"))
    single = cells.groupBy(*KEYS, "sample_id").agg(F.max("value").alias("value"))
    features = single.groupBy(*KEYS).agg(F.count("value").alias("n"))
    per = features.groupBy("profile").agg(F.count("*").alias("n_features"), F.sum("n").alias("n_present"))
    grid = F.col("n_samples") * F.col("n_features")
    return samples.join(per, "profile").select(
        "profile", "n_samples", "n_features", (grid - F.col("n_present")).alias("n_missing"),
        (grid > F.col("n_present")).alias("any_missing"),
    )


def fill_constant(cells: DataFrame, constant: float) -> DataFrame:
    return cells.withColumn("value", F.coalesce(F.col("value"), F.lit(float(constant))))


def fill_mean(cells: DataFrame) -> DataFrame:
    """Feature mean in every gap (aggregate and join, not one window per feature)."""
    means = cells.groupBy(*KEYS).agg(F.avg("value").alias("_mean"))
    return join_small(cells, means, KEYS).withColumn("value", F.coalesce("value", "_mean")).drop("_mean")


def fill_along(cells: DataFrame, method: str = "ffill") -> DataFrame:
    """Carry the last (``ffill``) or next (``bfill``) value along the sample order.

    A feature's samples are cut into runs; each run is filled by itself and
    takes the value carried over its edge from a table with one row per feature
    and run.  No task ever holds a whole feature.
    """
    forward = method == "ffill"
    if not forward and method != "bfill":
        raise ValueError("method is 'ffill' or 'bfill'")
    marked = cells.withColumn("_run", key_bucket("sample_id", split_points(cells, "sample_id")))
    inside = Window.partitionBy(*KEYS, "_run").orderBy("sample_id")
    pick = F.max_by if forward else F.min_by
    edges = marked.groupBy(*KEYS, "_run").agg(
        pick(F.col("value"), F.when(F.col("value").isNotNull(), F.col("sample_id"))).alias("_edge")
    )
    runs = Window.partitionBy(*KEYS).orderBy("_run")
    if forward:
        carried = F.last("_edge", ignorenulls=True).over(runs.rowsBetween(Window.unboundedPreceding, -1))
        own = F.last("value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    else:
        carried = F.first("_edge", ignorenulls=True).over(runs.rowsBetween(1, Window.unboundedFollowing))
        own = F.first("value", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    table = edges.select(*KEYS, "_run", carried.alias("_carried"))
    return (
        marked.withColumn("_own", own).join(table, [*KEYS, "_run"])
        .withColumn("value", F.coalesce("_own", "_carried")).drop("_own", "_carried", "_run")
    )


def keep_var_samp(cells: DataFrame, threshold: float, pattern: str | None = None) -> DataFrame:
    """Features with sample variance >= threshold; features off the platform pass."""
    scope = cells if pattern is None else cells.filter(F.col("feature").rlike(pattern))
    low = scope.groupBy(*KEYS).agg(F.var_samp("value").alias("v")).filter(
        (F.col("v") < threshold) | F.col("v").isNull()
    )
    return join_small(cells, low.select(*KEYS), KEYS, "left_anti")


def keep_var_pop(cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Features with population variance > threshold."""
    kept = cells.groupBy(*KEYS).agg(F.var_pop("value").alias("v")).filter(F.col("v") > threshold)
    return join_small(cells, kept.select(*KEYS), KEYS, "left_semi")


def keep_sample_var(cells: DataFrame, threshold: float) -> DataFrame:
    """Samples whose values vary by at least ``threshold`` (sample variance)."""
    kept = cells.groupBy("profile", "sample_id").agg(F.var_samp("value").alias("v")).filter(F.col("v") >= threshold)
    return cells.join(kept.select("profile", "sample_id"), ["profile", "sample_id"], "left_semi")


def consensus(cells: DataFrame, threshold: float, fill: float = 0.0) -> DataFrame:
    """Fill gaps, then filter features and samples by variance."""
    return keep_sample_var(keep_var_samp(fill_constant(cells, fill), threshold), threshold)
