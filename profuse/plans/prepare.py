"""Preparation plans and the design matrix the models read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from profuse.operators import align, impute, labels, quality, reshape, scale, split
from profuse.operators.small import join_small
from profuse.operators.rank import block_of, hash_rank
from profuse.session import stored
from profuse.sources import standin


def impute_profile(cells: DataFrame, method: str) -> DataFrame:
    """Complete the grid of one profile by feature means or by a low-rank fit."""
    names = reshape.feature_names(cells)
    if method == "mean":
        return quality.fill_mean(reshape.fill_grid(cells, names))
    if method == "low_rank":
        profile = cells.select("profile").first()[0]
        vectors = impute.soft_impute(reshape.to_vectors(cells, names)).transform(mode="reconstruct")
        return reshape.to_cells(vectors, names).withColumn("profile", F.lit(profile))
    raise ValueError("method is 'mean' or 'low_rank'")


def prepare(profiles: dict[str, DataFrame], logged: Sequence[str], whitelist: DataFrame, listed: Sequence[str],
            first: dict[str, int], threshold: float = 0.001, method: str = "mean") -> DataFrame:
    """Impute and scale, filter by variance, then choose features.

    Profiles in ``logged`` are log-scaled and not imputed; ``listed`` ones keep
    whitelisted features; ``first`` keeps a profile's leading features.
    """
    out = None
    for name, cells in profiles.items():
        cells = stored(cells, "profile")  # read several times below
        filled = scale.log_scale(cells) if name in logged else impute_profile(cells, method)
        scaled = scale.minmax(filled.select("profile", "sample_id", "feature", "value"))
        kept = quality.keep_var_pop(scaled, threshold)
        if name in listed:
            kept = align.restrict_features(kept, whitelist.select(F.col("name").alias("feature")))
        elif name in first:
            leading = split.first_features(split.feature_table(kept), first[name])
            kept = align.restrict_features(kept, leading)
        out = kept if out is None else out.unionByName(kept)
    return out


@dataclass
class Reload:
    """Switches of the configurable reload."""

    target: str
    scaling: str = "zscore"
    log_target: bool = True
    threshold: float | None = None
    substrings: DataFrame | None = None
    draws: int | None = None
    test_share: float = 0.2
    seed: int = 10


def reload(cells: DataFrame, response: DataFrame, options: Reload) -> DataFrame:
    """Variance filter, scale, select by substring, draw features, split, attach the response.

    The filter comes before scaling: after z-scoring every variance is one.
    """
    cells = stored(cells, "profile")  # read several times below
    out = cells if options.threshold is None else quality.keep_var_pop(cells, options.threshold)
    out = scale.zscore(out) if options.scaling == "zscore" else scale.minmax(out)
    table = split.feature_table(out)
    if options.substrings is not None:
        table = align.match_substrings(table, options.substrings, distinct=True).select("profile", "feature").distinct()
    if options.draws is not None:
        table = split.random_features_repeated(table, options.draws, options.seed)
    outcome = labels.target(response, options.target).filter(F.col("y").isNotNull())
    if options.log_target:
        outcome = outcome.withColumn("y", scale.log10(F.col("y")))
    parts = split.train_test_ceil(outcome.select("sample_id"), options.seed, options.test_share)
    return join_small(out, table, ["profile", "feature"]).join(outcome.join(parts, "sample_id"), "sample_id")


def demo_set(cells: DataFrame, names: Sequence[str], threshold: float, seed: int) -> DataFrame:
    """Fixed feature list, variance filter, split, scaling fitted on the training part."""
    kept = quality.keep_var_pop(labels.project_features(cells, names), threshold)
    parted = split.apply_split(kept, split.train_test(kept.select("sample_id").distinct(), seed))
    return scale.fit_zscore(parted.filter(F.col("split") == "train")).transform(parted)


# ---- design matrices ---------------------------------------------------------

EARLY = standin.PROFILES
TARGET = "response:y"


def raw_cells(spark: SparkSession, sf: str, names: Sequence[str]) -> DataFrame:
    """Unscaled cells (spend in logs) with profile-qualified feature names."""
    out = None
    for name in names:
        cells = standin.BUILDERS[name](spark, sf)
        part = scale.log_scale(cells) if name == "spend" else cells
        out = part if out is None else out.unionByName(part)
    return out.withColumn("feature", F.concat("profile", F.lit(":"), "feature"))


def scaled_cells(spark: SparkSession, sf: str, names: Sequence[str] = EARLY) -> DataFrame:
    """Min-max cells; the raw ones are written once, so the fit does not repeat the joins."""
    return scale.minmax(stored(raw_cells(spark, sf, names), "cells"))


def outcome(spark: SparkSession, sf: str, name: str = "max_price") -> DataFrame:
    """log10 of the chosen response, for samples that have one."""
    y = labels.target(standin.response(spark, sf), name).filter(F.col("y").isNotNull())
    return y.withColumn("y", scale.log10(F.col("y")))


def design(spark: SparkSession, sf: str, names: Sequence[str] = EARLY, folds: int = 5, seed: int = 10,
           fill: float | None = 0.0) -> tuple[DataFrame, tuple[str, ...]]:
    """(sample_id, x, y, split, fold) with all profiles fused; absent cells mean 0.

    The response is stacked under the profiles as one more feature, so cells and
    outcome are written once and one aggregate per sample gives both x and y.
    """
    y = outcome(spark, sf).select(
        F.lit("response").alias("profile"), "sample_id", F.lit(TARGET).alias("feature"), F.col("y").alias("value"))
    raw = stored(raw_cells(spark, sf, names).unionByName(y), "cells")
    scaler = scale.fit_minmax(raw.filter(F.col("profile") != "response"))
    order = reshape.feature_names(scaler.stats)
    scaled = scaler.transform(raw.filter(F.col("profile") != "response"))
    vectors = reshape.to_vectors(scaled.unionByName(raw.filter(F.col("profile") == "response")), [*order, TARGET])
    x = F.slice("x", 1, len(order))
    known = F.exists(x, lambda v: v.isNotNull()) & F.col("x")[len(order)].isNotNull()
    filled = x if fill is None else F.transform(x, lambda v: F.coalesce(v, F.lit(float(fill))))
    rows = vectors.filter(known).select("sample_id", filled.alias("x"), F.col("x")[len(order)].alias("y"))
    return stored(with_folds(rows, folds, seed), "design"), order


def with_folds(df: DataFrame, folds: int = 5, seed: int = 10, train_share: float = 0.8) -> DataFrame:
    """Add a seeded ``split`` and, for training rows, ``fold`` 1..k (0 for test).

    Samples are ranked once by hash; both columns follow from the rank.
    """
    ranked = hash_rank(df.select("sample_id"), "sample_id", seed)
    cut = F.floor(F.lit(train_share) * F.col("n"))
    train = F.col("rank") <= cut
    marked = ranked.select(
        "sample_id", F.when(train, "train").otherwise("test").alias("split"),
        F.when(train, block_of(F.col("rank"), cut, folds)).otherwise(F.lit(0)).alias("fold"))
    return df.join(marked, "sample_id")
