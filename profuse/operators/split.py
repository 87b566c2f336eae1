"""Reproducible splits, folds and feature draws."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from profuse.functions.hashing import seeded_hash, unit_hash
from profuse.operators.rank import block_of, hash_rank, key_rank


def train_test(samples: DataFrame, seed, train_share: float = 0.8) -> DataFrame:
    """Shuffled split with floor(share * n) training samples."""
    ranked = hash_rank(samples, "sample_id", seed)
    train = F.col("rank") <= F.floor(F.lit(train_share) * F.col("n"))
    return ranked.select("sample_id", F.when(train, "train").otherwise("test").alias("split"))


def train_test_ceil(samples: DataFrame, seed, test_share: float = 0.2) -> DataFrame:
    """Shuffled split with ceil(share * n) test samples."""
    ranked = hash_rank(samples, "sample_id", seed)
    test = F.col("rank") > F.col("n") - F.ceil(F.lit(test_share) * F.col("n"))
    return ranked.select("sample_id", F.when(test, "test").otherwise("train").alias("split"))


def apply_split(cells: DataFrame, assignment: DataFrame) -> DataFrame:
    """Carry one sample-level assignment to every profile."""
    return cells.join(assignment, "sample_id")


def shuffled_folds(samples: DataFrame, k: int, seed) -> DataFrame:
    ranked = hash_rank(samples, "sample_id", seed)
    return ranked.select("sample_id", block_of(F.col("rank"), F.col("n"), k).alias("fold"))


def contiguous_folds(samples: DataFrame, k: int) -> DataFrame:
    """Folds that are runs of the sample order."""
    ranked = key_rank(samples, "sample_id")
    return ranked.select("sample_id", block_of(F.col("rank"), F.col("n"), k).alias("fold"))


def feature_table(cells: DataFrame) -> DataFrame:
    return cells.select("profile", "feature").distinct()


def random_features(features: DataFrame, n: int, seed) -> DataFrame:
    """``n`` features per profile without replacement (top-n by hash)."""
    order = Window.partitionBy("profile").orderBy(seeded_hash(seed, "profile", "feature"), "feature")
    return features.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("profile", "feature")


def random_features_repeated(features: DataFrame, n: int, seed) -> DataFrame:
    """``n`` draws per profile with replacement; ``draw`` tells repeats apart."""
    order = Window.partitionBy("profile").orderBy("feature")
    indexed = features.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))
    sizes = features.groupBy("profile").agg(F.count("*").alias("p"))
    draws = sizes.select("profile", "p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).select(
        "profile", F.col("draw").cast("bigint").alias("draw"),
        (seeded_hash(seed, "profile", F.col("draw")) % F.col("p")).alias("idx"),
    )
    return draws.join(indexed, ["profile", "idx"]).select("profile", "draw", "feature")


def first_features(features: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("profile").orderBy("feature")
    return features.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("profile", "feature")


def head_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hash_sample(df: DataFrame, key: str, n_rows: int, total: int, seed) -> DataFrame:
    """Exactly ``min(n_rows, total)`` rows: those of smallest seeded hash.

    A threshold a little above the wanted share keeps the sort small; when it
    passes too few rows (never seen beyond tiny tables) it is dropped.
    """
    want = min(n_rows, total)
    share = min(1.0, (want + 10 * math.sqrt(want) + 20) / max(total, 1))
    near = df.filter(unit_hash(seed, key) < share) if share < 1.0 else df
    if share < 1.0 and near.limit(want).count() < want:
        near = df
    return near.orderBy(seeded_hash(seed, key), key).limit(want)
