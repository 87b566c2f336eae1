"""Renames, row and feature filters on long cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from profuse.functions import text


def relabel(df: DataFrame, column: str, rule: Callable[..., Column], *args) -> DataFrame:
    """Rewrite one label column with a rule from ``functions.text``."""
    return df.withColumn(column, rule(F.col(column), *args))


def keep_available(df: DataFrame, flag: str, sample: str = "sample_id", refuse: str = "-02$") -> DataFrame:
    """Samples whose profile is available and whose type code is not refused."""
    return df.filter((F.col(flag) == "Yes") & ~F.col(sample).rlike(refuse))


def keep_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose label matches a regular expression (platform, tissue code)."""
    return df.filter(F.col(column).rlike(pattern))


def keep_strand(df: DataFrame, column: str = "Strand", strand: str = "+") -> DataFrame:
    """Rows of one strand; a table without the column passes unchanged."""
    return df.filter(F.col(column) == strand) if column in df.columns else df


def platform_symbols(df: DataFrame, tag: str) -> DataFrame:
    """Distinct symbols of the features that carry ``tag``, with the tag removed."""
    return (
        df.select("feature").distinct().filter(F.col("feature").contains(tag))
        .select(F.replace(F.trim("feature"), F.lit(tag), F.lit("")).alias("symbol"))
    )


def candidate_names(names: DataFrame, prefixes: Sequence[tuple[str, str]]) -> DataFrame:
    """(profile, feature) for every listed name under every profile's prefix."""
    pairs = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(x).alias("prefix")) for p, x in prefixes])
    return names.select("name", F.explode(pairs).alias("pair")).select(
        F.col("pair.profile").alias("profile"), F.concat("pair.prefix", "name").alias("feature")
    )


def project_features(cells: DataFrame, names: Sequence[str], strict: bool = False) -> DataFrame:
    """Keep a fixed list of features; ``strict`` raises when one is absent."""
    wanted = cells.filter(F.col("feature").isin(list(names)))
    if strict:
        found = {r["feature"] for r in wanted.select("feature").distinct().collect()}
        missing = sorted(set(names) - found)
        if missing:
            raise KeyError(f"features not present: {missing}")
    return wanted


def drop_leading_column(df: DataFrame) -> DataFrame:
    return df.drop(df.columns[0])


def target(response: DataFrame, name: str) -> DataFrame:
    """The response by column name, never by position."""
    return response.select("sample_id", F.col(name).alias("y"))


def shape_report(cells: DataFrame) -> DataFrame:
    """Samples and features per profile.

    Two plain distincts instead of two ``countDistinct`` in one aggregate, which
    would expand every cell twice before the shuffle.
    """
    samples = cells.select("profile", "sample_id").distinct().groupBy("profile").agg(F.count("*").alias("n_samples"))
    features = cells.select("profile", "feature").distinct().groupBy("profile").agg(F.count("*").alias("n_features"))
    return samples.join(features, "profile")


def mutate(df: DataFrame, function: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    """Apply a user function to a profile."""
    return df.transform(function, *args, **kwargs)
