"""Sample and feature alignment between profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from profuse.operators.small import join_small


def shared_samples(cells: DataFrame, response: DataFrame | None = None, n_profiles: int | None = None) -> DataFrame:
    """Samples present in every profile (and in the response)."""
    pairs = cells.select("sample_id", "profile")
    if response is not None:
        pairs = pairs.unionByName(response.select("sample_id", F.lit("response").alias("profile")))
    if n_profiles is None:
        n_profiles = pairs.select("profile").distinct().count()
    # one shuffle: a sample's set of profiles is combined map-side and stays tiny
    per = pairs.groupBy("sample_id").agg(F.size(F.collect_set("profile")).alias("n"))
    return per.filter(F.col("n") == n_profiles).select("sample_id")


def restrict(cells: DataFrame, keys: DataFrame, on: Sequence[str] | str = "sample_id") -> DataFrame:
    """Keep cells whose key is listed (semi join)."""
    return cells.join(keys, on, "left_semi")


def restrict_features(cells: DataFrame, features: DataFrame) -> DataFrame:
    """Keep cells of listed features; ``features`` has ``feature`` and maybe ``profile``."""
    keys = [c for c in ("profile", "feature") if c in features.columns]
    return join_small(cells, features.select(*keys).distinct(), keys, "left_semi")


def exclude(cells: DataFrame, keys: DataFrame, on: Sequence[str] | str = "sample_id") -> DataFrame:
    """Keep cells whose key is not listed (the complement of a saved part)."""
    return cells.join(keys, on, "left_anti")


def align_to(reference: DataFrame, other: DataFrame, strict: bool = False) -> DataFrame:
    """``other``'s rows for the reference's samples; gaps stay NULL unless strict."""
    if strict:
        lacking = reference.join(other, "sample_id", "left_anti").count()
        if lacking:
            raise KeyError(f"{lacking} samples of the reference are missing")
    return reference.select("sample_id").join(other, "sample_id", "left")


def match_substrings(features: DataFrame, names: DataFrame, distinct: bool = False) -> DataFrame:
    """Every (name, feature) with ``name`` inside ``feature``; repeats in the list repeat.

    Instead of comparing each feature with each name, a feature is expanded into
    its substrings of the lengths that occur in the list, and those are joined
    by equality.
    """
    lengths = sorted(r[0] for r in names.select(F.length("name")).distinct().collect() if r[0])
    if not lengths:
        return features.join(names.limit(0).withColumn("feature", F.lit("")), "feature")
    sizes = F.array(*[F.lit(n) for n in lengths])
    label = F.col("feature")
    grams = F.flatten(F.transform(
        F.filter(sizes, lambda n: n <= F.length(label)),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(label) - n + 1), lambda i: F.substring(label, i, n)),
    ))
    pieces = features.select("*", F.explode(F.array_distinct(grams)).alias("name"))
    joined = pieces.join(names.select("name"), "name")
    return joined.distinct() if distinct else joined


def attach_response(cells: DataFrame, response: DataFrame) -> DataFrame:
    return cells.join(response, "sample_id")


def fuse_wide(vectors: Sequence[DataFrame], widths: Sequence[int], how: str = "outer") -> DataFrame:
    """Concatenate per-profile vectors per sample (early fusion).

    A sample absent from a profile gets NULL entries of that profile's width.
    """
    out = None
    for i, frame in enumerate(vectors):
        part = frame.select("sample_id", F.col("x").alias(f"_x{i}"))
        out = part if out is None else out.join(part, "sample_id", how)
    blocks = [
        F.coalesce(F.col(f"_x{i}"), F.array_repeat(F.lit(None).cast("double"), w)) for i, w in enumerate(widths)
    ]
    return out.select("sample_id", F.concat(*blocks).alias("x"))


def prediction_columns(predictions: DataFrame, profiles: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One column per profile from long predictions (level-1 table)."""
    columns = [F.max(F.when(F.col("profile") == p, F.col("prediction"))).alias(p) for p in profiles]
    return predictions.groupBy("sample_id", *keep).agg(*columns)


def drop_duplicates(df: DataFrame, keys: Sequence[str], position: str, keep: str = "first") -> DataFrame:
    """One row per label: the first or the last by ``position``.

    ``min_by``/``max_by`` combine map-side, so a label that holds a large share
    of the rows is never gathered in one task.  Rows without a position come
    after the others; ties go by the hash of the row.
    """
    rest = [c for c in df.columns if c not in keys]
    first = keep == "first"
    pick, last = (F.min_by, F.col(position).isNull()) if first else (F.max_by, F.col(position).isNotNull())
    place = F.struct(last.alias("known"), F.col(position).alias("position"), F.xxhash64(*rest).alias("tie"))
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), place).alias("_row"))
    return chosen.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
