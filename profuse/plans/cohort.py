"""Cohort build: clean each raw layout, then keep the shared samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profuse.functions import text
from profuse.operators import align, labels, quality
from profuse.session import stored


def clean_packed(raw: DataFrame, profile: str) -> DataFrame:
    """(sample_id, available, feature, value): trim names, keep available primary samples."""
    kept = labels.keep_available(raw, "available")
    return kept.select(F.lit(profile).alias("profile"), "sample_id", text.strip_blanks(F.col("feature")).alias("feature"), "value")


def clean_text(raw: DataFrame, profile: str, prefix: str, junk: str, fill: float) -> DataFrame:
    """(sample_id, feature, text): drop junk rows, cast, prefix names, fill gaps."""
    cells = raw.filter(F.col("text") != junk).select(
        F.lit(profile).alias("profile"), "sample_id", text.prefix_and_drop(F.col("feature"), prefix, "").alias("feature"),
        text.to_number(F.col("text")).alias("value"))
    return quality.fill_constant(cells, fill)


def clean_portions(raw: DataFrame, profile: str, length: int) -> DataFrame:
    """(sample_id, feature, value, position[, Strand]): plus strand, short labels, first copy."""
    cells = labels.relabel(labels.keep_strand(raw), "sample_id", text.truncate_label, length)
    single = align.drop_duplicates(cells, ["sample_id", "feature"], "position", "first")
    return quality.drop_empty_features(
        single.select(F.lit(profile).alias("profile"), "sample_id", "feature", "value"))


def clean_antibody(raw: DataFrame, profile: str, length: int) -> DataFrame:
    """(sample_id, feature, value): short labels and a separator safe for formulas."""
    return raw.select(
        F.lit(profile).alias("profile"), text.truncate_label(F.col("sample_id"), length).alias("sample_id"),
        text.replace_all(F.col("feature"), [("|", "_-_")]).alias("feature"), "value")


def build(parts: list[DataFrame], response: DataFrame, suffix: str = "-01") -> DataFrame:
    """Cells of the samples that every profile and the response share."""
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    cells = stored(cells, "cohort")  # read for the shared samples and again for the cells
    outcome = response.withColumn("sample_id", text.add_suffix(F.col("sample_id"), suffix))
    return align.restrict(cells, align.shared_samples(cells, outcome, len(parts) + 1))


def normal_tissue(raw: DataFrame, other: DataFrame, profile: str, prefix: str, length: int) -> DataFrame:
    """Normal-tissue cells limited to the features another profile also has.

    Labels are shortened, repeated labels keep their last copy.
    """
    kept = labels.keep_matching(
        labels.relabel(raw, "sample_id", text.truncate_label, length), "sample_id", "-1[0-9]$")
    single = align.drop_duplicates(kept, ["sample_id", "feature"], "position", "last")
    named = single.select(F.lit(profile).alias("profile"), "sample_id", F.concat(F.lit(prefix), "feature").alias("feature"), "value")
    return align.restrict_features(named, other.select("feature"))
