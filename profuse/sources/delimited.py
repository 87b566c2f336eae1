"""Delimited matrices, name lists and saved partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from profuse.functions import text

CELL_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("profile", T.StringType()),
    T.StructField("split", T.StringType()),
])


def read_matrix(spark: SparkSession, path: str, id_col: str, sep: str = "\t", strict: bool = False) -> DataFrame:
    """Rows = samples, columns = features: header scan, then unpivot to cells."""
    wide = spark.read.csv(path, header=True, sep=sep)
    if id_col not in wide.columns:
        raise ValueError(f"{path} has no index column {id_col!r}")
    columns = [c for c in wide.columns if c != id_col]
    cells = wide.unpivot([id_col], [F.col(f"`{c}`") for c in columns], "feature", "value")
    return cells.select(
        F.col(id_col).alias("sample_id"), "feature", text.to_number(F.col("value"), strict).alias("value")
    )


def read_feature_rows(spark: SparkSession, path: str, id_col: str, sep: str = "\t", junk: str | None = None,
                      strict: bool = False) -> DataFrame:
    """Rows = features, columns = samples.

    The header is the line that starts with ``id_col``.  Read as text and split
    line by line, so a file with very many samples does
    not become a very wide DataFrame.  Lines whose cells hold ``junk`` (a second
    header under the first) are dropped.
    """
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith(id_col + sep)).first()["value"]
    names = header.split(sep)[1:]
    body = lines.filter(F.col("value") != F.lit(header))
    parts = F.split(F.col("value"), _literal_pattern(sep), -1)
    cells = (
        body.select(parts.alias("parts"))
        .select(F.col("parts")[0].alias("feature"), F.posexplode(F.slice("parts", 2, len(names))).alias("pos", "text"))
    )
    if junk is not None:
        cells = cells.filter(F.col("text") != F.lit(junk))
    labels = F.array(*[F.lit(n) for n in names])
    return cells.select(
        labels[F.col("pos")].alias("sample_id"), "feature", text.to_number(F.col("text"), strict).alias("value")
    )


def _literal_pattern(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def read_names(spark: SparkSession, path: str, column: str, sep: str = ",") -> DataFrame:
    """One named column of a list file; repeats are kept."""
    return spark.read.csv(path, header=True, sep=sep).select(F.trim(F.col(column)).alias("name"))


def write_partitions(cells: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Save labelled cells by profile and split, so a reader prunes to one part."""
    out = cells.select("sample_id", "feature", "value", "profile", "split").write.partitionBy("profile", "split")
    out.option("header", True).format(fmt).save(path)


def read_partitions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(CELL_SCHEMA).option("header", True).format(fmt).load(path)


def write_wide(wide: DataFrame, path: str, sep: str = ",") -> None:
    """A narrow wide table (few features) as delimited text with a header."""
    wide.write.option("header", True).option("sep", sep).csv(path)


def name_line(features: DataFrame, drop: str = "") -> DataFrame:
    """All feature names, ``drop`` removed, as one comma-separated line."""
    name: Column = F.replace("feature", F.lit(drop), F.lit("")) if drop else F.col("feature")
    return features.select(name.alias("name")).distinct().agg(
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("value")
    )


def write_name_line(features: DataFrame, path: str, drop: str = "") -> None:
    name_line(features, drop).write.text(path)
