"""Shared pieces: words, safe bindings, hot-key joins, bounded block tasks, global order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from profuse.session import stored

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
HOT_SHARE = 1000
BROADCAST_ROWS = 200_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null reads as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever the optimiser merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def attach(rows: DataFrame, values: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join on ``key``; ``values`` has one row per key and the rows it has in ``count``.

    Keys with at least 1/1000 of all ``total`` rows, so at most 1000 of them, are
    broadcast and never shuffled; the others have few rows each and meet in a
    shuffled join.  ``rows`` is read twice: pass a stored table.
    """
    is_hot = F.col(count) * HOT_SHARE >= F.lit(total)
    values = values.where(F.col(key).isNotNull())
    hot, cold = values.where(is_hot).drop(count), values.where(~is_hot).drop(count)
    in_hot = F.broadcast(hot)
    return rows.join(in_hot, key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))


def join_checked(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Broadcast ``small`` (a stored table) if its counted rows allow it, else shuffle."""
    fits = small.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(small) if fits else small, list(keys), how)


def ordered(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Store ``df`` in global order and add ``position`` (0..n-1) and ``n_rows``.

    A range shuffle on the keys and the input position (so equal keys can be cut
    as well), one write, then counts per written run.  The runs' counts are as
    many rows as there are partitions.
    """
    spread = df.withColumn("_at", F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = spread.repartitionByRange(parts, *keys, "_at").sortWithinPartitions(*keys, "_at").drop("_at")
    kept = stored(run.withColumn("_id", F.monotonically_increasing_id()), label)
    kept = kept.withColumn("_run", F.shiftright("_id", 33))
    counts = kept.groupBy("_run").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_run", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy()).alias("n_rows"))
    inside = F.col("_id") - F.shiftleft(F.col("_run"), 33)
    return (kept.join(F.broadcast(offsets), "_run")
            .withColumn("position", F.col("_offset") + inside).drop("_run", "_id", "_offset"))
