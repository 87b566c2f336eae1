"""Exact global ranks without a single-task sort.

Rows get an order-preserving bucket, buckets are counted (a table of at most a
few thousand rows), and the rank is the bucket's offset plus the row's place
inside its bucket.  Buckets are even because they come from a hash of distinct
keys or from split points of a hash sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from profuse.functions.hashing import hash_bucket, seeded_hash

KEY_BUCKETS = 256
KEY_SAMPLE = KEY_BUCKETS * 16


def split_points(df: DataFrame, key: str, buckets: int = KEY_BUCKETS, sample: int = KEY_SAMPLE) -> list:
    """At most ``buckets - 1`` ordered keys that cut ``df`` into even runs.

    They come from the ``sample`` keys of smallest hash (a bounded top-k).  A
    table smaller than the sample needs no cut.
    """
    keys = df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample)
    found = sorted(r[0] for r in keys.collect() if r[0] is not None)
    if len(found) < sample:
        return []
    step = len(found) / buckets
    return [found[int(i * step)] for i in range(1, buckets)]


def key_bucket(key: str, points: Sequence) -> Column:
    """Number of split points at or below the key: an order-preserving bucket.

    Two short scans (a coarse one, then the run it points to) instead of a
    comparison with every split point.
    """
    if not points:
        return F.lit(0)
    width = max(1, int(len(points) ** 0.5))
    runs = [points[i:i + width] for i in range(0, len(points), width)]
    passed = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col(key)))
    coarse = passed(F.array(*[F.lit(r[0]) for r in runs]))
    fine = F.array(*[F.array(*[F.lit(p) for p in r]) for r in runs])
    inside = passed(F.element_at(fine, F.greatest(coarse, F.lit(1))))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + inside)


def global_rank(df: DataFrame, bucket: Column, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` (1..n) and ``n`` over ``order`` within each ``by`` group."""
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = counts.select(
        *by, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("n"),
    )
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return (
        marked.withColumn("_place", place).join(F.broadcast(offsets), [*by, "_bucket"])
        .withColumn("rank", (F.col("_offset") + F.col("_place")).cast("bigint"))
        .withColumn("n", F.col("n").cast("bigint"))
        .drop("_bucket", "_place", "_offset")
    )


def hash_rank(df: DataFrame, key: str, seed, by: Sequence[str] = ()) -> DataFrame:
    """Shuffled order of distinct keys: rank by seeded hash, ties by the key."""
    hashed = df.withColumn("_hash", seeded_hash(seed, key))
    return global_rank(hashed, hash_bucket(F.col("_hash")), ["_hash", key], by).drop("_hash")


def key_rank(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Natural order of distinct keys."""
    return global_rank(df, key_bucket(key, split_points(df, key)), [key], by)


def block_of(rank: Column, n: Column, k: int) -> Column:
    """Block 1..k of a rank when the first ``n mod k`` blocks are one longer."""
    size = F.floor(n / F.lit(k))
    longer = n % F.lit(k)
    edge = longer * (size + 1)
    head = F.floor((rank - 1) / (size + 1)) + 1
    tail = longer + F.floor((rank - 1 - edge) / F.greatest(size, F.lit(1))) + 1
    return F.when(rank <= edge, head).otherwise(tail).cast("bigint")
