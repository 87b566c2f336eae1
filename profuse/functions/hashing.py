"""Seeded, engine-independent hashes used wherever the work needs chance.

A draw depends on the key and the seed only, so it is the same for any number
of partitions and for a recomputed task.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 60


def seeded_hash(seed, *keys) -> Column:
    """60-bit integer from the first 15 hex digits of md5('seed|key|...')."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def unit_hash(seed, *keys) -> Column:
    """The same hash as a number in [0, 1)."""
    return seeded_hash(seed, *keys).cast("double") / F.lit(float(1 << HASH_BITS))


def hash_bucket(hashed: Column, bits: int = 10) -> Column:
    """Leading bits: equal-sized, order-preserving buckets of a hash."""
    return F.shiftright(hashed, HASH_BITS - bits)
