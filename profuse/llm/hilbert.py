"""Sharding along a Hilbert curve over document metadata.

Size, source and language are quantised to one grid, the curve index of the cell
orders the documents, and equal runs of that order are the shards, so each file
covers a small box of all dimensions.  Equal texts follow each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from profuse.llm.common import let, ordered, text_of

BITS = 6


def curve_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Hilbert index of integer cells below 2^bits (Skilling's transform of axes to the curve)."""
    n = len(cells)
    inverse = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        p = s["q"] - 1
        head, mine = F.get(x, F.lit(0)), F.get(x, s["i"])
        set_bit = mine.bitwiseAND(s["q"]) != 0
        swap = head.bitwiseXOR(mine).bitwiseAND(p)
        return F.transform(x, lambda v, j: F.when(set_bit, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).otherwise(
            F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    turned = F.aggregate(inverse, F.array(*[c.cast("int") for c in cells]), undo)

    def finish(x: Column) -> Column:
        # Gray code: each axis takes the ones before it in.
        mixed = F.transform(x, lambda _, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

        def spread(y: Column) -> Column:
            last = F.get(y, F.lit(n - 1))
            flips = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0),
                                lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
            out = F.lit(0).cast("long")
            return F.aggregate(
                F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)]), out,
                lambda acc, s: acc * 2 + F.when(F.get(y, s["i"]).bitwiseXOR(flips).bitwiseAND(F.element_at(
                    F.array(*[F.lit(1 << k) for k in range(bits)]), s["b"] + 1)) != 0, 1).otherwise(0))

        return let(mixed, spread)

    return let(turned, finish)


def log_cell(size: Column, bits: int = BITS) -> Column:
    """Sizes on a logarithmic scale; 2^32 and more share the last cell."""
    steps = (1 << bits) / 32
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * steps), F.lit((1 << bits) - 1)).cast("int")


def label_cell(label: Column, bits: int = BITS) -> Column:
    """A cell per label by hash; labels may share cells.  Null has cell 0."""
    return F.when(label.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(label.cast("string")), F.lit((1 << bits) - 1))).cast("int")


def shards(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", labels: Sequence[str] = ("source", "lang")) -> DataFrame:
    """One row per document: key, size, text_crc32, ``curve``, ``shard``, ``slot``.

    Law ``rows``: counts of shards differ by at most one.  A null text has one
    byte (the separator) and checksum 0.  Order: curve index, text checksum and
    size, key (null keys first), input position, so copies and repeated rows may
    be cut anywhere.  Other columns are not read.
    """
    t = text_of(text)
    rows = docs.select(
        F.col(key).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        curve_index([log_cell(F.octet_length(t) + 1), *[label_cell(F.col(c)) for c in labels]]).alias("curve"))
    placed = ordered(rows, ["curve", "text_crc32", "size", "id"], "curve")
    shard = F.expr(f"(position * {n_shards}) div n_rows")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * n_rows + {n_shards} - 1) div {n_shards}")
    return placed.select(F.col("id").alias(key), "size", "text_crc32", "curve", "shard", (F.col("position") - first).cast("long").alias("slot"))


def write(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the documents as one folder per shard, each in slot order, for pruning by file statistics."""
    rows = docs.join(placed.select(key, "shard", "slot"), key)
    rows.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
