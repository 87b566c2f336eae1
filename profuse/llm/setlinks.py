"""Links between similar sets that share a bucket, exact and without all pairs of a large group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from profuse.llm.components import components
from profuse.session import stored


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two ascending sets is at least ``similarity``."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (small + large - both)


def links_in_buckets(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, block: int = 256) -> DataFrame:
    """Forest (a, b) over ``node`` of the sets that share a bucket and have Jaccard ``similarity`` or more.

    ``bands`` (stored) has mark, node, band and bucket, one row per set and
    bucket; ``sets_of`` takes a table of (mark, node) and gives (mark, found),
    found being the ascending 64-bit members as bytes.

    A bucket is first cut into blocks of ``block`` sets, each linked by itself;
    then one set of each class found meets those of up to ``block`` others of the
    bucket, level by level.  What is then still apart meets in pairs of blocks, so
    no pair is lost, while a large group of similar sets costs a few links a set.
    """
    sizes = bands.groupBy("band", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("n"), F.count("*").alias("size"))
    held = stored(bands.join(sizes.where("size > 1"), ["band", "bucket"]).select("mark", "node", "band", "bucket", "n"), "held")
    sets = sets_of(stored(held.select("mark", "node").distinct(), "wanted"))

    def forest(group: pa.Table) -> pa.Table:
        nodes, parts, roots = (group.column(c).to_pylist() for c in ("node", "part", "root"))
        found = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group.column("found")]
        across = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        first, home, groups, links = {}, list(range(len(nodes))), {}, []
        for i, root in enumerate(roots):
            mine = home[i] = home[first.setdefault(root, i)] if root is not None else i
            groups.setdefault(mine, []).append(i)
            # Only what is not linked yet is compared; the first member that is near links the whole group.
            for g in [g for g in groups if g != mine]:
                near = next((j for j in groups[g] if (not across or parts[i] != parts[j]) and similar(found[i], found[j], similarity)), None)
                if near is not None:
                    links.append((i, near))
                    for j in groups[g]:
                        home[j] = mine
                    groups[mine] += groups.pop(g)
        out = [(nodes[i], nodes[j], None) for i, j in links]
        if group.column("wide")[0].as_py():
            marks = group.column("mark").to_pylist()
            out += [(nodes[i], nodes[h], marks[h]) for i, h in enumerate(home)]
        place = [group.column(c)[:1].take(pa.array([0] * len(out), pa.int32())) for c in ("band", "bucket")]
        kinds = [group.column("node").type, group.column("node").type, pa.int64()]
        return pa.table([*place, *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["band", "bucket", "a", "b", "mark"])

    kind, bucket = bands.schema["node"].dataType.simpleString(), ["band", "bucket"]

    def linked(rows: DataFrame, label: str) -> DataFrame:
        """Of each task (x, y): links (a, b) without a mark and, if it is wide, the class b (with its mark) of each a."""
        rows = rows.select("mark", "node", "band", "bucket", "part", "root", "x", "y", "wide")
        return stored(sets.join(rows, "mark").groupBy("band", "bucket", "x", "y").applyInArrow(
            forest, f"band int, bucket long, a {kind}, b {kind}, mark long"), label)

    def levels() -> tuple[DataFrame, DataFrame]:
        """All links, and the class (node, rep) of each set of a wide bucket."""
        part = F.pmod(F.col("mark"), F.col("n")).cast("int")
        found = linked(held.select("*", part.alias("part"), part.alias("x"), part.alias("y"), F.lit(None).cast(kind).alias("root"), (F.col("n") > 1).alias("wide")), "blocks")
        ties, classes, level = found.where("mark is null").select("a", "b"), found.where("mark is not null").withColumnsRenamed({"a": "node", "b": "rep"}), 0
        while True:
            reps = stored(classes.select("band", "bucket", "rep", "mark").distinct(), "reps")
            counts = reps.groupBy(*bucket).agg(F.count("*").alias("c")).where("c > 1")
            level, m = level + 1, F.ceil(F.col("c") / block).cast("int")
            x = F.pmod(F.hash("rep", F.lit(level)), F.col("m")).cast("int")
            heads = stored(reps.join(counts, bucket).withColumn("m", m).select(
                "mark", F.col("rep").alias("node"), "band", "bucket", zero.alias("part"), F.lit(None).cast(kind).alias("root"), x.alias("x"), x.alias("y"), F.lit(True).alias("wide"), "m"), "heads")
            if heads.isEmpty():
                return ties, classes
            found = linked(heads, "heads")
            ties = ties.unionByName(found.where("mark is null").select("a", "b"))
            up = found.where("mark is not null").select("band", "bucket", F.col("a").alias("rep"), F.col("b").alias("up"), F.col("mark").alias("up_mark"))
            classes = stored(classes.join(up, ["band", "bucket", "rep"], "left").select(
                "band", "bucket", "node", F.coalesce("up", "rep").alias("rep"), F.coalesce("up_mark", "mark").alias("mark")), "classes")
            if heads.where("m > 1").isEmpty() or found.where("mark is null").isEmpty():
                return ties, classes

    zero = F.lit(0)
    ties, classes = levels()
    apart = classes.groupBy(*bucket).agg((F.min("rep") < F.max("rep")).alias("apart")).where("apart").drop("apart")
    if apart.isEmpty():
        return ties
    # Other buckets may have joined what this one has not.
    roots = components(ties, "similar-roots").toDF("node", "root")
    wide = held.join(stored(apart, "apart-buckets"), bucket, "left_semi").drop("n")
    rooted = stored(wide.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    classes = stored(rooted.groupBy("band", "bucket", "root").agg(F.count("*").alias("size")), "classes")
    counts = classes.groupBy(*bucket).agg(F.count("*").alias("classes")).where("classes > 1")
    # Still apart: blocks of one large class, or of small ones together; two blocks of one class need not meet.
    small = F.col("size") < block
    cut = F.when(small, F.lit(1)).otherwise(F.ceil(F.col("size") / block)).cast("int")
    rest = Window.partitionBy("band", "bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    together = F.ceil(F.sum(F.when(small, F.col("size")).otherwise(0)).over(rest) / block).cast("int")
    cuts = classes.join(counts, bucket).select(
        "band", "bucket", "root", cut.alias("cut"), F.when(small, F.pmod(F.hash("root"), together)).alias("shelf"))
    # A shelf of small classes has the whole class None.
    own = F.when(F.col("shelf").isNull(), F.col("root"))
    placed = stored(rooted.join(cuts, ["band", "bucket", "root"]).select(
        "mark", "node", "root", "band", "bucket", own.alias("whole"),
        F.xxhash64(own, F.coalesce("shelf", F.pmod(F.col("mark"), F.col("cut")).cast("int"))).alias("part")), "placed")
    blocks = stored(placed.select("band", "bucket", "whole", "part").distinct(), "parts")
    left, right = (blocks.select("band", "bucket", F.col("whole").alias(f"whole_{c}"), F.col("part").alias(c)) for c in "xy")
    differ = F.col("whole_x").isNull() | F.col("whole_y").isNull() | (F.col("whole_x") != F.col("whole_y"))
    pairs = left.join(right, bucket).where((F.col("x") <= F.col("y")) & differ).select("band", "bucket", "x", "y")
    pairs = stored(pairs, "pairs")
    either = pairs.select("*", F.col("x").alias("part")).unionByName(pairs.where("x <> y").select("*", F.col("y").alias("part")))
    last = linked(placed.drop("whole").join(either, ["band", "bucket", "part"]).withColumn("wide", F.lit(False)), "apart")
    return ties.unionByName(last.select("a", "b"))
