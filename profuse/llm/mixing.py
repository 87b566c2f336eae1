"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order take the weights in turn and share
``share`` times all words; a target above ``most`` times its source is capped
and the excess is shared again by weight.  Each source has a weight schedule
over training time; its integral is the source's cumulative demand.  Documents
of a source follow each other in hash order, pass after pass, and a document's
training position is the time at which demand reaches its first word.  The mix
is the documents sorted by that position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from profuse.llm.common import WORD, let, ordered, text_of, words
from profuse.session import stored

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Slope of each weight class's schedule: weight(t) is proportional to 1 + slope * (2t - 1), t from 0 to 1.
SLOPES = (-0.5, 0.25, 0.75)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, class, target; ``sizes`` has one row (source, source_size) per source.

    Each round caps every source above its limit and shares the rest by weight
    among the others, until none is above.
    """
    placed = ordered(sizes, [F.col("source").asc_nulls_last()], "sources")
    kind = F.pmod(F.col("position"), F.lit(len(weights))).cast("int")
    rows = stored(placed.select(
        "source", "source_size", kind.alias("class"), F.get(F.array(*[F.lit(float(w)) for w in weights]), kind).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("limit")), "weights")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, capped = 0.0, None
    over = F.lit(False)
    while True:
        bound, weight, n = rows.agg(
            F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
            F.sum(over.cast("long"))).first()
        level = max(level, (total - (bound or 0.0)) / weight) if weight else level
        if n == capped:
            break
        capped, over = n, F.lit(level) * F.col("weight") > F.col("limit")
    target = F.least(F.lit(level) * F.col("weight"), F.col("limit"))
    return rows.select("source", "source_size", "class", target.alias("target"))


def demand_time(u: Column, slope: Column) -> Column:
    """Time at which the demand reaches the share ``u`` of its total: inverse of (1 - slope) t + slope t^2."""
    start = 1 - slope
    root = (F.sqrt(start * start + 4 * slope * u) - start) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, u).otherwise(root)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """One row per document: key, text_hash, size, source_size, target, taken, ``positions``.

    ``positions`` has the training time (0 to 1) of each pass that takes words of
    the document.  A null or empty text has no words and is never taken.  Null
    sources form one source, the last in order.  Order within a source: hash of
    the key, key, hash and size of the text; equal rows are interchangeable.
    Reruns agree.  Other columns are not read.
    """
    t = text_of(text)
    rows = stored(docs.select(
        F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(t).alias("text_hash"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("size")), "sizes")
    n = rows.count()
    # About sqrt(n) runs per source, so that neither a run nor the list of runs gets long.
    runs = max(1, math.isqrt(n))
    order = [F.xxhash64("id", "text_hash").alias("order")]
    rows = rows.select("*", *order).withColumn("run", F.pmod(F.shiftright("order", 20), F.lit(runs)))
    per_run = stored(rows.groupBy("source", "run").agg(F.sum("size").alias("run_size")), "runs")
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select("source", "run", F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("offset"))
    wanted = targets(per_run.groupBy("source").agg(F.sum("run_size").alias("source_size")), weights, share, most)
    offsets = offsets.join(wanted, offsets["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    offsets = offsets.select(F.coalesce(F.xxhash64("source"), F.lit(0)).alias("s"), F.col("source").isNull().alias("no_source"),
                             "run", "offset", "source_size", "class", "target")
    inside = Window.partitionBy("s", "no_source", "run").orderBy("order", "id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("id", "text_hash", "size", "order", "run", F.xxhash64("source").alias("s"), F.col("source").isNull().alias("no_source"))
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["s", "no_source", "run"])
    at, size, whole = F.col("offset") + F.col("at"), F.col("size"), F.col("source_size")
    goal = F.floor(F.col("target") + F.lit(0.5))
    passes = [(at + k * whole, F.greatest(F.lit(0), F.least(size, goal - at - k * whole))) for k in range(math.ceil(most))]
    slope = F.get(F.array(*[F.lit(float(s)) for s in slopes]), F.pmod("class", F.lit(len(slopes))))
    positions = F.array(*[F.when(take > 0, demand_time(F.least(first / F.col("target"), F.lit(1.0)), slope)) for first, take in passes])
    return rows.select(
        F.col("id").alias(key), "text_hash", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        sum((take for _, take in passes), F.lit(0)).cast("long").alias("taken"), F.array_compact(positions).alias("positions"))


def places(plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """``mix`` with ``places``: the rank (0..n-1) that each of ``positions`` has among all passes of all documents.

    The passes are range-sorted by position, then key (null last) and text hash;
    equal rows are interchangeable.  An empty table gives an empty result.
    """
    own = [c for c in plan.columns if c != "positions"]
    rows = plan.withColumn("_pf_row", F.monotonically_increasing_id())
    rows = rows.select(*own, "_pf_row", F.posexplode_outer("positions").alias("_pf_pass", "_pf_at"))
    placed = ordered(rows, [F.col("_pf_at").asc_nulls_last(), F.col(key).asc_nulls_last(), F.col("text_hash")], "places")
    one = F.struct(F.col("_pf_pass").alias("k"), F.col("_pf_at").alias("at"), F.col("position").alias("place"))
    passes = placed.groupBy("_pf_row").agg(
        *[F.first(c).alias(c) for c in own], F.array_sort(F.collect_list(F.when(F.col("_pf_at").isNotNull(), one))).alias("_pf_all"))
    return passes.select(*own, F.col("_pf_all")["at"].alias("positions"), F.col("_pf_all")["place"].alias("places"))


def training_set(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents in training order, one row per pass that takes them; all columns stay.

    A document that a pass takes in part is cut after those words (their white
    space becomes single spaces).
    """
    plan = mix(docs, key, text, source, **options).where("taken > 0").select(
        F.col(key).alias("_pf_key"), F.col("text_hash").alias("_pf_hash"), F.col("size").alias("_pf_size"),
        F.col("taken").alias("_pf_taken"), F.col("positions").alias("_pf_positions"))
    # Equal keys with equal texts have equal rows; each takes one of the plan's.
    plan = plan.groupBy("_pf_key", "_pf_hash", "_pf_size").agg(F.max("_pf_taken").alias("_pf_taken"), F.max("_pf_positions").alias("_pf_positions"))
    rows = docs.join(plan, F.col(key).eqNullSafe(F.col("_pf_key")) & (F.xxhash64(text_of(text)) == F.col("_pf_hash")))
    rows = rows.select("*", F.posexplode("_pf_positions").alias("_pf_pass", "_pf_at"))
    left = F.col("_pf_taken") - F.col("_pf_pass") * F.col("_pf_size")
    short = let(words(text_of(text)), lambda w: F.array_join(F.slice(w, 1, F.greatest(left, F.lit(1)).cast("int")), " "))
    rows = rows.withColumn(text, F.when(left < F.col("_pf_size"), short).otherwise(F.col(text)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "_pf_at", "_pf_key").sortWithinPartitions("_pf_at", "_pf_key")
    return rows.select(*docs.columns)
