"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact reranking.

Vectors are scaled to length one and rotated by several learned orthogonal
matrices; the signs are balanced binary codes.  A code is cut into substrings,
each the key of one table, and vectors that agree on a substring are compared
with their original values in double precision.  The number of bits per
substring follows the number of vectors (buckets keep their mean size) and the
number of tables follows from the wanted recall at the threshold.

The rotations are fitted on a bounded sample (``sample``); every vector is
indexed.  A bucket above ``block`` rows is cut into blocks and each pair of
blocks is one task, so a dense bucket is compared whole.  A pair that meets in
several tables is counted in the first one, which both codes tell, so links are
counted without being listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profuse.llm.common import attach, join_checked
from profuse.llm.components import components, merge
from profuse.session import stored

ROWS_AT_ONCE = 256


def rotation(points: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Orthogonal matrix (d x d): principal axes, then alternating codes and Procrustes rotations."""
    d = points.shape[1]
    _, axes = np.linalg.eigh(points.T @ points + 1e-12 * np.eye(d))
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    flat = points @ axes
    for _ in range(rounds):
        codes = np.where(flat @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(codes.T @ flat)
        turn = vt.T @ u.T
    return axes @ turn


def plan(n: int, d: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per substring and number of tables for ``n`` vectors.

    Two vectors at the threshold agree on one bit with probability 1 - angle / pi.
    """
    bits = max(1, min(d, 24, round(math.log2(max(n, 2))) - 4))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def usable(column: str):
    """Neither null nor empty nor zero, and all components finite."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_pairs(x: np.ndarray, part: np.ndarray, self_part: bool, keys: np.ndarray, table: int, threshold: float):
    """Index pairs i < j of one bucket with cosine at or above the threshold that no earlier table holds.

    ``part`` tells the two blocks apart; unless ``self_part``, only pairs between them count.
    """
    for k in range(0, len(x), ROWS_AT_ONCE):
        some = np.arange(k, min(k + ROWS_AT_ONCE, len(x)))
        close = x[some] @ x.T >= threshold
        close &= np.arange(len(x))[None, :] > some[:, None]
        if not self_part:
            close &= part[None, :] != part[some][:, None]
        i, j = np.nonzero(close)
        i = some[i]
        fresh = np.ones(len(i), dtype=bool)
        for t in range(table):
            fresh &= keys[i, t] != keys[j, t]
        yield i[fresh], j[fresh]


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
    recall: float = 0.98, sample: int = 16_384, block: int = 1024,
) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components,
    rows without a key, and vectors of another length than the commonest one
    link with nothing they cannot be compared with: each length is compared on
    its own.  Equal vectors are grouped first and count as links of each other.
    Repeated rows each count.  Other columns are not read.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = stored(rows.withColumn("ok", usable("x") & F.col("id").isNotNull()), "vectors")
    # One row per distinct vector, named by its least key.
    distinct = stored(rows.where("ok").groupBy(F.xxhash64("x").alias("h"), "x").agg(
        F.min("id").alias("node"), F.count("*").alias("copies")), "distinct-vectors")
    degrees, ties = None, None
    for d, n in sorted((r[0], r[1]) for r in distinct.groupBy(F.size("x")).count().collect()):
        found = stored(_links(distinct.where(F.size("x") == d), n, d, threshold, recall, sample, block), f"links-{d}")
        more = found.where("b is null").groupBy("a").agg(F.sum("weight").alias("weight"))
        pairs = found.where("b is not null").select("a", "b")
        degrees = more if degrees is None else degrees.unionByName(more)
        ties = pairs if ties is None else ties.unionByName(pairs)
    alone = rows.where(~F.col("ok")).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if degrees is None:
        return _finish(alone, key)
    roots = components(ties, "ties").toDF("node", "root")
    found = distinct.join(degrees.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("weight")), "node", "left").join(roots, "node", "left")
    found = stored(found.select(
        "h", F.col("copies").alias("_n"), (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("root", "node").alias("component_id")), "vector-classes")
    linked = stored(rows.where("ok").select("id", F.xxhash64("x").alias("h")), "vector-keys")
    joined = attach(linked, found, "h", "_n", linked.count()).select("id", "n_links", "component_id")
    return _finish(joined.unionByName(alone), key)


def _finish(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col("id").alias(key), "n_links", "component_id",
                       F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(vectors: DataFrame, n: int, d: int, threshold, recall, sample, block) -> DataFrame:
    """(a, b, weight): rows with b null add ``weight`` links to node a, the others are ties of a forest."""
    bits, tables = plan(n, d, threshold, recall)
    share = min(1.0, sample / max(n, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("x").collect()
    points = _unit(np.array([r[0] for r in chosen], dtype=np.float64)) if chosen else np.eye(d)
    per_turn = max(1, d // bits)
    turns = np.concatenate([rotation(points, k)[:, :per_turn * bits] for k in range(math.ceil(tables / per_turn))], axis=1)[:, :tables * bits]
    weights = (1 << np.arange(bits, dtype=np.int64))

    def code(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column("x"), d))
            signs = (x @ turns >= 0).reshape(len(x), tables, bits)
            keys = (signs @ weights).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("copies"),
                pa.ListArray.from_arrays(np.arange(0, x.size + 1, d, dtype=np.int32), pa.array(x.ravel())),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))],
                names=["node", "copies", "x", "keys"])

    coded = stored(vectors.select("node", "copies", "x").mapInArrow(
        code, "node long, copies long, x array<double>, keys array<int>"), "codes")
    entries = coded.select("node", F.posexplode("keys").alias("t", "bucket"))
    heavy = stored(entries.groupBy("t", "bucket").count().where(F.col("count") > block).select(
        "t", "bucket", F.ceil(F.col("count") / block).cast("int").alias("parts")), "heavy")
    full = coded.select("node", "copies", "x", "keys", F.posexplode("keys").alias("t", "bucket"))
    full = join_checked(full, heavy, ["t", "bucket"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    full = full.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(
        F.least(i, F.col("part")).alias("p"), F.greatest(i, F.col("part")).alias("q")))
    full = full.select("node", "copies", "x", "keys", "t", "bucket", "part", "parts", F.explode(pairs).alias("pq"))
    # Light buckets of a table share tasks of about one block.
    light = max(1, math.ceil(n / block))
    group = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("bucket"), F.lit(light))).otherwise(-1 - F.col("bucket")).cast("long")

    def compare(task: pa.Table) -> pa.Table:
        bucket = task.column("bucket").to_numpy()
        order = np.lexsort((task.column("node").to_numpy(), bucket))
        task = task.take(pa.array(order))
        bucket, nodes = bucket[order], task.column("node").to_numpy()
        x, keys = _matrix(task.column("x"), d), _matrix(task.column("keys"), tables).astype(np.int64)
        copies, part = task.column("copies").to_numpy(), task.column("part").to_numpy()
        t, self_part = task.column("t")[0].as_py(), task.column("p")[0].as_py() == task.column("q")[0].as_py()
        parent, degree = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s < 2:
                continue
            for i, j in linked_pairs(x[s:e], part[s:e], self_part, keys[s:e], t, threshold):
                np.add.at(degree, s + i, copies[s + j])
                np.add.at(degree, s + j, copies[s + i])
                merge(parent, s + i, s + j)
        deg, tie = np.flatnonzero(degree), np.flatnonzero(parent != np.arange(len(x)))
        return pa.table({
            "a": pa.array(np.concatenate([nodes[deg], nodes[tie]]), pa.int64()),
            "b": pa.array([None] * len(deg) + nodes[parent[tie]].tolist(), pa.int64()),
            "weight": pa.array(np.concatenate([degree[deg], np.zeros(len(tie), dtype=np.int64)]), pa.int64())})

    ready = full.select("node", "copies", "x", "keys", "t", "bucket", "part", group.alias("g"), "pq.p", "pq.q")
    return ready.groupBy("t", "g", "p", "q").applyInArrow(compare, "a long, b long, weight long")
