"""Exact nearest-neighbour regression in bounded blocks.

Training rows are assigned to the nearest of some pivot rows.  Cell radii and
counts bound each query's k-th distance from above and its distance to a cell
from below (triangle inequality); a query visits only cells it cannot exclude.
Cells that lie close are packed into parts of bounded size and large ones are cut
into several, so a query's vector travels once per part, not once per cell.  A
block of work is a part and a bounded group of its queries.  It excludes most
pairs by a cheap lower bound of their distance, computes the others exactly and
returns at most k rows per query.

Copies do not multiply the work: of training rows with the same vector only the
k of smallest id can be neighbours, and queries with the same vector are asked
once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from profuse.functions.hashing import seeded_hash
from profuse.functions.kernels import absolute_distance, squared_distance
from profuse.operators.arrays import matrix_of, row_blocks
from profuse.session import stored

CHUNK = 65_536   # training rows of a part
ASKING = 16_384  # queries of a block
BYTES = 1 << 26  # of vectors in a part
KEEP = 64        # a part has so many times the rows that a query may bring from it
TILE = {1: 1 << 15, 2: 1 << 17}  # pairs whose bounds stay in a core's cache
SEGMENT = 1_024  # smaller cells of a part are compared together
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    return absolute_distance(a, b) if p == 1 else np.sqrt(squared_distance(a, b))


def nearest(train: DataFrame, queries: DataFrame, k: int, p: int = 2, pivots: int | None = None, seed=0,
            chunk: int = CHUNK) -> DataFrame:
    """(query_id, neighbor_id, y, distance, place) with place 1..k; ties go to the smaller id.

    ``train`` has (sample_id, x, y), ``queries`` (sample_id, x).
    """
    copies = Window.partitionBy("x").orderBy("sample_id")
    train = stored(
        train.select("sample_id", "x", F.col("y").cast("double").alias("y")).withColumn("copy", F.row_number().over(copies))
        .filter(F.col("copy") <= k).drop("copy"), "train")
    asked_by = queries.select("sample_id", F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)).alias("vector"), "x")
    distinct = asked_by.groupBy("vector").agg(F.first("x").alias("x")).withColumnRenamed("vector", "sample_id")
    near = _nearest(train, distinct, k, p, pivots, seed, chunk).withColumnRenamed("query_id", "vector")
    return asked_by.select("vector", F.col("sample_id").alias("query_id")).join(near, "vector").drop("vector")


def _nearest(train: DataFrame, queries: DataFrame, k: int, p: int, pivots: int | None, seed, chunk: int) -> DataFrame:
    n, m = train.count(), queries.count()
    k = min(k, n)
    count = pivots or int(min(2_048, max(4, math.isqrt(n) // 2)))
    marks = np.array([r[0] for r in train.orderBy(seeded_hash(seed, "sample_id"), "sample_id").select("x").limit(count).collect()])
    # Blocks small enough to keep all cores busy, and never larger than a task may hold.
    even = math.isqrt(n * m // (4 * train.sparkSession.sparkContext.defaultParallelism) + 1)
    # A query brings k rows from each part: with many, parts are larger and groups of queries smaller.
    chunk = max(1, min(chunk, max(1_024, even, KEEP * k), BYTES // (8 * max(marks.shape[1:], default=1))))
    asking = min(chunk, ASKING) if chunk <= max(1_024, even) else max(64, even * even // chunk)

    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch.column("x"))
            d = np.vstack([distances(x[at], marks, p) for at in row_blocks(len(x))])
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sample_id"), batch.column("x"), batch.column("y"), pa.array(cell.astype(np.int32)),
                 pa.array(d[np.arange(len(x)), cell])], ["sample_id", "x", "y", "cell", "away"])

    cells = stored(train.mapInArrow(
        assign, "sample_id string, x array<double>, y double, cell int, away double"), "neighbors")
    table = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect()
    ids = np.array([r["cell"] for r in table], dtype=np.int32)
    sizes, lo, hi = (np.array([r[c] for r in table], dtype=float) for c in ("n", "lo", "hi"))
    part, pieces = _packed(marks[ids], sizes, chunk, p)
    member = np.zeros((len(ids), len(pieces)), dtype=np.float32)
    member[np.arange(len(ids)), part] = 1.0

    def visit(batches):
        for batch in batches:
            whole = matrix_of(batch.column("x")) if batch.num_rows else ()
            for at in row_blocks(len(whole)):
                x = whole[at]
                every = distances(x, marks, p)
                d = every[:, ids]
                far = d + hi                                   # every row of the cell is at most this far
                order = np.argsort(far, axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) >= k).argmax(axis=1)
                bound = np.take_along_axis(far, order, 1)[np.arange(len(x)), enough]
                if k <= len(marks):                            # pivots are training rows too
                    bound = np.fmin(bound, np.partition(every, k - 1, axis=1)[:, k - 1])
                bound = bound * (1 + SLACK) + SLACK
                near = np.maximum(np.maximum(d - hi, lo - d), 0.0)
                row, place = np.nonzero((~(near > bound[:, None])).astype(np.float32) @ member)
                taken = pa.array(row + at.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sample_id").take(taken), batch.column("x").take(taken), pa.array(bound[row]), pa.array(place.astype(np.int32))],
                    ["query_id", "x", "bound", "part"])

    visits = queries.select("sample_id", "x").mapInArrow(visit, "query_id binary, x array<double>, bound double, part int")
    asked = {r["part"]: r["n"] for r in visits.groupBy("part").agg(F.count("*").alias("n")).collect()}
    plan = [(i, int(cut), math.ceil(asked.get(i, 0) / asking)) for i, cut in enumerate(pieces)]
    blocks = max(1, sum(cut * asks for _, cut, asks in plan))
    cuts = F.broadcast(train.sparkSession.createDataFrame([t for t in plan if t[2]], "part int, pieces int, asks int"))
    homes = F.broadcast(train.sparkSession.createDataFrame([(int(c), int(i)) for c, i in zip(ids, part)], "cell int, part int"))
    keys, tasks = ["part", "piece", "ask"], min(2 * blocks, 4_096)
    left = visits.join(cuts, "part").select(
        "part", "query_id", "x", "bound", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int").alias("ask"),
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).repartition(tasks, *keys)
    right = cells.join(homes, "cell").join(cuts, "part").select(
        "part", "cell", "sample_id", "x", "y", F.pmod(F.xxhash64("sample_id"), F.col("pieces")).cast("int").alias("piece"),
        F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask")).repartition(tasks, *keys)
    spans = {int(c): (marks[c], a, b) for c, a, b in zip(ids, lo, hi)}

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            row = column = np.zeros(0, dtype=int)
            d = np.zeros(0)
        else:
            b = b.sort_by([("cell", "ascending"), ("sample_id", "ascending")])
            by_id = np.empty(b.num_rows, dtype=int)
            by_id[pc.sort_indices(b.column("sample_id")).to_numpy()] = np.arange(b.num_rows)
            row, column, d = _closest(matrix_of(a.column("x")), a.column("bound").to_numpy(), matrix_of(b.column("x")), b.column("cell").to_numpy(),
                                      by_id, spans, k, p)
        y = b.column("y").take(pa.array(column)).to_numpy()
        return pa.table({"query_id": a.column("query_id").take(pa.array(row)), "neighbor_id": b.column("sample_id").take(pa.array(column)),
                         "y": pa.array(y.astype(np.float64), from_pandas=True), "distance": pa.array(d)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        block, "query_id binary, neighbor_id string, y double, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _packed(pivots: np.ndarray, sizes: np.ndarray, chunk: int, p: int) -> tuple[np.ndarray, list[int]]:
    """Part of every cell, and into how many pieces each part is cut; cells of a part lie close and a larger one is alone."""
    part, pieces = np.zeros(len(sizes), dtype=int), []
    left, at, room = np.ones(len(sizes), dtype=bool), 0, -1.0
    for _ in range(len(sizes)):
        left[at] = False
        if sizes[at] > room or sizes[at] > chunk:
            pieces.append(max(1, math.ceil(sizes[at] / chunk)))
            room = chunk
        part[at] = len(pieces) - 1
        room -= sizes[at]
        rest = np.flatnonzero(left)
        if len(rest):
            at = int(rest[distances(pivots[at:at + 1], pivots[rest], p)[0].argmin()])
    return part, pieces


def _closest(q: np.ndarray, bound: np.ndarray, z: np.ndarray, cell: np.ndarray, by_id: np.ndarray, spans: dict, k: int,
             p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k closest rows of each query within its bound; ties go to the smaller place in ``by_id``.

    ``cell`` is sorted.  A query's bound falls as rows are found.
    """
    bound = bound.copy()
    qt, zt = np.ascontiguousarray(q.T), np.ascontiguousarray(z.T)
    kept = (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))
    pending, waiting = [], 0
    starts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)]
    lower, first = _Bounds(q, z, p), 0
    near = np.full(len(q), np.inf)
    for begin, last in zip(starts[:-1], starts[1:]):
        mark, lo, hi = spans[int(cell[begin])]
        away = distances(q, mark[None], p)[:, 0]
        near = np.minimum(near, np.maximum(np.maximum(away - hi, lo - away), 0.0))
        if last - first < SEGMENT and last < len(cell):
            continue
        asking = np.flatnonzero(~(near > bound))
        for at in row_blocks(len(asking), max(1, TILE[p] // (last - first))):
            mine = asking[at]
            low, most = lower.of(mine, first, last, bound[mine], 0 if len(kept[0]) else k)
            row, column = np.nonzero(~(low > most[:, None]))
            row, column = mine[row], column + first
            d = np.zeros(len(row))
            for own, other in zip(qt, zt):
                gap = own[row] - other[column]
                d += np.abs(gap) if p == 1 else gap * gap
            d = d if p == 1 else np.sqrt(d)
            good = ~(d > bound[row])
            pending.append((row[good], column[good], d[good]))
            waiting += int(good.sum())
        if waiting > len(kept[0]) or last == len(cell):
            row, column, d = (np.concatenate(parts) for parts in zip(kept, *pending))
            order = np.lexsort((by_id[column], d, row))
            row, column, d = row[order], column[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
            full = place == k - 1
            bound[row[full]] = np.fmin(bound[row[full]], d[full])
            kept, pending, waiting = tuple(part[place < k] for part in (row, column, d)), [], 0
        near, first = np.full(len(q), np.inf), last
    return kept


class _Bounds:
    """Lower bounds of distances (of their squares for p = 2), cheaper than the distances; their error is bounded."""

    def __init__(self, q: np.ndarray, z: np.ndarray, p: int) -> None:
        self.p, width = p, q.shape[1]
        if p == 1:  # single precision, but for numbers that it cannot hold
            largest = max(float(np.abs(m).max(initial=0.0)) for m in (q, z))
            kind = np.float32 if largest < 1e30 else np.float64
            self.unit = 2.0 * (width + 4) * float(np.finfo(kind).eps)
            self.q, self.z = np.ascontiguousarray(q.T, dtype=kind), np.ascontiguousarray(z.T, dtype=kind)
            self.size_q, self.size_z = np.abs(q).sum(axis=1), np.abs(z).sum(axis=1)
        else:
            self.unit = 4.0 * (width + 4) * float(np.finfo(float).eps)
            self.q, self.z = q, np.ascontiguousarray(z.T)
            self.size_q, self.size_z = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", z, z)

    def of(self, rows: np.ndarray, first: int, last: int, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of pairs and, per row, the value above which a pair lies beyond its bound.

        With ``k`` the bound is at most the k-th smallest value of the row.
        """
        error = self.unit * (self.size_q[rows] + self.size_z[first:last].max()) + 1e-30
        if self.p == 1:
            values, gap = (np.zeros((len(rows), last - first), dtype=self.q.dtype) for _ in range(2))
            for mine, other in zip(self.q[:, rows], self.z[:, first:last]):
                np.subtract(mine[:, None], other, out=gap)
                np.abs(gap, out=gap)
                values += gap
            most = bound
        else:
            values = (-2.0 * self.q[rows]) @ self.z[:, first:last]
            values += self.size_z[first:last]
            values += self.size_q[rows, None]
            most = bound * bound
        if 0 < k <= last - first:
            most = np.fmin(most, np.partition(values, k - 1, axis=1)[:, k - 1] + error)
        most = (most * (1 + SLACK) + error).astype(values.dtype)
        return values, np.nextafter(most, values.dtype.type(np.inf))


def neighbour_regression(train: DataFrame, queries: DataFrame, ks: Sequence[int] = (5,), weights: Sequence[str] = ("uniform",),
                         p: int = 2, **options) -> DataFrame:
    """Predictions per query for every k and weighting, from one neighbour search.

    Distance weights are inverse distances; rows at distance zero, if any, decide alone.
    """
    found = nearest(train, queries, max(ks), p, **options)
    each = []
    for k in ks:  # one aggregate for all, so the search runs once
        near = F.col("place") <= k
        for kind in weights:
            zero = F.when(near & (F.col("distance") == 0), 1.0)
            if kind == "uniform":
                value = F.avg(F.when(near, F.col("y")))
            else:
                w = F.when(near & (F.col("distance") > 0), 1.0 / F.col("distance"))
                value = F.coalesce(F.sum(F.col("y") * zero) / F.sum(zero), F.sum(F.col("y") * w) / F.sum(w))
            each.append((k, kind, value.alias(f"p{len(each)}")))
    found = found.groupBy(F.col("query_id").alias("sample_id")).agg(*[value for *_, value in each])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("weights"), F.col(f"p{i}").alias("prediction"))
                               for i, (k, kind, _) in enumerate(each)])).alias("r")
    return found.select("sample_id", rows).select("sample_id", "r.k", "r.weights", "r.prediction")


# Search grid.
GRID = {"k": [5, 10, 35, 50, 100], "weights": ["uniform", "distance"], "p": [1, 2]}
