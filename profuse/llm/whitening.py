"""Embedding whitening by shifted CholeskyQR.

The centred vectors are one tall matrix.  A pass over the rows sums their Gram
matrix; its Cholesky factor, shifted in the first pass so that it exists for
any matrix, orthogonalises the rows by triangular solves; the next pass does
the same with the rows so obtained, and so on until their Gram matrix is the
identity.  The product of the factors is R of the QR factorisation, and its
singular values and right vectors are those of the rows, without the squared
condition of a covariance matrix.

Rows are never collected: a pass sends one d x d partial sum per task, as
cells, and gets d x d sums back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from profuse.session import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Passes after which rows that are still not orthogonal have fewer dimensions than columns.
MAX_PASSES = 6
MAX_WIDTH = 2_048
ROUNDING = np.finfo(np.float64).eps


@dataclass
class Whitening:
    """Component k: ``vectors[:, k]``, its share of the variance, and the deviation by which scores are divided."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def scores(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.vectors / self.deviations)


def scaled(docs: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """Stored: the key columns and ``x`` (array of long) of the usable rows.

    Left out: null and empty vectors, vectors with null or non-finite entries, and
    vectors of another length than the commonest one (the longer of equals).
    """
    entries = F.col(vector).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = docs.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    x = F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(OFFSET))
    rows = stored(rows.select(*keys, x.alias("_pf_x")), "scaled")
    widths = rows.groupBy(F.size("_pf_x").alias("d")).count()
    common = widths.orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    return rows.where(F.size("_pf_x") == (common[0]["d"] if common else 0))


def _cells(rows: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all rows of Aᵀ A, ``of`` giving the rows A of a batch of x."""
    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            a = of(_matrix(batch.column(0), width))
            total += a.T @ a
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    sums = rows.select("_pf_x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((width, width))
    for r in sums.collect():
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["v"]
    return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centring(n: int, sums: list[int]):
    """x -> x - S / n, from integers near zero: both are shifted by the same whole number first."""
    shift = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    return lambda x: (x - shift).astype(np.float64) - rest


def cholesky_qr(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R (d x d) with RᵀR = AᵀA for the centred rows A, by repeated shifted CholeskyQR."""
    width, centre, inverse, r = len(sums), _centring(n, sums), np.eye(len(sums)), np.eye(len(sums))
    for k in range(MAX_PASSES):
        gram = _cells(rows, lambda x, inverse=inverse: centre(x) @ inverse, width)
        if not gram.any():
            return gram
        if k and np.abs(gram - np.eye(width)).max() <= 8 * width * ROUNDING:
            break
        shift = 11 * ROUNDING * (width * n + width * (width + 1)) * np.linalg.norm(gram, 2)
        try:
            factor = np.linalg.cholesky(gram if k else gram + shift * np.eye(width)).T
        except np.linalg.LinAlgError:
            # Rows of lower rank stay so; the shift keeps the factor regular.
            factor = np.linalg.cholesky(gram + max(shift, ROUNDING) * np.eye(width)).T
        r = factor @ r
        # Triangular solve against the identity; the rows are multiplied by it in the next pass.
        inverse = inverse @ np.linalg.solve(factor, np.eye(width))
    return r


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of ``scaled`` rows; None for an empty table.

    Components without variance (beyond rounding) cannot be whitened and are left
    out, so there are fewer than asked for if the rows have fewer dimensions.
    """
    first = rows.select(F.size("_pf_x")).first()
    if first is None:
        return None
    width = first[0]
    if width > MAX_WIDTH:
        raise ValueError(f"at most {MAX_WIDTH} dimensions")
    totals = rows.select(F.posexplode("_pf_x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    sums, n = [r["s"] for r in sorted(totals, key=lambda r: r["j"])], totals[0]["n"]
    _, size, right = np.linalg.svd(cholesky_qr(rows, n, sums))
    variance = size**2 / n
    total = variance.sum()
    kept = np.flatnonzero(size > size[0] * width * n**0.5 * ROUNDING * 8)[:components] if total else np.zeros(0, dtype=int)
    model = Whitening(n, sums, right[kept].T, np.sqrt(variance[kept]), variance[kept] / total if total else variance[kept])
    if len(kept):
        centre = _centring(n, sums)
        pad = np.zeros((width, width))
        pad[:, :len(kept)] = model.vectors / model.deviations
        spread = _cells(rows, lambda x: centre(x) @ pad, width)[:len(kept), :len(kept)] / n
        model.error = float(np.abs(spread - np.eye(len(kept))).max())
    return model


def deviation(n: int, sums: list[int], x: Column) -> Column:
    """Sum over dimensions of (n x - S)^2, in whole numbers; an overflow raises."""
    apart = F.zip_with(x, F.array(*[F.lit(s) for s in sums]).cast("array<bigint>"), lambda v, s: v * F.lit(n).cast("long") - s)
    return F.aggregate(apart, F.lit(0).cast("long"), lambda a, v: a + v * v)


def whiten(docs: DataFrame, *keys: str, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the key columns, component, n, deviation, whitened, explained, identity_error.

    Usable rows are those of ``scaled``; all of them are fitted, repeated rows as
    often as they are there.  Null keys stay null, other columns are not read.
    Components of equal variance are any basis of their space, each with either
    sign, the same for all rows.  An empty table, and one without variance, give
    an empty result.
    """
    rows = scaled(docs, *keys, vector=vector)
    model = fit(rows, components)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", deviation long, _pf_z array<double>"
    if model is None or not len(model.explained):
        model = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
        rows = rows.limit(0)
    centre = _centring(model.n, model.sums) if model.n else None
    width = len(model.sums)

    def score(batches):
        for batch in batches:
            last = batch.num_columns - 1
            z = model.scores(centre(_matrix(batch.column(last), width))) if batch.num_rows else np.zeros((0, 1))
            offsets = pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=[*batch.schema.names[:last], "_pf_z"])

    placed = rows.select(*keys, deviation(model.n, model.sums, F.col("_pf_x")).alias("deviation"), "_pf_x").mapInArrow(score, schema)
    share = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    flat = placed.select(*keys, "deviation", F.posexplode("_pf_z").alias("_pf_k", "whitened"))
    return flat.select(
        *keys, (F.col("_pf_k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_pf_k")).alias("explained"), F.lit(float(model.error)).alias("identity_error"))
