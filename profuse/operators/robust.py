"""Robust and online linear regressors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from profuse.functions.hashing import seeded_hash
from profuse.operators.arrays import dot_column, matrix_of, numbers_of, sum_partials
from profuse.operators.gram import member_moments, moments
from profuse.operators.linear import LinearModel, ols
from profuse.operators.rank import hash_rank
from profuse.session import stored


# ---- exact quantiles ---------------------------------------------------------

def exact_quantile(df: DataFrame, column: str, q: float, bins: int = 4096, final: int = 20_000) -> float:
    """Interpolated quantile by narrowing a histogram; at most ``final`` values are collected."""
    v = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("v")).first()
    place = q * (n - 1)
    lower, upper = int(math.floor(place)), int(math.ceil(place))
    found = _order_statistics(v, low, high, lower, upper, bins, final)
    return found[0] + (place - lower) * (found[1] - found[0])


def _order_statistics(v: DataFrame, low: float, high: float, a: int, b: int, bins: int, final: int) -> tuple[float, float]:
    if a != b:
        x = _order_statistics(v, low, high, a, a, bins, final)[0]
        y = _order_statistics(v, low, high, b, b, bins, final)[0]
        return x, y
    skipped = 0
    while low < high:
        width = (high - low) / bins
        inside = v.filter((F.col("v") >= low) & (F.col("v") <= high))
        slot = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
        counts = sorted(inside.groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        for _, n, lo, hi in counts:
            if skipped + n > a:
                low, high, size = lo, hi, n
                break
            skipped += n
        if low < high and size <= final:
            values = sorted(r[0] for r in v.filter((F.col("v") >= low) & (F.col("v") <= high)).collect())
            low = high = values[a - skipped]
    return low, low


def median_deviation(df: DataFrame, column: str = "y") -> float:
    """Median absolute deviation from the median."""
    df = stored(df.select(column), "column")  # one narrow column, scanned several times
    middle = exact_quantile(df, column, 0.5)
    return exact_quantile(df.select(F.abs(F.col(column) - middle).alias("d")), "d", 0.5)


# ---- subset fits -------------------------------------------------------------

def hashed_subsets(df: DataFrame, subsets: int, size: int, seed: int, key: str = "sample_id") -> DataFrame:
    """``subsets`` draws of ``size`` distinct rows each, as (subset, row columns).

    The draw list has subsets x size ranks, made on the driver.  Only keys are
    ranked; the drawn keys, as bounded as the list, then find their rows.
    """
    n = df.count()
    if size > n:
        raise ValueError(f"subsets of {size} rows from {n}")
    rng = np.random.default_rng(seed)
    ranks = np.concatenate([rng.choice(n, size, replace=False) for _ in range(subsets)]) + 1
    wanted = df.sparkSession.createDataFrame(pa.table({"subset": np.repeat(np.arange(subsets, dtype=np.int32), size), "rank": ranks.astype(np.int64)}))
    drawn = hash_rank(df.select(key), key, seed).join(F.broadcast(wanted), "rank").select("subset", "rank", key)
    return df.join(F.broadcast(drawn), key)


def _subset_fits(subsets: DataFrame, x: str, y: str) -> np.ndarray:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        z = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["x"].to_numpy())])
        beta = np.linalg.lstsq(z, pdf["y"].to_numpy(), rcond=None)[0]
        return pd.DataFrame({"subset": [int(pdf["subset"].iloc[0])], "beta": [beta]})

    rows = subsets.select("subset", "rank", F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    fits = rows.groupBy("subset").applyInPandas(solve, "subset int, beta array<double>").collect()
    return np.array([r["beta"] for r in sorted(fits, key=lambda r: r["subset"])])


def spatial_median(points: np.ndarray, rounds: int = 300, tol: float = 1e-8) -> np.ndarray:
    """Point of least summed distance (Weiszfeld steps; points at the centre are skipped)."""
    centre = points.mean(axis=0)
    for _ in range(rounds):
        distance = np.linalg.norm(points - centre, axis=1)
        far = distance > 1e-12
        if not far.any():
            break
        weights = 1.0 / distance[far]
        new = (points[far] * weights[:, None]).sum(axis=0) / weights.sum()
        moved = np.linalg.norm(new - centre)
        centre = new
        if moved <= tol * max(1.0, np.linalg.norm(centre)):
            break
    return centre


def theil_sen(df: DataFrame, subsets: int = 1000, seed=0, x: str = "x", y: str = "y") -> LinearModel:
    """Spatial median of least-squares fits on small hashed subsets (p + 1 rows each)."""
    p = len(df.select(x).first()[0])
    beta = spatial_median(_subset_fits(hashed_subsets(df, subsets, p + 1, seed), x, y))
    return LinearModel(beta[1:], float(beta[0]), {"subsets": subsets})


# ---- consensus ---------------------------------------------------------------

def ransac(df: DataFrame, min_samples: float = 0.5, trials: int = 20, threshold: float | None = None, seed=0,
           x: str = "x", y: str = "y") -> LinearModel:
    """Fit many samples, keep the fit with most inliers, refit on its inliers.

    A share below 1 samples rows by hash, all trials in one Gram pass; a count of
    1 or more draws that many rows per trial.  One further pass counts inliers of
    every candidate.
    """
    rows = df.select("sample_id", F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    limit = median_deviation(rows) if threshold is None else threshold
    if min_samples < 1:
        found = [ols(m) for m in member_moments(rows, trials, lambda u, _: (u < min_samples).astype(float), seed)]
        betas = np.array([[f.intercept, *f.coef] for f in found])
    else:
        betas = _subset_fits(hashed_subsets(rows, trials, int(min_samples), seed), "x", "y")

    def count(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ys = numbers_of(batch.column("y"))[:, None]
            gap = np.abs(ys - betas[:, 0] - matrix_of(batch.column("x")) @ betas[:, 1:].T)
            hit = gap <= limit
            total = total + np.vstack([hit.sum(axis=0), (hit * gap ** 2).sum(axis=0), (hit * ys).sum(axis=0), (hit * ys ** 2).sum(axis=0)])
        return {"t": total} if np.ndim(total) else {}

    n, sse, sy, syy = sum_partials(rows, count)["t"]
    fit_r2 = 1.0 - sse / np.maximum(syy - sy ** 2 / np.maximum(n, 1), 1e-300)
    best = max(range(len(betas)), key=lambda t: (n[t], fit_r2[t], -t))
    residual = F.abs(F.col("y") - dot_column(betas[best, 1:], betas[best, 0]))
    final = ols(moments(rows.filter(residual <= limit))["all"])
    final.params = {"min_samples": min_samples, "inliers": int(n[best]), "threshold": float(limit)}
    return final


# ---- Huber -------------------------------------------------------------------

def huber(df: DataFrame, epsilon: float = 1.35, alpha: float = 1e-4, x: str = "x", y: str = "y") -> LinearModel:
    """Joint fit of weights and scale; ``alpha`` multiplies |w|^2 in the summed loss."""
    n = df.count()
    rows = df.select(array_to_vector(F.col(x)).alias("features"), F.col(y).alias("label"))
    fit = LinearRegression(loss="huber", epsilon=epsilon, regParam=2.0 * alpha / n, standardization=False,
                           maxIter=100, tol=1e-8).fit(rows)
    return LinearModel(fit.coefficients.toArray(), float(fit.intercept), {"scale": float(fit.scale)})


# ---- passive-aggressive ------------------------------------------------------

def passive_aggressive(df: DataFrame, c: float = 1.0, epsilon: float = 0.1, epochs: int = 5, shard_rows: int = 10_000,
                       seed=0, x: str = "x", y: str = "y", key: str = "sample_id") -> LinearModel:
    """Online updates inside bounded shards, weights averaged after every epoch.

    Shards and their order come from a hash of the key, so the result is the same for any partitioning
    and no shard grows with the table.
    """
    n = df.count()
    shards = max(1, math.ceil(n / shard_rows))
    rows = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), seeded_hash(seed, key).alias("h")).withColumn(
        "shard", F.pmod(F.col("h"), F.lit(shards)))
    width = len(df.select(x).first()[0])
    beta = np.zeros(width + 1)
    for epoch in range(epochs):
        start = beta.copy()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(pdf["h"].to_numpy() ^ np.int64(epoch * 0x9E3779B9), kind="stable")
            z = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["x"].to_numpy())])[order]
            target, size = pdf["y"].to_numpy()[order], np.maximum((z * z).sum(axis=1), 1e-300)
            w = start.copy()
            for i in range(len(z)):
                gap = target[i] - z[i] @ w
                step = min(c, max(abs(gap) - epsilon, 0.0) / size[i])
                if step:
                    w += np.sign(gap) * step * z[i]
            return pd.DataFrame({"n": [len(z)], "w": [w]})

        parts = rows.groupBy("shard").applyInPandas(run, "n bigint, w array<double>")
        weighted = parts.select("n", F.posexplode("w").alias("i", "w")).groupBy("i").agg(
            (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).collect()
        beta = np.array([r["w"] for r in sorted(weighted, key=lambda r: r["i"])])
        if np.abs(beta - start).max() <= 1e-6:
            break
    return LinearModel(beta[1:], float(beta[0]), {"C": c})

