"""Tree regressors, AdaBoost.R2 and isolation forests."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from profuse.operators.arrays import mixed_uniform, row_hash, vector_to_number
from profuse.session import stored

MAX_DEPTH = 30  # deepest tree the engine grows


def with_features(df: DataFrame, x: str = "x", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(x)))


def _columns_per_split(value) -> str:
    """'auto' and None mean all columns here; the engine's own 'auto' differs."""
    return "all" if value in (None, "auto") else {"log2": "log2", "sqrt": "sqrt"}.get(value, str(value))


def depth_limit(max_depth: int | None) -> int:
    """None means as deep as the engine grows; a deeper wish is refused, not cut."""
    if max_depth is not None and max_depth > MAX_DEPTH:
        raise ValueError(f"trees grow to depth {MAX_DEPTH} at most")
    return MAX_DEPTH if max_depth is None else max_depth


def fit_tree(df: DataFrame, max_depth: int | None = 5, min_rows: int = 1, y: str = "y", weight: str | None = None, seed: int = 0, bins: int = 64):
    """``bins``: split points tried per column come from that many quantiles."""
    tree = DecisionTreeRegressor(labelCol=y, maxDepth=depth_limit(max_depth), minInstancesPerNode=min_rows, seed=seed, maxBins=bins)
    if weight:
        tree = tree.setWeightCol(weight)
    return tree.fit(df)


def fit_forest(df: DataFrame, trees: int = 100, max_depth: int | None = None, min_rows: int = 1, columns=None, y: str = "y", seed: int = 0, bins: int = 64):
    """Random forest; all columns are tried at a split unless told otherwise."""
    return RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=depth_limit(max_depth), minInstancesPerNode=min_rows, seed=seed,
                                 featureSubsetStrategy=_columns_per_split(columns), maxBins=bins).fit(df)


# ---- AdaBoost.R2 -------------------------------------------------------------

@dataclass
class Boosted:
    trees: list
    logs: list[float]  # log(1 / beta) per tree

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Weighted median of the trees' predictions."""
        keep = df.columns
        for i, tree in enumerate(self.trees):
            df = tree.setPredictionCol(f"_p{i}").transform(df)
        pairs = F.array_sort(F.array(*[
            F.struct(F.col(f"_p{i}").alias("p"), F.lit(float(w)).alias("w")) for i, w in enumerate(self.logs)]))
        half = 0.5 * sum(self.logs)
        walked = F.aggregate(pairs, F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p")),
                             lambda s, e: F.struct((s["w"] + e["w"]).alias("w"),
                                                   F.when(s["p"].isNotNull(), s["p"]).when(s["w"] + e["w"] >= half - 1e-12, e["p"]).alias("p")))
        return df.select(*keep, walked["p"].alias(out))


def fit_boosted(df: DataFrame, rounds: int = 50, max_depth: int = 3, rate: float = 1.0, y: str = "y", store_every: int = 10) -> Boosted:
    """AdaBoost.R2 with case weights in place of resampling and linear loss."""
    work = df.withColumn("_w", F.lit(1.0))
    trees, logs = [], []
    for i in range(rounds):
        tree = fit_tree(work, max_depth, y=y, weight="_w", seed=i).setPredictionCol("_p")
        scored = tree.transform(work).withColumn("_e", F.abs(F.col(y) - F.col("_p")))
        top, total, missed = scored.agg(F.max("_e"), F.sum("_w"), F.sum(F.col("_w") * F.col("_e"))).first()
        if top <= 0:
            trees.append(tree)
            logs.append(1.0 if not logs else max(logs))
            break
        loss = missed / top / total
        if loss >= 0.5:
            if not trees:
                trees.append(tree)
                logs.append(1.0)
            break
        beta = loss / (1.0 - loss)
        trees.append(tree)
        logs.append(rate * float(np.log(1.0 / beta)))
        work = scored.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), (1.0 - F.col("_e") / F.lit(top)) * rate)).select(*df.columns, "_w")
        if (i + 1) % store_every == 0:
            work = stored(work, "boost")
    return Boosted(trees, logs)


# ---- isolation forest --------------------------------------------------------

def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    return np.where(big, 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1), out)


@dataclass
class IsolationForest:
    trees: list[tuple]   # (feature, cut, left, right, depth + c(n)) arrays per tree
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Negative anomaly score: -1 is isolated at once, near 0 is deep inside."""
        depth = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = np.flatnonzero(inner)
                node = at[go]
                at[go] = np.where(x[go, feature[node]] <= cut[node], left[node], right[node])
            depth += path[at]
        return -np.power(2.0, -depth / (len(self.trees) * max(float(average_path(self.rows)), 1e-300)))

    def score_column(self, x: str = "x") -> Column:
        return vector_to_number(self.scores, x)

    def transform(self, df: DataFrame, threshold: float = -0.5, x: str = "x") -> DataFrame:
        return df.withColumn("score", self.score_column(x)).withColumn("outlier", F.col("score") < threshold)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple:
    feature, cut, left, right, path = [], [], [], [], []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for column in (feature, left, right):
            column.append(-1)
        cut.append(0.0)
        path.append(depth + float(average_path(len(rows))))
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        wide = np.flatnonzero(hi > lo)
        if depth < limit and len(rows) > 1 and len(wide):
            j = int(rng.choice(wide))
            at = float(rng.uniform(lo[j], hi[j]))
            goes = rows[:, j] <= at
            feature[me], cut[me] = j, at
            left[me] = add(rows[goes], depth + 1)
            right[me] = add(rows[~goes], depth + 1)
        return me

    add(x, 0)
    return feature, cut, left, right, path


def fit_isolation(df: DataFrame, trees: int = 100, max_samples: int = 100, seed: int = 42, key: str = "sample_id", x: str = "x") -> IsolationForest:
    """Each tree grows on at most ``max_samples`` rows drawn by a per-tree hash.

    A threshold a little above the wanted share thins the rows before the
    per-tree top-k, so the shuffle carries about trees x max_samples rows.
    """
    n = df.count()
    size = min(max_samples, n)
    near = min(1.0, (size + 10 * np.sqrt(size) + 20) / n)
    limit = int(np.ceil(np.log2(max(size, 2))))
    source = df.select(key, F.col(x).alias("x"), row_hash(seed, key).alias("h"))
    for share in (near, 1.0):
        forest = _grow_trees(source, trees, size, share, limit, seed, key)
        if len(forest) == trees and all(r["rows"] == size for r in forest):
            break
    return IsolationForest([
        (np.array(r["feature"]), np.array(r["cut"]), np.array(r["lhs"]), np.array(r["rhs"]), np.array(r["path"]))
        for r in sorted(forest, key=lambda r: r["tree"])], size)


def _grow_trees(source: DataFrame, trees: int, size: int, share: float, limit: int, seed: int, key: str) -> list:
    def draw(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            base = batch.column("h").to_numpy().view(np.uint64)
            for t in range(trees):
                u = mixed_uniform(base, t)
                hit = np.flatnonzero(u < share)
                if len(hit):
                    part = batch.take(pa.array(hit))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hit), t, dtype=np.int32)), pa.array(u[hit]), part.column(key), part.column("x")],
                        ["tree", "u", key, "x"])

    drawn = source.mapInArrow(draw, f"tree int, u double, {key} string, x array<double>")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("u", key))
    picked = drawn.withColumn("place", place).filter(F.col("place") <= size)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        t = int(pdf["tree"].iloc[0])
        grown = _grow(np.vstack(pdf["x"].to_numpy()), np.random.default_rng([seed, t]), limit)
        return pd.DataFrame({"tree": [t], "rows": [len(pdf)], "feature": [grown[0]], "cut": [grown[1]],
                             "lhs": [grown[2]], "rhs": [grown[3]], "path": [grown[4]]})

    schema = "tree int, rows int, feature array<int>, cut array<double>, lhs array<int>, rhs array<int>, path array<double>"
    return picked.groupBy("tree").applyInPandas(build, schema).collect()
