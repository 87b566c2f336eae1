"""Parameter grids and cross-validated search."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from profuse.operators.gram import Moments, total_of
from profuse.operators.linear import GRIDS, SOLVERS, LinearModel


def parameter_grid(space: dict[str, Sequence]) -> list[dict]:
    """Every combination, keys in alphabetical order."""
    keys = sorted(space)
    return [dict(zip(keys, values)) for values in itertools.product(*[space[k] for k in keys])]


def grid_rows(spark: SparkSession, space: dict[str, Sequence]) -> DataFrame:
    """The same combinations as rows: one exploded array per parameter."""
    out = spark.range(1).select()
    for key in sorted(space):
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in space[key]])).alias(key))
    return out


def step_values(start: float, stop: float, jump: float) -> list[float]:
    """Evenly stepped values from ``start`` up to, not including, ``stop``."""
    count = int(np.ceil((stop - start) / jump - 1e-9))
    return [start + i * jump for i in range(max(count, 0))]


def params_text(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


def search_moments(folds: dict[str, Moments], solver: Callable[..., LinearModel], space: dict) -> tuple[LinearModel, dict, float]:
    """Mean R2 over folds for every setting, then a refit of the best on all folds.

    Training statistics of a fold are the total minus the fold, so the search
    needs no scan beyond the one that produced the moments.
    """
    whole = total_of(folds)
    best, best_score = None, -np.inf
    for params in parameter_grid(space):
        scores = []
        for part in folds.values():
            fit = solver(whole - part, **params)
            scores.append(part.r2(fit.coef, fit.intercept))
        score = float(np.mean(scores))
        if score > best_score:
            best, best_score = params, score
    return solver(whole, **best), best, best_score


def linear_leaderboard(folds: dict[str, Moments], test: Moments, grids: dict = GRIDS) -> list[tuple]:
    """(model, params, cv_r2, test_mse) for every linear regressor."""
    rows = []
    for name, space in grids.items():
        model, params, score = search_moments(folds, SOLVERS[name], space)
        rows.append((name, params_text(params), score, test.mse(model.coef, model.intercept)))
    return sorted(rows, key=lambda row: row[3])


LEADERBOARD_SCHEMA = "model string, params string, cv_r2 double, test_mse double"
