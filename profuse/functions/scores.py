"""Prediction scores as aggregate columns over (truth, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column, floor: float = 1e-7) -> Column:
    """Mean absolute percentage error; small truths are clipped to ``floor``."""
    return F.lit(100.0) * F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(floor)))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST, with SST from the population variance (one pass)."""
    return F.lit(1.0) - F.avg((y - p) * (y - p)) / F.var_pop(y)


def residual_std(y: Column, p: Column) -> Column:
    return F.stddev_pop(y - p)
