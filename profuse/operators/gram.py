"""Sufficient statistics of a linear model, for every fold in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profuse.operators.arrays import matrix_of, mixed_uniform, numbers_of, row_hash, sum_partials

MAX_DOUBLES = 1 << 27  # 1 GiB of statistics per task
MAX_WIDTH = 2_000


@dataclass
class Moments:
    """Z'WZ of Z = [1, x, y]: count, sums and cross products."""

    z: np.ndarray

    @property
    def n(self) -> float:
        return float(self.z[0, 0])

    @property
    def p(self) -> int:
        return len(self.z) - 2

    @property
    def mean_x(self) -> np.ndarray:
        return self.z[0, 1:-1] / self.n

    @property
    def mean_y(self) -> float:
        return float(self.z[0, -1] / self.n)

    @property
    def xx(self) -> np.ndarray:
        return self.z[1:-1, 1:-1]

    @property
    def xy(self) -> np.ndarray:
        return self.z[1:-1, -1]

    @property
    def yy(self) -> float:
        return float(self.z[-1, -1])

    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Centred X'X, X'y and y'y."""
        mx, my = self.mean_x, self.mean_y
        return (self.xx - self.n * np.outer(mx, mx), self.xy - self.n * mx * my, self.yy - self.n * my * my)

    def take(self, columns) -> "Moments":
        keep = np.r_[0, np.asarray(columns, dtype=int) + 1, self.p + 1]
        return Moments(self.z[np.ix_(keep, keep)])

    def sse(self, coef: np.ndarray, intercept: float) -> float:
        a, b, c = self.centred()
        gap = self.mean_y - intercept - float(self.mean_x @ coef)
        return max(float(c - 2 * coef @ b + coef @ a @ coef) + self.n * gap * gap, 0.0)

    def mse(self, coef: np.ndarray, intercept: float) -> float:
        return self.sse(coef, intercept) / self.n

    def r2(self, coef: np.ndarray, intercept: float) -> float:
        return 1.0 - self.sse(coef, intercept) / self.centred()[2]

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.z + other.z)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.z - other.z)


def width_of(df: DataFrame, column: str = "x") -> int:
    return len(df.select(column).first()[0])


def check_width(p: int, groups: int) -> None:
    if p > MAX_WIDTH or groups * (p + 2) ** 2 > MAX_DOUBLES:
        raise ValueError(
            f"{p} features x {groups} groups exceed the statistics a task may hold; "
            "filter by variance, whitelist or draw features first")


def moments(df: DataFrame, by: str | None = None, x: str = "x", y: str = "y") -> dict[str, Moments]:
    """Moments per value of ``by`` (fold, split, ...); one scan whatever their number."""
    cols = [F.col(x).alias("x"), F.col(y).cast("double").alias("y")]
    cols.append((F.col(by) if by else F.lit("all")).cast("string").alias("g"))

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs = matrix_of(batch.column("x"))
            z = np.column_stack([np.ones(len(xs)), xs, numbers_of(batch.column("y"))])
            groups = batch.column("g").to_numpy(zero_copy_only=False)
            for g in np.unique(groups.astype(str)):
                rows = z[groups == g]
                check_width(xs.shape[1], len(total) + 1)
                total[g] = total.get(g, 0.0) + rows.T @ rows
        return total

    return {g: Moments(m) for g, m in sum_partials(df.select(*cols), partial).items()}


def member_moments(df: DataFrame, members: int, weigh: Callable[[np.ndarray, int], np.ndarray], seed,
                   x: str = "x", y: str = "y") -> list[Moments]:
    """Moments of ``members`` weighted copies of the rows in one scan.

    ``weigh(u, member)`` turns one uniform hash per row into its weight.
    """
    cols = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), row_hash(seed).alias("h"))

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs = matrix_of(batch.column("x"))
            check_width(xs.shape[1], members)
            z = np.column_stack([np.ones(len(xs)), xs, numbers_of(batch.column("y"))])
            base = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            for m in range(members):
                w = weigh(mixed_uniform(base, m), m)
                total[str(m)] = total.get(str(m), 0.0) + (z * w[:, None]).T @ z
        return total

    found = sum_partials(cols, partial)
    return [Moments(found[str(m)]) for m in range(members)]


def total_of(parts: dict[str, Moments]) -> Moments:
    out = None
    for part in parts.values():
        out = part if out is None else out + part
    return out
