"""Collinearity pruning, principal components and non-negative factors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from profuse.operators.arrays import matrix_of, mixed_uniform, row_blocks, sum_partials, vector_to_vector
from profuse.operators.gram import check_width, moments, width_of
from profuse.session import spread, stored


# ---- variance inflation ------------------------------------------------------

def inflation(xx: np.ndarray) -> np.ndarray:
    """Variance inflation of every column, no intercept, from X'X alone.

    Columns that are a combination of others get infinity: they are those with
    an entry in the null space.
    """
    scale = np.sqrt(np.diag(xx))
    out = np.ones(len(xx))
    live = scale > 0
    corr = xx[np.ix_(live, live)] / np.outer(scale[live], scale[live])
    values, vectors = np.linalg.eigh(corr)
    flat = values < 1e-12 * max(values.max(initial=0.0), 1e-300)
    found = (vectors[:, ~flat] ** 2 / values[~flat]).sum(axis=1)
    found[(np.abs(vectors[:, flat]) > 1e-6).any(axis=1)] = np.inf
    out[live] = found
    return out


def prune_inflated(xx: np.ndarray, names: Sequence[str], thresh: float = 5.0) -> list[tuple[str, float]]:
    """Drop the most inflated column (first on ties) until all are at most ``thresh``."""
    kept = list(range(len(names)))
    while True:
        factors = inflation(xx[np.ix_(kept, kept)])
        worst = int(np.argmax(factors))
        if len(kept) == 1 or factors[worst] <= thresh:
            return [(names[j], factors[i]) for i, j in enumerate(kept)]
        kept.pop(worst)


# ---- principal components ----------------------------------------------------

@dataclass
class Components:
    mean: np.ndarray
    axes: np.ndarray       # p x r
    variances: np.ndarray  # population variance of each component

    def first(self, n: int) -> "Components":
        return Components(self.mean, self.axes[:, :n], self.variances[:n])

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        mean, axes = self.mean, self.axes
        return df.withColumn(x, vector_to_vector(lambda m: (m - mean) @ axes, x))


def signed(axes: np.ndarray) -> np.ndarray:
    """Fix each column's sign: its largest entry in size is positive."""
    top = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    return axes * np.where(top < 0, -1.0, 1.0)


SOLVERS = ("full", "randomized", "arpack")


def fit_pca(df: DataFrame, n_components: int, x: str = "x", svd_solver: str = "full", seed: int = 0) -> Components:
    """Components of the centred rows.

    ``full`` takes one Gram pass and is bounded in width; ``randomized`` sketches
    the range of the covariance and ``arpack`` builds a Krylov space of it, both
    from products with a few vectors, so that no p x p matrix exists anywhere.
    """
    if svd_solver not in SOLVERS:
        raise ValueError(f"svd_solver is one of {', '.join(SOLVERS)}")
    if svd_solver != "full":
        rows = stored(df.select(F.col(x).alias("x")), "components")
        product = _Spread(rows)
        return (_sketch if svd_solver == "randomized" else _lanczos)(product, min(n_components, product.p), seed)
    m = moments(df.select(F.col(x).alias("x"), F.lit(0.0).alias("y")))["all"]
    values, vectors = np.linalg.eigh(m.centred()[0] / m.n)
    order = np.argsort(values)[::-1][:n_components]
    return Components(m.mean_x, signed(vectors[:, order]), values[order])


def fit_pca_by(df: DataFrame, by: str, n_components: int, x: str = "x") -> dict[str, Components]:
    """Components of every group's centred rows; widths may differ between groups.

    One scan sums the Grams of all groups, so ``by`` has few values and every
    group is bounded in width.
    """
    source = df.select(F.col(by).cast("string").alias("g"), F.col(x).alias("x"))

    def partial(batches):
        out: dict[str, np.ndarray] = {}
        for batch in batches:
            groups = batch.column("g")
            for g in groups.unique().to_pylist():
                m = matrix_of(batch.column("x").filter(pc.equal(groups, g)))
                check_width(m.shape[1], len(out) + 1)
                z = np.column_stack([np.ones(len(m)), m])
                out[g] = out.get(g, 0.0) + z.T @ z
        return out

    found = {}
    for g, z in sum_partials(source, partial).items():
        n, mean = z[0, 0], z[0, 1:] / z[0, 0]
        values, vectors = np.linalg.eigh(z[1:, 1:] / n - np.outer(mean, mean))
        order = np.argsort(values)[::-1][:n_components]
        found[g] = Components(mean, signed(vectors[:, order]), values[order])
    return found


def transform_by(df: DataFrame, fits: dict[str, Components], by: str, x: str = "x") -> DataFrame:
    """Every row's scores on the components of its group; groups without components give NULL."""

    @F.arrow_udf("array<double>")
    def apply(groups: pa.Array, rows: pa.Array) -> pa.Array:
        out = [None] * len(rows)
        for g in groups.unique().to_pylist():
            if g in fits:
                mine = pc.equal(groups, g)
                scores = (matrix_of(rows.filter(mine)) - fits[g].mean) @ fits[g].axes
                for i, row in zip(np.flatnonzero(mine.to_numpy(zero_copy_only=False)), scores):
                    out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    return df.withColumn(x, apply(F.col(by).cast("string"), F.col(x)))


class _Spread:
    """The covariance of the rows as an operator: a product with p x l vectors is one scan with p x l sums."""

    def __init__(self, rows: DataFrame) -> None:
        def totals(batches):
            n, s = 0, 0.0
            for batch in batches:
                if batch.num_rows:
                    m = matrix_of(batch.column("x"))
                    n, s = n + len(m), s + m.sum(axis=0)
            return {"n": np.array([[float(n)]]), "s": np.asarray(s)[None]} if n else {}

        sums = sum_partials(rows, totals)
        if not sums:
            raise ValueError("no rows to take components of")
        self.rows, self.n = rows, sums["n"][0, 0]
        self.mean = sums["s"][0] / self.n
        self.p = len(self.mean)

    def times(self, vectors: np.ndarray) -> np.ndarray:
        mean = self.mean

        def partial(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    m = matrix_of(batch.column("x")) - mean
                    part = m.T @ (m @ vectors)
                    total = part if total is None else total + part
            return {} if total is None else {"cv": total}

        return sum_partials(self.rows, partial)["cv"] / self.n


def _gaussian(rows: int, columns: int, seed: int) -> np.ndarray:
    """Hashed normal numbers, the same on every run."""
    ids = np.arange(rows * columns, dtype=np.uint64)
    u, v = mixed_uniform(ids, 2 * seed), mixed_uniform(ids, 2 * seed + 1)
    return (np.sqrt(-2.0 * np.log(1.0 - u)) * np.cos(2.0 * np.pi * v)).reshape(rows, columns)


def _sketch(spread: _Spread, n: int, seed: int, extra: int = 10, passes: int = 30, tol: float = 1e-10) -> Components:
    """Range sketch with power passes until the wanted variances stand still, then a small eigenproblem."""
    basis = np.linalg.qr(_gaussian(spread.p, min(spread.p, n + extra), seed))[0]
    last = np.zeros(n)
    for _ in range(passes):
        image = spread.times(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        found = values[::-1][:n]
        if np.abs(found - last).max() <= tol * max(found[0], 1e-300):
            break
        last, before = found, basis
        basis = np.linalg.qr(image)[0]
    else:
        basis = before
    return Components(spread.mean, signed(basis @ turn[:, ::-1][:, :n]), found)


def _lanczos(spread: _Spread, n: int, seed: int, tol: float = 1e-9, most: int = 300) -> Components:
    """Lanczos with full reorthogonalisation; ends when the wanted pairs have small residuals.

    A Krylov space that closes early is continued with a fresh vector, so equal
    variances are found as often as they occur.
    """
    fresh = lambda k: _gaussian(spread.p, 1, seed + 1 + k)[:, 0]
    basis, alpha, beta = np.zeros((spread.p, 0)), [], []
    v = fresh(0)
    v /= np.linalg.norm(v)
    while True:
        basis = np.column_stack([basis, v])
        image = spread.times(v[:, None])[:, 0]
        alpha.append(float(v @ image))
        for _ in range(2):
            image -= basis @ (basis.T @ image)
        k, left = len(alpha), float(np.linalg.norm(image))
        small = np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1)
        values, turn = np.linalg.eigh(small)
        values, turn = values[::-1], turn[:, ::-1]
        scale = max(values[0], 1e-300)
        closed = left <= 1e-12 * scale
        if k == spread.p or (k >= min(spread.p, n + 2) and not closed and (left * np.abs(turn[-1, :n]) <= tol * scale).all()):
            break
        if k == most:
            raise ValueError(f"no convergence in {most} passes")
        if closed:
            image = fresh(k)
            for _ in range(2):
                image -= basis @ (basis.T @ image)
            beta.append(0.0)
        else:
            beta.append(left)
        v = image / np.linalg.norm(image)
    return Components(spread.mean, signed(basis @ turn[:, :n]), values[:n])


# ---- non-negative factors ----------------------------------------------------

@dataclass
class Factors:
    """Rows ~ W H with both non-negative; W follows from a row and H."""

    h: np.ndarray
    losses: list[float]
    l2: float
    l1: float

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        h, l1, l2 = self.h, self.l1, self.l2
        return df.withColumn(x, vector_to_vector(lambda m: nonnegative_rows(m, h, l1, l2), x))


def _sweeps(gram: np.ndarray, target: np.ndarray, w: np.ndarray, l1: float, l2: float, sweeps: int = 200) -> np.ndarray:
    """Non-negative least squares, all rows at once, by coordinate descent."""
    scale = max(float(np.abs(target).max(initial=0.0)), 1e-300)
    target, w = np.ascontiguousarray(target.T), np.ascontiguousarray(w.T)  # a component's entries side by side
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(gram)):
            width = gram[j, j] + l2
            if width <= 0:
                continue
            new = np.maximum((target[j] - l1 - gram[j] @ w + w[j] * gram[j, j]) / width, 0.0)
            moved = max(moved, float(np.abs(new - w[j]).max(initial=0.0)) * width)
            w[j] = new
        if moved <= 1e-10 * scale:
            break
    return np.ascontiguousarray(w.T)


def nonnegative_rows(x: np.ndarray, h: np.ndarray, l1: float = 0.0, l2: float = 0.0) -> np.ndarray:
    gram, out = h @ h.T, np.zeros((len(x), len(h)))
    for at in row_blocks(len(x)):
        out[at] = _sweeps(gram, x[at] @ h.T, out[at], l1, l2)
    return out


def fit_nmf(df: DataFrame, n_components: int, alpha: float = 0.0, l1_ratio: float = 0.0, rounds: int = 30,
            tol: float = 1e-4, seed: int = 0, x: str = "x") -> Factors:
    """Alternating non-negative least squares for one setting (see ``fit_nmf_grid``)."""
    return fit_nmf_grid(df, [(n_components, alpha, l1_ratio)], rounds, tol, seed, x)[0]


def fit_nmf_grid(df: DataFrame, settings: Sequence[tuple[int, float, float]], rounds: int = 30, tol: float = 1e-4,
                 seed: int = 0, x: str = "x") -> list[Factors]:
    """Factors of every (components, alpha, l1_ratio); all settings advance in the same scans.

    A row of W is recomputed from the row and H, so no state is kept between
    rounds: each is one scan that sums W'W, W'X and the loss of every setting
    that still moves.  Settings with equal penalties are fitted once.
    """
    rows = spread(df.select(F.col(x).alias("x")), "factors")
    p = width_of(rows)
    keys = [(int(n), float(alpha * ratio), float(alpha * (1.0 - ratio))) for n, alpha, ratio in settings]
    mean = max(float(rows.agg(F.avg(F.aggregate("x", F.lit(0.0), lambda s, v: s + v))).first()[0]) / p, 1e-12)
    state = {k: np.sqrt(mean / k[0]) * mixed_uniform(np.arange(k[0] * p, dtype=np.uint64), seed).reshape(k[0], p) * 2.0 for k in keys}
    losses: dict[tuple, list[float]] = {k: [] for k in state}
    active = list(state)
    check_width(sum(k[0] for k in active) + p, 1)
    for _ in range(rounds):
        task = [(str(i), k, state[k]) for i, k in enumerate(active)]

        def partial(batches, task=task):
            out: dict[str, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                m = matrix_of(batch.column("x"))
                for name, (_, l1, l2), h in task:
                    w = nonnegative_rows(m, h, l1, l2)
                    loss = 0.5 * ((m - w @ h) ** 2).sum() + l1 * w.sum() + 0.5 * l2 * (w * w).sum()
                    sums = np.vstack([np.hstack([w.T @ w, w.T @ m]), np.full((1, len(h) + m.shape[1]), loss)])
                    out[name] = out.get(name, 0.0) + sums
            return out

        sums = sum_partials(rows, partial)
        for name, k, h in task:
            (n, l1, l2), found = k, sums[name]
            loss = float(found[-1, 0]) + l1 * h.sum() + 0.5 * l2 * (h * h).sum()
            losses[k].append(float(loss))
            if len(losses[k]) > 1 and losses[k][-2] - loss <= tol * losses[k][0]:
                active.remove(k)
                continue
            state[k] = _sweeps(found[:-1, :n], found[:-1, n:].T, h.T.copy(), l1, l2).T
        if not active:
            break
    return [Factors(state[k], losses[k], k[2], k[1]) for k in keys]
