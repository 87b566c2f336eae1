"""Linear regressors solved from moments: the rows are never needed again."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from profuse.operators.arrays import dot_column
from profuse.operators.gram import Moments


@dataclass
class LinearModel:
    coef: np.ndarray
    intercept: float
    params: dict = field(default_factory=dict)

    def column(self, x: str = "x"):
        return dot_column(self.coef, self.intercept, x)

    def transform(self, df: DataFrame, x: str = "x", out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.column(x))


def _model(m: Moments, coef: np.ndarray, fit_intercept: bool = True, **params) -> LinearModel:
    intercept = m.mean_y - float(m.mean_x @ coef) if fit_intercept else 0.0
    return LinearModel(np.asarray(coef, dtype=float), float(intercept), params)


def _system(m: Moments, fit_intercept: bool = True):
    return m.centred() if fit_intercept else (m.xx, m.xy, m.yy)


def ols(m: Moments) -> LinearModel:
    """Least squares; the minimum-norm solution when columns are dependent."""
    a, b, _ = _system(m)
    return _model(m, np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b)


def ridge(m: Moments, alpha: float = 1.0) -> LinearModel:
    """Objective |y - Xw|^2 + alpha |w|^2."""
    a, b, _ = _system(m)
    return _model(m, np.linalg.solve(a + alpha * np.eye(m.p), b), alpha=alpha)


def elastic_net(m: Moments, alpha: float = 1.0, l1_ratio: float = 0.5, tol: float = 1e-10, rounds: int = 5000) -> LinearModel:
    """Objective |y - Xw|^2 / 2n + alpha (r |w|_1 + (1 - r)/2 |w|^2) by coordinate descent."""
    if not 0.0 <= l1_ratio <= 1.0:
        raise ValueError("l1_ratio lies in [0, 1]")
    a, b, _ = _system(m)
    a, b = a / m.n, b / m.n
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    w, slope = np.zeros(m.p), b.copy()  # slope = b - a w
    scale = np.diag(a).copy()
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            rho = slope[j] + scale[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (scale[j] + l2)
            step = new - w[j]
            if step:
                slope -= a[:, j] * step
                w[j] = new
                moved = max(moved, abs(step))
        if moved <= tol * max(1.0, np.abs(w).max()):
            break
    return _model(m, w, alpha=alpha, l1_ratio=l1_ratio)


def lasso(m: Moments, alpha: float = 1.0) -> LinearModel:
    found = elastic_net(m, alpha, 1.0)
    return LinearModel(found.coef, found.intercept, {"alpha": alpha})


def _angle_path(a, b, stop_count: int, stop_corr: float, drop: bool) -> np.ndarray:
    """Least-angle path on (X'X, X'y): all active columns keep equal correlation."""
    p = len(b)
    w, active, banned = np.zeros(p), [], set()
    tiny = 1e-12 * max(float(np.abs(b).max(initial=0.0)), 1e-300)
    just_left = -1
    for _ in range(8 * p + 8):
        corr = b - a @ w
        level = float(np.abs(corr[active]).max()) if active else float(np.abs(corr).max(initial=0.0))
        if level <= max(stop_corr, tiny):
            break
        if just_left < 0:
            rest = [j for j in range(p) if j not in active and j not in banned]
            if not rest and not active:
                break
            if rest:
                best = max(rest, key=lambda j: (abs(corr[j]), -j))
                if not active or abs(corr[best]) >= level * (1 - 1e-9):
                    if len(active) >= stop_count:
                        break
                    sub = a[np.ix_([*active, best], [*active, best])]
                    if np.linalg.eigvalsh(sub)[0] <= 1e-12 * np.trace(sub):
                        banned.add(best)
                        continue
                    active.append(best)
        just_left = -1
        signs = np.sign(corr[active])
        direction = np.linalg.solve(a[np.ix_(active, active)], signs)
        drift = a[:, active] @ direction
        level = float(np.abs(corr[active]).max())
        gamma = level - stop_corr
        for j in range(p):
            if j in active or j in banned:
                continue
            for top, bottom in ((level - corr[j], 1 - drift[j]), (level + corr[j], 1 + drift[j])):
                if bottom > 1e-12 and 1e-12 * level < top / bottom < gamma:
                    gamma = top / bottom
        leaving = -1
        if drop:
            for place, j in enumerate(active):
                cross = -w[j] / direction[place] if direction[place] else np.inf
                if 1e-12 * level < cross < gamma:
                    gamma, leaving = cross, j
        w[active] += gamma * direction
        if leaving >= 0:
            w[leaving] = 0.0
            active.remove(leaving)
            just_left = leaving
    return w


def lars(m: Moments, n_nonzero: int = 500) -> LinearModel:
    """Least-angle regression with a cap on the number of used features."""
    a, b, _ = _system(m)
    return _model(m, _angle_path(a, b, n_nonzero, 0.0, False), n_nonzero=n_nonzero)


def lasso_lars(m: Moments, alpha: float = 1.0, fit_intercept: bool = True) -> LinearModel:
    """The lasso solution at ``alpha`` found along the least-angle path."""
    a, b, _ = _system(m, fit_intercept)
    w = _angle_path(a, b, m.p, alpha * m.n, True)
    return _model(m, w, fit_intercept, alpha=alpha)


def matching_pursuit(m: Moments, n_nonzero: int = 10) -> LinearModel:
    """Orthogonal matching pursuit: take the best column, refit, repeat."""
    a, b, _ = _system(m)
    active: list[int] = []
    w = np.zeros(m.p)
    floor = 1e-10 * max(float(np.abs(b).max(initial=0.0)), 1e-300)
    while len(active) < min(n_nonzero, m.p):
        corr = np.abs(b - a @ w)
        corr[active] = -1.0
        j = int(np.argmax(corr))
        if corr[j] <= floor:
            break
        active.append(j)
        w = np.zeros(m.p)
        w[active] = np.linalg.lstsq(a[np.ix_(active, active)], b[active], rcond=1e-12)[0]
    return _model(m, w, n_nonzero=n_nonzero)


def bayesian_ridge(m: Moments, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6) -> LinearModel:
    """Evidence maximisation of noise and weight precision (flat gamma priors)."""
    a, b, c = _system(m)
    values, vectors = np.linalg.eigh(a)
    values, rotated = np.clip(values, 0.0, None), vectors.T @ b
    noise, weight, w = m.n / max(c, 1e-300), 1.0, np.zeros(m.p)
    for step in range(rounds):
        new = vectors @ (rotated / (values + weight / noise))
        rss = max(c - 2 * new @ b + new @ a @ new, 0.0)
        used = float((noise * values / (weight + noise * values)).sum())
        weight = (used + 2 * prior) / (new @ new + 2 * prior)
        noise = (m.n - used + 2 * prior) / (rss + 2 * prior)
        done = step > 0 and np.abs(new - w).sum() < tol
        w = new
        if done:
            break
    w = vectors @ (rotated / (values + weight / noise))
    return _model(m, w, noise_precision=float(noise), weight_precision=float(weight))


SOLVERS = {
    "ols": ols, "ridge": ridge, "lasso": lasso, "elastic_net": elastic_net, "lars": lars,
    "lasso_lars": lasso_lars, "matching_pursuit": matching_pursuit, "bayesian_ridge": bayesian_ridge,
}

# The search grid of each linear regressor.
GRIDS = {
    "ols": {},
    "ridge": {"alpha": [0.01, 0.1, 1, 5, 100]},
    "lasso": {"alpha": [0.01, 0.1, 1, 5, 100]},
    "elastic_net": {"alpha": [0.001, 0.05, 0.1, 1, 100], "l1_ratio": [0.001, 0.05, 0.01, 0.1, 1]},
    "lars": {"n_nonzero": [20, 30, 50]},
    "lasso_lars": {"alpha": [0.01, 0.1, 1], "fit_intercept": [True, False]},
    "matching_pursuit": {"n_nonzero": [10, 20, 30, 50]},
    "bayesian_ridge": {},
}
