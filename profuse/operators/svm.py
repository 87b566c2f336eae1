"""Support-vector regression in the primal, many settings per pass.

The tube loss max(0, |r| - e) equals |r - e|/2 + |r + e|/2 - e.  Each absolute
value has a quadratic upper bound that touches it at the current residual, so a
pass sums one weighted Gram per setting and the driver solves small systems; the
objective never rises.  Kernels enter through low-rank features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from profuse.operators.arrays import matrix_of, mixed_uniform, numbers_of, poisson_weights, row_blocks, row_hash, sum_partials
from profuse.operators.gram import check_width
from profuse.operators.kernels import LowRankMap, each_features
from profuse.operators.linear import LinearModel


@dataclass(frozen=True)
class Tube:
    c: float = 1.0
    epsilon: float = 0.1


def fit_tubes(df: DataFrame, tubes: Sequence[Tube], folds: Sequence[int] = (), x: str = "x", y: str = "y",
              fold: str = "fold", passes: int = 25, tol: float = 1e-5, floor: float = 1e-4,
              bags: int = 0, seed=0) -> dict[tuple[int, int], LinearModel]:
    """Models keyed (setting, group).

    With ``folds`` the group is the fold left out and 0 means fitted on all rows;
    with ``bags`` it is the number of a bootstrap copy of the rows.
    """
    groups = list(range(bags)) if bags else [*folds, 0]
    jobs = [(s, g) for s in range(len(tubes)) for g in groups]
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"),
                       (F.col(fold).cast("int") if folds else F.lit(-1)).alias("f"),
                       (row_hash(seed) if bags else F.lit(0).cast("bigint")).alias("h"))
    beta: np.ndarray | None = None  # (1 + p) x jobs, intercept first
    last = np.full(len(jobs), np.inf)
    for step in range(passes):
        sums = sum_partials(source, lambda batches, beta=beta: _pass(batches, beta, jobs, tubes, bags, floor))
        new, value = [], np.zeros(len(jobs))
        grams, rights, losses = _unpacked(sums["all"])
        for j in range(len(jobs)):
            gram, right, loss = grams[j], rights[j], losses[j]
            penalty = np.eye(len(gram))
            penalty[0, 0] = 1e-12
            if beta is not None:
                value[j] = loss + 0.5 * float(beta[1:, j] @ beta[1:, j])
            new.append(np.linalg.solve(gram + penalty, right))
        if step > 1 and bool((last - value <= tol * np.maximum(np.abs(value), 1e-300)).all()):
            break
        beta = np.column_stack(new)
        if step > 0:
            last = value
    return {job: LinearModel(beta[1:, j].copy(), float(beta[0, j]), {"C": tubes[job[0]].c, "epsilon": tubes[job[0]].epsilon})
            for j, job in enumerate(jobs)}


def _pass(batches, beta, jobs, tubes, bags, floor) -> dict[str, np.ndarray]:
    """One task's weighted Grams, right-hand sides and losses of every job: a row per job (see ``_tube_sums``)."""
    out: dict[str, np.ndarray] = {}
    c, e = (np.array([[getattr(tubes[s], name)] for s, _ in jobs]) for name in ("c", "epsilon"))
    left_out = np.array([[g] for _, g in jobs])
    for batch in batches:
        if batch.num_rows == 0:
            continue
        xs, ys = matrix_of(batch.column("x")), numbers_of(batch.column("y"))
        check_width(xs.shape[1], len(jobs))
        fold, base = batch.column("f").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
        for at in row_blocks(len(xs)):
            if bags:
                copies = {g: poisson_weights(mixed_uniform(base[at], g)) for g in {g for _, g in jobs}}
                case = np.stack([copies[g] for _, g in jobs])
            else:
                case = ((left_out == 0) | (fold[at] != left_out)).astype(np.float64)
            sums = _tube_sums(_rows_of(xs[at]), ys[at], beta, c, e, case, floor)
            out["all"] = out["all"] + sums if out else sums
    return out


def _rows_of(features: np.ndarray) -> np.ndarray:
    """One contiguous row per column, after a row of ones."""
    z = np.empty((features.shape[1] + 1, len(features)))
    z[0], z[1:] = 1.0, features.T
    return z


def _tube_sums(z: np.ndarray, ys: np.ndarray, beta: np.ndarray | None, c: np.ndarray, e: np.ndarray, case: np.ndarray, floor: float) -> np.ndarray:
    """A row per job: [upper triangle of the weighted Gram, right-hand side, loss] over a block of rows.

    ``z`` has a row per feature, so the products of two features are contiguous;
    ``c`` and ``e`` are columns and ``case`` weighs each row (a line per job).
    """
    width, n = z.shape
    weight = 0.5 * c * case
    if beta is None:
        gap, u, both = np.repeat(ys[None], len(c), axis=0), np.zeros_like(weight), 2.0 * weight
    else:
        gap = beta.T @ z
        np.subtract(ys, gap, out=gap)
        u, v = gap - e, gap + e
        for side in (u, v):
            np.abs(side, out=side)
            np.maximum(side, floor, out=side)
            np.divide(weight, side, out=side)
        both = u + v
        u -= v
    upper = _upper(width)
    out = np.empty((len(c), len(upper[0]) + width + 1))
    if 2 * len(c) < width:  # few jobs: weighted rows of each cost less than the products that all share
        out[:, :len(upper[0])] = ((both[:, None] * z).reshape(-1, n) @ z.T).reshape(-1, width, width)[:, upper[0], upper[1]]
    else:
        products, at = _scratch(len(upper[0]), n), 0
        for i in range(width):
            np.multiply(z[i:], z[i], out=products[at:at + width - i])
            at += width - i
        out[:, :len(upper[0])] = both @ products.T
    u *= e
    both *= ys
    both -= u
    out[:, len(upper[0]):-1] = both @ z.T
    np.abs(gap, out=gap)
    gap -= e
    np.maximum(gap, 0.0, out=gap)
    out[:, -1] = 2.0 * np.einsum("jn,jn->j", weight, gap)
    return out


@lru_cache
def _upper(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


@lru_cache(maxsize=4)
def _scratch(rows: int, columns: int) -> np.ndarray:
    """Room for products, kept by the worker process: it is larger than all other arrays of a block together."""
    return np.empty((rows, columns))


def tube_scores(df: DataFrame, models: dict[tuple[int, int], LinearModel], folds: Sequence[int], x: str = "x", y: str = "y",
                fold: str = "fold") -> dict[int, float]:
    """Mean R2 over folds of each setting, from one scoring pass."""
    settings = sorted({s for s, _ in models})
    coef = {f: np.column_stack([np.r_[models[s, f].intercept, models[s, f].coef] for s in settings]) for f in folds}
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("f"))

    def partial(batches):
        out: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys = matrix_of(batch.column("x")), numbers_of(batch.column("y"))
            z, fs = np.column_stack([np.ones(len(xs)), xs]), batch.column("f").to_numpy()
            for f in folds:
                use = fs == f
                if use.any():
                    gap = ys[use][:, None] - z[use] @ coef[f]
                    head = [use.sum(), ys[use].sum(), (ys[use] ** 2).sum()]
                    out[str(f)] = out.get(str(f), 0.0) + np.r_[head, (gap ** 2).sum(axis=0)][None]
        return out

    sums = sum_partials(source, partial)
    scores = np.array([1.0 - v[0, 3:] / max(v[0, 2] - v[0, 1] ** 2 / v[0, 0], 1e-300) for v in sums.values()])
    return dict(zip(settings, scores.mean(axis=0)))


# ---- many kernels in the same passes -----------------------------------------

@dataclass
class Panel:
    """Models on one kernel's features, or on the plain vector: a column (intercept, coefficients) per setting."""

    mapping: LowRankMap | None
    settings: list[dict]
    folds: dict[int, np.ndarray]
    whole: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), x if self.mapping is None else self.mapping.features(x)])

    def model(self, setting: int, fold: int = 0) -> LinearModel:
        beta = (self.folds[fold] if fold else self.whole)[:, setting]
        return LinearModel(beta[1:].copy(), float(beta[0]), self.settings[setting])


def fit_kernel_tubes(df: DataFrame, maps: Sequence[LowRankMap | None], tubes: Sequence[Tube], folds: Sequence[int] = (), x: str = "x", y: str = "y",
                     fold: str = "fold", passes: int = 15, tol: float = 1e-5, floor: float = 1e-4,
                     members: Sequence[int] | None = None, seed=0) -> list[Panel]:
    """A panel per kernel map (None: the plain vector); every map, tube and fold advances in the same scan.

    Features are recomputed in the scan, so nothing is written per kernel. A map
    whose models have all settled takes no part in later passes. Settings of a
    panel are those of ``tubes``.  With ``members`` a map is fitted on its
    member's bootstrap copy of the rows.
    """
    groups = [*folds, 0]
    jobs = [(tube, g) for tube in tubes for g in groups]
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), (F.col(fold).cast("int") if folds else F.lit(-1)).alias("f"),
                       (row_hash(seed) if members is not None else F.lit(0).cast("bigint")).alias("h"))
    betas: dict[int, np.ndarray] = {}
    last = {i: np.full(len(jobs), np.inf) for i in range(len(maps))}
    active = list(range(len(maps)))
    for step in range(passes):
        task = [(i, maps[i], betas.get(i), None if members is None else members[i]) for i in active]
        sums = sum_partials(source, lambda batches, task=task: _kernel_pass(batches, task, jobs, floor))
        for i in list(active):
            new, value = _solve_jobs(sums[str(i)])
            if i in betas:
                value = value + 0.5 * (betas[i][1:] ** 2).sum(axis=0)
                if step > 1 and not bool((last[i] - value > tol * np.maximum(np.abs(value), 1e-300)).any()):
                    active.remove(i)
                    continue
                last[i] = value
            betas[i] = new
        if not active:
            break
    names = [{"C": tube.c, "epsilon": tube.epsilon} for tube in tubes]
    at = {g: [j for j, (_, group) in enumerate(jobs) if group == g] for g in groups}
    return [Panel(m, names, {f: betas[i][:, at[f]] for f in folds}, betas[i][:, at[0]]) for i, m in enumerate(maps)]


def _unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams, right-hand sides and losses from the rows of ``_tube_sums``."""
    width = int((np.sqrt(9 + 8 * (sums.shape[1] - 1)) - 3) / 2 + 0.5)  # w (w + 1) / 2 + w entries
    upper = _upper(width)
    gram = np.zeros((len(sums), width, width))
    gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = sums[:, :len(upper[0])]
    return gram, sums[:, len(upper[0]):-1], sums[:, -1]


def _solve_jobs(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions and losses from the rows of ``_tube_sums``."""
    gram, right, loss = _unpacked(sums)
    width = gram.shape[1]
    gram[:, range(width), range(width)] += np.r_[1e-12, np.ones(width - 1)]
    # Unit diagonal first: kernels of high degree spread over many orders of magnitude.
    scale = 1.0 / np.sqrt(np.maximum(np.einsum("jii->ji", gram), 1e-300))
    scaled = gram * scale[:, :, None] * scale[:, None, :]
    right = right * scale
    sound = np.isfinite(scaled).all(axis=(1, 2)) & np.isfinite(right).all(axis=1)
    beta = np.full((len(sums), width), np.nan)
    if sound.any():
        beta[sound] = np.einsum("jab,jb->ja", np.linalg.pinv(scaled[sound], rcond=1e-13, hermitian=True), right[sound]) * scale[sound]
    return beta.T, loss


def _kernel_pass(batches, task, jobs, floor: float) -> dict[str, np.ndarray]:
    """One task's sums of every map: a row per job (see ``_tube_sums``)."""
    out: dict[str, np.ndarray] = {}
    c, e = (np.array([[getattr(tube, name)] for tube, _ in jobs]) for name in ("c", "epsilon"))
    left_out = np.array([[g] for _, g in jobs])
    maps = [mapping for _, mapping, *_ in task]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        xs, ys = matrix_of(batch.column("x")), numbers_of(batch.column("y"))
        fold, base = batch.column("f").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
        for at in row_blocks(len(xs)):
            seen = ((left_out == 0) | (fold[at] != left_out)).astype(np.float64)
            copies = {m: poisson_weights(mixed_uniform(base[at], m)) for m in {m for *_, m in task if m is not None}}
            for (i, _, beta, member), features in zip(task, each_features(maps, xs[at])):
                check_width(features.shape[1], len(jobs) * len(task))
                case = seen if member is None else seen * copies[member]
                sums = _tube_sums(_rows_of(features), ys[at], beta, c, e, case, floor)
                if str(i) in out:
                    out[str(i)] += sums
                else:
                    out[str(i)] = sums
    return out


def panel_predictions(panels: Sequence[Panel], fold: int, x: np.ndarray) -> Iterator[np.ndarray]:
    """Predictions of every panel's models for rows of ``fold`` (a column per setting)."""
    for p, z in zip(panels, each_features([p.mapping for p in panels], x)):
        yield z @ p.folds[fold][1:] + p.folds[fold][0]


def residual_moments(df: DataFrame, panels: Sequence[Panel], folds: Sequence[int], x: str = "x", y: str = "y",
                     fold: str = "fold") -> dict[int, tuple[np.ndarray, float]]:
    """(E'E, centred y'y) per fold, E holding the residuals of all settings of all panels on rows they have not seen.

    One scan. The error of any mean of predictions is a sum of entries of E'E,
    since its residual is the mean of theirs.
    """
    columns = sum(len(p.settings) for p in panels)
    check_width(columns, len(folds))
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("f"))

    def partial(batches):
        out: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys, fs = matrix_of(batch.column("x")), numbers_of(batch.column("y")), batch.column("f").to_numpy()
            for f in folds:
                mine = np.flatnonzero(fs == f)
                for at in row_blocks(len(mine)):
                    own = ys[mine[at]]
                    gaps = np.hstack([own[:, None] - g for g in panel_predictions(panels, f, xs[mine[at]])])
                    z = np.column_stack([np.ones(len(gaps)), own, gaps])
                    out[str(f)] = out.get(str(f), 0.0) + z.T @ z
        return out

    sums = sum_partials(source, partial)
    return {int(f): (m[2:, 2:], float(m[1, 1] - m[0, 1] ** 2 / m[0, 0])) for f, m in sums.items()}


def panel_scores(df: DataFrame, panels: Sequence[Panel], folds: Sequence[int], x: str = "x", y: str = "y", fold: str = "fold") -> list[np.ndarray]:
    """Mean R2 over folds of every setting of every panel, from one scan; settings without finite predictions get -inf."""
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("f"))

    def partial(batches):
        out: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys, fs = matrix_of(batch.column("x")), numbers_of(batch.column("y")), batch.column("f").to_numpy()
            for f in folds:
                mine = np.flatnonzero(fs == f)
                for at in row_blocks(len(mine)):
                    own = ys[mine[at]]
                    gaps = [((own[:, None] - g) ** 2).sum(axis=0) for g in panel_predictions(panels, f, xs[mine[at]])]
                    head = [len(own), own.sum(), (own ** 2).sum()]
                    out[str(f)] = out.get(str(f), 0.0) + np.concatenate([head, *gaps])[None]
        return out

    sums = [v[0] for v in sum_partials(source, partial).values()]
    mean = np.mean([1.0 - v[3:] / max(v[2] - v[1] ** 2 / v[0], 1e-300) for v in sums], axis=0)
    edges = np.cumsum([0, *[len(p.settings) for p in panels]])
    return [np.nan_to_num(mean[a:b], nan=-np.inf) for a, b in zip(edges[:-1], edges[1:])]
