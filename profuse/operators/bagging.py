"""Bags over several base regressors, searched with every member and fold in the same scans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from profuse.functions.kernels import gamma_kernel
from profuse.operators import svm
from profuse.operators.arrays import matrix_of, mixed_uniform, numbers_of, poisson_weights, row_blocks, row_hash, sum_partials
from profuse.operators.ensemble import Vote, drawn_columns
from profuse.operators.gram import Moments, check_width, total_of, width_of
from profuse.operators.kernels import Drawn, each_features, landmark_rows, nystrom
from profuse.operators.linear import LinearModel, elastic_net, ridge
from profuse.session import spread

# The base regressors and sizes of the bagging search.
BASES = {
    "svr": {"C": 0.1, "degree": 2, "gamma": 0.05, "kernel": "rbf"},
    "ridge": {"alpha": 100.0},
    "elastic_net": {"alpha": 0.05, "l1_ratio": 0.01},
    "kernel_ridge": {"alpha": 100.0, "degree": 4, "gamma": 0.01, "kernel": "poly"},
}
SIZES = (10, 50)


def bag_moments(df: DataFrame, entries: Sequence[tuple], seed=0, x: str = "x", y: str = "y", fold: str = "fold") -> list[dict[int, Moments]]:
    """Moments by fold of every (member, map) entry, rows weighted by the member's bootstrap counts; one scan.

    A map of None means the plain vector.
    """
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("f"), row_hash(seed).alias("h"))
    maps = [mapping for _, mapping in entries]

    def partial(batches):
        out: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys, fs = matrix_of(batch.column("x")), numbers_of(batch.column("y")), batch.column("f").to_numpy()
            base = batch.column("h").to_numpy().view(np.uint64)
            for f in np.unique(fs):
                mine = np.flatnonzero(fs == f)
                for at in row_blocks(len(mine)):
                    part, own = xs[mine[at]], np.column_stack([np.ones(len(mine[at])), ys[mine[at]]])
                    copies = {m: poisson_weights(mixed_uniform(base[mine[at]], m)) for m in {m for m, _ in entries}}
                    for i, ((member, _), features) in enumerate(zip(entries, each_features(maps, part))):
                        check_width(features.shape[1], len(entries) * len(np.unique(fs)))
                        z, key = np.column_stack([own[:, 0], features, own[:, 1]]), f"{i}|{f}"
                        out[key] = out.get(key, 0.0) + (z * copies[member][:, None]).T @ z
        return out

    found: list[dict[int, Moments]] = [{} for _ in entries]
    for key, z in sum_partials(source, partial).items():
        i, f = key.split("|")
        found[int(i)][int(f)] = Moments(z)
    return found


def _panel(parts: dict[int, Moments], folds: Sequence[int], solver, settings: dict, mapping=None, columns=None) -> svm.Panel:
    """Fold models of one member; drawn plain features fold back into coefficients of the whole vector."""

    def column(m: Moments) -> np.ndarray:
        if columns is None:
            fit = solver(m, **settings)
            return np.r_[fit.intercept, fit.coef][:, None]
        fit, coef = solver(m.take(columns), **settings), np.zeros(m.p)
        np.add.at(coef, columns, fit.coef)
        return np.r_[fit.intercept, coef][:, None]

    whole = total_of(parts)
    return svm.Panel(mapping, [settings], {f: column(whole - parts[f] if f in parts else whole) for f in folds}, column(whole))


def bag_scores(df: DataFrame, bags: Sequence[Sequence[svm.Panel]], sizes: Sequence[int], folds: Sequence[int],
               x: str = "x", y: str = "y", fold: str = "fold") -> np.ndarray:
    """Mean R2 over folds of the first ``size`` members of every bag (bags x sizes), from one scan."""
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("f"))
    starts = np.cumsum([0, *[len(bag) for bag in bags]])[:-1]

    def partial(batches):
        out: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys, fs = matrix_of(batch.column("x")), numbers_of(batch.column("y")), batch.column("f").to_numpy()
            for f in folds:
                mine = np.flatnonzero(fs == f)
                for at in row_blocks(len(mine)):
                    own, errors = ys[mine[at]], []
                    each = np.hstack(list(svm.panel_predictions([p for bag in bags for p in bag], f, xs[mine[at]])))
                    for start in starts:
                        errors += [((own - each[:, start:start + size].mean(axis=1)) ** 2).sum() for size in sizes]
                    head = [len(own), own.sum(), (own ** 2).sum()]
                    out[str(f)] = out.get(str(f), 0.0) + np.array([[*head, *errors]])
        return out

    sums = [v[0] for v in sum_partials(source, partial).values()]
    mean = np.mean([1.0 - v[3:] / max(v[2] - v[1] ** 2 / v[0], 1e-300) for v in sums], axis=0)
    return np.nan_to_num(mean.reshape(len(bags), len(sizes)), nan=-np.inf)


def bagging_search(train: DataFrame, bases: dict[str, dict] | None = None, sizes: Sequence[int] = SIZES, modes: Sequence[bool] = (True, False),
                   folds: Sequence[int] = range(1, 6), rank: int = 20, epsilon: float = 0.1, fold: str = "fold", seed: int = 0,
                   x: str = "x", passes: int = 15) -> tuple[Vote, list[dict], np.ndarray]:
    """Bags of every base, size and feature mode, scored by folds; the best, every setting and its score.

    A smaller bag is the beginning of a larger one.  ``modes`` says whether
    members draw features with replacement; a kernel then reads the drawn
    features only.  Linear bases share one scan, kernel ridge takes one, support
    vectors one a pass.  The best is the mean of its members fitted on all rows.
    """
    bases = BASES if bases is None else bases
    if set(bases) - set(BASES):
        raise ValueError(f"bases are {', '.join(BASES)}")
    train = spread(train, "bags")
    members, width = range(max(sizes)), width_of(train, x)
    columns = {m: drawn_columns(width, m, seed) for m in members}
    marks = landmark_rows(train, rank, seed, x=x) if {"svr", "kernel_ridge"} & set(bases) else None

    def maps(spec: dict, drawn: bool) -> list:
        kernel = gamma_kernel(spec["kernel"], spec.get("gamma", 1.0), spec.get("degree", 3), spec.get("coef0", 0.0))
        if not drawn:
            return len(members) * [nystrom(train, kernel, rank, landmarks=marks)]
        return [Drawn(columns[m], nystrom(train, kernel, rank, landmarks=marks[:, columns[m]]), marks) for m in members]

    plain = None
    bags: list[tuple[str, bool, list[svm.Panel]]] = []
    for name, spec in bases.items():
        if name in ("ridge", "elastic_net"):
            if plain is None:
                plain = bag_moments(train, [(m, None) for m in members], seed, x, fold=fold)
            solver = ridge if name == "ridge" else elastic_net
            for drawn in modes:
                bags.append((name, drawn, [_panel(plain[m], folds, solver, spec, columns=columns[m] if drawn else None) for m in members]))
            continue
        each = [(drawn, mapping) for drawn in modes for mapping in maps(spec, drawn)]
        if name == "kernel_ridge":
            parts = bag_moments(train, [(i % len(members), mapping) for i, (_, mapping) in enumerate(each)], seed, x, fold=fold)
            panels = [_panel(part, folds, ridge, {"alpha": spec["alpha"]}, mapping) for part, (_, mapping) in zip(parts, each)]
        else:
            panels = svm.fit_kernel_tubes(train, [mapping for _, mapping in each], [svm.Tube(float(spec["C"]), epsilon)], folds, x, fold=fold,
                                          passes=passes, members=[i % len(members) for i in range(len(each))], seed=seed)
        bags += [(name, drawn, panels[k * len(members):(k + 1) * len(members)]) for k, drawn in enumerate(modes)]
    scores = bag_scores(train, [bag for _, _, bag in bags], sizes, folds, x, fold=fold)
    settings = [{"base": name, "n_estimators": size, "bootstrap_features": drawn} for name, drawn, _ in bags for size in sizes]
    b, s = np.unravel_index(int(scores.argmax()), scores.shape)
    vote = Vote([(p.mapping, LinearModel(p.whole[1:, 0].copy(), float(p.whole[0, 0]))) for p in bags[b][2][:sizes[s]]])
    return vote, settings, scores.ravel()
