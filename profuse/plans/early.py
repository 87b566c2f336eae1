"""Early integration: tune any regressor on fused vectors and rank the results."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from profuse.functions import scores
from profuse.functions.kernels import gamma_kernel
from profuse.operators import bagging, ensemble, forest, gram, kernels, linear, network, robust, svm, trees
from profuse.operators.neighbors import neighbour_regression
from profuse.operators.tuning import parameter_grid, params_text
from profuse.session import spread, stored


SIDE = 8  # searches whose jobs run side by side


@dataclass
class Neighbours:
    """Lazy learner: prediction is a join with the training rows."""

    train: DataFrame
    k: int
    weights: str
    p: int

    def transform(self, df: DataFrame) -> DataFrame:
        found = neighbour_regression(self.train, df.select("sample_id", "x"), (self.k,), (self.weights,), self.p)
        return df.join(found.select("sample_id", "prediction"), "sample_id")


@dataclass
class Mapped:
    """A linear model on low-rank kernel features."""

    mapping: kernels.LowRankMap
    model: linear.LinearModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(kernels.apply_maps(df, [self.mapping], "x", "_g"), "_g").drop("_g")


@dataclass
class Featured:
    """A tree model that reads the engine's own vector type."""

    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(trees.with_features(df)).drop("features")


def _support_vectors(df, kernel="linear", C=1.0, gamma=0.05, degree=3, coef0=0.0, epsilon=0.1, rank=30, passes=15):
    tube = svm.Tube(float(C), epsilon)
    if kernel == "linear":
        return svm.fit_tubes(df, [tube], passes=passes)[0, 0]
    mapping = kernels.nystrom(df, gamma_kernel(kernel, gamma, degree, coef0), rank)
    return Mapped(mapping, svm.fit_tubes(kernels.apply_maps(df, [mapping], "x", "_g"), [tube], x="_g", passes=passes)[0, 0])


def _kernel_ridge(df, kernel="rbf", alpha=1.0, gamma=0.05, degree=3, rank=30):
    mapping = kernels.nystrom(df, gamma_kernel(kernel, gamma, degree), rank)
    return Mapped(mapping, kernels.kernel_ridge(df, [mapping], alpha).model)


def _perceptron(width: int, start: float, hidden=(100, 3), activation="relu", alpha=1e-4):
    """A feed-forward network whose output begins at ``start``, the mean response of its training rows."""
    net = network.Network.build(network.perceptron("all", hidden, activation), {"all": (0, width)}, l2=alpha)
    net.weights[-1] = np.full((1, 1), start)
    return net


def _network(df, hidden=(100, 3), activation="relu", alpha=1e-4, epochs=60, rate=0.01, patience=10):
    net = _perceptron(gram.width_of(df), df.agg(F.avg("y")).first()[0], hidden, activation, alpha)
    network.train(df, [network.Job(net, epochs, rate=rate, patience=patience)])
    return net


# Model name -> function (training rows, parameters) -> object with ``transform``.
FITTERS: dict[str, Callable] = {
    "passive_aggressive": robust.passive_aggressive,
    "ransac": robust.ransac,
    "theil_sen": robust.theil_sen,
    "huber": robust.huber,
    "svr": _support_vectors,
    "knn": lambda df, k=5, weights="uniform", p=2: Neighbours(df, k, weights, p),
    "gaussian_process": lambda df, noise=1e-2, rank=30: _kernel_ridge(df, "rbf", noise, 0.5, rank=rank),
    "kernel_ridge": _kernel_ridge,
    "tree": lambda df, max_depth=5, min_rows=1: Featured(trees.fit_tree(trees.with_features(df), max_depth, min_rows)),
    "nn": _network,
    "random_forest": lambda df, n_estimators=100, max_depth=None, min_rows=1, max_features=None: Featured(
        trees.fit_forest(trees.with_features(df), n_estimators, max_depth, min_rows, max_features)),
    "bagging": lambda df, n_estimators=10, bootstrap_features=False, alpha=100.0: ensemble.bag_linear(
        df, linear.ridge, n_estimators, bootstrap_features, alpha=alpha),
    "adaboost": lambda df, rounds=50: Featured(trees.fit_boosted(trees.with_features(df), rounds)),
}


def search(rows: DataFrame, fit: Callable, space: dict, folds: int) -> tuple[object, dict, float]:
    """Mean R2 over folds of every setting, then a refit of the best on all training rows.

    ``rows`` carry ``fold`` 1..k for training and 0 for test.  The folds of a
    setting are fitted side by side, since the jobs of one fit seldom keep all
    cores busy; a lone setting is refitted meanwhile.
    """
    settings, train = parameter_grid(space), F.col("fold") > 0

    def held_out(params, f):
        model = fit(rows.filter(train & (F.col("fold") != f)), **params)
        scored = model.transform(rows.filter(F.col("fold") == f))
        return scored.groupBy("fold").agg(scores.r2(F.col("y"), F.col("prediction")).alias("r2")).collect()

    best, top = None, -np.inf
    with ThreadPoolExecutor(folds + 1) as pool:
        whole = pool.submit(fit, rows.filter(train), **settings[0]) if len(settings) == 1 else None
        for params in settings:
            found = [r["r2"] for part in pool.map(lambda f, params=params: held_out(params, f), range(1, folds + 1)) for r in part]
            score = float(np.mean([v for v in found if v is not None]))
            if score > top:
                best, top = params, score
        model = whole.result() if whole else None
    return model or fit(rows.filter(train), **best), best, top


def search_kernel_ridge(rows: DataFrame, space: dict, folds: int, rank: int = 30) -> tuple[Mapped, dict, float]:
    """Kernel ridge: two scans whatever the number of settings, one for Grams by fold and one for fold errors.

    Settings that a kernel ignores are not repeated; all kernels share landmarks of the training rows.
    """
    train = spread(rows.filter(F.col("fold") > 0), "search")
    settings = ensemble.kernel_settings(space)
    alphas = [float(a) for a in space.get("alpha", [1.0])]
    marks = kernels.landmark_rows(train, rank, 0)
    maps = [kernels.nystrom(train, gamma_kernel(kind, gamma, degree, coef0), rank, landmarks=marks) for kind, gamma, degree, coef0 in settings]
    parts = kernels.map_moments(train, maps)
    whole = [gram.total_of({g: m for (j, g), m in parts.items() if j == i}) for i in range(len(maps))]

    def models(i, f):
        fits = [linear.ridge(whole[i] - parts[i, f], a) for a in alphas]
        return np.column_stack([np.r_[fit.intercept, fit.coef] for fit in fits])

    found = kernels.fold_r2(train, maps, {str(f): [models(i, str(f)) for i in range(len(maps))] for f in range(1, folds + 1)})
    scores = np.nan_to_num(np.array(found), nan=-np.inf)
    i, a = np.unravel_index(int(scores.argmax()), scores.shape)
    kind, gamma, degree, coef0 = settings[i]
    params = {"kernel": kind, "gamma": gamma, "degree": degree, "coef0": coef0, "alpha": alphas[a]}
    return Mapped(maps[i], linear.ridge(whole[i], alphas[a])), params, float(scores[i, a])


def search_neighbours(rows: DataFrame, space: dict, folds: int) -> tuple[Neighbours, dict, float]:
    """Neighbours: one search per metric and fold gives every count and weighting."""
    ks, kinds = tuple(space.get("k", (5,))), tuple(space.get("weights", ("uniform",)))
    train = stored(rows.filter(F.col("fold") > 0), "search")

    def scored(p, f):
        held = train.filter(F.col("fold") == f)
        found = neighbour_regression(train.filter(F.col("fold") != f), held.select("sample_id", "x"), ks, kinds, p)
        return found.join(held.select("sample_id", "fold", "y"), "sample_id").groupBy("fold", "k", "weights").agg(
            scores.r2(F.col("y"), F.col("prediction")).alias("r2")).collect()

    best, top, ps = None, -np.inf, space.get("p", [2])
    with ThreadPoolExecutor(SIDE) as pool:  # the jobs of one search are many and short
        parts = list(pool.map(lambda pf: scored(*pf), [(p, f) for p in ps for f in range(1, folds + 1)]))
    for i, p in enumerate(ps):
        each: dict[tuple, list] = {}
        for r in (r for part in parts[i * folds:(i + 1) * folds] for r in part):
            each.setdefault((r["k"], r["weights"]), []).append(r["r2"])
        for (k, kind), values in sorted(each.items()):
            score = float(np.mean([v for v in values if v is not None] or [-np.inf]))
            if score > top:
                best, top = {"k": k, "weights": kind, "p": p}, score
    return Neighbours(train, **best), best, float(top)


def search_tubes(rows: DataFrame, space: dict, folds: int) -> tuple[object, dict, float]:
    """Support vectors: every C and fold of a kernel in the same passes."""
    found = ensemble.tune_tubes(spread(rows.filter(F.col("fold") > 0), "search"), space, range(1, folds + 1), "fold", passes=space.get("passes", [15])[0])
    return found.whole if found.mapping is None else Mapped(found.mapping, found.whole), found.params, found.score


def search_networks(rows: DataFrame, space: dict, folds: int, rate: float = 0.01, patience: int = 10) -> tuple[network.Network, dict, float]:
    """Feed-forward networks: every setting and fold trains in the same passes and stops early on its own.

    The networks fitted on all training rows take part too, so the best needs no refit.
    """
    train = spread(rows.filter(F.col("fold") > 0), "search")
    width = gram.width_of(train)
    epochs = space.get("epochs", [60])[0]
    settings = parameter_grid({k: v for k, v in space.items() if k != "epochs"})
    groups = [*range(1, folds + 1), 0]
    parts = {r["fold"]: np.array([r["n"], r["total"]]) for r in train.groupBy("fold").agg(F.count("y").alias("n"), F.sum("y").alias("total")).collect()}
    sums = {f: sum(parts.values()) - parts.get(f, 0.0) for f in groups}
    jobs = [network.Job(_perceptron(width, sums[f][1] / sums[f][0], **s), epochs, f, rate, patience=patience) for s in settings for f in groups]
    network.train(train, jobs, fold="fold")
    scores = np.array(network.fold_scores(train, [job for job in jobs if job.left_out], fold="fold")).reshape(len(settings), folds)
    mean = np.nan_to_num(scores.mean(axis=1), nan=-np.inf)
    best = int(mean.argmax())
    return jobs[best * len(groups) + folds].net, {**settings[best], "epochs": epochs}, float(mean[best])


def search_bagging(rows: DataFrame, space: dict, folds: int) -> tuple[ensemble.Vote, dict, float]:
    """Bags: every base, size, feature mode, member and fold in shared scans."""
    bases = {name: bagging.BASES[name] for name in space.get("base", bagging.BASES)}
    vote, settings, found = bagging.bagging_search(rows.filter(F.col("fold") > 0), bases, space.get("n_estimators", [10]),
                                                   space.get("bootstrap_features", [False]), range(1, folds + 1))
    best = int(found.argmax())
    return vote, settings[best], float(found[best])


def search_forests(rows: DataFrame, space: dict, folds: int) -> tuple[object, dict, float]:
    """Random forests: one scan grows the trees of all settings and folds; sizes and depths share trees.

    A table whose binned rows are too many for a task is searched setting by setting with the engine's forests.
    """
    settings = parameter_grid({"n_estimators": [100], "max_depth": [None], "min_rows": [1], "max_features": [None], **space})
    width = gram.width_of(rows)
    if rows.count() * width > forest.BYTES:
        return search(rows, FITTERS["random_forest"], space, folds)
    cuts = forest.cut_points(rows.filter(F.col("fold") > 0), width)
    coded = forest.binned(forest.numbered(rows), cuts)

    def key(s):
        return trees.depth_limit(s["max_depth"]), (s["min_rows"], forest.columns_per_split(s["max_features"], width))

    families = sorted({key(s)[1] for s in settings})
    sizes, depths = (sorted({f(s) for s in settings}) for f in (lambda s: s["n_estimators"], lambda s: key(s)[0]))
    found = forest.prediction_sums(coded, families, sizes, depths, range(1, folds + 1))
    cells = [(a, b) for a in sizes for b in depths]
    table = found.groupBy("family", "fold").agg(*[scores.r2(F.col("y"), F.col("p")[i]).alias(f"r{i}") for i in range(len(cells))])
    per_fold = np.full((len(families), folds, len(cells)), np.nan)
    for r in table.collect():
        per_fold[r["family"], r["fold"] - 1] = [np.nan if v is None else v for v in r[2:]]
    mean = np.nan_to_num(np.nanmean(per_fold, axis=1), nan=-np.inf)
    score = [mean[families.index(key(s)[1]), cells.index((s["n_estimators"], key(s)[0]))] for s in settings]
    best = settings[int(np.argmax(score))]
    depth, family = key(best)
    model = forest.Forest(rows.filter(F.col("fold") > 0), cuts, best["n_estimators"], depth, *family)
    return model, {k: best[k] for k in space}, float(max(score))


# Families whose settings share scans; the others are searched setting by setting.
SEARCHES: dict[str, Callable] = {"kernel_ridge": search_kernel_ridge, "knn": search_neighbours, "svr": search_tubes, "nn": search_networks,
                                "bagging": search_bagging, "random_forest": search_forests}


def leaderboard(rows: DataFrame, spaces: dict[str, dict], folds: int) -> list[tuple]:
    """(model, params, cv_r2, test_mse) of every named regressor, best test error first."""

    def entry(name):
        shared, space = SEARCHES.get(name), spaces[name]
        model, params, score = shared(rows, space, folds) if shared else search(rows, FITTERS[name], space, folds)
        test = model.transform(rows.filter(F.col("fold") == 0))
        return name, params_text(params), score, float(test.agg(scores.mse(F.col("y"), F.col("prediction"))).first()[0])

    with ThreadPoolExecutor(SIDE) as pool:  # tasks of one regressor run while the driver solves for another
        return sorted(pool.map(entry, spaces), key=lambda row: row[3])


# Search grids of the non-linear and ensemble regressors.  Trees take a least number of rows per leaf, not per split,
# and grow to depth 30 at most (None), so these two axes are this library's own.
NONLINEAR = {
    "svr": {"kernel": ["linear", "poly", "rbf", "sigmoid"], "C": [0.1, 1, 3, 10, 20], "degree": [2, 4, 6, 8],
            "gamma": [0.001, 0.05, 0.01, 0.1, 1, 100]},
    "knn": {"k": [5, 10, 35, 50, 100], "weights": ["uniform", "distance"], "p": [1, 2]},
    "gaussian_process": {},
    "tree": {"max_depth": [2, 20, None], "min_rows": [1, 5, 75]},
    "nn": network.GRID,
    "kernel_ridge": {"alpha": [0.001, 0.05, 0.1, 1, 100], "kernel": ["linear", "poly", "rbf", "sigmoid", "laplacian"],
                     "degree": [2, 4, 6, 8], "gamma": [0.001, 0.05, 0.01, 0.1, 1, 100]},
}
ENSEMBLES = {
    "random_forest": {"n_estimators": [100, 200, 500], "max_depth": [10, 25, None], "min_rows": [1, 5, 10, 15],
                      "max_features": ["auto", "sqrt", "log2", None]},
    "bagging": {"base": list(bagging.BASES), "n_estimators": list(bagging.SIZES), "bootstrap_features": [True, False]},
    "adaboost": {},
}
ROBUST = {
    "passive_aggressive": {"c": [0.1, 1, 3, 10, 20]},
    "ransac": {"min_samples": [0.5, 0.7, 0.85, 1]},
    "theil_sen": {},
    "huber": {},
}
