"""Imputation, factors, kernels, support vectors, neighbours, trees, stacking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profuse.functions.kernels import KERNELS, Kernel, gamma_kernel
from profuse.operators import ensemble, impute, kernels, linear, neighbors, reduce, svm, trees
from profuse.operators.gram import moments


def frame(spark, x, y=None, ids=None):
    y = np.zeros(len(x)) if y is None else y
    ids = [f"s{i:04d}" for i in range(len(x))] if ids is None else ids
    data = [(ids[i], [None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(len(x))]
    return spark.createDataFrame(data, "sample_id string, x array<double>, y double").repartition(4)


def collected(df, column="x"):
    rows = sorted(df.select("sample_id", column).collect())
    return np.array([r[1] for r in rows], dtype=float)


# ---- imputation --------------------------------------------------------------

@pytest.fixture(scope="module")
def gappy():
    rng = np.random.default_rng(8)
    full = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 7))
    holes = rng.random(full.shape) < 0.15
    return full, np.where(holes, np.nan, full), holes


def test_imputation_recovers_low_rank(spark, gappy):
    full, x, holes = gappy
    fit = impute.soft_impute(frame(spark, x), rank=2, thresh=1e-12, max_steps=60, store_every=7)
    filled = collected(fit.transform("fill"))
    np.testing.assert_array_equal(filled[~holes], x[~holes])
    assert np.abs(filled - full)[holes].max() < 0.05 * np.abs(full).max()
    whole = collected(fit.transform("reconstruct"))
    assert np.linalg.matrix_rank(whole, tol=1e-6) == 2


def twin_soft_impute(x, u, rank, lam, steps):
    """Published alternating scheme in numpy, from the same start."""
    miss = np.isnan(x)
    fill = np.where(miss, np.nanmean(x, axis=0), x)
    u, d = u, np.ones(rank)
    for _ in range(steps):
        b = (u.T @ fill) * (d / (d + lam) if lam else 1.0)[:, None] if lam else u.T @ fill
        v, d, r = np.linalg.svd(b.T, full_matrices=False)
        u = u @ r.T
        fill = np.where(miss, (u * d) @ v.T, x)
        a = fill @ v * (d / (d + lam) if lam else 1.0)
        low = a @ v.T
        uu, d, r = np.linalg.svd(a, full_matrices=False)
        u, v = uu, v @ r.T
        fill = np.where(miss, low, x)
    return low


@pytest.mark.parametrize("lam", [0.0, 1.5])
def test_imputation_matches_numpy_twin(spark, gappy, lam):
    _, x, _ = gappy
    df = frame(spark, x)
    hashes = df.select("sample_id", impute.row_hash(0).alias("h")).collect()
    h = np.array([r["h"] for r in sorted(hashes)], dtype=np.int64)
    start = impute._start_factor(h, 2)
    values, vectors = np.linalg.eigh(start.T @ start)
    start = start @ (vectors / np.sqrt(values))
    fit = impute.soft_impute(df, rank=2, lam=lam, thresh=0.0, max_steps=6, store_every=4)
    np.testing.assert_allclose(collected(fit.transform("reconstruct")), twin_soft_impute(x, start, 2, lam, 6), atol=1e-7)


def test_nonnegative_factors(spark):
    rng = np.random.default_rng(5)
    x = rng.random((80, 3)) @ rng.random((3, 9))
    df = frame(spark, x)
    model = reduce.fit_nmf(df, 3, rounds=40, tol=0.0)
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    w = collected(model.transform(df))
    assert (w >= 0).all() and (model.h >= 0).all()
    assert np.abs(w @ model.h - x).max() < 0.1 * x.max()


# ---- kernels -----------------------------------------------------------------

@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 3))
    return x, np.sin(x[:, 0]) + 0.3 * x[:, 1] ** 2


@pytest.mark.parametrize("kind", sorted(KERNELS))
def test_kernel_diagonal_and_symmetry(points, kind):
    x, _ = points
    k = Kernel(kind)
    full = k(x, x)
    np.testing.assert_allclose(full, full.T, atol=1e-12)
    np.testing.assert_allclose(k.diagonal(x), np.diag(full), atol=1e-9)


def test_gamma_parametrisation(points):
    x, _ = points
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.testing.assert_allclose(gamma_kernel("rbf", 0.3)(x, x), np.exp(-0.3 * d), atol=1e-12)
    np.testing.assert_allclose(gamma_kernel("poly", 0.3, 2, 1.0)(x, x), (0.3 * x @ x.T + 1) ** 2, atol=1e-12)


def test_nystrom_matches_dense(spark, points):
    x, _ = points
    df = frame(spark, x)
    k = Kernel("rbf", {"sigma": 1.5})
    fit = kernels.nystrom(df, k, 10)
    g = collected(kernels.apply_maps(df, [fit]), "g")
    a = fit.landmarks
    np.testing.assert_allclose(g @ g.T, k(x, a) @ np.linalg.pinv(k(a, a)) @ k(a, x), atol=1e-7)
    residual = kernels.trace_residual(df, fit).first()[0]
    assert abs(residual - np.trace(k(x, x) - g @ g.T)) < 1e-8


def test_cholesky_residual_never_rises(spark, points):
    x, _ = points
    k = Kernel("rbf", {"sigma": 1.0})
    fit = kernels.incomplete_cholesky(frame(spark, x[:12]), k, 12)
    assert all(b <= a + 1e-9 for a, b in zip(fit.residuals, fit.residuals[1:]))
    assert fit.residuals[-1] <= 1e-6
    g = fit.features(x[:12])
    np.testing.assert_allclose(g @ g.T, k(x[:12], x[:12]), atol=1e-5)


def test_kernel_ridge_matches_dense(spark, points):
    x, y = points
    df = frame(spark, x, y)
    k = Kernel("rbf", {"sigma": 1.0})
    fit = kernels.kernel_ridge(df, [kernels.nystrom(df, k, len(x))], 0.5)
    got = collected(fit.transform(df), "prediction")
    c = np.eye(len(x)) - 1 / len(x)
    kc = c @ k(x, x) @ c
    np.testing.assert_allclose(got, y.mean() + kc @ np.linalg.solve(kc + 0.5 * np.eye(len(x)), y - y.mean()), atol=1e-4)


def test_alignment_weights_match_dense(spark, points):
    x, y = points
    df = frame(spark, x, y)
    ks = [Kernel("linear"), Kernel("rbf", {"sigma": 2.0}), Kernel("poly", {"degree": 2})]
    maps = [kernels.nystrom(df, k, len(x)) for k in ks]
    m, blocks = kernels.block_moments(df, maps)
    c = np.eye(len(x)) - 1 / len(x)
    dense = [c @ k(x, x) @ c for k in ks]
    yc = y - y.mean()
    np.testing.assert_allclose(kernels.align(m, blocks), [yc @ d @ yc for d in dense], rtol=1e-4)
    between = np.array([[(p * q).sum() for q in dense] for p in dense])
    want = np.linalg.solve(between, [yc @ d @ yc for d in dense])
    np.testing.assert_allclose(kernels.alignf(m, blocks), want / want.sum(), rtol=1e-2, atol=1e-3)
    convex = kernels.alignf(m, blocks, "convex")
    assert (convex >= 0).all() and abs(convex.sum() - 1) < 1e-12


def test_greedy_kernel_path(spark, points):
    """The first column chosen is the best of all candidates; error falls with rank."""
    x, y = points
    df = frame(spark, x, y)
    ks = [Kernel("rbf", {"sigma": 1.0}), Kernel("linear"), Kernel("poly", {"degree": 2})]
    path = kernels.forward_kernels(df, ks, rank=5, lam=0.01, ahead=len(x))
    gains = []
    for k in ks:
        full = k(x, x)
        for i in range(len(x)):
            if full[i, i] > 1e-9:
                g = full[:, i] / np.sqrt(full[i, i])
                g = g - g.mean()
                gains.append((g @ (y - y.mean())) ** 2 / (g @ g + 0.01))
    assert abs(path.chosen[0][1] - max(gains)) < 1e-4 * max(gains)
    short = kernels.forward_kernels(df, ks, rank=1, lam=0.01, ahead=len(x))
    mse = lambda p: float(((collected(p.model.transform(df), "prediction") - y) ** 2).mean())
    assert mse(path) < mse(short) < y.var()


# ---- support vectors ---------------------------------------------------------

def objective(x, y, w, b, t):
    return 0.5 * w @ w + t.c * np.maximum(np.abs(y - x @ w - b) - t.epsilon, 0).sum()


def test_tubes_reach_the_minimum(spark, points):
    x, y = points
    df = frame(spark, x, y).withColumn("fold", F.pmod(F.xxhash64("sample_id"), F.lit(2)).cast("int") + 1)
    tubes = [svm.Tube(1.0, 0.1), svm.Tube(10.0, 0.3)]
    fits = svm.fit_tubes(df, tubes, (1, 2), passes=60, tol=1e-9)
    rng = np.random.default_rng(0)
    for s, t in enumerate(tubes):
        fit = fits[s, 0]
        best = objective(x, y, fit.coef, fit.intercept, t)
        for _ in range(300):
            step = rng.normal(size=4) * rng.choice([1e-1, 1e-2, 1e-3])
            assert best <= objective(x, y, fit.coef + step[:3], fit.intercept + step[3], t) * (1 + 2e-4)
    folds = np.array([r["fold"] for r in sorted(df.select("sample_id", "fold").collect())])
    alone = svm.fit_tubes(df.filter("fold <> 1"), tubes[:1], passes=60, tol=1e-9)[0, 0]
    np.testing.assert_allclose(fits[0, 1].coef, alone.coef, atol=1e-4)
    score = svm.tube_scores(df, {k: v for k, v in fits.items() if k[1]}, (1, 2))[0]
    want = []
    for f in (1, 2):
        gap = y[folds == f] - x[folds == f] @ fits[0, f].coef - fits[0, f].intercept
        want.append(1 - (gap ** 2).sum() / ((y[folds == f] - y[folds == f].mean()) ** 2).sum())
    assert abs(score - np.mean(want)) < 1e-9


# ---- neighbours --------------------------------------------------------------

@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("chunk", [8, 2048])
def test_neighbours_match_brute_force_with_a_hot_group(spark, p, chunk):
    """A third of the training rows are copies of one point; ties go to the smaller id."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 3))
    x[::3] = x[0]
    y = rng.normal(size=90)
    q = np.vstack([rng.normal(size=(25, 3)), x[:5]])
    train, queries = frame(spark, x, y), frame(spark, q, ids=[f"q{i:03d}" for i in range(len(q))])
    got = neighbors.nearest(train, queries, 7, p, pivots=5, chunk=chunk).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["place"]] = (r["neighbor_id"], r["distance"])
    d = np.abs(q[:, None] - x[None]).sum(2) if p == 1 else np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(q)):
        order = sorted(range(90), key=lambda j: (round(d[i, j], 12), j))[:7]
        assert [found[f"q{i:03d}"][k + 1][0] for k in range(7)] == [f"s{j:04d}" for j in order]


def test_neighbour_weights(spark):
    train = frame(spark, np.array([[0.0], [1.0], [3.0]]), np.array([1.0, 2.0, 6.0]))
    queries = frame(spark, np.array([[0.0], [2.0]]), ids=["a", "b"])
    out = {(r["sample_id"], r["weights"]): r["prediction"] for r in
           neighbors.neighbour_regression(train, queries, (2,), ("uniform", "distance")).collect()}
    assert out == {("a", "uniform"): 1.5, ("a", "distance"): 1.0, ("b", "uniform"): 4.0, ("b", "distance"): 4.0}


# ---- trees -------------------------------------------------------------------

def test_boosting_takes_the_weighted_median(spark, points):
    x, y = points
    df = trees.with_features(frame(spark, x, y)).cache()
    model = trees.fit_boosted(df, rounds=5, store_every=2)
    got = collected(model.transform(df), "prediction")
    each = np.column_stack([collected(t.setPredictionCol("p").transform(df), "p") for t in model.trees])
    w = np.array(model.logs)
    for i in range(len(x)):
        order = np.argsort(each[i], kind="stable")
        place = np.searchsorted(np.cumsum(w[order]), 0.5 * w.sum() - 1e-12)
        assert got[i] == each[i][order[place]]


def test_isolation_finds_the_far_point(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(300, 2)), [[12.0, -12.0]]])
    df = frame(spark, x)
    forest = trees.fit_isolation(df, trees=60, max_samples=64)
    again = trees.fit_isolation(df.repartition(1), trees=60, max_samples=64)
    scores = collected(forest.transform(df), "score")
    assert scores.argmin() == 300 and -1 <= scores.min() < -0.6 and scores.max() < 0
    np.testing.assert_allclose(scores, again.scores(x), atol=1e-12)
    assert trees.average_path(2) == 1.0 and trees.average_path(1) == 0.0


# ---- stacking ----------------------------------------------------------------

def test_late_integration_beats_the_mean(spark):
    rng = np.random.default_rng(11)
    n = 200
    a, b = rng.normal(size=(n, 3)), rng.normal(size=(n, 2))
    y = a @ np.array([1.0, -2.0, 0.5]) + b @ np.array([1.0, 1.0]) + 0.1 * rng.normal(size=n)
    parts = {}
    for name, x in (("a", a), ("b", b)):
        parts[name] = frame(spark, x, y).withColumn("split", F.when(F.substring("sample_id", 5, 1) < "8", "train").otherwise("test"))
    scored, params = ensemble.late_integration(parts, 4, {"kernel": ["linear"], "C": [1]}, {"kernel": ["linear"], "C": [1]}, passes=10)
    test = np.array([int(f"{i:04d}"[3]) >= 8 for i in range(n)])
    assert ensemble.test_error(scored).first()[0] < 0.5 * y[test].var()
    assert params["kernel"] == "linear" and scored.count() == n


def test_kernel_settings_are_not_repeated():
    assert len(ensemble.kernel_settings(ensemble.LEVEL0_GRID)) == 1 + 4 + 1 + 2


def test_map_models_score_like_their_features(spark, points):
    x, y = points
    df = frame(spark, x, y).withColumn("fold", F.pmod(F.xxhash64("sample_id"), F.lit(3)).cast("int") + 1)
    mapping = kernels.nystrom(df, Kernel("rbf", {"sigma": 1.0}), 8)
    models = ensemble.gram_fold_models(df, linear.ridge, mapping, alpha=1.0)
    got = collected(df.withColumn("p", models.out_of_fold()), "p")
    folds = np.array([r["fold"] for r in sorted(df.select("sample_id", "fold").collect())])
    g = mapping.features(x)
    for f in (1, 2, 3):
        part = moments(kernels.apply_maps(df.filter(F.col("fold") != f), [mapping]), x="g")["all"]
        fit = linear.ridge(part, 1.0)
        np.testing.assert_allclose(got[folds == f], g[folds == f] @ fit.coef + fit.intercept, atol=1e-8)


def test_deeper_trees_are_refused(rows):
    with pytest.raises(ValueError):
        trees.fit_tree(trees.with_features(rows), 31)
    with pytest.raises(ValueError):
        trees.fit_forest(trees.with_features(rows), max_depth=50)
