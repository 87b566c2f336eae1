"""Gram-based regressors against numpy."""

import numpy as np
import pytest

from profuse.operators import ensemble, evaluate, gram, linear, reduce, robust, tuning
from profuse.operators.gram import Moments


def centred(x, y):
    return x - x.mean(0), y - y.mean()


@pytest.fixture(scope="module")
def m(rows):
    return gram.moments(rows)["all"]


def test_moments_match_numpy_for_any_partitioning(rows, table):
    x, y = table
    z = np.column_stack([np.ones(len(x)), x, y])
    for n in (1, 7):
        parts = gram.moments(rows.repartition(n), "fold")
        np.testing.assert_allclose(gram.total_of(parts).z, z.T @ z, rtol=1e-12)
        pick = np.arange(len(x)) % 4 == 1
        np.testing.assert_allclose(parts["2"].z, z[pick].T @ z[pick], rtol=1e-12)


def test_least_squares_and_scores(m, table):
    x, y = table
    fit = linear.ols(m)
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    np.testing.assert_allclose([fit.intercept, *fit.coef], want, atol=1e-9)
    residual = y - fit.intercept - x @ fit.coef
    assert abs(m.sse(fit.coef, fit.intercept) - residual @ residual) < 1e-8
    assert abs(m.r2(fit.coef, fit.intercept) - (1 - residual.var() / y.var())) < 1e-9


def test_ridge(m, table):
    x, y = table
    xc, yc = centred(x, y)
    np.testing.assert_allclose(linear.ridge(m, 3.0).coef, np.linalg.solve(xc.T @ xc + 3 * np.eye(6), xc.T @ yc), atol=1e-9)


@pytest.mark.parametrize("alpha,ratio", [(0.05, 1.0), (0.3, 0.5), (0.1, 0.0)])
def test_elastic_net_optimality(m, table, alpha, ratio):
    x, y = table
    xc, yc = centred(x, y)
    w = linear.elastic_net(m, alpha, ratio).coef
    slope = xc.T @ (yc - xc @ w) / len(y) - alpha * (1 - ratio) * w
    on = w != 0
    np.testing.assert_allclose(slope[on], alpha * ratio * np.sign(w[on]), atol=1e-7)
    assert (np.abs(slope[~on]) <= alpha * ratio + 1e-7).all()


def test_ratio_out_of_range(m):
    with pytest.raises(ValueError):
        linear.elastic_net(m, 1.0, 100)


@pytest.mark.parametrize("alpha", [0.01, 0.1, 0.5])
def test_lasso_path_meets_coordinate_descent(m, alpha):
    np.testing.assert_allclose(linear.lasso_lars(m, alpha).coef, linear.lasso(m, alpha).coef, atol=1e-7)


def test_lasso_path_without_intercept(m, table):
    x, y = table
    fit = linear.lasso_lars(m, 0.1, fit_intercept=False)
    assert fit.intercept == 0.0
    slope = x.T @ (y - x @ fit.coef) / len(y)
    on = fit.coef != 0
    np.testing.assert_allclose(np.abs(slope[on]), 0.1, atol=1e-7)


def test_angle_path_levels(m, table):
    x, y = table
    xc, yc = centred(x, y)
    for k in (1, 2, 3):
        w = linear.lars(m, k).coef
        assert (w != 0).sum() == k
        corr = np.abs(xc.T @ (yc - xc @ w))
        assert np.ptp(corr[w != 0]) < 1e-6 * corr.max() + 1e-8
    np.testing.assert_allclose(linear.lars(m, 6).coef, linear.ols(m).coef, atol=1e-7)


def test_matching_pursuit(m, table):
    x, y = table
    xc, yc = centred(x, y)
    active, w = [], np.zeros(6)
    for _ in range(3):
        corr = np.abs(xc.T @ (yc - xc @ w))
        corr[active] = -1
        active.append(int(corr.argmax()))
        w = np.zeros(6)
        w[active] = np.linalg.lstsq(xc[:, active], yc, rcond=None)[0]
    np.testing.assert_allclose(linear.matching_pursuit(m, 3).coef, w, atol=1e-8)


def test_bayesian_ridge_fixed_point(m, table):
    x, y = table
    xc, yc = centred(x, y)
    fit = linear.bayesian_ridge(m, tol=1e-12)
    a, l = fit.params["noise_precision"], fit.params["weight_precision"]
    np.testing.assert_allclose(fit.coef, np.linalg.solve(xc.T @ xc + l / a * np.eye(6), xc.T @ yc), atol=1e-9)
    values = np.linalg.eigvalsh(xc.T @ xc)
    used = (a * values / (l + a * values)).sum()
    assert abs(l - (used + 2e-6) / (fit.coef @ fit.coef + 2e-6)) < 1e-3 * l
    assert abs(a - (len(y) - used + 2e-6) / (((yc - xc @ fit.coef) ** 2).sum() + 2e-6)) < 1e-3 * a


def test_search_matches_refits(rows, table):
    x, y = table
    fold = np.arange(len(x)) % 4
    parts = gram.moments(rows, "fold")
    model, best, score = tuning.search_moments(parts, linear.ridge, {"alpha": [0.01, 1, 100]})
    means = {}
    for alpha in (0.01, 1, 100):
        r2 = []
        for f in range(4):
            a, b = x[fold != f], y[fold != f]
            w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + alpha * np.eye(6), (a - a.mean(0)).T @ (b - b.mean()))
            p = b.mean() + (x[fold == f] - a.mean(0)) @ w
            t = y[fold == f]
            r2.append(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        means[alpha] = np.mean(r2)
    assert best["alpha"] == max(means, key=means.get) and abs(score - means[best["alpha"]]) < 1e-9
    np.testing.assert_allclose(model.coef, linear.ridge(gram.total_of(parts), best["alpha"]).coef)


def test_grid_and_steps():
    assert tuning.parameter_grid({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    assert tuning.parameter_grid({}) == [{}]
    np.testing.assert_allclose(tuning.step_values(0, 1, 0.1), np.arange(10) / 10)


@pytest.mark.parametrize("alpha", [0.0, 2.0])
def test_leave_one_out_equals_refits(rows, table, alpha):
    """Exact for least squares; for ridge the centring is that of all rows."""
    x, y = table
    got = {r["sample_id"]: r["residual"] for r in evaluate.leave_one_out(rows, alpha).collect()}
    mean = x.mean(0)
    penalty = alpha * np.eye(7)
    penalty[0, 0] = 0.0
    for i in range(0, len(x), 10):
        keep = np.arange(len(x)) != i
        z = np.column_stack([np.ones(len(x)), x - mean])
        beta = np.linalg.solve(z[keep].T @ z[keep] + penalty, z[keep].T @ y[keep])
        assert abs(got[f"s{i:04d}"] - (y[i] - z[i] @ beta)) < 1e-8


def test_inflation(table):
    x, _ = table
    got = reduce.inflation(x.T @ x)
    for j in range(6):
        rest = np.delete(x, j, 1)
        gap = x[:, j] - rest @ np.linalg.lstsq(rest, x[:, j], rcond=None)[0]
        assert abs(got[j] - (x[:, j] ** 2).sum() / (gap ** 2).sum()) < 1e-6 * got[j]
    twin = np.column_stack([x[:, :3], x[:, 0]])
    factors = reduce.inflation(twin.T @ twin)
    assert np.isinf(factors[[0, 3]]).all() and np.isfinite(factors[[1, 2]]).all()
    kept = [n for n, _ in reduce.prune_inflated(twin.T @ twin, ["a", "b", "c", "d"], 5.0)]
    assert kept == ["b", "c", "d"]


def test_components(rows, table):
    x, _ = table
    model = reduce.fit_pca(rows, 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(model.variances, s[:3] ** 2 / len(x), rtol=1e-9)
    np.testing.assert_allclose(np.abs(model.axes.T), np.abs(vt[:3]), atol=1e-7)
    assert (model.axes[np.abs(model.axes).argmax(0), range(3)] > 0).all()
    got = {r["sample_id"]: r["x"] for r in model.transform(rows).collect()}
    np.testing.assert_allclose(got["s0007"], (x[7] - x.mean(0)) @ model.axes, atol=1e-9)


def test_bagging_is_the_mean_of_weighted_fits(rows):
    from profuse.operators.arrays import poisson_weights
    parts = gram.member_moments(rows, 4, lambda u, _: poisson_weights(u), 5)
    assert len({round(p.n) for p in parts}) > 1
    fit = ensemble.bag_linear(rows, linear.ridge, 4, seed=5, alpha=1.0)
    np.testing.assert_allclose(fit.coef, np.mean([linear.ridge(p, 1.0).coef for p in parts], axis=0), atol=1e-9)
    again = ensemble.bag_linear(rows.repartition(1), linear.ridge, 4, bootstrap_features=True, seed=5, alpha=1.0)
    assert again.coef.shape == (6,)


def test_out_of_fold_never_sees_its_row(rows, table):
    x, y = table
    fold = np.arange(len(x)) % 4 + 1
    models = ensemble.gram_fold_models(rows, linear.ridge, alpha=1.0)
    got = {r["sample_id"]: r["p"] for r in rows.select("sample_id", models.out_of_fold().alias("p")).collect()}
    for i in (0, 1, 50, 119):
        a, b = x[fold != fold[i]], y[fold != fold[i]]
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + np.eye(6), (a - a.mean(0)).T @ (b - b.mean()))
        assert abs(got[f"s{i:04d}"] - (b.mean() + (x[i] - a.mean(0)) @ w)) < 1e-9


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.77, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(2)
    values = np.r_[rng.normal(size=997), np.full(500, 0.25)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert robust.exact_quantile(df, "v", q, bins=16, final=20) == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_consensus_ignores_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = 1.0 + x @ np.array([2.0, -3.0]) + 0.01 * rng.normal(size=400)
    y[:80] += 50.0
    df = spark.createDataFrame([(f"s{i}", [float(v) for v in x[i]], float(y[i])) for i in range(400)],
                               "sample_id string, x array<double>, y double").cache()
    for fit, tol in ((robust.ransac(df, 3, trials=30, threshold=0.5), 0.02), (robust.theil_sen(df, 500), 0.35), (robust.huber(df), 0.1)):
        np.testing.assert_allclose(fit.coef, [2.0, -3.0], atol=tol)
    assert robust.ransac(df, 3, trials=30, threshold=0.5).params["inliers"] == 320
    assert robust.ransac(df, 0.5, trials=10).params["threshold"] == pytest.approx(
        float(np.median(np.abs(y - np.median(y)))), abs=1e-9)


def test_passive_aggressive_is_partition_free(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = 1.0 + x @ np.array([2.0, -3.0])
    df = spark.createDataFrame([(f"s{i}", [float(v) for v in x[i]], float(y[i])) for i in range(300)],
                               "sample_id string, x array<double>, y double")
    a = robust.passive_aggressive(df.repartition(1), c=1.0, epochs=4, shard_rows=100)
    b = robust.passive_aggressive(df.repartition(5), c=1.0, epochs=4, shard_rows=100)
    np.testing.assert_allclose(a.coef, b.coef, atol=1e-12)
    np.testing.assert_allclose(a.coef, [2.0, -3.0], atol=0.3)


def test_take_keeps_response():
    z = np.arange(25.0).reshape(5, 5)
    assert Moments(z).take([2]).z.tolist() == z[np.ix_([0, 3, 4], [0, 3, 4])].tolist()
