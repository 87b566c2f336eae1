import numpy as np
import pytest
from pyspark.errors import PythonException

from profuse.functions.kernels import Kernel
from profuse.operators import kernels, reduce
from profuse.operators.gram import moments

KERNELS = [Kernel("linear", {}, 0, 3), Kernel("rbf", {"sigma": 1.5}, 0, 3), Kernel("poly", {"degree": 2}, 3, 5), Kernel("exponential", {"sigma": 2.0}, 1, 5)]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    y = np.sin(x[:, 0]) + x[:, 3] * x[:, 4] + 0.1 * rng.normal(size=40)
    data = [(f"s{i:03d}", x[i].tolist(), float(y[i])) for i in range(40)]
    return x, y, spark.createDataFrame(data, "sample_id string, x array<double>, y double").repartition(4)


def brute_path(x, y, ks, rank):
    """Least-angle regression with explicit bisectors over the next Cholesky columns of dense kernel matrices."""
    dense = [k(x, x) for k in ks]
    factor = [np.zeros((len(x), 0)) for _ in ks]
    y, fit, taken, chosen = y - y.mean(), np.zeros(len(y)), [], []
    unit = lambda g: (g - g.mean()) / np.linalg.norm(g - g.mean())
    while len(taken) < rank:
        pool = []
        for q, k in enumerate(dense):
            left = k - factor[q] @ factor[q].T
            for i in range(len(x)):
                if left[i, i] > 1e-9 and np.linalg.norm(left[:, i] - left[:, i].mean()) > 1e-8:
                    g = left[:, i] / np.sqrt(left[i, i])
                    pool.append((q, g, unit(g)))
        c = np.array([u @ (y - fit) for _, _, u in pool])
        if not taken:
            best, level = int(np.argmax(np.abs(c))), float(np.abs(c).max())
        else:
            a = np.column_stack(taken)
            own = a.T @ (y - fit)
            level = np.abs(own).max()
            signed = a * np.sign(own)
            w = np.linalg.solve(signed.T @ signed, np.ones(len(taken)))
            size = 1.0 / np.sqrt(w.sum())
            bisector = signed @ w * size
            steps = np.full(len(pool), np.inf)
            for j, (_, _, u) in enumerate(pool):
                s = u @ bisector
                both = [v for v in ((level - c[j]) / (size - s), (level + c[j]) / (size + s)) if v >= 0]
                steps[j] = 0.0 if abs(c[j]) >= level else min(both, default=np.inf)
            best = int(np.argmin(steps))
            fit = fit + steps[best] * bisector
            level = level - steps[best] * size
        q, g, u = pool[best]
        factor[q] = np.column_stack([factor[q], g])
        taken.append(u)
        chosen.append((q, level))
    a = np.column_stack(taken)
    return chosen, a @ np.linalg.lstsq(a, y, rcond=None)[0]


def test_path_is_that_of_dense_kernels(points):
    """The candidates of one step may correlate more than the active columns, so both sides let those join at once."""
    x, y, df = points
    for single in KERNELS[:2]:
        want, _ = brute_path(x, y, [single], 2)
        got = kernels.least_angle_kernels(df, [single], rank=2, ahead=40).chosen
        assert [q for q, _ in got] == [q for q, _ in want] and np.allclose([v for _, v in got], [v for _, v in want], atol=1e-7)
    want, fit = brute_path(x, y, KERNELS, 5)
    path = kernels.least_angle_kernels(df, KERNELS, rank=5, ahead=40)
    first = next((k for k, (a, b) in enumerate(zip(path.chosen, want)) if a[0] != b[0]), 5)
    equal = np.allclose([v for _, v in path.chosen[:first]], [v for _, v in want[:first]], atol=1e-6)
    assert first >= 3 and equal, (path.chosen, want)
    rows = path.model.transform(df).orderBy("sample_id").collect()
    if first == 5:
        assert np.allclose([r["prediction"] for r in rows], fit + y.mean(), atol=1e-6)


def test_steps_of_least_angle_regression_match_the_linear_one(spark):
    """On fixed columns with equal correlations the path is ordinary least-angle regression."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(60, 6))
    y = z @ [3, -2, 0, 1, 0, 0.5] + 0.1 * rng.normal(size=60)
    z, y = z - z.mean(axis=0), y - y.mean()
    z = z / np.linalg.norm(z, axis=0)
    state, order, levels = kernels.LeastAngle([], np.zeros(0)), [], []
    for _ in range(7):
        best, level = state.advance(z.T @ z, z.T @ y, range(6), 0.0)
        if best is not None:
            order.append(best)
            levels.append(level)
            c = z.T @ (y - z[:, state.active] @ state.weights)
            # All active columns, the new one included, share the largest correlation.
            assert np.allclose(np.abs(c[state.active]), level) and np.abs(c).max() <= level + 1e-9
    assert sorted(order) == list(range(6)) and levels == sorted(levels, reverse=True)
    assert np.allclose(z[:, state.active] @ state.weights, z @ np.linalg.lstsq(z, y, rcond=None)[0])


def test_ridge_and_odd_kernels(points, spark):
    x, y, df = points
    lam = 0.5
    path = kernels.least_angle_kernels(df, KERNELS, rank=4, lam=lam, ahead=5)
    assert len(path.chosen) == 4
    # The last step ends at the ridge solution on unit columns.
    mapped = kernels.apply_maps(df, path.model.maps)
    gg, gy, _ = moments(mapped, x="g")["all"].centred()
    size = np.sqrt(np.diag(gg))
    want = np.linalg.solve(gg / np.outer(size, size) + lam * np.eye(4), gy / size) / size
    assert np.allclose(path.model.model.coef, want, atol=1e-8)
    flat = spark.createDataFrame([(f"s{k}", [1.0], float(k)) for k in range(5)], "sample_id string, x array<double>, y double")
    assert kernels.least_angle_kernels(flat, [Kernel("linear", {}, 0, 1)], rank=3).chosen == []
    # One column in all: the path stops there and predicts as least squares does.
    line = spark.createDataFrame([(f"s{k}", [float(k)], 2.0 * k + 1) for k in range(5)], "sample_id string, x array<double>, y double")
    fit = kernels.least_angle_kernels(line, [Kernel("linear", {}, 0, 1)], rank=3)
    assert len(fit.chosen) == 1 and np.allclose([r["prediction"] for r in fit.model.transform(line).orderBy("sample_id").collect()], [1, 3, 5, 7, 9])


@pytest.mark.parametrize("solver", ["randomized", "arpack"])
def test_solvers_span_the_same_space(spark, solver):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 25)) @ np.diag(np.linspace(5, 0.2, 25)) @ np.linalg.qr(rng.normal(size=(25, 25)))[0] + 100.0
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5)
    full, other = reduce.fit_pca(df, 4), reduce.fit_pca(df, 4, svd_solver=solver)
    assert np.allclose(full.variances, other.variances, rtol=1e-7) and np.allclose(full.axes, other.axes, atol=1e-4)
    # All components, equal variances and ranks below the number of components.
    assert np.allclose(reduce.fit_pca(df, 25, svd_solver=solver).variances, reduce.fit_pca(df, 25).variances, atol=1e-8)
    square = spark.createDataFrame([([float(a), float(b), 0.0],) for a in (-1, 1) for b in (-1, 1)], "x array<double>")
    assert np.allclose(reduce.fit_pca(square, 3, svd_solver=solver).variances, [1, 1, 0], atol=1e-12)
    with pytest.raises(ValueError):
        reduce.fit_pca(df, 2, svd_solver="exact")


@pytest.mark.parametrize("solver", ["randomized", "arpack"])
def test_wide_rows_need_no_gram(spark, solver):
    """20,000 features: more than the Gram route takes."""
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(60, 3)) * [30, 20, 10], np.linalg.qr(rng.normal(size=(20_000, 3)))[0]
    x = left @ right.T + 1e-3 * rng.normal(size=(60, 20_000))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    found = reduce.fit_pca(df, 3, svd_solver=solver)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:3] ** 2 / 60
    assert np.allclose(found.variances, want, rtol=1e-6)
    with pytest.raises(PythonException, match="exceed the statistics"):
        reduce.fit_pca(df, 3)
