import numpy as np

from profuse.operators import reduce
from profuse.plans import integrate


def frame(spark, rows=60, p=5):
    rng = np.random.default_rng(8)
    x = np.abs(rng.normal(size=(rows, 2)) @ rng.normal(size=(2, p))) + 0.05 * rng.random((rows, p))
    return x, spark.createDataFrame([(f"s{i}", [float(v) for v in x[i]]) for i in range(rows)], "sample_id string, x array<double>").repartition(3)


def test_settings_of_a_grid_equal_their_own_fits(spark, monkeypatch):
    x, df = frame(spark)
    grid = [(1, 0.0, 0.0), (2, 0.0, 0.5), (2, 0.0, 0.01), (3, 0.4, 0.5), (8, 0.0, 0.0)]
    scans = []
    plain = reduce.sum_partials
    monkeypatch.setattr(reduce, "sum_partials", lambda *a: scans.append(1) or plain(*a))
    shared = reduce.fit_nmf_grid(df, grid, rounds=6)
    assert len(scans) <= 6
    for (n, alpha, ratio), fit in zip(grid, shared):
        alone = reduce.fit_nmf(df, n, alpha, ratio, rounds=6)
        assert np.allclose(fit.h, alone.h, atol=1e-10) and np.allclose(fit.losses, alone.losses)
        assert fit.h.shape == (n, 5) and (fit.h >= 0).all() and all(np.diff(fit.losses) <= 1e-9)
    assert shared[1].h is shared[2].h  # no penalty: the same factors
    w = np.array([r[0] for r in shared[1].transform(df).orderBy("sample_id").select("x").collect()])
    order = np.argsort([f"s{i}" for i in range(len(x))])
    assert ((x[order] - w @ shared[1].h) ** 2).mean() < ((x - x.mean(axis=0)) ** 2).mean()


def test_fewer_components_are_the_first_of_more(spark):
    _, df = frame(spark)
    found = integrate.reductions(df, "pca", [{"n_components": n, "svd_solver": s} for n in (1, 3) for s in reduce.SOLVERS])
    for fit, n, solver in zip(found, (1, 1, 1, 3, 3, 3), 2 * reduce.SOLVERS):
        alone = reduce.fit_pca(df, n, svd_solver=solver)
        assert np.allclose(fit.axes, alone.axes, atol=1e-5) and np.allclose(fit.variances, alone.variances)
