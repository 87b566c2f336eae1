"""Shared searches give what setting-by-setting fits give."""

import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from profuse.functions.kernels import gamma_kernel
from profuse.operators import ensemble, kernels, linear, network
from profuse.operators.arrays import list_of
from profuse.operators.gram import moments
from profuse.plans import early


def test_kernel_ridge_search_matches_dense_fits(spark, rows):
    space = {"kernel": ["linear", "rbf", "poly", "laplacian"], "gamma": [0.05, 1.0], "degree": [2, 3], "alpha": [0.1, 5.0]}
    model, params, score = early.search_kernel_ridge(rows, space, 4, rank=20)
    data = sorted(rows.select("sample_id", "x", "y", "fold").collect())
    x, y, fold = np.array([r[1] for r in data]), np.array([r[2] for r in data]), np.array([r[3] for r in data])
    marks = kernels.landmark_rows(rows, 20, 0)
    scores = {}
    for kind, gamma, degree, coef0 in ensemble.kernel_settings(space):
        g = kernels.nystrom(rows, gamma_kernel(kind, gamma, degree, coef0), 20, landmarks=marks).features(x)
        for alpha in space["alpha"]:
            r2 = []
            for f in range(1, 5):
                a, b = g[fold != f], y[fold != f]
                ac = a - a.mean(axis=0)
                w = np.linalg.solve(ac.T @ ac + alpha * np.eye(g.shape[1]), ac.T @ (b - b.mean()))
                gap = y[fold == f] - b.mean() - (g[fold == f] - a.mean(axis=0)) @ w
                r2.append(1 - (gap ** 2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum())
            scores[kind, gamma, degree, coef0, alpha] = np.mean(r2)
    best = max(scores, key=scores.get)
    assert abs(score - scores[best]) < 1e-6
    assert (params["kernel"], params["gamma"], params["degree"], params["coef0"], params["alpha"]) == best
    whole = linear.ridge(moments(kernels.apply_maps(rows, [model.mapping]), x="g")["all"], params["alpha"])
    np.testing.assert_allclose(model.model.coef, whole.coef, atol=1e-8)
    assert model.transform(rows).count() == len(x)


def test_map_moments_are_those_of_each_map(spark, rows):
    maps = [kernels.nystrom(rows, gamma_kernel(kind, 0.1), 6) for kind in ("rbf", "linear")]
    parts = kernels.map_moments(rows, maps)
    for i, m in enumerate(maps):
        for g, part in moments(kernels.apply_maps(rows, [m]), "fold", x="g").items():
            np.testing.assert_allclose(parts[i, g].z, part.z, atol=1e-8)


def test_neighbour_search_matches_single_settings(spark, rows):
    space = {"k": [3, 7], "weights": ["uniform", "distance"], "p": [1, 2]}
    alone = rows.where("fold <= 2")
    _, again, shared = early.search_neighbours(alone, space, 2)
    _, single, brute = early.search(alone, early.FITTERS["knn"], space, 2)
    assert again == single and abs(shared - brute) < 1e-9


def test_every_board_runs_from_its_space(rows):
    board = early.leaderboard(rows.withColumn("fold", rows["fold"] - 1), {
        "svr": {"kernel": ["linear"], "C": [1.0, 5.0], "passes": [8]}, "kernel_ridge": {"kernel": ["rbf"], "gamma": [0.05]}, "knn": {"k": [5]}}, 3)
    assert {name for name, *_ in board} == {"svr", "kernel_ridge", "knn"} and all(np.isfinite(mse) for *_, mse in board)


def test_networks_of_all_settings_and_folds_train_together(rows):
    space = {"hidden": [(4,), (3, 2)], "activation": ["tanh"], "alpha": [0.001], "epochs": [12]}
    model, params, score = early.search_networks(rows, space, 4, rate=0.05)
    found = {}
    for hidden in space["hidden"]:
        r2 = []
        for f in range(1, 5):
            net = early._network(rows.filter(rows["fold"] != f), hidden, "tanh", 0.001, 12, 0.05)
            held = rows.filter(rows["fold"] == f).collect()
            y = np.array([r["y"] for r in held])
            r2.append(1 - ((net.predict(np.array([r["x"] for r in held])) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        found[hidden] = np.mean(r2)
    assert params["hidden"] == max(found, key=found.get) and abs(score - max(found.values())) < 1e-9
    whole = early._network(rows, params["hidden"], "tanh", 0.001, 12, 0.05)
    for u, v in zip(model.weights, whole.weights):
        np.testing.assert_allclose(u, v, atol=1e-9)


def test_regressors_of_a_board_are_searched_side_by_side(rows, monkeypatch):
    """the jobs of one search leave cores idle that another can use."""
    met = threading.Barrier(2, timeout=60)

    class Mean:
        def transform(self, df):
            return df.withColumn("prediction", F.lit(0.0))

    def fit(df):
        met.wait()
        return Mean()

    monkeypatch.setitem(early.FITTERS, "one", fit)
    monkeypatch.setitem(early.FITTERS, "two", fit)
    board = early.leaderboard(rows.withColumn("fold", F.col("fold") % 4), {"one": {}, "two": {}}, 3)
    assert {row[0] for row in board} == {"one", "two"} and board[0][3] == board[1][3]


def test_networks_with_the_same_rows_choose_them_once(monkeypatch):
    """and their sums travel in few records."""
    asked, plain = [], network.held_out
    monkeypatch.setattr(network, "held_out", lambda *a: asked.append(1) or plain(*a))
    rng = np.random.default_rng(2)
    x, y, h, f = rng.normal(size=(300, 5)), rng.normal(size=300), rng.integers(0, 2 ** 62, size=300), np.arange(300, dtype=np.int32) % 3 + 1
    batch = pa.RecordBatch.from_arrays([list_of(x), pa.array(y), pa.array(h), pa.array(f)], ["x", "y", "h", "f"])
    nets = [early._perceptron(5, 0.0, (7, 3), kind) for kind in ("relu", "tanh", "logistic", "linear")]
    task = [(i, net, i % 2, 0, 0.2, True) for i, net in enumerate(nets)]
    sums = network._gradients([batch], task, 0, 0, 1)
    assert len(asked) == 2 and {m.shape for m in sums.values()} == {(1, network.LINE)}
    aside = plain(h.view(np.uint64), 0, 0.2)
    for i, net in enumerate(nets):
        own = f != i % 2
        sse, grads = net.gradient(x[own & ~aside], y[own & ~aside])
        gap = net.predict(x[own & aside]) - y[own & aside]
        want = np.concatenate([[(own & ~aside).sum(), sse, (own & aside).sum(), gap @ gap], *[g.ravel() for g in grads]])
        np.testing.assert_allclose(sums[str(i)].ravel()[:len(want)], want, rtol=1e-9, atol=1e-9)
