import numpy as np
import pytest
from pyspark.sql import functions as F

from profuse.operators import bagging, svm
from profuse.operators.arrays import mixed_uniform, poisson_weights, row_hash
from profuse.operators.ensemble import drawn_columns
from profuse.operators.kernels import landmark_rows
from profuse.plans import early


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + np.sin(x[:, 0]) + rng.normal(size=90) * 0.2
    data = [(f"s{i:03d}", [float(v) for v in x[i]], float(y[i]), i % 4) for i in range(90)]  # fold 0 is the test part
    return spark.createDataFrame(data, "sample_id string, x array<double>, y double, fold int").repartition(3)


def arrays(rows, seed=0):
    found = rows.select("x", "y", "fold", row_hash(seed).alias("h"), "sample_id").orderBy("sample_id").toPandas()
    return np.array(found.x.tolist()), found.y.to_numpy(), found.fold.to_numpy(), found.h.to_numpy().astype(np.int64).view(np.uint64)


def ridge_predict(z, y, w, alpha, held):
    mean, my = (z * w[:, None]).sum(axis=0) / w.sum(), (y * w).sum() / w.sum()
    c = z - mean
    coef = np.linalg.solve((c * w[:, None]).T @ c + alpha * np.eye(z.shape[1]), (c * w[:, None]).T @ (y - my))
    return (held - mean) @ coef + my


def expected(x, y, fold, h, make, alpha, size, drawn):
    scores = []
    for f in (1, 2, 3):
        fit, held, each = (fold > 0) & (fold != f), fold == f, []
        for m in range(size):
            w = poisson_weights(mixed_uniform(h, m))[fit]
            columns = drawn_columns(4, m, 0) if drawn else np.arange(4)
            z = make(x, columns)
            each.append(ridge_predict(z[fit], y[fit], w, alpha, z[held]))
        gap = y[held] - np.mean(each, axis=0)
        scores.append(1 - (gap ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum())
    return np.mean(scores)


def test_scores_equal_a_bag_fitted_member_by_member(rows):
    train = rows.filter("fold > 0")
    bases = {"ridge": {"alpha": 3.0}, "kernel_ridge": {"alpha": 2.0, "kernel": "rbf", "gamma": 0.2}}
    vote, settings, scores = bagging.bagging_search(train, bases, (2, 5), folds=range(1, 4), rank=70)
    x, y, fold, h = arrays(rows)
    marks = landmark_rows(train, 70, 0)

    def kernel_features(x, columns):
        k = lambda a, b: np.exp(-0.2 * ((a[:, None] - b[None]) ** 2).sum(axis=2))
        values, vectors = np.linalg.eigh(k(marks[:, columns], marks[:, columns]))
        keep = values > 1e-10 * values.max()
        return k(x[:, columns], marks[:, columns]) @ (vectors[:, keep] / np.sqrt(values[keep]))

    assert len(settings) == 8
    for s, score in zip(settings, scores):
        make = (lambda x, c: x[:, c]) if s["base"] == "ridge" else kernel_features
        want = expected(x, y, fold, h, make, bases[s["base"]]["alpha"], s["n_estimators"], s["bootstrap_features"])
        assert abs(score - want) < 1e-6, s
    best = settings[int(scores.argmax())]
    assert len(vote.members) == best["n_estimators"]
    assert vote.transform(rows).filter(F.col("prediction").isNull()).count() == 0


def test_support_vectors_of_members_equal_the_plain_fit(rows):
    train = rows.filter("fold > 0")
    tube = svm.Tube(0.5, 0.1)
    whole = svm.fit_tubes(train, [tube], bags=3, seed=7, passes=12)
    panels = svm.fit_kernel_tubes(train, [None] * 3, [tube], passes=12, members=range(3), seed=7)
    for m in range(3):
        assert np.allclose(panels[m].whole[:, 0], np.r_[whole[0, m].intercept, whole[0, m].coef], atol=1e-3)
    assert not np.allclose(panels[0].whole, panels[1].whole, atol=1e-3)


def test_whole_space_runs_and_serves_the_leaderboard(rows):
    space = {**early.ENSEMBLES["bagging"], "n_estimators": [2, 3]}
    board = early.leaderboard(rows, {"bagging": space}, 3)
    assert board[0][0] == "bagging" and 0.3 < board[0][2] <= 1.0 and board[0][3] < 6.0
    assert sorted(early.ENSEMBLES["bagging"]["base"]) == ["elastic_net", "kernel_ridge", "ridge", "svr"]
    with pytest.raises(ValueError):
        bagging.bagging_search(rows.filter("fold > 0"), {"other": {}}, (2,))
