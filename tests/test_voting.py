"""Shared kernel passes and the voting search against fits one by one."""

import numpy as np
import pytest

from profuse.functions.kernels import gamma_kernel
from profuse.operators import ensemble, kernels, linear, svm
from profuse.operators.gram import moments, total_of

GRID = {"kernel": ["linear", "poly", "rbf"], "C": [0.5, 5.0], "gamma": [0.05], "degree": [2]}
FOLDS = [1, 2, 3, 4]


@pytest.fixture(scope="module")
def arrays(rows):
    data = sorted(rows.select("sample_id", "x", "y", "fold").collect())
    return np.array([r[1] for r in data]), np.array([r[2] for r in data]), np.array([r[3] for r in data])


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_kernels_in_the_same_passes_give_the_fits_of_each(spark, rows):
    maps = [None, kernels.nystrom(rows, gamma_kernel("rbf", 0.05), 12)]
    tubes = [svm.Tube(0.5, 0.1), svm.Tube(5.0, 0.2)]
    panels = svm.fit_kernel_tubes(rows, maps, tubes, FOLDS, passes=6, tol=0.0)
    for m, panel in zip(maps, panels):
        source, x = (rows, "x") if m is None else (kernels.apply_maps(rows, [m]), "g")
        alone = svm.fit_tubes(source, tubes, FOLDS, x, passes=6, tol=0.0)
        for s in range(2):
            for f in [0, *FOLDS]:
                np.testing.assert_allclose(panel.model(s, f).coef, alone[s, f].coef, atol=1e-6)
                assert panel.model(s, f).intercept == pytest.approx(alone[s, f].intercept, abs=1e-6)
    one = svm.fit_kernel_tubes(rows.repartition(7), maps, tubes, FOLDS, passes=6, tol=0.0)
    np.testing.assert_allclose(one[1].whole, panels[1].whole, atol=1e-8)


def test_settled_kernels_leave_the_passes(rows, monkeypatch):
    sizes, sums = [], svm.sum_partials

    def counted(df, partial):
        found = sums(df, partial)
        sizes.append(len(found))
        return found

    monkeypatch.setattr(svm, "sum_partials", counted)
    svm.fit_kernel_tubes(rows, [None, kernels.nystrom(rows, gamma_kernel("rbf", 5.0), 10)], [svm.Tube(1.0)], FOLDS, passes=60, tol=1e-3)
    assert 3 <= len(sizes) < 60 and sizes == sorted(sizes, reverse=True)


def test_scores_of_panels(rows, arrays):
    x, y, fold = arrays
    maps = ensemble.kernel_maps(rows, ensemble.kernel_settings(GRID), 10)
    panels = svm.fit_kernel_tubes(rows, maps, [svm.Tube(1.0)], FOLDS, passes=5)
    for panel, score in zip(panels, svm.panel_scores(rows, panels, FOLDS)):
        mine = np.mean([r2(y[fold == f], panel.features(x[fold == f]) @ panel.folds[f][:, 0]) for f in FOLDS])
        assert score[0] == pytest.approx(mine, abs=1e-9)


def test_every_choice_of_every_base(rows, arrays):
    """Two bases of several settings: the one scan equals averaging predictions choice by choice."""
    x, y, fold = arrays
    parts = moments(rows, "fold")
    bases = [[ensemble.gram_panel(parts, linear.ridge, [{"alpha": a} for a in (0.1, 50.0, 500.0)])],
             [ensemble.gram_panel(parts, linear.elastic_net, [{"alpha": a, "l1_ratio": 0.5} for a in (0.01, 1.0)]),
              svm.fit_kernel_tubes(rows, [kernels.nystrom(rows, gamma_kernel("rbf", 0.1), 8)], [svm.Tube(1.0)], FOLDS, passes=4)[0]]]
    scores = ensemble.vote_scores(rows, bases, FOLDS)
    assert scores.shape == (3, 3)
    second = [(bases[1][0], 0), (bases[1][0], 1), (bases[1][1], 0)]
    for a in range(3):
        for b, (panel, s) in enumerate(second):
            each = []
            for f in FOLDS:
                held = x[fold == f]
                p = bases[0][0].features(held) @ bases[0][0].folds[f][:, a]
                each.append(r2(y[fold == f], (p + panel.features(held) @ panel.folds[f][:, s]) / 2))
            assert scores[a, b] == pytest.approx(np.mean(each), abs=1e-9)


def test_voting_search(rows, arrays):
    x, y, fold = arrays
    vote, settings, scores = ensemble.voting_search(rows, GRID, FOLDS, rank=10, passes=6)
    assert len(settings) == len(scores) == 6 and np.isfinite(scores).all()
    best = settings[int(scores.argmax())]
    kernel = best["kernel"]
    mapping = None if kernel == "linear" else kernels.nystrom(rows, gamma_kernel(kernel, best["gamma"], best["degree"], best["coef0"]), 10)
    source, column = (rows, "x") if mapping is None else (kernels.apply_maps(rows, [mapping]), "g")
    tube = svm.fit_tubes(source, [svm.Tube(best["C"], 0.1)], FOLDS, column, passes=6)[0, 0]
    whole = total_of(moments(rows, "fold"))
    low = kernels.nystrom(rows, gamma_kernel("linear", 1.0), 10)
    others = [linear.ridge(whole, 1.0), linear.elastic_net(whole, 1.0, 0.5)]
    ridge = linear.ridge(moments(kernels.apply_maps(rows, [low]), x="g")["all"], 1.0)
    each = [(x if mapping is None else mapping.features(x)) @ tube.coef + tube.intercept, *[x @ m.coef + m.intercept for m in others],
            low.features(x) @ ridge.coef + ridge.intercept]
    np.testing.assert_allclose(vote.predict(x), np.mean(each, axis=0), atol=1e-4)
    found = {r["sample_id"]: r["prediction"] for r in vote.transform(rows).collect()}
    np.testing.assert_allclose([found[f"s{i:04d}"] for i in range(len(x))], vote.predict(x), atol=1e-9)


def test_a_kernel_out_of_range_scores_lowest(rows):
    """Powers that overflow leave no finite model; the others are searched all the same."""
    grid = {"kernel": ["linear", "poly"], "C": [1.0], "gamma": [1e200], "degree": [8]}
    with np.errstate(all="ignore"):
        panels = svm.fit_kernel_tubes(rows, [None, kernels.LowRankMap(gamma_kernel("poly", 1e200, 8), np.ones((2, 6)), np.eye(2))],
                                      [svm.Tube(c) for c in grid["C"]], FOLDS, passes=4)
    scores = svm.panel_scores(rows, panels, FOLDS)
    assert np.isfinite(scores[0]).all() and scores[1][0] == -np.inf
