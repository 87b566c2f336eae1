"""Forests of a whole grid against trees grown node by node, and the space that the leaderboard runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profuse.operators import forest
from profuse.operators.arrays import mixed_hash, mixed_uniform, poisson_weights
from profuse.plans import catalog, catalog_models, early


def twin(codes, y, w, ask, depth, least, columns, key, level=0):
    """Predictions of one tree for the rows ``ask``, by recursion; ``w`` counts the drawn rows."""
    n, s, width = w.sum(), (w * y).sum(), codes.shape[1]
    value = np.full(len(ask), s / n)
    if level == depth or not len(ask):
        return value
    keys = mixed_hash(np.full(width, key), np.arange(width))
    best, found = s * s / n + 1e-9, None
    for j in sorted(np.argsort(keys)[:columns]):
        for c in np.unique(codes[w > 0, j])[:-1]:
            left = (codes[:, j] <= c) * w
            if min(left.sum(), n - left.sum()) >= least:
                a = (left * y).sum()
                gain = a * a / left.sum() + (s - a) * (s - a) / (n - left.sum())
                if gain > best:
                    best, found = gain, (j, c)
    if found is None:
        return value
    goes = codes[:, found[0]] > found[1]
    for side in (0, 1):
        sub = mixed_hash(np.array([key]), width + side)[0]
        mine = goes[ask] == side
        value[mine] = twin(codes, y, w * (goes == side), ask[mine], depth, least, columns, sub, level + 1)
    return value


@pytest.mark.parametrize("least,columns,small", [(1, 4, 0), (1, 4, 10 ** 6), (5, 2, 0), (5, 2, 25), (1, 2, 25), (10, 4, 25)])
def test_trees_equal_those_grown_by_recursion(monkeypatch, least, columns, small):
    monkeypatch.setattr(forest, "SMALL", small)
    monkeypatch.setattr(forest, "CELLS", 64)  # several blocks
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 12, size=(150, 4)).astype(np.uint8)
    y = np.round(20 * rng.normal(size=150)) + 20.0 * (codes[:, 0] // 4)  # whole, so that equal splits are equal to the last bit
    used, asked = np.arange(110), np.arange(110, 150)
    counts = np.zeros((3, 150))
    counts[:, used] = rng.poisson(1.0, size=(3, 110))
    keys = mixed_hash(np.zeros(3, dtype=np.uint64), np.arange(3))
    got = forest.grow(codes, y, counts, asked, [0, 2, 5, 30], least, columns, keys)
    for line, depth in zip(got, (0, 2, 5, 30)):
        want = sum(twin(codes, y, w, asked, depth, least, columns, k) for w, k in zip(counts, keys))
        np.testing.assert_allclose(line, want, atol=1e-9)


def test_sizes_and_folds_of_a_grid(spark, rows):
    """The means over the first trees, of rows that took no part; the same however rows are dealt."""
    width = 6
    cuts = forest.cut_points(rows, width)
    assert all(len(c) and (np.diff(c) > 0).all() for c in cuts)
    seen = []
    for n in (1, 3):
        coded = forest.binned(forest.numbered(rows.repartition(n)).withColumn("no", F.substring("sample_id", 2, 9).cast("bigint")), cuts)
        found = forest.prediction_sums(coded, [(1, 6), (5, 3)], [3, 30], [2, 30], [1, 2])
        seen.append({(r["family"], r["fold"], r["no"]): (r["y"], r["p"]) for r in found.collect()})
    assert len(seen[0]) == 2 * 60 and seen[0].keys() == seen[1].keys()
    for key, (y, p) in seen[0].items():
        np.testing.assert_allclose(p, seen[1][key][1], atol=1e-9)
    table = coded.orderBy("h", "no").collect()
    codes = np.array([list(r["codes"]) for r in table], dtype=np.uint8)
    y, fold = np.array([r["y"] for r in table]), np.array([r["fold"] for r in table])
    base = np.array([r["h"] for r in table]).view(np.uint64)
    asked, used = np.flatnonzero(fold == 2), fold != 2
    each = [twin(codes, y, poisson_weights(mixed_uniform(base, t)) * used, asked, 2, 1, 6, mixed_hash(np.zeros(1, dtype=np.uint64), t)[0]) for t in range(3)]
    for at, want in zip(asked, np.mean(each, axis=0)):
        assert abs(seen[0][0, 2, table[at]["no"]][1][0] - want) < 1e-9


def test_search_scores_every_setting_and_serves_the_board(rows):
    space = {"n_estimators": [5, 20], "max_depth": [2, None], "min_rows": [1, 10], "max_features": ["auto", "sqrt", None]}
    model, params, score = early.search_forests(rows, space, 4)
    assert set(params) == set(space) and 0.5 < score < 1
    again = early.search_forests(rows, {k: [v] for k, v in params.items()}, 4)
    assert again[1] == params and abs(again[2] - score) < 1e-12
    scored = model.transform(rows.limit(20)).select("y", "prediction").collect()
    assert len(scored) == 20 and np.corrcoef(np.array(scored).T)[0, 1] > 0.8


def test_a_table_too_large_for_a_task_uses_the_engine(rows, monkeypatch):
    monkeypatch.setattr(forest, "BYTES", 100)
    _, params, score = early.search_forests(rows, {"n_estimators": [5], "max_depth": [3], "min_rows": [1, 10], "max_features": ["auto", None]}, 4)
    assert params["max_depth"] == 3 and score > 0.3


def test_leaderboard_runs_the_declared_space(spark, monkeypatch):
    """every declared setting and five folds, nothing less."""
    seen = {}

    def board(rows, spaces, folds):
        seen.update(spaces=spaces, folds=folds)
        return []

    monkeypatch.setattr(catalog_models, "design", lambda spark, sf, folds: (seen.update(design=folds), None))
    monkeypatch.setattr(early, "leaderboard", board)
    catalog.QUERIES["t7_ensemble_leaderboard"](spark, "")
    assert seen == {"spaces": early.ENSEMBLES, "folds": 5, "design": 5}
