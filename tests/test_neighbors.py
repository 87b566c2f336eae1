"""Blocks of the neighbour search against brute force."""

import numpy as np
import pytest

from profuse.operators import neighbors


def frame(spark, x, y=None, kind="s"):
    data = [(f"{kind}{i:04d}", [float(v) for v in x[i]], float(i if y is None else y[i])) for i in range(len(x))]
    return spark.createDataFrame(data, "sample_id string, x array<double>, y double")


def brute(q, x, p):
    d = np.abs(q[:, None] - x[None]).sum(2) if p == 1 else np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    return d, np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)


def test_one_search_serves_every_count(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(60, 3)), rng.normal(size=(9, 3))
    found = neighbors.neighbour_regression(frame(spark, x), frame(spark, q, kind="q"), (2, 5, 9), ("uniform", "distance"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") + plan.count("FlatMapCoGroupsInPandas") == 1
    d, order = brute(q, x, 2)
    got = {(r["sample_id"], r["k"], r["weights"]): r["prediction"] for r in found.collect()}
    assert len(got) == 9 * 6
    for i in range(9):
        for k in (2, 5, 9):
            near = order[i, :k]
            assert got[f"q{i:04d}", k, "uniform"] == pytest.approx(near.mean())
            assert got[f"q{i:04d}", k, "distance"] == pytest.approx(np.average(near, weights=1 / d[i, near]))


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("scale", [1.0, 1e32, 1e-20])
def test_closest_rows_of_a_block(p, scale, monkeypatch):
    """Ties, copies, small tiles, and numbers that single precision cannot hold."""
    monkeypatch.setattr(neighbors, "TILE", {1: 64, 2: 64})
    monkeypatch.setattr(neighbors, "SEGMENT", 20)
    rng = np.random.default_rng(6)
    z = np.round(rng.normal(size=(90, 4)), 1) * scale
    z[::4] = z[0]
    q = np.vstack([np.round(rng.normal(size=(20, 4)), 1) * scale, z[:5]])
    marks = z[[0, 1, 2]]
    d = neighbors.distances(z, marks, p)
    cell = d.argmin(axis=1)
    by = np.argsort(cell, kind="stable")
    spans = {c: (marks[c], d[cell == c, c].min(), d[cell == c, c].max()) for c in range(3)}
    row, column, far = neighbors._closest(q, np.full(len(q), np.inf), z[by], cell[by], by, spans, 7, p)
    own = neighbors.distances(q, z, p)
    for i in range(len(q)):
        want = sorted(range(90), key=lambda j: (own[i, j], j))[:7]
        assert by[column[row == i]].tolist() == want
        np.testing.assert_array_equal(far[row == i], own[i, want])


def test_near_cells_share_a_part_and_large_ones_are_cut():
    pivots = np.array([[0.0], [10.0], [0.1], [10.1], [50.0]])
    part, pieces = neighbors._packed(pivots, np.array([3.0, 3.0, 3.0, 3.0, 25.0]), 6, 2)
    assert part[0] == part[2] != part[1] == part[3] and pieces == [1, 1, 5]
