"""Passes over blocks of rows: shared kernel parts, spread tables, networks and factor rows."""

import numpy as np
import pytest

from profuse.functions.kernels import gamma_kernel
from profuse.operators import kernels, network, reduce, svm
from profuse.operators.arrays import BLOCK
from profuse.plans import early
from profuse.session import spread


def low_rank(kernel, marks):
    return kernels.LowRankMap(kernel, marks, kernels.inverse_root(kernel(marks, marks)))


def test_maps_on_the_same_landmarks_share_their_parts(monkeypatch):
    rng = np.random.default_rng(2)
    x, marks = rng.normal(size=(50, 6)), rng.normal(size=(5, 6))
    drawn = [rng.integers(0, 6, 6) for _ in range(3)]
    same = low_rank(gamma_kernel("rbf", 0.1), marks)
    maps = [None, same, same, low_rank(gamma_kernel("rbf", 1.0), marks)]
    maps += [low_rank(gamma_kernel(kind, 0.1, 4, 0.5), marks) for kind in ("poly", "sigmoid", "linear", "laplacian")]
    maps += [kernels.Drawn(c, low_rank(gamma_kernel(kind, 0.1, 4), marks[:, c]), marks) for kind in ("rbf", "poly", "laplacian") for c in drawn]
    want = [x if m is None else m.features(x) for m in maps]
    calls = []
    monkeypatch.setitem(kernels.PART, "square", lambda a, b, f=kernels.PART["square"]: calls.append(1) or f(a, b))
    got = list(kernels.each_features(maps, x))
    assert len(calls) == 1 and got[1] is got[2] and len(got) == len(maps)
    for a, b in zip(got, want):
        np.testing.assert_allclose(a, b, atol=1e-9)


@pytest.mark.parametrize("jobs", [2, 9])
def test_sums_of_a_block(jobs):
    """Both ways of summing weighted Grams, for few and for many jobs."""
    rng = np.random.default_rng(3)
    x, y, beta, case = rng.normal(size=(40, 4)), rng.normal(size=40), rng.normal(size=(5, jobs)), rng.integers(0, 3, (jobs, 40)) * 1.0
    c, e = rng.uniform(0.1, 2, (jobs, 1)), rng.uniform(0, 0.3, (jobs, 1))
    z = np.column_stack([np.ones(40), x])
    gram, right, loss = svm._unpacked(svm._tube_sums(svm._rows_of(x), y, beta, c, e, case, 1e-4))
    for j in range(jobs):
        r = y - z @ beta[:, j]
        u, v = (c[j] * case[j] / (2 * np.maximum(np.abs(r - s * e[j]), 1e-4)) for s in (1, -1))
        np.testing.assert_allclose(gram[j], (z * (u + v)[:, None]).T @ z, atol=1e-9)
        np.testing.assert_allclose(right[j], z.T @ (u * (y - e[j]) + v * (y + e[j])), atol=1e-9)
        assert loss[j] == pytest.approx(float((c[j] * case[j] * np.maximum(np.abs(r) - e[j], 0)).sum()))


def test_searches_scan_a_small_table_on_every_core(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(early.network, "train", lambda df, jobs, **_: seen.append(df.rdd.getNumPartitions()))
    monkeypatch.setattr(early.ensemble, "tune_tubes", lambda df, *_, **__: seen.append(df.rdd.getNumPartitions()) or 1 / 0)
    one = rows.coalesce(1)
    early.search_networks(one, {"hidden": [(2,)], "epochs": [1]}, 2)
    with pytest.raises(ZeroDivisionError):
        early.search_tubes(one, {"kernel": ["linear"], "C": [1]}, 2)
    assert seen == 2 * [spark.sparkContext.defaultParallelism]
    assert sorted(spread(one, "t").select("sample_id").collect()) == sorted(one.select("sample_id").collect())


def test_gradients_in_blocks_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2 * BLOCK + 7, 3))
    y = x @ [1.0, -2.0, 0.5]
    df = spark.createDataFrame([(f"s{i:05d}", [float(v) for v in x[i]], float(y[i])) for i in range(len(x))],
                               "sample_id string, x array<double>, y double").coalesce(1)
    layers = network.perceptron("all", (4,), "tanh")
    job = network.Job(network.Network.build(layers, {"all": (0, 3)}), 1, rate=0.1)
    alone = network.Job(network.Network.build(layers, {"all": (0, 3)}), 1, rate=0.1)
    loss, grads = alone.net.gradient(x, y)
    alone.adam([g / len(x) for g in grads])
    network.train(df, [job])
    assert job.losses == [pytest.approx(loss / len(x))]
    for a, b in zip(job.net.weights, alone.net.weights):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_first_layer_sends_no_gradient_to_its_input():
    net = network.Network.build(network.perceptron("all", (4,), "tanh"), {"all": (0, 3)})
    _, tape = net.run(np.ones((2, 3)))
    assert tape[0][1](np.ones((2, 4)))[0] == []


def test_factor_rows_do_not_depend_on_their_block():
    rng = np.random.default_rng(5)
    h, x = rng.uniform(size=(3, 6)), rng.uniform(size=(BLOCK + 40, 6))
    both = reduce.nonnegative_rows(x, h)
    np.testing.assert_allclose(both[BLOCK:], reduce.nonnegative_rows(x[BLOCK:], h), atol=1e-8)
    flow = (x - both @ h) @ h.T
    assert (both >= 0).all() and flow.max() < 1e-6 and np.abs(flow[both > 0]).max() < 1e-6
