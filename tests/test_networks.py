"""Networks: gradients, partition invariance, training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profuse.operators import network as nw

BLOCKS = {"a": (0, 3), "b": (3, 5), "c": (5, 6)}
LAYOUTS = {
    "dense": nw.Dense(nw.Dense(nw.Input("a"), 4, "tanh"), 1, "linear"),
    "experts": nw.Dense(nw.Experts(nw.Input("a"), 3, 2, "tanh", "softmax"), 1),
    "softmax_experts": nw.Dense(nw.Experts(nw.Input("a"), 3, 2, "softmax", "logistic"), 1),
    "one_stage": nw.one_stage(("a", "b", "c"), 3, 3, 1, 1),
    "two_stage": nw.two_stage(("a", "b"), "c", 3, 3, 1, 1, 1),
    "all_profiles": nw.all_profiles(("a", "b"), 3, 0.3, "tanh", 2, 1),
    "gate_expert": nw.gate_expert("b", "a", 4, 1, activation="tanh"),
    "two_gates": nw.two_gates("b", "c", "a", 3, 2, 4),
}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    return x, 0.5 + x[:, 0] - 0.4 * x[:, 3]


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_gradient_equals_finite_differences(data, name):
    x, y = data
    net = nw.Network.build(LAYOUTS[name], BLOCKS, 3)
    for w in net.weights:
        w += 0.01
    noise = (lambda layer, width: np.random.default_rng(layer).random((len(x), width))) if name == "all_profiles" else None
    _, grads = net.gradient(x, y, noise)
    rng = np.random.default_rng(2)
    for w, g in zip(net.weights, grads):
        for _ in range(3):
            i = tuple(rng.integers(0, n) for n in w.shape)
            keep, h = w[i], 1e-6
            w[i] = keep + h
            up = net.gradient(x, y, noise)[0]
            w[i] = keep - h
            down = net.gradient(x, y, noise)[0]
            w[i] = keep
            assert abs((up - down) / (2 * h) - g[i]) < 1e-4 * max(1.0, abs(g[i]))


def test_expert_layer_formula(data):
    x, _ = data
    net = nw.Network.build(nw.Experts(nw.Input("a"), 2, 3, "relu", "softmax"), BLOCKS, 5)
    w, b, v, c = net.weights
    out = np.zeros((len(x), 2))
    for i, row in enumerate(x[:, :3]):
        gate = np.exp(row @ v + c[0])
        gate /= gate.sum()
        for u in range(2):
            out[i, u] = sum(gate[k] * max(row @ w[:, u * 3 + k] + b[0, u * 3 + k], 0) for k in range(3))
    np.testing.assert_allclose(net.run(x)[0], out, atol=1e-12)


def frame(spark, x, y):
    rows = [(f"s{i}", [float(v) for v in x[i]], float(y[i]), i % 2 + 1) for i in range(len(x))]
    return spark.createDataFrame(rows, "sample_id string, x array<double>, y double, fold int")


def test_training_is_partition_free_and_learns(spark, data):
    x, y = data
    df = frame(spark, x, y)

    def fit(d):
        jobs = [nw.Job(nw.Network.build(LAYOUTS["all_profiles"], BLOCKS, 1), 3, seed=4),
                nw.Job(nw.Network.build(LAYOUTS["dense"], BLOCKS, 1), 15, rate=0.05),
                nw.Job(nw.Network.build(LAYOUTS["dense"], BLOCKS, 1), 4, left_out=1, rate=0.05)]
        return nw.train(d, jobs, batches=2, fold="fold")

    a, b = fit(df.repartition(1)), fit(df.repartition(6))
    for p, q in zip(a, b):
        for u, v in zip(p.net.weights, q.net.weights):
            np.testing.assert_allclose(u, v, atol=1e-9)
    assert a[1].losses[-1] < 0.5 * a[1].losses[0]
    alone = nw.train(df.filter("fold <> 1"), [nw.Job(nw.Network.build(LAYOUTS["dense"], BLOCKS, 1), 4, rate=0.05)], batches=2)
    for u, v in zip(a[2].net.weights, alone[0].net.weights):
        np.testing.assert_allclose(u, v, atol=1e-9)
    whole, left = nw.errors(df, [a[1]], fold="fold")[0], nw.errors(df, [a[2]], fold="fold")[0]
    assert whole == pytest.approx(((a[1].net.predict(x) - y) ** 2).mean())
    held = np.arange(len(x)) % 2 == 0
    assert left == pytest.approx(((a[2].net.predict(x[held]) - y[held]) ** 2).mean())
    scored = a[1].net.transform(df).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    assert scored == pytest.approx(whole)


def test_early_stopping_keeps_the_weights_of_the_turn(spark):
    """Few noisy training rows: the validation error falls, turns and rises; training ends there."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 6))
    y = x[:, 0] + rng.normal(size=60)
    df = frame(spark, x, y)
    layout = nw.perceptron("a", (30,), "tanh")

    def job(**options):
        return nw.Job(nw.Network.build(layout, {"a": (0, 6)}, 2), 80, rate=0.05, seed=5, hold=0.4, **options)

    stopped, further = nw.train(df, [job(patience=6), job(patience=80)])
    turn = stopped.best_epoch
    assert 0 < turn < 70 and len(stopped.curve) == turn + 7 and stopped.stopped
    assert min(stopped.curve) == stopped.curve[turn] and stopped.curve[-1] > stopped.curve[turn]
    np.testing.assert_allclose(further.curve[:len(stopped.curve)], stopped.curve, atol=1e-9)
    assert further.curve[-1] > 1.1 * further.curve[turn] and len(further.curve) == 81
    assert stopped.losses[-1] < stopped.losses[0]
    base = np.array([r["h"] for r in df.select("sample_id", nw.row_hash(0).alias("h")).orderBy(F.expr("int(substr(sample_id, 2))")).collect()], dtype=np.int64)
    aside = nw.held_out(base.view(np.uint64), 5, 0.4)
    assert ((stopped.net.predict(x[aside]) - y[aside]) ** 2).mean() == pytest.approx(stopped.curve[turn])
    again = nw.train(df.repartition(5), [job(patience=6)])[0]
    assert again.best_epoch == turn
    np.testing.assert_allclose(again.curve, stopped.curve, atol=1e-9)
    alone = nw.train(spark.createDataFrame(df.toPandas()[~aside]), [nw.Job(nw.Network.build(layout, {"a": (0, 6)}, 2), turn, rate=0.05, seed=5)])[0]
    for u, v in zip(alone.net.weights, stopped.net.weights):
        np.testing.assert_allclose(u, v, atol=1e-9)


def test_validation_folds_and_left_out_folds(spark, data):
    """A named fold validates; rows of the left-out fold neither train nor validate."""
    x, y = data
    df = frame(spark, x, y)
    build = lambda: nw.Network.build(nw.perceptron("a", (4,), "tanh"), {"a": (0, 6)}, 1)
    job = nw.train(df, [nw.Job(build(), 3, patience=9, rate=0.05)], fold="fold", validate=2)[0]
    held = np.arange(len(x)) % 2 == 1
    assert job.curve[0] == pytest.approx(((build().predict(x[held]) - y[held]) ** 2).mean()) and len(job.curve) == 4
    both, only = nw.train(df, [nw.Job(build(), 4, left_out=1, patience=2)], fold="fold")[0], nw.train(
        df.filter("fold = 2"), [nw.Job(build(), 4, patience=2)])[0]
    np.testing.assert_allclose(both.curve, only.curve, atol=1e-9)
