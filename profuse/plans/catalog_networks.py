"""Queries for mixture-of-experts scoring and multi-input networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from profuse.functions import scores
from profuse.functions.hashing import seeded_hash
from profuse.operators import evaluate, network, tuning
from profuse.operators.arrays import vector_to_number
from profuse.plans import early
from profuse.plans.catalog_linear import PAIR_SQL, model_rows, pair
from profuse.plans.prepare import EARLY, design
from profuse.plans.registry import md5_hash, query, r, rounded

# A two-input layer with one unit and two experts.
EXPERT_W, EXPERT_B = [[0.5, -0.25], [0.75, 0.1]], [0.1, 0.2]
GATE_W, GATE_B = [[0.2, -0.1], [-0.3, 0.4]], [0.0, 0.05]


@query("n1_expert_layer", f"""WITH {PAIR_SQL}, z AS (SELECT k,
  greatest(0.5 * x + 0.75 * x2 + 0.1, 0) AS h1, greatest(-0.25 * x + 0.1 * x2 + 0.2, 0) AS h2, exp(0.2 * x - 0.3 * x2) AS g1, exp(-0.1 * x + 0.4 * x2 + 0.05) AS g2 FROM pair)
SELECT k, {r('(h1 * g1 + h2 * g2) / (g1 + g2)')} AS y FROM z""")
def n1(spark, sf):
    net = network.Network(network.Experts(network.Input("x"), 1, 2, "relu", "softmax"), {"x": (0, 2)},
                          [np.array(EXPERT_W), np.array([EXPERT_B]), np.array(GATE_W), np.array([GATE_B])])
    return pair(spark, sf, True).select("k", rounded(vector_to_number(net.predict)).alias("y"))


@query("n2_network_gradient", f"""WITH {PAIR_SQL}, f AS (SELECT *, tanh(0.3 * x - 0.2 * x2 + 0.1) AS h FROM pair),
g AS (SELECT *, 0.7 * h + 0.05 - y AS gap FROM f), d AS (SELECT *, 2 * gap * 0.7 * (1 - h * h) AS dz FROM g)
SELECT {r('avg(gap * gap)')} AS loss, {r('avg(dz * x)')} AS w1, {r('avg(dz * x2)')} AS w2, {r('avg(dz)')} AS b1, {r('avg(2 * gap * h)')} AS v, {r('avg(2 * gap)')} AS b2 FROM d""")
def n2_gradient(spark, sf):
    """Loss and mean gradient of a fixed two-layer network over all rows."""
    layout = network.Dense(network.Dense(network.Input("x"), 1, "tanh"), 1, "linear")
    net = network.Network(layout, {"x": (0, 2)}, [np.array([[0.3], [-0.2]]), np.array([[0.1]]), np.array([[0.7]]), np.array([[0.05]])])
    loss, grads = network.mean_gradient(pair(spark, sf, True), net)
    names = ["loss", "w1", "w2", "b1", "v", "b2"]
    row = (loss, *[float(v) for g in grads for v in g.ravel()])
    return model_rows(spark, [row], ", ".join(f"{n} double" for n in names)).select(*[rounded(n).alias(n) for n in names])


@query("l17_validation_curve", f"""WITH {PAIR_SQL}, v AS (SELECT x, y FROM pair WHERE {md5_hash(3, 'k')} % 10 = 0), t AS (SELECT x, y FROM pair WHERE {md5_hash(3, 'k')} % 10 <> 0)
SELECT 0::bigint AS epoch, {r('avg(y * y)')} AS error FROM v
UNION ALL SELECT 1, {r('avg((y - (0.01 * sign(s.xy) * x + 0.01 * sign(s.my))) ** 2)')} FROM v CROSS JOIN (SELECT avg(x * y) AS xy, avg(y) AS my FROM t) AS s""")
def l17_curve(spark, sf):
    """Validation errors of a linear unit from zero weights: before training and after its first step, whose size is the rate."""
    rows = pair(spark, sf).withColumn("fold", F.when(seeded_hash(3, "k") % 10 == 0, 2).otherwise(1))
    net = network.Network(network.Dense(network.Input("x"), 1), {"x": (0, 1)}, [np.zeros((1, 1)), np.zeros((1, 1))])
    job = network.Job(net, 1, rate=0.01, patience=5)
    network.train(rows, [job], fold="fold", key="k", validate=2)
    return model_rows(spark, list(enumerate(job.curve)), "epoch long, error double").select("epoch", rounded("error").alias("error"))


def blocks_of(names) -> dict:
    out = {"all": (0, len(names))}
    for profile in {n.split(":", 1)[0] for n in names}:
        places = [i for i, n in enumerate(names) if n.startswith(profile + ":")]
        out[profile] = (places[0], places[-1] + 1)
    return out


def _trained(name: str, layout, profiles=EARLY, epochs: int = 6, rate: float = 0.01):
    """Train one layout and report the test error."""

    @query(name)
    def run(spark, sf):
        rows, names = design(spark, sf, profiles)
        job = network.Job(network.Network.build(layout(), blocks_of(names), 1), epochs, rate=rate)
        network.train(rows.filter(F.col("split") == "train"), [job])
        scored = job.net.transform(rows.filter(F.col("split") == "test"))
        return scored.agg(rounded(scores.mse(F.col("y"), F.col("prediction")), 4).alias("mse"))
    return run


@query("l17_feed_forward")
def l17(spark, sf):
    """A feed-forward network that stops early; its test error."""
    rows, _ = design(spark, sf)
    net = early.FITTERS["nn"](rows.filter(F.col("split") == "train"), (100, 3), "tanh")
    scored = net.transform(rows.filter(F.col("split") == "test"))
    return scored.agg(rounded(scores.mse(F.col("y"), F.col("prediction")), 4).alias("mse"))


_trained("n2_multi_input", lambda: network.one_stage(EARLY, units=8, head=8, depth=2, head_depth=2))
_trained("n3_two_stage", lambda: network.two_stage(("spend", "mix"), "share", units=8, head=8, depth=2, head_depth=2, late_depth=2))
_trained("n4_all_profiles", lambda: network.all_profiles(EARLY, 6, 0.2, "tanh", experts=3, depth=2))
_trained("n5_gate_expert", lambda: network.gate_expert("mix", "spend", 10, 1, depth=2, activation="relu"))
_trained("n5_two_gates", lambda: network.two_gates("mix", "share", "spend", 5, 2, 6))


@query("n6_network_sweep")
def n6(spark, sf):
    """Neurons x dropout x activation by three folds, all trained in the same passes."""
    rows, names = design(spark, sf, folds=3)
    train = rows.filter(F.col("fold") > 0)
    settings = tuning.parameter_grid({"units": [4, 8], "dropout": [0.0, 0.2], "activation": ["tanh"]})
    jobs, keys = [], []
    for i, s in enumerate(settings):
        for fold in (1, 2, 3):
            layout = network.all_profiles(EARLY, s["units"], s["dropout"], s["activation"], experts=2, depth=1)
            jobs.append(network.Job(network.Network.build(layout, blocks_of(names), i), 5, fold, rate=0.01, seed=i))
            keys.append((s["units"], s["dropout"], s["activation"]))
    network.train(train, jobs, fold="fold")
    rows_out = [(*k, e) for k, e in zip(keys, network.errors(train, jobs, fold="fold"))]
    scored = model_rows(spark, rows_out, "units int, dropout double, activation string, score double")
    return evaluate.summarise_scores(scored, ["units", "dropout", "activation"]).select(
        "units", "dropout", "activation", rounded("mean", 4).alias("mean"), rounded("variance", 4).alias("variance"))


@query("n7_epoch_sweep")
def n7(spark, sf):
    """Epoch counts with two repeats from fresh weights: mean and variance of the test error."""
    rows, names = design(spark, sf)
    jobs, keys = [], []
    for epochs in (2, 4, 6):
        for repeat in (0, 1):
            layout = network.one_stage(EARLY, units=6, head=6, depth=1, head_depth=1)
            jobs.append(network.Job(network.Network.build(layout, blocks_of(names), 10 * epochs + repeat), epochs, rate=0.01))
            keys.append(epochs)
    network.train(rows.filter(F.col("split") == "train"), jobs)
    found = network.errors(rows.filter(F.col("split") == "test"), jobs)
    scored = model_rows(spark, list(zip(keys, found)), "epochs int, score double")
    return evaluate.summarise_scores(scored, ["epochs"]).select("epochs", rounded("mean", 4).alias("mean"), rounded("variance", 4).alias("variance"))
