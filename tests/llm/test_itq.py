import numpy as np
from pyspark.sql import functions as F

from profuse.llm import components, itq

from .conftest import SF


def brute(rows):
    good = [(k, np.array(v, dtype=float)) for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, comp = {}, {k: k for k, _ in rows}
    for d in {len(v) for _, v in good}:
        ids = [k for k, v in good if len(v) == d]
        x = np.array([v / np.linalg.norm(v) for _, v in good if len(v) == d])
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        order = np.argsort(ids, kind="stable")
        near, ids = near[order][:, order], [ids[k] for k in order]
        parent = np.arange(len(ids))
        components.merge(parent, *np.nonzero(near))
        links |= dict(zip(ids, near.sum(1)))
        comp |= {k: ids[p] for k, p in zip(ids, parent)}
    return sorted((k, int(links.get(k, 0)), comp[k], k == comp[k]) for k, _ in rows if k is not None)


def test_embeddings(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted(map(tuple, itq.near_vectors(frame).collect())) == brute(frame.select("vec_id", "embedding").collect())


def test_copies_groups_and_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(k, [float(x) for x in base[k % 60] + (k // 60) * 0.06 * rng.normal(size=16)]) for k in range(900)]
    rows += [(1000 + k, rows[5][1]) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = frame.select("vec_id", F.col("embedding").cast("array<double>")).collect()
    got, want = {r[0]: r for r in map(tuple, itq.near_vectors(frame, block=40).collect())}, brute(rows)
    assert all(got[k][1] <= n for k, n, _, _ in want)
    assert sum(got[k][1] for k, *_ in want) >= 0.97 * sum(n for _, n, _, _ in want)
    assert all(got[1000 + k][1] == got[5][1] for k in range(300))


def test_recall_at_the_threshold():
    """Pairs at cosine 0.9 to 0.92 meet in a table with the planned probability."""
    rng = np.random.default_rng(3)
    x = itq._unit(rng.normal(size=(3000, 64)))
    noise = rng.normal(size=x.shape)
    noise = itq._unit(noise - (noise * x).sum(1, keepdims=True) * x)
    y = 0.905 * x + np.sqrt(1 - 0.905 ** 2) * noise
    bits, tables = itq.plan(50_000, 64, 0.9, 0.98)
    per = 64 // bits
    met = np.zeros(len(x), dtype=bool)
    for k in range(tables):
        turn = itq.rotation(x[:1000], k // per, 5)[:, k % per * bits:(k % per + 1) * bits]
        met |= ((x @ turn >= 0) == (y @ turn >= 0)).all(1)
    assert met.mean() >= 0.95


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (4, [], "x"), (5, [0.0, 0.0], "x"),
            (6, [1.0, None], "x"), (7, [1.0, float("nan")], "x"), (8, [float("inf"), 1.0], "x"), (9, [1.0, 0.0, 0.0], "x"), (None, [1.0, 0.0], "x"),
            (10, [1e300, 1e300], "x"), (11, [1e-300, 1e-300], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").withColumn("node", F.lit(1))
    got = sorted(((r[0], r[1], r[2], r[3]) for r in itq.near_vectors(frame).collect()), key=str)
    one = (1, 2, 1, True)
    assert got == sorted([one, one, (2, 2, 1, False), *[(k, 0, k, True) for k in range(3, 10)], (None, 0, None, True), (10, 1, 10, True), (11, 1, 10, False)], key=str)
    assert itq.near_vectors(frame.limit(0)).count() == 0
