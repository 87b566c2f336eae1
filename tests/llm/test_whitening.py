import math

import numpy as np
import pytest

from profuse.llm import queries, whitening

from .conftest import SF


def brute(vectors):
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return [sum(int(d) ** 2 for d in n * row - s) for row in x.astype(object)], centred, e[::-1], v[:, ::-1]


def check(vectors, got, components=32):
    """Rows by key 0..n-1 against an eigendecomposition of the covariance."""
    deviations, centred, e, v = brute(vectors)
    kept = min(components, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == len(vectors) * kept
    z = np.full((len(vectors), kept), np.nan)
    for r in got:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(vectors) and r["deviation"] == deviations[r["vec_id"]] and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-6)
    want = centred @ v[:, :kept] / np.sqrt(e[:kept])
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z - sign * want).max() < 1e-6
    assert np.abs(z.T @ z / len(z) - np.eye(kept)).max() < 1e-8


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    check([r["embedding"] for r in rows], queries.op13_whitening(spark, SF).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, x string")


def test_badly_scaled_and_rank_deficient(spark):
    rng = np.random.default_rng(2)
    wide = rng.normal(size=(300, 6)) * [1e4, 1e3, 100, 10, 1, 0.5]
    check(wide.tolist(), whitening.whiten(frame(spark, [(k, v, "c", "x") for k, v in enumerate(wide.tolist())]), "vec_id").collect())
    flat = np.hstack([wide[:, 2:4], np.floor(wide[:, 2:4]), np.full((300, 1), 7.0)])
    flat[:, 2:4] = flat[:, :2]
    check(flat.tolist(), whitening.whiten(frame(spark, [(k, v, "c", "x") for k, v in enumerate(flat.tolist())]), "vec_id").collect())


def test_cholesky_qr_gives_the_factor(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) * 50).tolist()
    rows = whitening.scaled(frame(spark, [(k, v, "c", "x") for k, v in enumerate(vectors)]), "vec_id").repartition(7)
    _, centred, _, _ = brute(vectors)
    x = np.floor(np.array(vectors) * 64).astype(np.int64) + 1_000_000
    r = whitening.cholesky_qr(rows, 200, x.sum(axis=0).tolist())
    assert np.allclose(np.tril(r, -1), 0) and np.abs(r.T @ r - centred.T @ centred).max() < 1e-9 * np.abs(centred.T @ centred).max()


def test_odd_rows(spark):
    good = [[1.0, 2.0], [2.0, 1.5], [0.5, 4.0], [0.5, 4.0]]
    bad = [None, [], [math.nan, 1.0], [math.inf, 1.0], [None, 1.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [(k, v, "c", "x") for k, v in enumerate(good + bad)]
    got = whitening.whiten(frame(spark, rows), "vec_id").collect()
    check(good, got)
    assert len(whitening.whiten(frame(spark, [(None, v, None, None) for v in good]), "vec_id").collect()) == 8
    assert whitening.whiten(frame(spark, []), "vec_id").count() == 0
    assert whitening.whiten(frame(spark, [(k, [1.0, 1.0], "c", "x") for k in range(3)]), "vec_id").count() == 0
