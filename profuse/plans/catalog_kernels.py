"""Queries for kernels, low-rank features, kernel weights and support vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from profuse.functions import scores
from profuse.functions.kernels import Kernel, gamma_kernel
from profuse.operators import evaluate, gram, kernels, linear, svm, tuning
from profuse.plans.catalog_linear import PAIR_SQL, pair
from profuse.plans.prepare import EARLY, design, with_folds
from profuse.plans.registry import md5_hash, query, r, rounded
from profuse.session import stored
from profuse.sources import standin

# Default kernel parameters.
SEVEN = {
    "linear": {"b": 0.0}, "poly": {"degree": 2}, "rbf": {"sigma": 2.0}, "sigmoid": {"c": 1.0},
    "exponential": {"sigma": 2.0}, "periodic": {"sigma": 1.0}, "matern": {"nu": 1.5},
}


def bundle_rows(spark, sf):
    """The packed bundle with its label as response."""
    return standin.bundle(spark, sf).select(
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("sample_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))


KEYED = "vec AS (SELECT lpad(vec_id::varchar, 9, '0') AS sample_id, embedding::double[] AS e, label::double AS y FROM embeddings)"
MARKS = f"marks AS (SELECT e AS z, row_number() OVER (ORDER BY {md5_hash(0, 'sample_id')}, sample_id) - 1 AS l FROM vec)"
PRODUCTS = """prod AS (SELECT sample_id, l, any_value(y) AS y, sum(a * b) AS dot, sum((a - b) ** 2) AS sq, sum(abs(a - b)) AS ab FROM (
  SELECT sample_id, y, l, unnest(e) AS a, unnest(z) AS b FROM vec CROSS JOIN marks WHERE l < {n}) GROUP BY sample_id, l)"""


@query("q1_kernel_values", f"""WITH {KEYED}, {MARKS}, {PRODUCTS.format(n=5)}
SELECT sample_id, l::bigint AS landmark, {r('dot')} AS linear, {r('dot ** 2')} AS poly, {r('exp(-sq / 8)')} AS rbf, {r('tanh(dot)')} AS sigmoid,
  {r('exp(-ab / 8)')} AS exponential, {r('exp(-2 * sin(pi() * sqrt(sq)) ** 2)')} AS periodic,
  {r('(1 + sqrt(3::double) * sqrt(sq)) * exp(-sqrt(3::double) * sqrt(sq))')} AS matern FROM prod""")
def q1(spark, sf):
    rows = bundle_rows(spark, sf)
    marks = kernels.landmark_rows(rows, 5, 0)
    for kind, params in SEVEN.items():
        rows = kernels.kernel_values(rows, Kernel(kind, params), marks, out=kind)
    zipped = rows.select("sample_id", F.posexplode(F.arrays_zip(*SEVEN)).alias("landmark", "k"))
    return zipped.select("sample_id", F.col("landmark").cast("bigint").alias("landmark"), *[rounded(f"k.{n}").alias(n) for n in SEVEN])


@query("u2_user_kernel", f"""WITH {KEYED}, {MARKS}, {PRODUCTS.format(n=3)}
SELECT sample_id, l::bigint AS landmark, {r('0.5 * exp(-sq / 8) + 2 * dot')} AS value FROM prod""")
def u2(spark, sf):
    """A user function as kernel: here a sum of two base kernels."""
    first, second = Kernel("rbf", {"sigma": 2.0}), Kernel("linear")
    combined = Kernel(lambda a, b: 0.5 * first(a, b) + 2.0 * second(a, b))
    rows = bundle_rows(spark, sf)
    values = kernels.kernel_values(rows, combined, kernels.landmark_rows(rows, 3, 0))
    return values.select("sample_id", F.posexplode("k").alias("landmark", "value")).select(
        "sample_id", F.col("landmark").cast("bigint").alias("landmark"), rounded("value").alias("value"))


@query("q2_nystrom_factor")
def q2(spark, sf):
    rows = bundle_rows(spark, sf)
    fit = kernels.nystrom(rows, Kernel("rbf", {"sigma": 2.0}), 15)
    return kernels.apply_maps(rows, [fit]).select("sample_id", F.transform("g", lambda v: F.round(v, 6)).alias("g"))


@query("q2_nystrom_one_landmark", f"""WITH {KEYED}, {MARKS}, {PRODUCTS.format(n=1)},
z AS (SELECT sum(b * b) AS zz FROM (SELECT unnest(z) AS b FROM marks WHERE l = 0))
SELECT sample_id, {r('dot / sqrt(zz)')} AS g FROM prod CROSS JOIN z""")
def q2_one(spark, sf):
    rows = bundle_rows(spark, sf)
    fit = kernels.nystrom(rows, Kernel("linear"), 1)
    # the sign of a one-column root is free; take it positive
    fit.mix = np.abs(fit.mix)
    return kernels.apply_maps(rows, [fit]).select("sample_id", rounded(F.col("g")[0]).alias("g"))


@query("q3_incomplete_cholesky")
def q3(spark, sf):
    """Trace of what the factor misses, after each of 15 pivots."""
    fit = kernels.incomplete_cholesky(bundle_rows(spark, sf), Kernel("rbf", {"sigma": 1.0}), 15)
    rows = [(i, t) for i, t in enumerate(fit.residuals)]
    return spark.createDataFrame(rows, "step int, residual double").select("step", rounded("residual", 5).alias("residual"))


@query("q3_two_pivots", f"""WITH {KEYED},
d AS (SELECT sample_id, e, list_inner_product(e, e) AS k0 FROM vec),
p1 AS (SELECT e AS z1, k0 AS d1 FROM d ORDER BY k0 DESC, sample_id DESC LIMIT 1),
s1 AS (SELECT sample_id, e, k0 - list_inner_product(e, z1) ** 2 / d1 AS k1, list_inner_product(e, z1) / sqrt(d1) AS g1 FROM d CROSS JOIN p1),
p2 AS (SELECT e AS z2, k1 AS d2, g1 AS h FROM s1 ORDER BY k1 DESC, sample_id DESC LIMIT 1),
s2 AS (SELECT k1 - (list_inner_product(e, z2) - g1 * h) ** 2 / d2 AS k2 FROM s1 CROSS JOIN p2)
SELECT 0 AS step, {r('sum(k0)', 5)} AS residual FROM d UNION ALL SELECT 1, {r('sum(k1)', 5)} FROM s1 UNION ALL SELECT 2, {r('sum(k2)', 5)} FROM s2""")
def q3_two(spark, sf):
    fit = kernels.incomplete_cholesky(bundle_rows(spark, sf), Kernel("linear"), 2)
    rows = [(i, t) for i, t in enumerate(fit.residuals)]
    return spark.createDataFrame(rows, "step int, residual double").select("step", rounded("residual", 5).alias("residual"))


@query("q4_trace_residual", f"""WITH {KEYED}, {MARKS}, {PRODUCTS.format(n=1)},
z AS (SELECT sum(b * b) AS zz FROM (SELECT unnest(z) AS b FROM marks WHERE l = 0)),
k AS (SELECT sum(a * a) AS total FROM (SELECT unnest(e) AS a FROM vec))
SELECT {r('any_value(total) - sum(dot * dot / zz)', 5)} AS residual FROM prod CROSS JOIN z CROSS JOIN k""")
def q4(spark, sf):
    rows = bundle_rows(spark, sf)
    return kernels.trace_residual(rows, kernels.nystrom(rows, Kernel("linear"), 1)).select(rounded("residual", 5).alias("residual"))


@query("q5_kernel_ridge_one_landmark", f"""WITH {KEYED}, {MARKS}, {PRODUCTS.format(n=1)},
g AS (SELECT sample_id, y, exp(-sq / 8) AS g FROM prod),
s AS (SELECT regr_sxy(y, g) / (regr_sxx(y, g) + 1) AS w, avg(y) AS my, avg(g) AS mg FROM g)
SELECT sample_id, {r('my + w * (g - mg)')} AS prediction FROM g CROSS JOIN s""")
def q5_one(spark, sf):
    rows = bundle_rows(spark, sf)
    fit = kernels.kernel_ridge(rows, [kernels.nystrom(rows, Kernel("rbf", {"sigma": 2.0}), 1)], 1.0)
    return fit.transform(rows).select("sample_id", rounded("prediction").alias("prediction"))


def three_maps(rows, rank=15):
    return [kernels.nystrom(rows, Kernel(k, p), rank) for k, p in
            (("exponential", {"sigma": 2.0}), ("linear", {"b": 0.0}), ("poly", {"degree": 2}))]


@query("q5_low_rank_ridge")
def q5(spark, sf):
    """Uniform combination of three kernels, scored by fold on rows left out."""
    rows = bundle_rows(spark, sf)
    fit = kernels.kernel_ridge(rows, three_maps(rows), 1.0)
    return fit.transform(rows).agg(rounded(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).alias("mse"))


@query("q6_alignment_weights", f"""WITH {KEYED}, {MARKS}, {PRODUCTS.format(n=1)},
z AS (SELECT sum(b * b) AS zz FROM (SELECT unnest(z) AS b FROM marks WHERE l = 0))
SELECT {r('regr_sxy(y, dot) ** 2 / any_value(zz)', 5)} AS linear, {r('regr_sxy(y, exp(-sq / 8)) ** 2', 5)} AS rbf FROM prod CROSS JOIN z""")
def q6(spark, sf):
    rows = bundle_rows(spark, sf)
    maps = [kernels.nystrom(rows, Kernel("linear"), 1), kernels.nystrom(rows, Kernel("rbf", {"sigma": 2.0}), 1)]
    mu = kernels.align(*kernels.block_moments(rows, maps))
    return spark.createDataFrame([tuple(map(float, mu))], "linear double, rbf double").select(
        rounded("linear", 5).alias("linear"), rounded("rbf", 5).alias("rbf"))


TWO_MAPS_SQL = f"""WITH {KEYED}, {MARKS}, {PRODUCTS.format(n=1)},
z AS (SELECT sum(b * b) AS zz FROM (SELECT unnest(z) AS b FROM marks WHERE l = 0)),
g AS (SELECT sample_id, y, dot / sqrt(zz) AS g1, exp(-sq / 8) AS g2 FROM prod CROSS JOIN z),
s AS (SELECT regr_sxx(y, g1) AS s11, regr_sxx(y, g2) AS s22, regr_sxy(g1, g2) AS s12, regr_sxy(y, g1) AS b1, regr_sxy(y, g2) AS b2, avg(g1) AS m1, avg(g2) AS m2, avg(y) AS my FROM g)"""


def two_maps(rows):
    return [kernels.nystrom(rows, Kernel("linear"), 1), kernels.nystrom(rows, Kernel("rbf", {"sigma": 2.0}), 1)]


@query("q7_alignf_two_kernels", f"""{TWO_MAPS_SQL},
w AS (SELECT (s22 ** 2 * b1 ** 2 - s12 ** 2 * b2 ** 2) AS u1, (s11 ** 2 * b2 ** 2 - s12 ** 2 * b1 ** 2) AS u2 FROM s)
SELECT {r('u1 / (u1 + u2)', 5)} AS linear, {r('u2 / (u1 + u2)', 5)} AS rbf FROM w""")
def q7_two(spark, sf):
    rows = bundle_rows(spark, sf)
    mu = kernels.alignf(*kernels.block_moments(rows, two_maps(rows)))
    return spark.createDataFrame([tuple(map(float, mu))], "linear double, rbf double").select(
        rounded("linear", 5).alias("linear"), rounded("rbf", 5).alias("rbf"))


@query("q8_combined_two_kernels", f"""{TWO_MAPS_SQL},
m AS (SELECT *, b1 ** 2 / (b1 ** 2 + b2 ** 2) AS mu1, b2 ** 2 / (b1 ** 2 + b2 ** 2) AS mu2 FROM s),
a AS (SELECT *, mu1 * s11 + 10 AS p, mu2 * s22 + 10 AS q, sqrt(mu1 * mu2) * s12 AS c, sqrt(mu1) * b1 AS e, sqrt(mu2) * b2 AS f FROM m),
w AS (SELECT *, (q * e - c * f) / (p * q - c * c) AS w1, (p * f - c * e) / (p * q - c * c) AS w2 FROM a)
SELECT sample_id, {r('my + w1 * sqrt(mu1) * (g1 - m1) + w2 * sqrt(mu2) * (g2 - m2)')} AS prediction FROM g CROSS JOIN w""")
def q8_two(spark, sf):
    rows = bundle_rows(spark, sf)
    maps = two_maps(rows)
    mu = kernels.align(*kernels.block_moments(rows, maps))
    fit = kernels.kernel_ridge(rows, maps, 10.0, mu / mu.sum())
    return fit.transform(rows).select("sample_id", rounded("prediction").alias("prediction"))


@query("q7_alignf_weights")
def q7(spark, sf):
    rows = bundle_rows(spark, sf)
    m, blocks = kernels.block_moments(rows, three_maps(rows))
    out = [(kind, i, float(w)) for kind in ("linear", "convex") for i, w in enumerate(kernels.alignf(m, blocks, kind))]
    return spark.createDataFrame(out, "kind string, kernel int, weight double").select("kind", "kernel", rounded("weight").alias("weight"))


@query("q8_combined_kernel_ridge")
def q8(spark, sf):
    rows = bundle_rows(spark, sf)
    maps = three_maps(rows)
    mu = kernels.alignf(*kernels.block_moments(rows, maps), "convex")
    fit = kernels.kernel_ridge(rows, maps, 10.0, mu)
    return fit.transform(rows).select("sample_id", rounded("prediction").alias("prediction"))


@query("q9_least_angle")
def q9_least(spark, sf):
    """Three profiles x seven kernels by least-angle steps: kernel and correlation at each column's entry, and the test error."""
    rows, names = design(spark, sf)
    specs = []
    for profile in EARLY:
        places = [i for i, n in enumerate(names) if n.startswith(profile + ":")]
        specs += [(profile, Kernel(kind, params, places[0], places[-1] + 1)) for kind, params in SEVEN.items()]
    path = kernels.least_angle_kernels(rows.filter(F.col("split") == "train"), [k for _, k in specs], rank=6, lam=0.923, ahead=4)
    out = [(i, specs[q][0], str(specs[q][1].kind), level) for i, (q, level) in enumerate(path.chosen)]
    scored = path.model.transform(rows).filter(F.col("split") == "test")
    return spark.createDataFrame(out, "step int, profile string, kernel string, correlation double").crossJoin(
        F.broadcast(scored.agg(scores.mse(F.col("y"), F.col("prediction")).alias("mse")))).select(
        "step", "profile", "kernel", rounded("correlation", 4).alias("correlation"), rounded("mse", 4).alias("mse"))


@query("q9_least_angle_pair", f"""WITH {PAIR_SQL}, s AS (
  SELECT regr_sxy(y, x) / sqrt(regr_sxx(y, x)) AS c1, regr_sxy(y, x2) / sqrt(regr_sxx(y, x2)) AS c2, corr(x, x2) AS r FROM pair),
o AS (SELECT *, CASE WHEN abs(c1) >= abs(c2) THEN 0 ELSE 1 END AS k, CASE WHEN abs(c1) >= abs(c2) THEN c1 ELSE c2 END AS a,
             CASE WHEN abs(c1) >= abs(c2) THEN c2 ELSE c1 END AS b FROM s),
g AS (SELECT *, (abs(a) - b) / (abs(a) - r * a) AS g1, (abs(a) + b) / (abs(a) + r * a) AS g2 FROM o),
t AS (SELECT *, least(CASE WHEN g1 BETWEEN 0 AND 1 THEN g1 ELSE 2 END, CASE WHEN g2 BETWEEN 0 AND 1 THEN g2 ELSE 2 END) AS step FROM g)
SELECT 0 AS step, k AS kernel, {r('abs(a)', 4)} AS correlation FROM t
UNION ALL SELECT 1 AS step, 1 - k AS kernel, {r('(1 - step) * abs(a)', 4)} AS correlation FROM t""")
def q9_pair(spark, sf):
    """Two linear kernels of one column each: entry order and correlations have a closed form."""
    rows = pair(spark, sf, True).withColumn("sample_id", F.col("k").cast("string"))
    path = kernels.least_angle_kernels(rows, [Kernel("linear", {}, 0, 1), Kernel("linear", {}, 1, 2)], rank=2, ahead=2)
    out = [(i, q, level) for i, (q, level) in enumerate(path.chosen)]
    return spark.createDataFrame(out, "step int, kernel int, correlation double").select("step", "kernel", rounded("correlation", 4).alias("correlation"))


@query("q9_multiple_kernels")
def q9(spark, sf):
    """Three profiles x seven kernels, columns picked across all of them."""
    rows, names = design(spark, sf)
    specs = []
    for profile in EARLY:
        places = [i for i, n in enumerate(names) if n.startswith(profile + ":")]
        specs += [(profile, Kernel(kind, params, places[0], places[-1] + 1)) for kind, params in SEVEN.items()]
    train = rows.filter(F.col("split") == "train")
    path = kernels.forward_kernels(train, [k for _, k in specs], rank=6, lam=0.923, ahead=4)
    out = [(i, specs[q][0], str(specs[q][1].kind), gain) for i, (q, gain) in enumerate(path.chosen)]
    return spark.createDataFrame(out, "step int, profile string, kernel string, gain double").select(
        "step", "profile", "kernel", rounded("gain").alias("gain"))


@query("q10_degree_sweep")
def q10(spark, sf):
    """Nine polynomial degrees x five folds from one pass: mean and variance of the fold errors."""
    rows = with_folds(bundle_rows(spark, sf), 5)
    train = rows.filter(F.col("fold") > 0)
    marks = kernels.landmark_rows(train, 15, 0)
    degrees = [int(d) for d in tuning.step_values(1, 10, 1)]
    maps = [kernels.nystrom(train, Kernel("poly", {"degree": d}), 15, landmarks=marks) for d in degrees]
    folds = gram.moments(kernels.apply_maps(train, maps), "fold", x="g")
    whole = gram.total_of(folds)
    edges = np.cumsum([0, *[m.rank for m in maps]])
    out = []
    for d, a, b in zip(degrees, edges[:-1], edges[1:]):
        for f, part in folds.items():
            fit = linear.ridge((whole - part).take(range(a, b)), 1.0)
            out.append((d, int(f), part.take(range(a, b)).mse(fit.coef, fit.intercept)))
    scored = spark.createDataFrame(out, "degree int, fold int, score double")
    return evaluate.summarise_scores(scored, ["degree"]).select("degree", rounded("mean").alias("mean"), rounded("variance").alias("variance"))


@query("l13_support_vectors")
def l13(spark, sf):
    """Tube regression on raw and on kernel features; test error per kernel."""
    rows, _ = design(spark, sf)
    train = rows.filter(F.col("split") == "train")
    out = None
    for kind in ("linear", "rbf"):
        mapped = rows.select("sample_id", "split", "y", "x") if kind == "linear" else kernels.apply_maps(
            rows, [kernels.nystrom(train, gamma_kernel(kind, 0.05), 40)]).select("sample_id", "split", "y", F.col("g").alias("x"))
        mapped = stored(mapped, "mapped") if kind != "linear" else mapped
        fit = svm.fit_tubes(mapped.filter(F.col("split") == "train"), [svm.Tube(1.0, 0.05)], passes=15)[(0, 0)]
        part = fit.transform(mapped).filter(F.col("split") == "test").agg(
            F.lit(kind).alias("kernel"), rounded(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)), 5).alias("mse"))
        out = part if out is None else out.unionByName(part)
    return out


@query("l16_kernel_ridge_search")
def l16(spark, sf):
    """Low-rank kernel ridge over five kernels and penalties: all settings from one pass."""
    rows, _ = design(spark, sf)
    train = rows.filter(F.col("fold") > 0)
    marks = kernels.landmark_rows(train, 30, 0)
    kinds = ["linear", "poly", "rbf", "sigmoid", "laplacian"]
    maps = [kernels.nystrom(train, gamma_kernel(k, 0.05), 30, landmarks=marks) for k in kinds]
    folds = gram.moments(kernels.apply_maps(train, maps), "fold", x="g")
    edges = np.cumsum([0, *[m.rank for m in maps]])
    out = []
    for kind, a, b in zip(kinds, edges[:-1], edges[1:]):
        block = {f: m.take(range(a, b)) for f, m in folds.items()}
        _, best, score = tuning.search_moments(block, linear.ridge, {"alpha": [0.001, 0.05, 0.1, 1.0, 100.0]})
        out.append((kind, float(best["alpha"]), score))
    return spark.createDataFrame(out, "kernel string, alpha double, cv_r2 double").select("kernel", "alpha", rounded("cv_r2", 5).alias("cv_r2"))
