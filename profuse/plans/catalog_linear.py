"""Queries for linear models, collinearity, principal components and scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from profuse.functions import scores
from profuse.operators import evaluate, gram, linear, reduce, tuning
from profuse.operators.rank import block_of, hash_rank
from profuse.plans.prepare import design
from profuse.plans.registry import md5_hash, query, r, rounded
from profuse.sources import standin

# Orders: price explained by the customer's balance (one feature, whole table).
PAIR_SQL = """pair AS (SELECT o_orderkey AS k, log10(o_totalprice) AS y, c_acctbal / 1000.0::double AS x, o_totalprice / 100000.0::double AS x2
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def pair(spark, sf, second: bool = False):
    orders = standin.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = standin.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    xs = [F.col("c_acctbal") / F.lit(1000.0)]
    if second:
        xs.append(F.col("o_totalprice") / F.lit(100000.0))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"), F.log10("o_totalprice").alias("y"), F.array(*xs).alias("x"))


def model_rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("l1_least_squares_line", f"WITH {PAIR_SQL} SELECT {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept, {r('regr_r2(y, x)')} AS r2 FROM pair")
def l1_line(spark, sf):
    m = gram.moments(pair(spark, sf))["all"]
    fit = linear.ols(m)
    rows = [(float(fit.coef[0]), fit.intercept, m.r2(fit.coef, fit.intercept))]
    return model_rows(spark, rows, "slope double, intercept double, r2 double").select(
        *[rounded(c).alias(c) for c in ("slope", "intercept", "r2")])


@query("l1_least_squares_predictions", f"""WITH {PAIR_SQL}, f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM pair)
SELECT k, {r('a * x + b')} AS prediction FROM pair CROSS JOIN f""")
def l1_predictions(spark, sf):
    rows = pair(spark, sf)
    fit = linear.ols(gram.moments(rows)["all"])
    return fit.transform(rows).select("k", rounded("prediction").alias("prediction"))


@query("l2_ridge_line", f"""WITH {PAIR_SQL}, s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM pair)
SELECT a AS alpha, {r('sxy / (sxx + a)')} AS slope, {r('my - mx * sxy / (sxx + a)')} AS intercept
FROM s CROSS JOIN (VALUES (0.01::double), (0.1::double), (1::double), (5::double), (100::double)) AS g(a)""")
def l2_line(spark, sf):
    m = gram.moments(pair(spark, sf))["all"]
    fits = [(float(a), linear.ridge(m, a)) for a in linear.GRIDS["ridge"]["alpha"]]
    rows = [(a, float(f.coef[0]), f.intercept) for a, f in fits]
    return model_rows(spark, rows, "alpha double, slope double, intercept double").select(
        "alpha", rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


@query("l2_ridge_two_features", f"""WITH {PAIR_SQL},
s AS (SELECT regr_sxx(y, x) + 5 AS a, regr_sxx(y, x2) + 5 AS d, regr_sxy(x2, x) AS b, regr_sxy(y, x) AS e, regr_sxy(y, x2) AS f, avg(x) AS mx, avg(x2) AS mx2, avg(y) AS my FROM pair),
w AS (SELECT (d * e - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2, mx, mx2, my FROM s)
SELECT {r('w1')} AS w1, {r('w2')} AS w2, {r('my - w1 * mx - w2 * mx2')} AS intercept FROM w""")
def l2_two(spark, sf):
    fit = linear.ridge(gram.moments(pair(spark, sf, True))["all"], 5.0)
    return model_rows(spark, [(*map(float, fit.coef), fit.intercept)], "w1 double, w2 double, intercept double").select(
        *[rounded(c).alias(c) for c in ("w1", "w2", "intercept")])


@query("l3_lasso_line", f"""WITH {PAIR_SQL}, s AS (SELECT covar_pop(y, x) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM pair),
w AS (SELECT a, sign(c) * greatest(abs(c) - a, 0) / v AS slope, mx, my FROM s CROSS JOIN (VALUES (0.0001::double), (0.001::double), (0.01::double)) AS g(a))
SELECT a AS alpha, {r('slope')} AS slope, {r('my - slope * mx')} AS intercept FROM w""")
def l3_line(spark, sf):
    m = gram.moments(pair(spark, sf))["all"]
    fits = [(a, linear.lasso(m, a)) for a in (0.0001, 0.001, 0.01)]
    return model_rows(spark, [(a, float(f.coef[0]), f.intercept) for a, f in fits], "alpha double, slope double, intercept double").select(
        "alpha", rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


def _path(name: str, fit):
    """Coefficients of one linear regressor on the fused profiles."""

    @query(name)
    def run(spark, sf):
        rows, names = design(spark, sf)
        m = gram.moments(rows, "split")["train"]
        found = fit(m)
        out = [(n, float(c)) for n, c in zip(names, found.coef)]
        return model_rows(spark, out, "feature string, weight double").select("feature", rounded("weight").alias("weight"))
    return run


_path("l3_lasso", lambda m: linear.lasso(m, 0.001))
_path("l4_elastic_net", lambda m: linear.elastic_net(m, 0.001, 0.1))
_path("l5_lars", lambda m: linear.lars(m, 20))
_path("l6_lasso_lars", lambda m: linear.lasso_lars(m, 0.001))
_path("l7_matching_pursuit", lambda m: linear.matching_pursuit(m, 10))
_path("l8_bayesian_ridge", linear.bayesian_ridge)


@query("l4_elastic_net_line", f"""WITH {PAIR_SQL}, s AS (SELECT covar_pop(y, x) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM pair),
w AS (SELECT a, sign(c) * greatest(abs(c) - a * 0.1::double, 0) / (v + a * 0.9::double) AS slope, mx, my FROM s CROSS JOIN (VALUES (0.001::double), (0.05::double), (1::double)) AS g(a))
SELECT a AS alpha, {r('slope')} AS slope, {r('my - slope * mx')} AS intercept FROM w""")
def l4_line(spark, sf):
    m = gram.moments(pair(spark, sf))["all"]
    fits = [(a, linear.elastic_net(m, a, 0.1)) for a in (0.001, 0.05, 1.0)]
    return model_rows(spark, [(a, float(f.coef[0]), f.intercept) for a, f in fits], "alpha double, slope double, intercept double").select(
        "alpha", rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


TWO_SQL = f"""{PAIR_SQL}, s AS (SELECT regr_sxx(y, x) AS a11, regr_sxx(y, x2) AS a22, regr_sxy(x2, x) AS a12, regr_sxy(y, x) AS b1, regr_sxy(y, x2) AS b2,
  avg(x) AS m1, avg(x2) AS m2, avg(y) AS my FROM pair),
t AS (SELECT *, abs(b1) >= abs(b2) AS one, CASE WHEN abs(b1) >= abs(b2) THEN a11 ELSE a22 END AS aj, CASE WHEN abs(b1) >= abs(b2) THEN b1 ELSE b2 END AS bj,
  CASE WHEN abs(b1) >= abs(b2) THEN b2 ELSE b1 END AS bk FROM s)"""


def _two(name: str, sql: str, fit):
    """One-feature fits chosen from two features."""

    @query(name, f"WITH {TWO_SQL}, {sql}, w AS (SELECT CASE WHEN one THEN wj ELSE 0 END AS w1, CASE WHEN one THEN 0 ELSE wj END AS w2, m1, m2, my FROM f) "
                 f"SELECT {r('w1')} AS w1, {r('w2')} AS w2, {r('my - w1 * m1 - w2 * m2')} AS intercept FROM w")
    def run(spark, sf):
        found = fit(gram.moments(pair(spark, sf, True))["all"])
        return model_rows(spark, [(*map(float, found.coef), found.intercept)], "w1 double, w2 double, intercept double").select(
            *[rounded(c).alias(c) for c in ("w1", "w2", "intercept")])
    return run


_two("l5_lars_one_of_two", """u AS (SELECT *, abs(bj) AS c, a12 * sign(bj) / aj AS d FROM t),
g AS (SELECT *, least(c, CASE WHEN d < 1 AND c - bk > 0 THEN (c - bk) / (1 - d) ELSE c END, CASE WHEN d > -1 AND c + bk > 0 THEN (c + bk) / (1 + d) ELSE c END) AS gamma FROM u),
f AS (SELECT *, gamma * sign(bj) / aj AS wj FROM g)""", lambda m: linear.lars(m, 1))
_two("l7_pursuit_one_of_two", "f AS (SELECT *, bj / aj AS wj FROM t)", lambda m: linear.matching_pursuit(m, 1))


@query("l6_lasso_lars_line", f"""WITH {PAIR_SQL}, s AS (SELECT covar_pop(y, x) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(x * y) AS xy FROM pair),
w AS (SELECT a, true AS fit_intercept, sign(c) * greatest(abs(c) - a, 0) / v AS slope, mx, my FROM s CROSS JOIN (VALUES (0.0001::double), (0.001::double), (0.01::double)) AS g(a)
  UNION ALL SELECT a, false, sign(xy) * greatest(abs(xy) - a, 0) / xx, mx, my FROM s CROSS JOIN (VALUES (0.0001::double), (0.001::double), (0.01::double)) AS g(a))
SELECT a AS alpha, fit_intercept, {r('slope')} AS slope, {r('CASE WHEN fit_intercept THEN my - slope * mx ELSE 0 END')} AS intercept FROM w""")
def l6_line(spark, sf):
    m = gram.moments(pair(spark, sf))["all"]
    fits = [(a, flag, linear.lasso_lars(m, a, flag)) for a in (0.0001, 0.001, 0.01) for flag in (True, False)]
    rows = [(a, flag, float(f.coef[0]), f.intercept) for a, flag, f in fits]
    return model_rows(spark, rows, "alpha double, fit_intercept boolean, slope double, intercept double").select(
        "alpha", "fit_intercept", rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


@query("l8_bayesian_ridge_line", f"""WITH RECURSIVE {PAIR_SQL}, s AS (SELECT count(*)::double AS n, regr_sxx(y, x) AS l, regr_sxy(y, x) AS b, regr_syy(y, x) AS c, avg(x) AS mx, avg(y) AS my FROM pair),
loop AS (SELECT 0 AS step, 0::double AS w, n / c AS noise, 1::double AS weight, false AS done FROM s
  UNION ALL SELECT step + 1, new, (n - used + 2e-6) / (c - 2 * new * b + new * new * l + 2e-6), (used + 2e-6) / (new * new + 2e-6), step > 0 AND abs(new - w) < 1e-3
  FROM (SELECT step, w, n, c, b, l, b / (l + weight / noise) AS new, noise * l / (weight + noise * l) AS used FROM loop CROSS JOIN s WHERE NOT done AND step < 300)),
z AS (SELECT b / (l + weight / noise) AS slope, mx, my FROM (SELECT * FROM loop ORDER BY step DESC LIMIT 1) CROSS JOIN s)
SELECT {r('slope')} AS slope, {r('my - slope * mx')} AS intercept FROM z""")
def l8_line(spark, sf):
    fit = linear.bayesian_ridge(gram.moments(pair(spark, sf))["all"])
    return model_rows(spark, [(float(fit.coef[0]), fit.intercept)], "slope double, intercept double").select(
        rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


@query("t2_grid_search", f"""WITH {PAIR_SQL},
f AS (SELECT *, ntile(5) OVER (ORDER BY {md5_hash(4, 'k')}, k) AS fold FROM pair),
t AS (SELECT g.fold, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM f JOIN (VALUES (1), (2), (3), (4), (5)) AS g(fold) ON f.fold <> g.fold GROUP BY g.fold),
q AS (SELECT a, t.fold, 1 - sum((y - my - (x - mx) * sxy / (sxx + a)) ** 2) / (var_pop(y) * count(*)) AS r2
  FROM f JOIN t USING (fold) CROSS JOIN (VALUES (0.01::double), (0.1::double), (1::double), (5::double), (100::double)) AS g(a) GROUP BY a, t.fold)
SELECT a AS alpha, {r('avg(r2)')} AS cv_r2 FROM q GROUP BY a""")
def t2(spark, sf):
    """Mean R2 over five folds for each ridge penalty, from one pass."""
    rows = hash_rank(pair(spark, sf), "k", 4).withColumn("fold", block_of(F.col("rank"), F.col("n"), 5))
    folds = gram.moments(rows, "fold")
    whole = gram.total_of(folds)
    out = []
    for alpha in linear.GRIDS["ridge"]["alpha"]:
        r2 = [m.r2(f.coef, f.intercept) for m in folds.values() for f in [linear.ridge(whole - m, alpha)]]
        out.append((float(alpha), float(np.mean(r2))))
    return model_rows(spark, out, "alpha double, cv_r2 double").select("alpha", rounded("cv_r2").alias("cv_r2"))


@query("t7_linear_leaderboard")
def t7(spark, sf):
    """Every linear regressor and grid on the fused profiles: one scan in all."""
    rows, _ = design(spark, sf)
    parts = gram.moments(rows, "fold")
    test = parts.pop("0")
    board = tuning.linear_leaderboard(parts, test)
    return model_rows(spark, board, tuning.LEADERBOARD_SCHEMA).select(
        "model", "params", rounded("cv_r2").alias("cv_r2"), rounded("test_mse").alias("test_mse")).orderBy("test_mse", "model")


@query("t1_parameter_grid", f"""WITH {PAIR_SQL}, s AS (SELECT covar_pop(y, x) AS c, var_pop(x) AS v, var_pop(y) AS vy FROM pair),
g AS (SELECT * FROM (VALUES (0.001::double), (0.05::double), (1::double), (10::double)) AS a(alpha) CROSS JOIN (VALUES (0::double), (0.1::double), (0.5::double), (1::double)) AS l(l1_ratio)),
w AS (SELECT *, sign(c) * greatest(abs(c) - alpha * l1_ratio, 0) / (v + alpha * (1 - l1_ratio)) AS slope FROM g CROSS JOIN s)
SELECT alpha, l1_ratio, {r('vy - 2 * slope * c + slope * slope * v')} AS mse FROM w""")
def t1(spark, sf):
    """Every elastic-net setting with its training error; all settings are fitted from one scan."""
    m = gram.moments(pair(spark, sf))["all"]
    space = {"alpha": [0.001, 0.05, 1.0, 10.0], "l1_ratio": [0.0, 0.1, 0.5, 1.0]}
    fits = [(*(p[k] for k in sorted(p)), linear.elastic_net(m, **p)) for p in tuning.parameter_grid(space)]
    errors = model_rows(spark, [(a, l1, float(m.mse(f.coef, f.intercept))) for a, l1, f in fits], "alpha double, l1_ratio double, mse double")
    return tuning.grid_rows(spark, space).join(errors, ["alpha", "l1_ratio"]).select("alpha", "l1_ratio", rounded("mse").alias("mse"))


# ---- scores ------------------------------------------------------------------

SCORED_SQL = f"""WITH {PAIR_SQL}, f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM pair),
scored AS (SELECT k, y, a * x + b AS p FROM pair CROSS JOIN f)
"""


def scored(spark, sf):
    rows = pair(spark, sf)
    return linear.ols(gram.moments(rows)["all"]).transform(rows)


def _score(name: str, sql: str, score):
    @query(name, SCORED_SQL + f"SELECT {r(sql)} AS score FROM scored")
    def run(spark, sf):
        return scored(spark, sf).agg(rounded(score(F.col("y"), F.col("prediction"))).alias("score"))
    return run


_score("t3_mean_squared_error", "avg((y - p) ** 2)", scores.mse)
_score("t4_mean_absolute_error", "avg(abs(y - p))", scores.mae)
_score("t4_mean_absolute_percentage", "100 * avg(abs(y - p) / greatest(abs(y), 1e-7))", scores.mape)
_score("t5_r_squared", "1 - sum((y - p) ** 2) / (var_pop(y) * count(*))", scores.r2)
_score("t6_residual_std", "stddev_pop(y - p)", scores.residual_std)


# ---- leave-one-out, collinearity, components ---------------------------------

@query("k5_leave_one_out", f"""WITH {PAIR_SQL}, s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM pair)
SELECT k, {r('(y - my - (x - mx) * sxy / sxx) / (1 - 1 / n - (x - mx) ** 2 / sxx)')} AS residual FROM pair CROSS JOIN s""")
def k5(spark, sf):
    return evaluate.leave_one_out(pair(spark, sf)).select("k", rounded("residual").alias("residual"))


@query("k5_leave_one_out_ridge")
def k5_ridge(spark, sf):
    rows, _ = design(spark, sf)
    return evaluate.leave_one_out(rows, alpha=1.0).select("sample_id", rounded("residual").alias("residual"))


@query("d2_first_inflation", f"""WITH {PAIR_SQL}, s AS (SELECT sum(x * x) AS a, sum(x2 * x2) AS d, sum(x * x2) AS b FROM pair)
SELECT {r('a * d / (a * d - b * b)')} AS inflation FROM s""")
def d2_first(spark, sf):
    factors = reduce.inflation(gram.moments(pair(spark, sf, True))["all"].xx)
    return model_rows(spark, [(float(factors[0]),)], "inflation double").select(rounded("inflation").alias("inflation"))


@query("d2_inflation_pruning")
def d2(spark, sf):
    """Features that stay after dropping the most inflated one until all are at most 5."""
    rows, names = design(spark, sf)
    kept = reduce.prune_inflated(gram.moments(rows)["all"].xx, names, 5.0)
    return model_rows(spark, [(n, float(v)) for n, v in kept], "feature string, inflation double").select(
        "feature", rounded("inflation").alias("inflation"))


COMPONENT_SQL = f"""WITH {PAIR_SQL}, s AS (SELECT var_pop(x) AS a, var_pop(x2) AS d, covar_pop(x, x2) AS b, avg(x) AS mx, avg(x2) AS m2 FROM pair),
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1 FROM s),
v AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS u1, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS u2 FROM e),
g AS (SELECT *, CASE WHEN abs(u1) >= abs(u2) THEN sign(u1) ELSE sign(u2) END AS sg FROM v)
SELECT k, {r('sg * ((x - mx) * u1 + (x2 - m2) * u2)', 5)} AS pc1 FROM pair CROSS JOIN g"""


@query("d4_two_components", COMPONENT_SQL)
def d4_two(spark, sf):
    rows = pair(spark, sf, True)
    model = reduce.fit_pca(rows, 1)
    return model.transform(rows).select("k", rounded(F.col("x")[0], 5).alias("pc1"))


@query("d4_two_components_randomized", COMPONENT_SQL)
def d4_two_sketch(spark, sf):
    rows = pair(spark, sf, True)
    model = reduce.fit_pca(rows, 1, svd_solver="randomized")
    return model.transform(rows).select("k", rounded(F.col("x")[0], 5).alias("pc1"))


@query("d4_two_components_arpack", COMPONENT_SQL)
def d4_two_lanczos(spark, sf):
    rows = pair(spark, sf, True)
    model = reduce.fit_pca(rows, 1, svd_solver="arpack")
    return model.transform(rows).select("k", rounded(F.col("x")[0], 5).alias("pc1"))


@query("d4_solvers")
def d4_solvers(spark, sf):
    """Variances of the packed bundle's first eight components by each solver."""
    rows = standin.bundle(spark, sf).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    out = [(solver, k + 1, float(v)) for solver in reduce.SOLVERS for k, v in enumerate(reduce.fit_pca(rows, 8, svd_solver=solver).variances)]
    return model_rows(spark, out, "solver string, component int, variance double").select("solver", "component", rounded("variance").alias("variance"))


@query("d4_principal_components")
def d4(spark, sf):
    rows, _ = design(spark, sf)
    model = reduce.fit_pca(rows.filter(F.col("split") == "train"), 4)
    return model.transform(rows).select("sample_id", "split", *[rounded(F.col("x")[i]).alias(f"pc{i + 1}") for i in range(4)])


@query("d4_bundle_variance", f"""SELECT {r("sum(v)", 5)} AS total FROM (
  SELECT var_pop(v::double) AS v FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)""")
def d4_total(spark, sf):
    """All components of the packed bundle keep its total variance."""
    rows = standin.bundle(spark, sf).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    model = reduce.fit_pca(rows, gram.width_of(rows))
    return model_rows(spark, [(float(model.variances.sum()),)], "total double").select(rounded("total", 5).alias("total"))
