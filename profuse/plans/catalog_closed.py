"""Iterative operators on few columns of whole tables, where SQL has the same result in closed form or by recursion."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from profuse.functions import scores
from profuse.operators import gram, impute, linear, reduce, robust, trees, tuning
from profuse.operators.rank import block_of, hash_rank
from profuse.plans.catalog_linear import PAIR_SQL, model_rows, pair
from profuse.plans.early import search_kernel_ridge
from profuse.plans.registry import md5_hash, query, r, rounded
from profuse.sources import standin


def priced(spark, sf, *columns):
    """Orders: log price (y) and functions of the price and balance (x)."""
    orders = standin.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = standin.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    make = {"x": F.col("c_acctbal") / F.lit(1000.0), "x2": F.col("o_totalprice") / F.lit(100000.0), "x3": F.sqrt("o_totalprice") / F.lit(100.0)}
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"), F.log10("o_totalprice").alias("y"), F.array(*[make[c] for c in columns]).alias("x"))


PRICED_SQL = f"{PAIR_SQL}, priced AS (SELECT *, sqrt(x2 * 100000.0::double) / 100.0::double AS x3 FROM pair)"


# ---- robust and online -------------------------------------------------------

def _step_sql(c: float, epsilon: float) -> str:
    """One passive-aggressive update of (w0, w1) by the row ``e``."""
    gap = "(e.y - a.w0 - e.x * a.w1)"
    step = f"(sign({gap}) * least({c}::double, greatest(abs({gap}) - {epsilon}::double, 0) / (1 + e.x * e.x)))"
    return f"{{'w0': a.w0 + {step}, 'w1': a.w1 + {step} * e.x, 'x': e.x, 'y': e.y}}"


@query("l9_one_epoch", f"""WITH {PAIR_SQL}, h AS (SELECT x, y, {md5_hash(0, 'k')} AS h FROM pair), s AS (SELECT greatest(1, ceil(count(*) / 10000.0::double))::bigint AS shards FROM pair),
lists AS (SELECT h % shards AS shard, count(*) AS n, list({{'w0': 0::double, 'w1': 0::double, 'x': x, 'y': y}} ORDER BY h) AS l FROM h CROSS JOIN s GROUP BY h % shards),
w AS (SELECT n, list_reduce(list_prepend({{'w0': 0::double, 'w1': 0::double, 'x': 0::double, 'y': 0::double}}, l), lambda a, e: {_step_sql(0.01, 0.1)}) AS w FROM lists)
SELECT {r('sum(w.w1 * n) / sum(n)')} AS slope, {r('sum(w.w0 * n) / sum(n)')} AS intercept FROM w""")
def l9_epoch(spark, sf):
    """Passive-aggressive weights after one epoch over all shards."""
    fit = robust.passive_aggressive(pair(spark, sf).withColumnRenamed("k", "sample_id"), c=0.01, epochs=1)
    return model_rows(spark, [(float(fit.coef[0]), fit.intercept)], "slope double, intercept double").select(
        rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


@query("l10_consensus_line", f"""WITH {PAIR_SQL}, m AS (SELECT median(y) AS m, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM pair),
t AS (SELECT median(abs(y - m)) AS threshold FROM pair CROSS JOIN m),
inside AS (SELECT x, y, threshold FROM pair CROSS JOIN m CROSS JOIN t WHERE abs(y - a * x - b) <= threshold)
SELECT count(*)::int AS inliers, {r('min(threshold)')} AS threshold, {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept FROM inside""")
def l10_line(spark, sf):
    """One candidate from practically all rows: its threshold, its inliers and the refit on them."""
    fit = robust.ransac(pair(spark, sf).withColumnRenamed("k", "sample_id"), 1 - 1e-12, trials=1)
    rows = [(fit.params["inliers"], fit.params["threshold"], float(fit.coef[0]), fit.intercept)]
    return model_rows(spark, rows, "inliers int, threshold double, slope double, intercept double").select(
        "inliers", *[rounded(c).alias(c) for c in ("threshold", "slope", "intercept")])


# Reweighted least squares to the joint optimum of line and scale.
@query("l12_huber_line", f"""WITH RECURSIVE {PRICED_SQL},
loop AS (SELECT 0 AS step, regr_slope(y, x2) AS a, regr_intercept(y, x2) AS b, 0.2::double AS s FROM priced
  UNION ALL SELECT step + 1, a, b, s FROM (
    SELECT step, (sw * sxy - sx * sy) / (sw * (sxx + 0.0001::double * s) - sx * sx) AS a,
           (sy - sx * (sw * sxy - sx * sy) / (sw * (sxx + 0.0001::double * s) - sx * sx)) / sw AS b, sqrt(inner2 / (n - outer_n * 1.8225::double)) AS s FROM (
      SELECT step, s, sum(w) AS sw, sum(w * x2) AS sx, sum(w * y) AS sy, sum(w * x2 * x2) AS sxx, sum(w * x2 * y) AS sxy, count(*) AS n,
             sum(CASE WHEN w < 1 THEN 1 ELSE 0 END) AS outer_n, sum(CASE WHEN w < 1 THEN 0 ELSE g * g END) AS inner2 FROM (
        SELECT step, s, x2, y, y - a * x2 - b AS g, least(1, 1.35::double * s / greatest(abs(y - a * x2 - b), 1e-300)) AS w FROM loop CROSS JOIN priced WHERE step < 80) GROUP BY step, s)))
SELECT {r('a', 3)} AS slope, {r('b', 3)} AS intercept, {r('s', 3)} AS scale FROM loop WHERE step = 80""")
def l12_line(spark, sf):
    fit = robust.huber(priced(spark, sf, "x2"))
    return model_rows(spark, [(float(fit.coef[0]), fit.intercept, fit.params["scale"])], "slope double, intercept double, scale double").select(
        *[rounded(c, 3).alias(c) for c in ("slope", "intercept", "scale")])


# ---- trees -------------------------------------------------------------------

LINES_SQL = "lines AS (SELECT l_quantity::double AS q, l_extendedprice / 1000.0::double AS y FROM lineitem)"


def lines(spark, sf):
    """Order lines: price by quantity, which has 50 values, so every cut between two of them is tried."""
    items = standin.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("y"))
    return trees.with_features(items.withColumn("x", F.array("q")))


def _cut_sql(name: str, source: str, by: str, weight: str = "1") -> str:
    """CTEs: the cut of each ``by`` group that lowers the squared error most, and the means on its two sides."""
    return f"""{name}_b AS (SELECT {by} AS g, q, sum({weight}) AS w, sum({weight} * y) AS s FROM {source} GROUP BY g, q),
{name}_c AS (SELECT g, q, sum(w) OVER (PARTITION BY g ORDER BY q) AS wl, sum(s) OVER (PARTITION BY g ORDER BY q) AS sl, sum(w) OVER (PARTITION BY g) AS wt, sum(s) OVER (PARTITION BY g) AS st FROM {name}_b),
{name} AS (SELECT g, q AS cut, sl / wl AS low, (st - sl) / (wt - wl) AS high FROM {name}_c WHERE wt - wl > 0.5
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) DESC, q) = 1)"""


@query("l15_tree_of_depth_two", f"""WITH {LINES_SQL}, {_cut_sql('root', 'lines', '0')},
sided AS (SELECT q, y, CASE WHEN q <= cut THEN 0 ELSE 1 END AS side FROM lines CROSS JOIN root), {_cut_sql('leaf', 'sided', 'side')},
qs AS (SELECT DISTINCT q, side, avg(y) OVER (PARTITION BY side) AS mean FROM sided)
SELECT q AS quantity, {r('CASE WHEN cut IS NULL THEN mean WHEN q <= cut THEN low ELSE high END')} AS prediction FROM qs LEFT JOIN leaf ON side = g""")
def l15_two(spark, sf):
    data = lines(spark, sf)
    model = trees.fit_tree(data, 2)
    return model.transform(data.dropDuplicates(["q"])).select(F.col("q").alias("quantity"), rounded("prediction").alias("prediction"))


@query("e3_two_rounds", f"""WITH {LINES_SQL}, {_cut_sql('t1', 'lines', '0')},
p1 AS (SELECT q, y, CASE WHEN q <= cut THEN low ELSE high END AS p FROM lines CROSS JOIN t1),
b1 AS (SELECT top, (missed / top / n) / (1 - missed / top / n) AS beta FROM (SELECT max(abs(y - p)) AS top, sum(abs(y - p)) AS missed, count(*) AS n FROM p1)),
w1 AS (SELECT q, y, p, pow(beta, 1 - abs(y - p) / top) AS w FROM p1 CROSS JOIN b1), {_cut_sql('t2', 'w1', '0', 'w')},
p2 AS (SELECT q, y, p, w, CASE WHEN q <= cut THEN low ELSE high END AS p2 FROM w1 CROSS JOIN t2),
b2 AS (SELECT (missed / top / n) / (1 - missed / top / n) AS beta FROM (SELECT max(abs(y - p2)) AS top, sum(w * abs(y - p2)) AS missed, sum(w) AS n FROM p2)),
pairs AS (SELECT DISTINCT q, p, p2, -ln(b1.beta) AS l1, -ln(b2.beta) AS l2 FROM p2 CROSS JOIN b1 CROSS JOIN b2)
SELECT q AS quantity, {r('CASE WHEN p <= p2 THEN CASE WHEN l1 >= (l1 + l2) / 2 - 1e-12 THEN p ELSE p2 END ELSE CASE WHEN l2 >= (l1 + l2) / 2 - 1e-12 THEN p2 ELSE p END END')} AS prediction FROM pairs""")
def e3_two(spark, sf):
    """Two boosted stumps: case weights, losses and the weighted median."""
    data = lines(spark, sf)
    model = trees.fit_boosted(data, rounds=2, max_depth=1)
    return model.transform(data.dropDuplicates(["q"])).select(F.col("q").alias("quantity"), rounded("prediction").alias("prediction"))


# ---- pruning, imputation, factors --------------------------------------------

@query("d2_prune_three", f"""WITH {PRICED_SQL}, s AS (SELECT sum(x * x) AS a, sum(x2 * x2) AS d, sum(x3 * x3) AS f, sum(x * x2) AS b, sum(x * x3) AS c, sum(x2 * x3) AS e FROM priced),
t AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s),
v AS (SELECT *, a * (d * f - e * e) / det AS v1, d * (a * f - c * c) / det AS v2, f * (a * d - b * b) / det AS v3 FROM t),
w AS (SELECT *, CASE WHEN greatest(v1, v2, v3) <= 5 THEN 0 WHEN v1 >= v2 AND v1 >= v3 THEN 1 WHEN v2 >= v3 THEN 2 ELSE 3 END AS gone FROM v),
two AS (SELECT *, CASE gone WHEN 1 THEN d * f / (d * f - e * e) WHEN 2 THEN a * f / (a * f - c * c) WHEN 3 THEN a * d / (a * d - b * b) END AS pair_v FROM w),
kept AS (SELECT i, CASE WHEN gone = 0 THEN [v1, v2, v3][i] WHEN pair_v <= 5 THEN pair_v ELSE 1 END AS inflation,
  i <> gone AND (gone = 0 OR pair_v <= 5 OR i = CASE WHEN gone = 3 THEN 2 ELSE 3 END) AS stays FROM two CROSS JOIN (VALUES (1), (2), (3)) AS g(i))
SELECT 'x' || i AS feature, {r('inflation')} AS inflation FROM kept WHERE stays""")
def d2_three(spark, sf):
    """Whole pruning of three columns, two of them nearly the same."""
    kept = reduce.prune_inflated(gram.moments(priced(spark, sf, "x", "x2", "x3"))["all"].xx, ["x1", "x2", "x3"], 5.0)
    return model_rows(spark, [(n, float(v)) for n, v in kept], "feature string, inflation double").select("feature", rounded("inflation").alias("inflation"))


def _axis_sql(a: str, d: str, source: str) -> str:
    """CTEs ``axis``: first eigenvector (u1, u2) of the uncentred moments."""
    return f"""s AS (SELECT sum({a} * {a}) AS a, sum({d} * {d}) AS d, sum({a} * {d}) AS b FROM {source}),
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS top FROM s),
axis AS (SELECT b / sqrt(b * b + (top - a) ** 2) AS u1, (top - a) / sqrt(b * b + (top - a) ** 2) AS u2 FROM e)"""


@query("d1_rank_one_fill", f""", known AS (SELECT balance / 1000.0::double AS b, avg_price / 100000.0::double AS p FROM response WHERE avg_price IS NOT NULL),
{_axis_sql('b', 'p', 'known')}
SELECT sample_id, {r('coalesce(avg_price / 100000.0::double, balance / 1000.0::double * u2 / u1)', 4)} AS price FROM response CROSS JOIN axis""", ["response"])
def d1_fill(spark, sf):
    """Prices of customers without orders from a rank-1 fit run to its fixed point, the first axis of the complete rows."""
    rows = standin.response(spark, sf).select("sample_id", F.array(F.col("balance") / F.lit(1000.0), F.col("avg_price") / F.lit(100000.0)).alias("x"))
    fit = impute.soft_impute(rows, rank=1, thresh=1e-14, max_steps=60)
    return fit.transform("fill").select("sample_id", rounded(F.col("x")[1], 4).alias("price"))


@query("d5_rank_one_factors", f"""WITH {PRICED_SQL}, {_axis_sql('x2', 'x3', 'priced')}
SELECT k, {r('(x2 * u1 + x3 * u2) * u1', 5)} AS fit1, {r('(x2 * u1 + x3 * u2) * u2', 5)} AS fit2 FROM priced CROSS JOIN axis""")
def d5_one(spark, sf):
    """W H of one non-negative factor run to its fixed point, per order."""
    rows = priced(spark, sf, "x2", "x3")
    model = reduce.fit_nmf(rows, 1, rounds=60, tol=0.0)
    w = model.transform(rows)
    return w.select("k", *[rounded(F.col("x")[0] * F.lit(float(v)), 5).alias(f"fit{i + 1}") for i, v in enumerate(model.h[0])])


# ---- leaderboard -------------------------------------------------------------

@query("t7_two_models", f"""WITH {PRICED_SQL}, f AS (SELECT x2 AS x, y, ntile(6) OVER (ORDER BY {md5_hash(4, 'k')}, k) AS fold FROM priced),
g AS (SELECT 'ridge' AS model, unnest({[float(a) for a in linear.GRIDS['ridge']['alpha']]}::double[]) AS alpha UNION ALL SELECT 'lasso', unnest({[float(a) for a in linear.GRIDS['lasso']['alpha']]}::double[])),
t AS (SELECT h.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM f JOIN range(1, 7) AS h(fold) ON f.fold <> h.fold AND f.fold <= 5 GROUP BY h.fold),
m AS (SELECT model, alpha, fold, mx, my, CASE model WHEN 'ridge' THEN sxy / (sxx + alpha) ELSE sign(sxy) * greatest(abs(sxy / n) - alpha, 0) / (sxx / n) END AS slope FROM t CROSS JOIN g),
q AS (SELECT model, alpha, fold, 1 - sum((y - my - (x - mx) * slope) ** 2) / (var_pop(y) * count(*)) AS r2, avg((y - my - (x - mx) * slope) ** 2) AS mse FROM m JOIN f USING (fold) GROUP BY model, alpha, fold),
z AS (SELECT model, alpha, avg(r2) FILTER (fold <= 5) AS cv_r2, sum(mse) FILTER (fold = 6) AS test_mse FROM q GROUP BY model, alpha
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY avg(r2) FILTER (fold <= 5) DESC) = 1)
SELECT model, alpha, {r('cv_r2')} AS cv_r2, {r('test_mse')} AS test_mse FROM z""")
def t7_two(spark, sf):
    """Ridge and lasso: tuned on five folds, refitted, scored on a sixth."""
    rows = hash_rank(priced(spark, sf, "x2"), "k", 4).withColumn("fold", block_of(F.col("rank"), F.col("n"), 6))
    parts = gram.moments(rows, "fold")
    test = parts.pop("6")
    board = tuning.linear_leaderboard(parts, test, {name: {"alpha": linear.GRIDS[name]["alpha"]} for name in ("ridge", "lasso")})
    found = [(model, float(json.loads(params)["alpha"]), cv, mse) for model, params, cv, mse in board]
    return model_rows(spark, found, "model string, alpha double, cv_r2 double, test_mse double").select(
        "model", "alpha", rounded("cv_r2").alias("cv_r2"), rounded("test_mse").alias("test_mse"))


@query("l16_linear_kernel_search", f"""WITH {PRICED_SQL}, f AS (SELECT x2 AS x, y, ntile(5) OVER (ORDER BY {md5_hash(4, 'k')}, k) AS fold FROM priced),
t AS (SELECT h.fold, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM f JOIN range(0, 6) AS h(fold) ON f.fold <> h.fold GROUP BY h.fold),
q AS (SELECT alpha, t.fold, 1 - sum((y - my - (x - mx) * sxy / (sxx + alpha)) ** 2) / (var_pop(y) * count(*)) AS r2
  FROM f JOIN t USING (fold) CROSS JOIN (VALUES (0.1::double), (10::double), (1000::double)) AS g(alpha) GROUP BY alpha, t.fold),
z AS (SELECT alpha, avg(r2) AS cv_r2 FROM q GROUP BY alpha QUALIFY row_number() OVER (ORDER BY avg(r2) DESC) = 1)
SELECT alpha, {r('cv_r2')} AS cv_r2, {r('(SELECT avg((y - my - (x - mx) * sxy / (sxx + alpha)) ** 2) FROM f CROSS JOIN t WHERE t.fold = 0)')} AS mse FROM z""")
def l16_search(spark, sf):
    """Kernel ridge with the linear kernel of one column, tuned on five folds and refitted: ridge in another form."""
    rows = hash_rank(priced(spark, sf, "x2"), "k", 4).withColumn("fold", block_of(F.col("rank"), F.col("n"), 5)).withColumnRenamed("k", "sample_id")
    model, params, score = search_kernel_ridge(rows, {"kernel": ["linear"], "alpha": [0.1, 10.0, 1000.0]}, 5, rank=5)
    error = model.transform(rows).agg(scores.mse(F.col("y"), F.col("prediction")).alias("mse")).first()[0]
    return model_rows(spark, [(params["alpha"], score, error)], "alpha double, cv_r2 double, mse double").select(
        "alpha", rounded("cv_r2").alias("cv_r2"), rounded("mse").alias("mse"))
