"""Queries for robust models, neighbours, trees, ensembles and late integration."""

from __future__ import annotations

from pyspark.sql import functions as F

from profuse.functions import scores
from profuse.functions.kernels import gamma_kernel
from profuse.operators import bagging, ensemble, evaluate, gram, impute, kernels, linear, reduce, reshape, robust, scale, split, svm, trees, tuning
from profuse.operators.arrays import vector_to_number
from profuse.operators.neighbors import neighbour_regression
from profuse.operators.rank import block_of, key_rank
from profuse.plans.catalog_kernels import KEYED, bundle_rows
from profuse.plans.catalog_linear import PAIR_SQL, model_rows, pair
from profuse.plans import early, integrate
from profuse.plans.integrate import profile_rows, reduced_late_integration
from profuse.plans.prepare import design
from profuse.plans.registry import md5_hash, query, r, rounded
from profuse.session import stored
from profuse.sources import standin

# Small grids for the registered runs; the full ones are in the operators.
SMALL0 = {"kernel": ["linear", "rbf"], "C": [1], "gamma": [0.05]}
SMALL1 = {"kernel": ["linear"], "C": [1, 5]}
SMALL = {"folds": 5, "grid0": SMALL0, "grid1": SMALL1, "tune0": 3, "tune1": 3, "rank": 20, "passes": 6}


def train_of(rows):
    return rows.filter(F.col("split") == "train")


def mse_of(scored, digits: int = 6):
    return scored.filter(F.col("split") == "test").agg(rounded(scores.mse(F.col("y"), F.col("prediction")), digits).alias("mse"))


# ---- robust and online -------------------------------------------------------

@query("l9_passive_aggressive")
def l9(spark, sf):
    rows, _ = design(spark, sf)
    return mse_of(robust.passive_aggressive(train_of(rows), c=0.1, epochs=3).transform(rows))


@query("l10_median_deviation", f"WITH {PAIR_SQL}, m AS (SELECT median(y) AS m FROM pair) SELECT {r('median(abs(y - m))')} AS deviation FROM pair CROSS JOIN m")
def l10_mad(spark, sf):
    """The default inlier threshold, exact and without sorting the column."""
    return model_rows(spark, [(robust.median_deviation(pair(spark, sf)),)], "deviation double").select(rounded("deviation").alias("deviation"))


@query("l10_ransac")
def l10(spark, sf):
    rows, _ = design(spark, sf)
    fit = robust.ransac(train_of(rows), 0.5, trials=20)
    return model_rows(spark, [(fit.params["inliers"], fit.params["threshold"])], "inliers int, threshold double").select(
        "inliers", rounded("threshold").alias("threshold"))


@query("l11_theil_sen")
def l11(spark, sf):
    rows, _ = design(spark, sf)
    return mse_of(robust.theil_sen(train_of(rows)).transform(rows), 4)


@query("l12_huber")
def l12(spark, sf):
    rows, _ = design(spark, sf)
    return mse_of(robust.huber(train_of(rows)).transform(rows), 4)


# ---- neighbours --------------------------------------------------------------

def _knn_sql(p: int) -> str:
    d = "sqrt(sum((a - b) ** 2))" if p == 2 else "sum(abs(a - b))"
    return f"""WITH {KEYED}, parts AS (SELECT *, row_number() OVER (ORDER BY {md5_hash(10, 'sample_id')}, sample_id) AS k, count(*) OVER () AS n FROM vec),
tr AS (SELECT sample_id AS nid, e AS z, y FROM parts WHERE k <= floor(0.8::double * n)), te AS (SELECT sample_id, e FROM parts WHERE k > floor(0.8::double * n)),
d AS (SELECT sample_id, nid, y, {d} AS d FROM (SELECT sample_id, nid, y, unnest(e) AS a, unnest(z) AS b FROM te CROSS JOIN tr) GROUP BY sample_id, nid, y),
near AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, nid) AS place FROM d)
SELECT sample_id, q.k::int AS k, w.kind AS weights, {r("CASE WHEN w.kind = 'uniform' THEN avg(y) WHEN min(d) = 0 THEN avg(y) FILTER (d = 0) ELSE sum(y / d) / sum(1 / d) END")} AS prediction
FROM near JOIN (VALUES (5), (10), (35)) AS q(k) ON place <= q.k CROSS JOIN (VALUES ('uniform'), ('distance')) AS w(kind) GROUP BY sample_id, q.k, w.kind"""


def _knn(name: str, p: int):
    @query(name, _knn_sql(p))
    def run(spark, sf):
        rows = bundle_rows(spark, sf)
        parts = split.apply_split(rows, split.train_test(rows.select("sample_id"), 10))
        found = neighbour_regression(train_of(parts), parts.filter(F.col("split") == "test"), (5, 10, 35), ("uniform", "distance"), p)
        return found.select("sample_id", "k", "weights", rounded("prediction").alias("prediction"))
    return run


_knn("l14_neighbours_euclidean", 2)
_knn("l14_neighbours_manhattan", 1)


# ---- trees -------------------------------------------------------------------

@query("l15_decision_tree")
def l15(spark, sf):
    rows, _ = design(spark, sf)
    data = trees.with_features(rows)
    out = None
    for depth in (2, 5):
        part = mse_of(trees.fit_tree(train_of(data), depth).transform(data)).select(F.lit(depth).alias("max_depth"), "mse")
        out = part if out is None else out.unionByName(part)
    return out


@query("e1_random_forest")
def e1(spark, sf):
    data = trees.with_features(design(spark, sf)[0])
    return mse_of(trees.fit_forest(train_of(data), trees=20, max_depth=5, columns="sqrt").transform(data))


@query("e3_adaboost")
def e3(spark, sf):
    data = trees.with_features(design(spark, sf)[0])
    return mse_of(trees.fit_boosted(train_of(data), rounds=4).transform(data))


@query("d3_isolation_outliers")
def d3(spark, sf):
    """Inliers and outliers of the fused profiles."""
    rows, _ = design(spark, sf)
    marked = trees.fit_isolation(rows, trees=100, max_samples=100, seed=42).transform(rows)
    return marked.groupBy("outlier").agg(F.count("*").alias("n_samples"))


# ---- imputation and factors --------------------------------------------------

@query("d1_low_rank_imputation")
def d1(spark, sf):
    """Gaps of a scaled profile filled from a rank-2 fit."""
    cells = stored(scale.minmax(scale.log_scale(standin.spend(spark, sf))), "scaled")
    names = reshape.feature_names(cells)
    fit = impute.soft_impute(reshape.to_vectors(cells, names), rank=2)
    filled = reshape.to_cells(fit.transform("fill"), names)
    return filled.select("sample_id", "feature", rounded("value", 5).alias("value"))


@query("d5_nonnegative_factors")
def d5(spark, sf):
    """Factors of every sample, from components fitted on the training rows."""
    rows, _ = design(spark, sf)
    model = reduce.fit_nmf(train_of(rows), 4)
    return model.transform(rows).select("sample_id", "split", *[rounded(F.col("x")[i], 4).alias(f"w{i + 1}") for i in range(4)])


# ---- repeated scores and fold means ------------------------------------------

@query("a9_score_summary", f"SELECT feature, {r('avg(value)')} AS mean, {r('var_pop(value)', 4)} AS variance FROM activity GROUP BY feature", ["activity"])
def a9(spark, sf):
    scored = standin.activity(spark, sf).withColumnRenamed("value", "score")
    return evaluate.summarise_scores(scored, ["feature"]).select("feature", rounded("mean").alias("mean"), rounded("variance", 4).alias("variance"))


FOLDED_SQL = f"""{PAIR_SQL}, f AS (SELECT *, ntile(10) OVER (ORDER BY k) AS fold FROM pair),
m AS (SELECT g.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f JOIN range(1, 11) AS g(fold) ON f.fold <> g.fold GROUP BY g.fold)"""


def folded(spark, sf):
    return key_rank(pair(spark, sf), "k").withColumn("fold", block_of(F.col("rank"), F.col("n"), 10))


@query("a10_mean_of_fold_models", f"WITH {FOLDED_SQL} SELECT k, {r('avg(a * x + b)')} AS prediction FROM pair CROSS JOIN m GROUP BY k")
def a10(spark, sf):
    """Each row predicted by ten fold models; the mean per row from long predictions."""
    rows = folded(spark, sf)
    models = ensemble.gram_fold_models(rows, linear.ols)
    each = F.explode(F.array(*[m.column() for m in models.folds.values()])).alias("prediction")
    return evaluate.mean_prediction(rows.select("k", each), ("k",)).select("k", rounded("prediction").alias("prediction"))


@query("e6_out_of_fold_line", f"WITH {FOLDED_SQL} SELECT k, f.fold::bigint AS fold, {r('a * x + b')} AS prediction FROM f JOIN m USING (fold)")
def e6_line(spark, sf):
    rows = folded(spark, sf)
    models = ensemble.gram_fold_models(rows, linear.ols)
    return rows.select("k", "fold", rounded(models.out_of_fold()).alias("prediction"))


# ---- ensembles ---------------------------------------------------------------

@query("e2_bagging")
def e2(spark, sf):
    """Bagged ridge, elastic net, kernel ridge and support vectors, all rows and hashed weights."""
    rows, _ = design(spark, sf)
    train = train_of(rows)
    mapping = kernels.nystrom(train, gamma_kernel("poly", 0.01, 4), 20)
    mapped = kernels.apply_maps(rows, [mapping])
    found = [
        ("ridge", ensemble.bag_linear(train, linear.ridge, 10, alpha=100.0), rows, "x"),
        ("ridge_features", ensemble.bag_linear(train, linear.ridge, 10, True, alpha=100.0), rows, "x"),
        ("elastic_net", ensemble.bag_linear(train, linear.elastic_net, 10, alpha=0.05, l1_ratio=0.01), rows, "x"),
        ("kernel_ridge", ensemble.bag_linear(train_of(mapped), linear.ridge, 10, x="g", alpha=100.0), mapped, "g"),
        ("support_vectors", ensemble.bag_tubes(train, svm.Tube(0.1, 0.1), 5, passes=6), rows, "x"),
    ]
    out = None
    for name, model, source, x in found:
        part = mse_of(model.transform(source, x), 5).select(F.lit(name).alias("base"), "mse")
        out = part if out is None else out.unionByName(part)
    return out


@query("e2_bagging_search")
def e2_search(spark, sf):
    """Four bases, two sizes, features drawn or not, five folds: score of every setting, and the test error of the best."""
    rows, _ = design(spark, sf)
    vote, settings, found = bagging.bagging_search(train_of(rows))
    test, best = mse_of(vote.transform(rows), 4).first()[0], int(found.argmax())
    return model_rows(spark, [(tuning.params_text(s), float(v), float(test) if i == best else None) for i, (s, v) in enumerate(zip(settings, found))],
                      "params string, cv_r2 double, test_mse double").select("params", rounded("cv_r2", 4).alias("cv_r2"), "test_mse")


@query("e4_voting_combiner", f"""WITH {PAIR_SQL}, s AS (SELECT avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM pair)
SELECT k, {r('my + (x - mx) * (sxy / (sxx + 0.1) + sxy / (sxx + 10) + sxy / (sxx + 1000)) / 3')} AS prediction FROM pair CROSS JOIN s""")
def e4_combiner(spark, sf):
    rows = pair(spark, sf)
    m = gram.moments(rows)["all"]
    out = rows
    for i, alpha in enumerate((0.1, 10.0, 1000.0)):
        out = linear.ridge(m, alpha).transform(out, out=f"p{i}")
    return out.select("k", rounded(ensemble.row_mean(["p0", "p1", "p2"])).alias("prediction"))


def four_bases(train, folds=(), passes: int = 8):
    """Support vectors, ridge, elastic net and kernel ridge as fold models."""
    mapping = kernels.nystrom(train, gamma_kernel("rbf", 0.05), 20)
    return {
        "svr": ensemble.tube_fold_models(train, svm.Tube(1.0, 0.1), folds, None, passes=passes),
        "ridge": ensemble.gram_fold_models(train, linear.ridge, alpha=1.0),
        "elastic": ensemble.gram_fold_models(train, linear.elastic_net, alpha=0.001, l1_ratio=0.1),
        "kernel": ensemble.gram_fold_models(train, linear.ridge, mapping, alpha=1.0),
    }


@query("e4_voting")
def e4(spark, sf):
    rows, _ = design(spark, sf)
    train = train_of(rows)
    bases = four_bases(train)
    scored = rows
    for name, models in bases.items():
        whole = ensemble.FoldModels(models.mapping, {}, models.whole)
        scored = scored.withColumn(name, _whole_column(whole))
    return mse_of(scored.withColumn("prediction", ensemble.row_mean(list(bases))), 5)


VOTE_ALPHAS = ((0.1, 10.0, 1000.0, 100000.0), (1.0, 10000.0))


def _values(numbers) -> str:
    return ", ".join(f"({n}::double)" for n in numbers)


@query("e4_voting_search_line", f"""WITH {PAIR_SQL}, f AS (SELECT *, ntile(10) OVER (ORDER BY k) AS fold FROM pair),
s AS (SELECT g.fold, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM f JOIN range(1, 11) AS g(fold) ON f.fold <> g.fold GROUP BY g.fold),
c AS (SELECT fold, a, b, mx, my, (sxy / (sxx + a) + sxy / (sxx + b)) / 2 AS slope FROM s CROSS JOIN (VALUES {_values(VOTE_ALPHAS[0])}) AS p(a) CROSS JOIN (VALUES {_values(VOTE_ALPHAS[1])}) AS q(b)),
e AS (SELECT a, b, f.fold, 1 - sum((y - my - (x - mx) * slope) ** 2) / regr_syy(y, x) AS r2 FROM f JOIN c USING (fold) GROUP BY a, b, f.fold)
SELECT a AS first, b AS second, {r('avg(r2)')} AS r2 FROM e GROUP BY a, b""")
def e4_search_line(spark, sf):
    """Every choice of two ridge penalties that vote, scored by ten folds in one scan."""
    rows = stored(folded(spark, sf), "voting")
    parts = gram.moments(rows, "fold")
    bases = [[ensemble.gram_panel(parts, linear.ridge, [{"alpha": a} for a in alphas])] for alphas in VOTE_ALPHAS]
    scores = ensemble.vote_scores(rows, bases, range(1, 11))
    found = [(a, b, float(scores[i, j])) for i, a in enumerate(VOTE_ALPHAS[0]) for j, b in enumerate(VOTE_ALPHAS[1])]
    return model_rows(spark, found, "first double, second double, r2 double").select("first", "second", rounded("r2").alias("r2"))


@query("e4_voting_search")
def e4_search(spark, sf):
    """The whole grid with ten folds: score of every distinct setting, and the test error of the best."""
    rows, _ = design(spark, sf, folds=10)
    vote, settings, scores = ensemble.voting_search(train_of(rows))
    test = mse_of(vote.transform(rows), 4).first()[0]
    best = int(scores.argmax())
    found = [(tuning.params_text(s), float(v), float(test) if i == best else None) for i, (s, v) in enumerate(zip(settings, scores))]
    return model_rows(spark, found, "params string, cv_r2 double, test_mse double").select("params", rounded("cv_r2", 4).alias("cv_r2"), "test_mse")


def _whole_column(models: ensemble.FoldModels):
    beta, bias, mapping = models.whole.coef, models.whole.intercept, models.mapping
    return vector_to_number(lambda m: (m if mapping is None else mapping.features(m)) @ beta + bias)


@query("e5_stacking_regressor")
def e5(spark, sf):
    """Four bases' out-of-fold predictions under a forest, bagged ridge and AdaBoost."""
    rows, _ = design(spark, sf)
    bases = four_bases(train_of(rows), folds=range(1, 6))
    preds = F.array(*[m.out_of_fold(average=False) for m in bases.values()])
    level1 = trees.with_features(stored(rows.select("sample_id", "split", "y", preds.alias("x")), "level1"))
    finals = {
        "random_forest": trees.fit_forest(train_of(level1), trees=10, max_depth=4).transform(level1),
        "bagging": ensemble.bag_linear(train_of(level1), linear.ridge, 10, alpha=1.0).transform(level1),
        "adaboost": trees.fit_boosted(train_of(level1), rounds=3).transform(level1),
    }
    out = None
    for name, scored in finals.items():
        part = mse_of(scored, 5).select(F.lit(name).alias("final"), "mse")
        out = part if out is None else out.unionByName(part)
    return out


@query("e6_level0_stacking")
def e6(spark, sf):
    out = None
    for name, rows in profile_rows(spark, sf).items():
        part = ensemble.level0(rows).select(
            F.lit(name).alias("profile"), "sample_id", "split", rounded("prediction", 4).alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


@query("e7_late_integration")
def e7(spark, sf):
    """Both whole grids with ten folds: the second model's settings and the test error."""
    scored, params = ensemble.late_integration(profile_rows(spark, sf))
    return mse_of(scored, 5).select(F.lit(tuning.params_text(params)).alias("params"), "mse")


@query("e8_late_integration_nmf")
def e8(spark, sf):
    rows = profile_rows(spark, sf)
    found = reduced_late_integration(rows, "nmf", integrate.NMF_SPACE, **{**SMALL, "grid0": {"kernel": ["linear"], "C": [1]}}, rounds=5)
    return model_rows(spark, [(tuning.params_text(p), m) for p, m in found], "params string, mse double").select("params", rounded("mse", 5).alias("mse"))


@query("e9_late_integration_pca")
def e9(spark, sf):
    rows = profile_rows(spark, sf)
    found = reduced_late_integration(rows, "pca", {"n_components": [2, 4]}, **{**SMALL, "grid0": {"kernel": ["linear"], "C": [1]}})
    return model_rows(spark, [(tuning.params_text(p), m) for p, m in found], "params string, mse double").select("params", rounded("mse", 5).alias("mse"))


# ---- leaderboards ------------------------------------------------------------

def _board(name: str, spaces: dict, folds: int = 2):
    """The robust families and single trees run small grids; the full ones are in ``plans.early``."""

    @query(name)
    def run(spark, sf):
        rows, _ = design(spark, sf, folds=folds)
        board = early.leaderboard(rows, spaces, folds)
        return model_rows(spark, board, tuning.LEADERBOARD_SCHEMA).select(
            "model", "params", rounded("cv_r2", 4).alias("cv_r2"), rounded("test_mse", 4).alias("test_mse"))
    return run


_board("t7_robust_leaderboard", {"passive_aggressive": {"c": [0.1]}, "ransac": {"min_samples": [0.85]}, "huber": {}})
_board("t7_nonlinear_leaderboard", {
    "svr": early.NONLINEAR["svr"], "knn": early.NONLINEAR["knn"], "gaussian_process": {}, "tree": {"max_depth": [2, 4]},
    "kernel_ridge": early.NONLINEAR["kernel_ridge"], "nn": {**early.NONLINEAR["nn"], "epochs": [30]}}, folds=5)
_board("t7_ensemble_leaderboard", early.ENSEMBLES, folds=5)
