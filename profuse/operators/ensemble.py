"""Bagging, voting, stacking and late integration."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from profuse.functions import scores
from profuse.functions.kernels import gamma_kernel
from profuse.operators import svm
from profuse.operators.align import prediction_columns
from profuse.operators.arrays import matrix_of, mixed_uniform, poisson_weights, vector_to_number
from profuse.operators.gram import Moments, member_moments, moments, total_of
from profuse.operators.kernels import LowRankMap, apply_maps, landmark_rows, nystrom
from profuse.operators.linear import LinearModel, elastic_net, ridge
from profuse.operators.rank import block_of, key_rank
from profuse.session import spread, stored


def mean_model(models: Sequence[LinearModel]) -> LinearModel:
    """The model whose prediction is the mean of the models' predictions."""
    return LinearModel(np.mean([m.coef for m in models], axis=0), float(np.mean([m.intercept for m in models])))


# ---- bagging -----------------------------------------------------------------

def drawn_columns(p: int, member: int, seed: int) -> np.ndarray:
    """``p`` hashed draws of a feature with replacement, one set per member."""
    return np.floor(mixed_uniform(np.arange(p, dtype=np.uint64), 1_000_003 * (member + 1) + seed) * p).astype(int)


def bag_linear(df: DataFrame, solver: Callable[..., LinearModel], members: int = 10, bootstrap_features: bool = False,
               seed: int = 0, x: str = "x", y: str = "y", **params) -> LinearModel:
    """Bagged linear models (ridge, elastic net, or kernel ridge on mapped features).

    Bootstrap weights of all members are summed in one Gram pass; drawing features
    with replacement is a choice of Gram columns.
    """
    parts = member_moments(df, members, lambda u, _: poisson_weights(u), seed, x, y)
    fits = []
    for i, m in enumerate(parts):
        if not bootstrap_features:
            fits.append(solver(m, **params))
            continue
        drawn = drawn_columns(m.p, i, seed)
        fit = solver(m.take(drawn), **params)
        coef = np.zeros(m.p)
        np.add.at(coef, drawn, fit.coef)
        fits.append(LinearModel(coef, fit.intercept))
    return mean_model(fits)


def bag_tubes(df: DataFrame, tube: svm.Tube, members: int = 10, seed: int = 0, x: str = "x", y: str = "y", passes: int = 25) -> LinearModel:
    """Bagged support-vector regression; every member is fitted in the same passes."""
    fits = svm.fit_tubes(df, [tube], x=x, y=y, bags=members, seed=seed, passes=passes)
    return mean_model([fits[0, b] for b in range(members)])


# ---- voting ------------------------------------------------------------------

def row_mean(columns: Sequence[str]) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / F.lit(float(len(columns)))


# ---- fold models -------------------------------------------------------------

@dataclass
class FoldModels:
    """One linear-in-features model per left-out fold, and one on all rows.

    ``mapping`` is the low-rank kernel map whose features the models read, if any.
    """

    mapping: LowRankMap | None
    folds: dict[int, LinearModel]
    whole: LinearModel

    def out_of_fold(self, x: str = "x", fold: str = "fold", average: bool = True) -> Column:
        """Rows of fold f get the model fitted without f.

        Other rows (fold 0: test) get the mean of the fold models, or the model
        fitted on all training rows when ``average`` is off.
        """
        rest = mean_model(list(self.folds.values())) if average else self.whole
        table = {f: np.r_[m.intercept, m.coef] for f, m in self.folds.items()}
        other, mapping = np.r_[rest.intercept, rest.coef], self.mapping

        @F.arrow_udf("double")
        def score(values: pa.Array, folds: pa.Array) -> pa.Array:
            if len(values) == 0:
                return pa.array([], pa.float64())
            m = matrix_of(values)
            z = mapping.features(m) if mapping is not None else m
            z = np.column_stack([np.ones(len(z)), z])
            fs = folds.to_numpy(zero_copy_only=False).astype(int)
            out = z @ other
            for f, beta in table.items():
                out[fs == f] = z[fs == f] @ beta
            return pa.array(out)

        return score(F.col(x), F.col(fold))


def gram_fold_models(train: DataFrame, solver: Callable[..., LinearModel], mapping: LowRankMap | None = None,
                     x: str = "x", fold: str = "fold", **params) -> FoldModels:
    """All fold models of a Gram-solvable regressor from one pass."""
    source = train if mapping is None else apply_maps(train, [mapping], x, "_g")
    parts = moments(source, fold, x if mapping is None else "_g")
    whole: Moments = total_of(parts)
    return FoldModels(mapping, {int(f): solver(whole - m, **params) for f, m in parts.items()}, solver(whole, **params))


def tube_fold_models(train: DataFrame, tube: svm.Tube, folds: Sequence[int], mapping: LowRankMap | None = None,
                     x: str = "x", fold: str = "fold", passes: int = 20) -> FoldModels:
    source = train if mapping is None else stored(apply_maps(train, [mapping], x, "_g").select("sample_id", "_g", "y", fold), "mapped")
    fits = svm.fit_tubes(source, [tube], folds, x if mapping is None else "_g", fold=fold, passes=passes)
    return FoldModels(mapping, {f: fits[0, f] for f in folds}, fits[0, 0])


# ---- tuned support vectors ---------------------------------------------------

# Search grids of level 0 and level 1.
LEVEL0_GRID = {"kernel": ["linear", "poly", "rbf", "sigmoid"], "C": [1, 10], "gamma": [0.001], "degree": [3, 10], "coef0": [0, 1]}
LEVEL1_GRID = {"kernel": ["linear", "poly", "rbf", "sigmoid"], "C": [1, 5, 10], "gamma": [0.0001, 0.001, 0.01], "degree": [2, 4, 10], "coef0": [0, 0.5, 1]}


def kernel_settings(grid: dict) -> list[tuple]:
    """Distinct (kernel, gamma, degree, coef0); parameters a kernel ignores are not repeated."""
    found: dict[tuple, None] = {}
    for kind in grid["kernel"]:
        for gamma in grid.get("gamma", [1.0]) if kind != "linear" else [1.0]:
            for degree in grid.get("degree", [3]) if kind == "poly" else [3]:
                for coef0 in grid.get("coef0", [0]) if kind in ("poly", "sigmoid") else [0]:
                    found[(kind, gamma, degree, coef0)] = None
    return list(found)


@dataclass
class Tuned:
    mapping: LowRankMap | None
    tube: svm.Tube
    params: dict
    score: float
    whole: LinearModel


def tune_tubes(train: DataFrame, grid: dict, folds: Sequence[int], fold: str = "tune", rank: int = 30, epsilon: float = 0.1,
               seed: int = 0, x: str = "x", passes: int = 15) -> Tuned:
    """Cross-validated search; every kernel, C and fold is fitted in the same passes."""
    tubes = [svm.Tube(float(c), epsilon) for c in grid["C"]]
    kinds = kernel_settings(grid)
    panels = svm.fit_kernel_tubes(train, kernel_maps(train, kinds, rank, seed, x), tubes, folds, x, fold=fold, passes=passes)
    scores = np.array(svm.panel_scores(train, panels, folds, x, fold=fold))
    i, s = np.unravel_index(int(scores.argmax()), scores.shape)
    return Tuned(panels[i].mapping, tubes[s], kernel_params(kinds[i], tubes[s]), float(scores[i, s]), panels[i].model(s))


def kernel_maps(train: DataFrame, kinds: Sequence[tuple], rank: int, seed=0, x: str = "x") -> list[LowRankMap | None]:
    """A low-rank map per kernel setting on shared landmarks; the linear kernel needs none."""
    marks = landmark_rows(train, rank, seed, x=x) if any(kind[0] != "linear" for kind in kinds) else None
    return [None if kind == "linear" else nystrom(train, gamma_kernel(kind, gamma, degree, coef0), rank, landmarks=marks)
            for kind, gamma, degree, coef0 in kinds]


def kernel_params(kind: tuple, tube: svm.Tube) -> dict:
    return {"kernel": kind[0], "C": tube.c, "gamma": kind[1], "degree": kind[2], "coef0": kind[3]}


# ---- voting search -----------------------------------------------------------

# Axes of the support-vector base of voting and stacking.
VOTING_GRID = {"kernel": ["linear", "poly", "rbf", "sigmoid"], "C": [0.1, 1, 3, 10, 20], "degree": [2, 4, 6, 8], "gamma": [0.001, 0.05, 0.01, 0.1, 1, 100]}


@dataclass
class Vote:
    """Mean of the predictions of one model per base."""

    members: list[tuple[LowRankMap | None, LinearModel]]

    def predict(self, m: np.ndarray) -> np.ndarray:
        each = [(m if mapping is None else mapping.features(m)) @ model.coef + model.intercept for mapping, model in self.members]
        return np.mean(each, axis=0)

    def transform(self, df: DataFrame, x: str = "x", out: str = "prediction") -> DataFrame:
        return df.withColumn(out, vector_to_number(self.predict, x))


def gram_panel(parts: dict[str, Moments], solver: Callable[..., LinearModel], settings: Sequence[dict], mapping: LowRankMap | None = None) -> svm.Panel:
    """Fold models of every setting of a Gram-solvable base; ``parts`` are moments by fold."""
    whole = total_of(parts)

    def columns(m: Moments) -> np.ndarray:
        fits = [solver(m, **s) for s in settings]
        return np.column_stack([np.r_[fit.intercept, fit.coef] for fit in fits])

    return svm.Panel(mapping, list(settings), {int(f): columns(whole - m) for f, m in parts.items()}, columns(whole))


def vote_scores(train: DataFrame, bases: Sequence[Sequence[svm.Panel]], folds: Sequence[int], x: str = "x", fold: str = "fold") -> np.ndarray:
    """Mean R2 over folds of the mean prediction, for every choice of one setting per base; axis b runs over the settings of base b.

    All predictions are compared in one scan, whatever the number of choices.
    Choices without finite predictions get -inf.
    """
    found = svm.residual_moments(train, [p for base in bases for p in base], folds, x, fold=fold)
    sizes = [sum(len(p.settings) for p in base) for base in bases]
    edges = np.cumsum([0, *sizes])
    total = np.zeros(sizes)
    for ee, yy in found.values():
        sse = np.zeros(sizes)
        for a in range(len(bases)):
            for b in range(len(bases)):
                block = ee[edges[a]:edges[a + 1], edges[b]:edges[b + 1]]
                shape = [1] * len(bases)
                shape[a], shape[b] = sizes[a], sizes[b]
                sse = sse + (np.diagonal(block) if a == b else block if a < b else block.T).reshape(shape)
        total += 1.0 - sse / len(bases) ** 2 / max(yy, 1e-300)
    return np.nan_to_num(total / len(found), nan=-np.inf)


def voting_search(train: DataFrame, grid: dict = VOTING_GRID, folds: Sequence[int] = range(1, 11), rank: int = 30, epsilon: float = 0.1,
                  fold: str = "fold", seed=0, x: str = "x", passes: int = 15) -> tuple[Vote, list[dict], np.ndarray]:
    """Voting of support vectors, ridge, elastic net and kernel ridge, searched over the support vectors' grid.

    The last three keep their default settings.  Returns the vote of the best
    setting refitted on all rows, every setting and its score.
    """
    train = spread(train, "voting")
    tubes, kinds = [svm.Tube(float(c), epsilon) for c in grid["C"]], kernel_settings(grid)
    tuned = svm.fit_kernel_tubes(train, kernel_maps(train, kinds, rank, seed, x), tubes, folds, x, fold=fold, passes=passes)
    plain = moments(train, fold, x)
    kernel = nystrom(train, gamma_kernel("linear", 1.0), rank, landmarks=landmark_rows(train, rank, seed, x=x))
    fixed = [gram_panel(plain, ridge, [{"alpha": 1.0}]), gram_panel(plain, elastic_net, [{"alpha": 1.0, "l1_ratio": 0.5}]),
             gram_panel(moments(apply_maps(train, [kernel], x, "_g"), fold, "_g"), ridge, [{"alpha": 1.0}], kernel)]
    scores = vote_scores(train, [tuned, *[[p] for p in fixed]], folds, x, fold).ravel()
    best, each = int(scores.argmax()), len(tubes)
    vote = Vote([(p.mapping, p.model(s)) for p, s in [(tuned[best // each], best % each), *[(p, 0) for p in fixed]]])
    return vote, [kernel_params(kind, tube) for kind in kinds for tube in tubes], scores


# ---- stacking ----------------------------------------------------------------

def number_folds(rows: DataFrame, folds: int, tune: int) -> DataFrame:
    """Contiguous ``fold`` and ``tune`` numbers for training rows, 0 for test rows."""
    train = key_rank(rows.filter(F.col("split") == "train").select("sample_id"), "sample_id").select(
        "sample_id", block_of(F.col("rank"), F.col("n"), folds).alias("fold"), block_of(F.col("rank"), F.col("n"), tune).alias("tune"))
    keep = [c for c in rows.columns if c not in ("fold", "tune")]
    return rows.select(*keep).join(train, "sample_id", "left").withColumn("fold", F.coalesce("fold", F.lit(0))).withColumn(
        "tune", F.coalesce("tune", F.lit(0)))


def level0(rows: DataFrame, folds: int = 10, tune: int = 3, grid: dict | None = LEVEL0_GRID, rank: int = 30,
           fixed: svm.Tube = svm.Tube(), passes: int = 15) -> DataFrame:
    """Out-of-fold predictions of one profile: (sample_id, split, y, prediction).

    The kernel and C are tuned on all training rows, then refitted per fold; test
    rows get the mean over the fold models.  Without a grid, a linear tube is used.
    """
    numbered = spread(number_folds(rows.select("sample_id", "split", "y", "x"), folds, tune), "level0")
    train = numbered.filter(F.col("split") == "train")
    mapping, tube = None, fixed
    if grid is not None:
        tuned = tune_tubes(train, grid, range(1, tune + 1), rank=rank, passes=passes)
        mapping, tube = tuned.mapping, tuned.tube
    models = tube_fold_models(train, tube, range(1, folds + 1), mapping, passes=passes)
    return numbered.select("sample_id", "split", "y", models.out_of_fold().alias("prediction"))


def stack_table(predictions: dict[str, DataFrame]) -> DataFrame:
    """Level-1 rows: one prediction per profile, for samples every profile covers."""
    union = None
    for name, frame in predictions.items():
        part = frame.withColumn("profile", F.lit(name))
        union = part if union is None else union.unionByName(part)
    wide = prediction_columns(union, list(predictions), ["split", "y"]).dropna(subset=list(predictions))
    return wide.select("sample_id", "split", "y", F.array(*[F.col(p) for p in predictions]).alias("x"))


def late_integration(profiles: dict[str, DataFrame], folds: int = 10, grid0: dict | None = LEVEL0_GRID, grid1: dict = LEVEL1_GRID,
                     tune0: int = 3, tune1: int = 3, rank: int = 30, passes: int = 15) -> tuple[DataFrame, dict]:
    """Stack per-profile predictions under a tuned second model; scored rows and its settings."""
    table = stored(stack_table({name: level0(rows, folds, tune0, grid0, rank, passes=passes) for name, rows in profiles.items()}), "level1")
    numbered = spread(number_folds(table, folds, tune1), "level1")
    best = tune_tubes(numbered.filter(F.col("split") == "train"), grid1, range(1, tune1 + 1), rank=rank, passes=passes)
    source, column = (numbered, "x") if best.mapping is None else (apply_maps(numbered, [best.mapping], "x", "_g"), "_g")
    return best.whole.transform(source, column).select("sample_id", "split", "y", "prediction"), best.params


def test_error(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("split") == "test").agg(scores.mse(F.col("y"), F.col("prediction")).alias("mse"))
