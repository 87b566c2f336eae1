"""Late integration over stand-in profiles, with optional reduction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from profuse.functions import scores
from profuse.operators import ensemble, gram, reduce, reshape, split
from profuse.operators.tuning import parameter_grid
from profuse.plans.prepare import EARLY, outcome, scaled_cells
from profuse.session import stored


def profile_rows(spark: SparkSession, sf: str, names: Sequence[str] = EARLY, seed: int = 10) -> dict[str, DataFrame]:
    """(sample_id, x, y, split) per profile; the split is shared by all of them."""
    y = outcome(spark, sf)
    parts = stored(y.join(split.train_test(y.select("sample_id"), seed), "sample_id"), "outcome")
    out = {}
    for name in names:
        cells = scaled_cells(spark, sf, (name,))
        vectors = reshape.to_vectors(cells, reshape.feature_names(cells), 0.0)
        out[name] = stored(vectors.join(parts, "sample_id"), "profile")
    return out


def reductions(train: DataFrame, method: str, settings: Sequence[dict], rounds: int = 10) -> list:
    """One fitted reduction per setting; all factorisations advance in the same scans."""
    if method == "nmf":
        return reduce.fit_nmf_grid(train, [(s["n_components"], s.get("alpha", 0.0), s.get("l1_ratio", 0.0)) for s in settings], rounds)
    width = gram.width_of(train)
    wide = max(s["n_components"] for s in settings)
    if wide > width:
        raise ValueError(f"a profile has {width} features, fewer than {wide} components")
    # Fewer components of a solver are the first of its larger fit.
    largest = {solver: reduce.fit_pca(train, wide, svd_solver=solver) for solver in {s.get("svd_solver", "full") for s in settings}}
    return [largest[s.get("svd_solver", "full")].first(s["n_components"]) for s in settings]


def reduced_late_integration(profiles: dict[str, DataFrame], method: str, space: dict, **options) -> list[tuple[dict, float]]:
    """Late integration for every reduction setting; (setting, test error) rows.

    The reduction is fitted on training rows and applied to all rows. Settings
    that give the same factors (penalties of weight zero) are integrated once.
    """
    settings = parameter_grid(space)
    fits = {name: reductions(rows.filter(F.col("split") == "train"), method, settings, options.get("rounds", 10)) for name, rows in profiles.items()}
    kept = {k: v for k, v in options.items() if k != "rounds"}
    done: dict[tuple, float] = {}
    out = []
    for i, setting in enumerate(settings):
        alpha, ratio = setting.get("alpha", 0.0), setting.get("l1_ratio", 0.0)
        key = (setting["n_components"], alpha * ratio, alpha * (1.0 - ratio), setting.get("svd_solver"))
        if key not in done:
            reduced = {name: stored(fits[name][i].transform(rows), "reduced") for name, rows in profiles.items()}
            scored, _ = ensemble.late_integration(reduced, **kept)
            test = scored.filter(F.col("split") == "test")
            done[key] = float(test.agg(scores.mse(F.col("y"), F.col("prediction"))).first()[0])
        out.append((setting, done[key]))
    return out


# Reduction grids of the late integration.
NMF_SPACE = {"n_components": [2, 4, 6, 8], "l1_ratio": [0.0001, 0.001, 0.01, 0.05]}
PCA_SPACE = {"n_components": [2, 4, 6, 8], "svd_solver": ["full", "randomized", "arpack"]}
