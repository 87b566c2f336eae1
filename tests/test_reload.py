import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profuse.plans.reload import ProfileReload, ProfileRule, reload_profiles


def tables(spark):
    rng = np.random.default_rng(5)
    labels = [f"P.{i:02d}" for i in range(40)]
    first = pd.DataFrame(rng.normal(size=(40, 5)) * [1, 2, 3, 4, 0], columns=["aa", "ab", "b", "c", "flat"])
    first.insert(0, "X", range(40))
    first.insert(0, "id", labels)
    other = pd.DataFrame(rng.normal(size=(50, 3)), columns=["p", "q", "r.s"])
    other.insert(0, "id", [f"P-{i:02d}" for i in range(50)])
    y = pd.DataFrame({"sample_id": labels, "days": [10.0 ** (i % 7) if i else None for i in range(40)]})
    return first, other, y, {"first": spark.createDataFrame(first), "other": spark.createDataFrame(other)}, spark.createDataFrame(y)


RULES = {"first": ProfileRule(drop_id=True, threshold=0.5), "other": ProfileRule(repair=("-", "."), follows=True, threshold=0.1)}


def test_zscore_alignment_and_components_equal_numpy(spark):
    first, other, y, wide, outcome = tables(spark)
    got = reload_profiles(wide, outcome, ProfileReload("days", "first", RULES, components=2, strict=True)).toPandas()
    assert set(got.sample_id) == {f"P.{i:02d}" for i in range(1, 40)}  # P.00 has no response
    assert (got.groupby("split").sample_id.nunique() == pd.Series({"test": 8, "train": 31})).all()
    a = first[["aa", "ab", "b", "c"]].to_numpy()  # the flat one falls to the variance limit
    b = other[["p", "q", "r.s"]].to_numpy()
    b = (b - b.mean(axis=0)) / b.std(axis=0)
    for name, m in (("first", (a - a.mean(axis=0)) / a.std(axis=0)), ("other", b[:40])):
        centred = m - m.mean(axis=0)
        axes = np.linalg.svd(centred, full_matrices=False)[2][:2].T
        want = centred @ axes
        mine = got[got.profile == name].pivot(index="sample_id", columns="feature", values="value").sort_index().to_numpy()
        for k in range(2):
            assert min(np.abs(mine[:, k] - s * want[1:, k]).max() for s in (1, -1)) < 1e-9
    assert np.allclose(got.y, [int(s[2:]) % 7 for s in got.sample_id])


def test_variance_is_taken_on_aligned_rows(spark):
    # Scaled over all rows; the rows that follow the reference do not vary.
    wide = {"first": spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, v double"),
            "other": spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 9.0, 3.0)], "id string, flat double, w double")}
    y = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("c", 100.0)], "sample_id string, t double")
    rules = {"other": ProfileRule(follows=True, threshold=0.01)}
    got = {tuple(r) for r in reload_profiles(wide, y, ProfileReload("t", "first", rules, scaling="minmax")).select(
        "profile", "sample_id", "feature", "value", "y").collect()}
    assert got == {("first", "a", "v", 0.0, 0.0), ("first", "b", "v", 1.0, 1.0), ("other", "a", "w", 0.0, 0.0), ("other", "b", "w", 0.5, 1.0)}


def test_names_draws_gaps_and_errors(spark):
    _, _, _, wide, outcome = tables(spark)
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    rules = {**RULES, "first": ProfileRule(drop_id=True, select="contains")}
    options = ProfileReload("days", "first", rules, names=names)
    got = reload_profiles(wide, outcome, options)
    assert {r[0] for r in got.filter("profile = 'first'").select("feature").distinct().collect()} == {"aa", "ab", "b", "flat"}
    options = ProfileReload("days", "first", {**rules, "first": ProfileRule(drop_id=True, select="exact")}, names=names, draws=3)
    drawn = reload_profiles(wide, outcome, options).filter("profile = 'first'")
    assert {tuple(r) for r in drawn.groupBy("feature").agg(F.countDistinct("draw"), F.count("*")).collect()} == {("b", 3, 117)}
    repeated = reload_profiles(wide, outcome, ProfileReload("days", "first", options.rules, names=names, draws=3, components=2))
    assert {r[0] for r in repeated.filter("profile = 'first'").select("feature").distinct().collect()} == {"pc1", "pc2"}
    gaps = {"first": spark.createDataFrame([("P.01", None), ("P.02", 2.0), ("P.02", 4.0), ("P.03", float("nan"))], "id string, v double")}
    found = reload_profiles(gaps, outcome, ProfileReload("days", "first", scaling="minmax")).select("sample_id", "value").collect()
    assert [tuple(r) for r in found] == [("P.02", 0.0)]
    assert reload_profiles({"first": gaps["first"].limit(0)}, outcome, ProfileReload("days", "first")).count() == 0
    with pytest.raises(KeyError):
        reload_profiles({"first": wide["first"], "other": wide["other"].filter("id <> 'P-05'")}, outcome, ProfileReload("days", "first", RULES, strict=True))
    with pytest.raises(KeyError):
        reload_profiles(wide, outcome, ProfileReload("days", "third"))
    with pytest.raises(ValueError):
        reload_profiles(wide, outcome, ProfileReload("days", "first", rules))
    with pytest.raises(ValueError):
        reload_profiles(wide, outcome, ProfileReload("days", "first", RULES, scaling="rank"))
