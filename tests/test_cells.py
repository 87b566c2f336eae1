"""Long cells: labels, joins, fills, scalers, ranks, splits and their traps."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from profuse.functions import text
from profuse.operators import align, arrays, labels, quality, rank, reshape, scale, small, split
from profuse.session import scratch_path, shared_dir
from profuse.sources import delimited

CELL = "profile string, sample_id string, feature string, value double"


def cells(spark, rows, profile="p"):
    return spark.createDataFrame([(profile, s, f, v) for s, f, v in rows], CELL)


def as_dict(df):
    return {(r["sample_id"], r["feature"]): r["value"] for r in df.collect()}


def test_constant_feature_scales_to_zero(spark):
    df = cells(spark, [("a", "f", 3.0), ("b", "f", 3.0), ("a", "g", 1.0), ("b", "g", 5.0)])
    assert as_dict(scale.zscore(df)) == {("a", "f"): 0.0, ("b", "f"): 0.0, ("a", "g"): -1.0, ("b", "g"): 1.0}
    assert as_dict(scale.minmax(df))[("a", "f")] == 0.0
    assert as_dict(scale.minmax(df, -1.0, 1.0))[("b", "g")] == 1.0


def test_scaled_moments(spark):
    rng = np.random.default_rng(0)
    df = cells(spark, [(f"s{i}", f"f{j}", float(v)) for (i, j), v in np.ndenumerate(rng.gamma(2.0, 3.0, (50, 4)))])
    stats = scale.feature_stats(scale.zscore(df)).collect()
    assert all(abs(r["mean"]) < 1e-12 and abs(r["var_pop"] - 1) < 1e-12 for r in stats)
    assert all(r["lo"] == 0.0 and r["hi"] == 1.0 for r in scale.feature_stats(scale.minmax(df)).collect())


def test_variance_filters_differ(spark):
    """Sample variance keeps equality, population variance does not."""
    df = cells(spark, [("a", "f", 0.0), ("b", "f", 2.0), ("a", "g", 0.0), ("b", "g", 1.0)])
    kept = lambda d: {r["feature"] for r in d.select("feature").distinct().collect()}
    assert kept(quality.keep_var_samp(df, 2.0)) == {"f"}
    assert kept(quality.keep_var_pop(df, 1.0)) == set()
    assert kept(quality.keep_var_samp(df, 2.0, "^f")) == {"f", "g"}


def test_empty_feature_and_audit(spark):
    df = cells(spark, [("a", "f", 1.0), ("b", "f", None), ("a", "g", None), ("b", "g", None)])
    assert {r["feature"] for r in quality.drop_empty_features(df).collect()} == {"f"}
    row = quality.audit_missing(df).first()
    assert (row["n_missing"], row["any_missing"]) == (3, True)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double").select(text.nan_to_null(F.col("v")).alias("v"))
    assert sorted([r[0] for r in df.collect()], key=lambda v: v is None) == [1.0, None]


@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_fill_along_many_runs(spark, method):
    """Enough samples for several runs, with gaps that span runs."""
    rng = np.random.default_rng(1)
    n = 6_000
    ids = [f"s{i:06d}" for i in range(n)]
    values = np.where(rng.random(n) < 0.02, rng.normal(size=n), np.nan)
    df = spark.createDataFrame(pd.DataFrame({"profile": "p", "sample_id": ids, "feature": "f", "value": values}), CELL)
    df = df.withColumn("value", text.nan_to_null(F.col("value"))).repartition(8)
    assert len(rank.split_points(df, "sample_id")) == rank.KEY_BUCKETS - 1
    got = quality.fill_along(df, method).toPandas().sort_values("sample_id")["value"].to_numpy()
    want = getattr(pd.Series(values), method)().to_numpy()
    np.testing.assert_array_equal(got, want)


def test_key_rank_with_split_points(spark):
    n = 10_000
    df = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("sample_id"))
    got = rank.key_rank(df, "sample_id").toPandas().sort_values("rank")
    assert got["sample_id"].tolist() == sorted(f"k{i}" for i in range(n))
    assert got["rank"].tolist() == list(range(1, n + 1)) and set(got["n"]) == {n}


@pytest.mark.parametrize("n,k", [(10, 3), (12, 4), (7, 7), (3, 5), (101, 10)])
def test_blocks_are_contiguous(spark, n, k):
    df = spark.range(1, n + 1).select(rank.block_of(F.col("id"), F.lit(n), k).alias("b"), "id")
    got = [r["b"] for r in df.orderBy("id").collect()]
    want = [i + 1 for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert got == want


def test_splits_partition_samples(spark):
    ids = spark.range(103).select(F.concat(F.lit("s"), "id").alias("sample_id"))
    parts = split.train_test(ids, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 82, "test": 21}
    parts = split.train_test_ceil(ids, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 82, "test": 21}
    sizes = sorted(r["count"] for r in split.shuffled_folds(ids, 4, 1).groupBy("fold").count().collect())
    assert sizes == [25, 26, 26, 26]
    again = split.shuffled_folds(ids.repartition(1), 4, 1)
    assert again.exceptAll(split.shuffled_folds(ids.repartition(7), 4, 1)).count() == 0


def test_hash_sample_is_exact(spark):
    ids = spark.range(5_000).select(F.col("id").cast("string").alias("sample_id"))
    assert split.hash_sample(ids, "sample_id", 100, 5_000, 0).count() == 100


def test_duplicates_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, pos int, v double")
    pick = lambda keep: {r["k"]: r["v"] for r in align.drop_duplicates(df, ["k"], "pos", keep).collect()}
    assert pick("first") == {"a": 10.0, "b": 5.0} and pick("last") == {"a": 30.0, "b": 5.0}


def test_substring_match_keeps_repeats(spark):
    names = ["B1", "1", "B1", "zz", "1B1"]
    features = ["B1", "B10", "xB1B1", "C2"]
    f = spark.createDataFrame([(x,) for x in features], "feature string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = sorted((r["name"], r["feature"]) for r in align.match_substrings(f, n).collect())
    assert got == sorted((a, b) for a in names for b in features if a in b)
    assert align.match_substrings(f, n, distinct=True).count() == len(set(got))


def test_missing_labels(spark):
    df = cells(spark, [("a", "f", 1.0)])
    with pytest.raises(KeyError):
        labels.project_features(df, ["f", "nope"], strict=True)
    other = spark.createDataFrame([("a",), ("z",)], "sample_id string")
    with pytest.raises(KeyError):
        align.align_to(other, df, strict=True)
    assert align.align_to(other, df).filter("value IS NULL").count() == 1


def test_every_sample_gets_a_vector_at_any_width(spark):
    df = cells(spark, [("a", "f", 1.0), ("a", "h", 3.0), ("b", "g", 2.0), ("b", "g", 1.5), ("c", "f", None), ("d", "other", 1.0), ("e", "f", float("nan"))])
    for names in (["f", "g", "h"], ["f", "g", "h"] + [f"z{k}" for k in range(150)]):
        pad = len(names) - 3
        got = {r["sample_id"]: r["x"] for r in reshape.to_vectors(df, names).collect()}
        assert got == {"a": [1.0, None, 3.0] + [None] * pad, "b": [None, 2.0] + [None] * (pad + 1), **{k: [None] * (pad + 3) for k in "cde"}}
        filled = {r["sample_id"]: r["x"] for r in reshape.to_vectors(df, names, 0.0).collect()}
        assert filled == {k: [v or 0.0 for v in x] for k, x in got.items()}


def test_unfitted_features_stay_as_gaps(spark):
    fitted = scale.fit_zscore(cells(spark, [("a", "f", 1.0), ("b", "f", 3.0)]))
    got = {(r["sample_id"], r["feature"]): r["value"] for r in fitted.transform(cells(spark, [("c", "f", 3.0), ("c", "new", 1.0)])).collect()}
    assert got == {("c", "f"): 1.0, ("c", "new"): None}


def test_audit_counts_repeated_cells_once(spark):
    df = cells(spark, [("a", "f", 1.0), ("a", "f", 2.0), ("b", "g", 1.0)])
    assert quality.audit_missing(df).first()["n_missing"] == 2


def test_strict_and_lenient_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("Beta_Value",)], "t string")
    assert [r[0] for r in df.select(text.to_number(F.col("t"))).collect()] == [1.5, None]
    with pytest.raises(Exception):
        df.select(text.to_number(F.col("t"), strict=True)).collect()


def test_small_join_beyond_the_limit(spark):
    big = cells(spark, [(f"s{i}", f"f{i % 50}", float(i)) for i in range(200)])
    table = big.groupBy("feature").agg(F.avg("value").alias("m"))
    settled = small.settle(table, limit=10)
    assert "Broadcast" not in settled._jdf.queryExecution().analyzed().toString()
    assert big.join(settled, "feature").count() == 200 and big.join(small.settle(table), "feature").count() == 200


def test_feature_row_file(spark):
    path = scratch_path(spark, "t")
    lines = ["gene\tS1\tS2", "Composite\tBeta_Value\tBeta_Value", "g1\t0.1\t", "g2\t0.3\t0.4"]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    got = as_dict(delimited.read_feature_rows(spark, path, "gene", junk="Beta_Value"))
    assert got == {("S1", "g1"): 0.1, ("S2", "g1"): None, ("S1", "g2"): 0.3, ("S2", "g2"): 0.4}


def test_shared_folder_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_rows_without_a_position_come_after_the_others(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", None, 4.0)], "k string, at int, v double")
    for keep, want in (("first", {"a": 2.0, "b": 4.0}), ("last", {"a": 3.0, "b": 4.0})):
        assert {r["k"]: r["v"] for r in align.drop_duplicates(rows, ["k"], "at", keep).collect()} == want


def test_null_vectors_are_refused():
    with pytest.raises(ValueError):
        arrays.matrix_of(pa.array([[1.0], None], pa.list_(pa.float64())))
