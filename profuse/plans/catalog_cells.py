"""Queries for sources, labels, joins, quality, scaling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from profuse.functions import text
from profuse.operators import align, labels, quality, reshape, scale, split
from profuse.plans.registry import ALL, md5_hash, query, r, rounded
from profuse.session import scratch_path, stored
from profuse.sources import delimited, packed, standin

# Fixed values of the examples: whitelist, substring list and scan settings.
WHITELIST = ["Brand#1", "Brand#7", "Brand#13", "Brand#21", "Brand#25"]
SUBSTRINGS = ["Brand#1", "Brand#2", "Brand#1"]
WHITELIST_SQL = "(VALUES " + ", ".join(f"('{n}')" for n in WHITELIST) + ") AS w(name)"
SUBSTRINGS_SQL = "(VALUES " + ", ".join(f"('{n}')" for n in SUBSTRINGS) + ") AS w(name)"
CELLS_OUT = f"SELECT profile, sample_id, feature, {r('value')} AS value"


def names_frame(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def cells_out(cells: DataFrame) -> DataFrame:
    return cells.select("profile", "sample_id", "feature", rounded("value").alias("value"))


# ---- sources and sinks -------------------------------------------------------

@query("s1_read_matrix", "SELECT sample_id, feature, value FROM mix", ["mix"])
def s1(spark, sf):
    cells = standin.mix(spark, sf)
    wide = reshape.to_vectors(cells, reshape.feature_names(cells))
    names = reshape.feature_names(cells)
    path = scratch_path(spark, "matrix")
    delimited.write_wide(wide.select("sample_id", *[F.col("x")[i].alias(n) for i, n in enumerate(names)]), path, "\t")
    return delimited.read_matrix(spark, path, "sample_id").filter(F.col("value").isNotNull())


@query("s2_read_feature_rows", "SELECT feature AS sample_id, sample_id AS feature, value FROM share", ["share"])
def s2(spark, sf):
    cells = standin.share(spark, sf)
    names = reshape.feature_names(cells)
    wide = reshape.to_vectors(cells, names).select(
        "sample_id", F.transform("x", lambda v: F.coalesce(v.cast("string"), F.lit(""))).alias("t"))
    rows = wide.select(F.concat_ws("\t", F.array("sample_id"), "t").alias("value"))
    header = spark.range(1).select(F.lit("\t".join(["feature", *names])).alias("value"))
    junk = spark.range(1).select(F.lit("\t".join(["junk", *["Beta_Value"] * len(names)])).alias("value"))
    path = scratch_path(spark, "rows")
    header.unionByName(junk).coalesce(1).unionByName(rows).write.text(path)
    return delimited.read_feature_rows(spark, path, "feature", "\t", junk="Beta_Value").filter(F.col("value").isNotNull())


@query("s3_name_list", f"SELECT profile, sample_id, feature, value FROM spend WHERE feature IN (SELECT name FROM {WHITELIST_SQL})", ["spend"])
def s3(spark, sf):
    path = scratch_path(spark, "names")
    names_frame(spark, WHITELIST).withColumnRenamed("name", "GeneSymbol").coalesce(1).write.option("header", True).csv(path)
    names = delimited.read_names(spark, path, "GeneSymbol").select(F.col("name").alias("feature"))
    return align.restrict_features(standin.spend(spark, sf), names)


@query("s4_unpack_bundle", f"""
SELECT vec_id::varchar AS sample_id, 'dim_' || lpad((pos - 1)::varchar, 4, '0') AS feature, {r('v::double')} AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)""")
def s4(spark, sf):
    bundle = standin.bundle(spark, sf)
    return packed.unpack(bundle, packed.symbol_table(bundle)).withColumn("value", rounded("value"))


SPLIT_SQL = f"""hashed AS (SELECT sample_id, row_number() OVER (ORDER BY {md5_hash(7, 'sample_id')}, sample_id) AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT sample_id FROM {{source}})),
parts AS (SELECT sample_id, CASE WHEN k <= floor(0.8::double * n) THEN 'train' ELSE 'test' END AS split FROM hashed)"""


@query("s5_save_partitions",
       ", " + SPLIT_SQL.format(source="cells") + f"SELECT profile, split, count(*)::bigint AS n_rows, {r('sum(value)', 2)} AS total "
       "FROM cells JOIN parts USING (sample_id) GROUP BY profile, split", list(ALL))
def s5(spark, sf):
    cells = standin.profiles(spark, sf)
    parts = split.train_test(cells.select("sample_id").distinct(), 7)
    path = scratch_path(spark, "parts")
    delimited.write_partitions(split.apply_split(cells, parts), path)
    return delimited.read_partitions(spark, path).groupBy("profile", "split").agg(
        F.count("*").alias("n_rows"), rounded(F.sum("value"), 2).alias("total"))


@query("s6_reread_partitions",
       ", " + SPLIT_SQL.format(source="activity") + f"SELECT profile, split, sample_id, feature, {r('value')} AS value "
       "FROM activity JOIN parts USING (sample_id)", ["activity"])
def s6(spark, sf):
    cells = standin.activity(spark, sf)
    parts = split.train_test(cells.select("sample_id").distinct(), 7)
    path = scratch_path(spark, "csv")
    delimited.write_partitions(split.apply_split(cells, parts), path, "csv")
    return delimited.read_partitions(spark, path, "csv").select(
        "profile", "split", "sample_id", "feature", rounded("value").alias("value"))


@query("s7_name_line", "SELECT string_agg(name, ', ' ORDER BY name) AS value FROM (SELECT DISTINCT replace(feature, 'Brand#', '') AS name FROM spend)", ["spend"])
def s7(spark, sf):
    path = scratch_path(spark, "line")
    delimited.write_name_line(standin.spend(spark, sf).select("feature"), path, "Brand#")
    return spark.read.text(path)


# ---- labels, filters, string rules -------------------------------------------

@query("p1_strip_blanks", "SELECT DISTINCT profile, trim('  ' || feature || ' ') AS feature FROM share", ["share"])
def p1(spark, sf):
    padded = standin.share(spark, sf).withColumn("feature", F.concat(F.lit("  "), "feature", F.lit(" ")))
    return labels.relabel(padded, "feature", text.strip_blanks).select("profile", "feature").distinct()


@query("p2_prefix_names", "SELECT DISTINCT 'met_' || replace(feature, 'Brand#', '') AS feature FROM spend", ["spend"])
def p2(spark, sf):
    return labels.relabel(standin.spend(spark, sf), "feature", text.prefix_and_drop, "met_", "Brand#").select("feature").distinct()


@query("p3_truncate_labels", "SELECT c_custkey, substr(c_name || '-01A-11R', 1, 15) AS label FROM customer")
def p3(spark, sf):
    return standin.table(spark, sf, "customer").select(
        "c_custkey", text.truncate_label(F.concat("c_name", F.lit("-01A-11R"))).alias("label"))


@query("p4_replace_characters", "SELECT c_custkey, replace(replace(c_name || '|' || c_mktsegment, '|', '_-_'), '-', '.') AS label FROM customer")
def p4(spark, sf):
    label = F.concat("c_name", F.lit("|"), "c_mktsegment")
    return standin.table(spark, sf, "customer").select(
        "c_custkey", text.replace_all(label, [("|", "_-_"), ("-", ".")]).alias("label"))


@query("p5_append_suffix", "SELECT c_custkey, c_name || '-01' AS label FROM customer")
def p5(spark, sf):
    return standin.table(spark, sf, "customer").select("c_custkey", text.add_suffix(F.col("c_name")).alias("label"))


# Feature prefix of each stand-in profile.
PREFIXES = {"spend": "spend_", "mix": "mix_"}


@query("p6_candidate_names", f"""
SELECT profile, prefix || p_brand AS feature FROM (SELECT DISTINCT p_brand FROM part)
CROSS JOIN (VALUES ('spend', 'spend_'), ('mix', 'mix_')) AS q(profile, prefix)""")
def p6(spark, sf):
    names = standin.table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return labels.candidate_names(names, list(PREFIXES.items()))


@query("p7_text_to_number", "SELECT event_id, try_cast(CASE WHEN event_type = 'click' THEN 'Beta_Value' ELSE value::varchar END AS double) AS value FROM events")
def p7(spark, sf):
    raw = F.when(F.col("event_type") == "click", F.lit("Beta_Value")).otherwise(F.col("value").cast("string"))
    return standin.table(spark, sf, "events").select("event_id", text.to_number(raw).alias("value"))


# Sample-type code that plays each market segment.
TYPE_CODES = {"AUTOMOBILE": "01", "BUILDING": "02", "FURNITURE": "10", "HOUSEHOLD": "11", "MACHINERY": "20"}
CODE_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_CODES.items()) + " ELSE '06' END"
BARCODES_SQL = f"(SELECT c_custkey, c_acctbal, c_name || '-' || {CODE_SQL} AS sample_id, CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS available FROM customer)"


def barcodes(spark, sf):
    code = F.lit("06")
    for segment, value in TYPE_CODES.items():
        code = F.when(F.col("c_mktsegment") == segment, F.lit(value)).otherwise(code)
    return standin.table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.concat("c_name", F.lit("-"), code).alias("sample_id"),
        F.when(F.col("c_acctbal") > 0, "Yes").otherwise("No").alias("available"))


@query("p8_keep_available", f"SELECT c_custkey, sample_id FROM {BARCODES_SQL} WHERE available = 'Yes' AND NOT regexp_matches(sample_id, '-02$')")
def p8(spark, sf):
    return labels.keep_available(barcodes(spark, sf), "available").select("c_custkey", "sample_id")


@query("p9_keep_normal_tissue", f"SELECT c_custkey, sample_id FROM {BARCODES_SQL} WHERE regexp_matches(sample_id, '-1[0-9]$')")
def p9(spark, sf):
    return labels.keep_matching(barcodes(spark, sf), "sample_id", "-1[0-9]$").select("c_custkey", "sample_id")


@query("p10_keep_strand", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def p10(spark, sf):
    stranded = standin.table(spark, sf, "customer").withColumn("Strand", F.when(F.col("c_acctbal") >= 0, "+").otherwise("-"))
    return labels.keep_strand(labels.keep_strand(stranded).drop("Strand")).select("c_custkey", "c_acctbal")


@query("p11_platform_features", CELLS_OUT + " FROM cells WHERE regexp_matches(feature, '^Brand#2')", list(ALL))
def p11(spark, sf):
    return cells_out(labels.keep_matching(standin.profiles(spark, sf), "feature", "^Brand#2"))


@query("p12_platform_symbols", "SELECT DISTINCT replace(trim(feature), 'Brand#', '') AS symbol FROM cells WHERE contains(feature, 'Brand#')", list(ALL))
def p12(spark, sf):
    return labels.platform_symbols(standin.profiles(spark, sf), "Brand#")


@query("p13_project_features", CELLS_OUT + f" FROM spend WHERE feature IN (SELECT name FROM {WHITELIST_SQL})", ["spend"])
def p13(spark, sf):
    return cells_out(labels.project_features(standin.spend(spark, sf), WHITELIST, strict=True))


@query("p14_drop_id_column", "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def p14(spark, sf):
    return labels.drop_leading_column(standin.table(spark, sf, "customer"))


@query("p15_choose_target", "SELECT sample_id, balance AS y FROM response", ["response"])
def p15(spark, sf):
    return labels.target(standin.response(spark, sf), "balance")


GAPPY = "SELECT profile, sample_id, feature, CASE WHEN feature IN ('Brand#3', 'Brand#4') THEN NULL ELSE value END AS value FROM spend"


def gappy(spark, sf):
    return standin.spend(spark, sf).withColumn("value", F.when(~F.col("feature").isin("Brand#3", "Brand#4"), F.col("value")))


@query("p16_drop_empty_features", f""", gappy AS ({GAPPY})
SELECT profile, feature, count(*)::bigint AS n_rows FROM gappy
WHERE feature IN (SELECT feature FROM gappy GROUP BY feature HAVING count(value) > 0) GROUP BY profile, feature""", ["spend"])
def p16(spark, sf):
    return quality.drop_empty_features(gappy(spark, sf)).groupBy("profile", "feature").agg(F.count("*").alias("n_rows"))


@query("p17_shape_report", "SELECT profile, count(DISTINCT sample_id)::bigint AS n_samples, count(DISTINCT feature)::bigint AS n_features FROM cells GROUP BY profile", list(ALL))
def p17(spark, sf):
    return labels.shape_report(standin.profiles(spark, sf))


@query("p18_reuse_profile", """, s AS (SELECT feature, var_pop(log2(value + 1)) AS v FROM spend GROUP BY feature)
SELECT t AS threshold, count(*)::bigint AS n_features FROM s JOIN (VALUES (0.0::double), (0.05::double), (2.0::double)) AS q(t) ON v > t GROUP BY t""", ["spend"])
def p18(spark, sf):
    """One stored profile tried under several thresholds."""
    logged = scale.log_scale(standin.spend(spark, sf))
    path = scratch_path(spark, "trial")
    logged.write.parquet(path)
    stored = spark.read.parquet(path)
    trials = [
        quality.keep_var_pop(stored, t).select("feature").distinct()
        .groupBy(F.lit(t).alias("threshold")).agg(F.count("*").alias("n_features")) for t in (0.0, 0.05, 2.0)
    ]
    return trials[0].unionByName(trials[1]).unionByName(trials[2])


# ---- reshape -----------------------------------------------------------------

@query("r1_transpose", f"SELECT profile, feature AS sample_id, sample_id AS feature, {r('value')} AS value FROM mix", ["mix"])
def r1(spark, sf):
    return cells_out(reshape.transpose(standin.mix(spark, sf)))


@query("r2_stack_response", CELLS_OUT + " FROM (SELECT * FROM share UNION ALL SELECT 'share', sample_id, 'balance', balance FROM response)", ["share", "response"])
def r2(spark, sf):
    return cells_out(reshape.stack_response(standin.share(spark, sf), standin.response(spark, sf), "balance", "share"))


MIX_NAMES_SQL = "names AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM {source}))"


@query("r3_dense_vectors", ", " + MIX_NAMES_SQL.format(source="mix") + """
SELECT s.sample_id, array_to_string(list(coalesce(m.value, 0.0::double)::bigint ORDER BY idx), ',') AS x
FROM (SELECT DISTINCT sample_id FROM mix) s CROSS JOIN names LEFT JOIN mix m ON m.sample_id = s.sample_id AND m.feature = names.feature
GROUP BY s.sample_id""", ["mix"])
def r3(spark, sf):
    cells = standin.mix(spark, sf)
    dense = reshape.to_vectors(cells, reshape.feature_names(cells), fill=0.0)
    return dense.select("sample_id", F.array_join(F.transform("x", lambda v: v.cast("bigint").cast("string")), ",").alias("x"))


WIDE_SQL = """
  SELECT o_custkey AS sample_id, p_brand || '/' || o_orderpriority AS feature,
         sum(l_quantity::bigint) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def wide(spark, sf):
    """Quantity per customer and brand by order priority (over 96 features); every seventh customer's values are unknown."""
    joined = standin.table(spark, sf, "lineitem").join(standin.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        standin.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("o_custkey").alias("sample_id"), F.concat_ws("/", "p_brand", "o_orderpriority").alias("feature")).agg(
        F.when(F.col("o_custkey") % 7 != 0, F.sum("l_quantity").cast("double")).alias("value"))


@query("r3_wide_vectors", f"""
WITH wide AS ({WIDE_SQL}), width AS (SELECT count(DISTINCT feature)::bigint AS n FROM wide)
SELECT sample_id, n AS width, count(*) FILTER (sample_id % 7 <> 0)::bigint AS n_values,
       coalesce(sum(value) FILTER (sample_id % 7 <> 0), 0)::bigint AS total
FROM wide, width GROUP BY sample_id, n""")
def r3_wide(spark, sf):
    cells = stored(wide(spark, sf), "cells")
    vectors = reshape.to_vectors(cells, reshape.feature_names(cells))
    present = F.filter("x", lambda v: v.isNotNull())
    return vectors.select(
        "sample_id", F.size("x").cast("bigint").alias("width"), F.size(present).cast("bigint").alias("n_values"),
        F.aggregate(present, F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("total"))


@query("m6_unseen_feature", f"""
WITH wide AS ({WIDE_SQL}), st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM wide WHERE sample_id % 7 <> 0 AND feature NOT LIKE '%/1-URGENT' GROUP BY feature)
SELECT sample_id, feature, CASE WHEN sample_id % 7 <> 0 THEN {r('(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} END AS value
FROM wide LEFT JOIN st USING (feature)""")
def m6_unseen(spark, sf):
    cells = stored(wide(spark, sf).withColumn("profile", F.lit("wide")), "cells")
    scaler = scale.fit_zscore(cells.filter(~F.col("feature").endswith("/1-URGENT")))
    return scaler.transform(cells).select("sample_id", "feature", rounded("value").alias("value"))


@query("r4_named_cells", "SELECT sample_id, feature, value FROM mix", ["mix"])
def r4(spark, sf):
    cells = standin.mix(spark, sf)
    names = reshape.feature_names(cells)
    return reshape.to_cells(reshape.to_vectors(cells, names), names).filter(F.col("value").isNotNull())


@query("r5_renumber_rows", "SELECT (row_number() OVER (ORDER BY sample_id) - 1)::bigint AS row, balance FROM response", ["response"])
def r5(spark, sf):
    return reshape.renumber(standin.response(spark, sf)).select("row", "balance")


# ---- joins and set operations ------------------------------------------------

SHARED_SQL = """shared AS (SELECT sample_id FROM (SELECT DISTINCT sample_id, profile FROM cells
  UNION SELECT sample_id, 'response' FROM response) GROUP BY sample_id HAVING count(*) = 5)"""


@query("j1_shared_samples", f", {SHARED_SQL} SELECT sample_id FROM shared", [*ALL, "response"])
def j1(spark, sf):
    return align.shared_samples(standin.profiles(spark, sf), standin.response(spark, sf), 5)


@query("j2_restrict_samples", f", {SHARED_SQL} {CELLS_OUT} FROM cells WHERE sample_id IN (SELECT sample_id FROM shared)", [*ALL, "response"])
def j2(spark, sf):
    cells = stored(standin.profiles(spark, sf), "cells")
    return cells_out(align.restrict(cells, align.shared_samples(cells, standin.response(spark, sf), 5)))


@query("j3_align_profile", f"SELECT r.sample_id, a.feature, {r('a.value')} AS value FROM response r LEFT JOIN activity a ON r.sample_id = a.sample_id", ["activity", "response"])
def j3(spark, sf):
    aligned = align.align_to(standin.response(spark, sf), standin.activity(spark, sf))
    return aligned.select("sample_id", "feature", rounded("value").alias("value"))


@query("j4_feature_intersection", f"SELECT profile, feature, count(*)::bigint AS n_rows FROM spend WHERE feature IN (SELECT name FROM {WHITELIST_SQL}) GROUP BY profile, feature", ["spend"])
def j4(spark, sf):
    wanted = labels.candidate_names(names_frame(spark, [*WHITELIST, "Brand#99"]), [("spend", ""), ("share", "")])
    kept = align.restrict_features(standin.profiles(spark, sf, ("spend", "share")), wanted)
    return kept.groupBy("profile", "feature").agg(F.count("*").alias("n_rows"))


@query("j5_substring_match", f"SELECT name, feature, count(*)::bigint AS n_matches FROM (SELECT DISTINCT feature FROM spend) JOIN {SUBSTRINGS_SQL} ON contains(feature, name) GROUP BY name, feature", ["spend"])
def j5(spark, sf):
    features = standin.spend(spark, sf).select("feature").distinct()
    matched = align.match_substrings(features, names_frame(spark, SUBSTRINGS))
    return matched.groupBy("name", "feature").agg(F.count("*").alias("n_matches"))


def _slot(source: str, name: str) -> str:
    return f"max(CASE WHEN profile = '{source}' AND feature = '{name}' THEN value END)"


@query("j6_early_fusion", f"""
SELECT sample_id, {r(_slot('share', '1-URGENT'))} AS urgent, {r(_slot('share', '5-LOW'))} AS low,
       {r(_slot('activity', 'click'))} AS click, {r(_slot('activity', 'purchase'))} AS purchase
FROM (SELECT * FROM share UNION ALL SELECT * FROM activity) GROUP BY sample_id""", ["share", "activity"])
def j6(spark, sf):
    share, activity = standin.share(spark, sf), standin.activity(spark, sf)
    names = [reshape.feature_names(share), reshape.feature_names(activity)]
    fused = align.fuse_wide([reshape.to_vectors(share, names[0]), reshape.to_vectors(activity, names[1])], [len(n) for n in names])
    order = [*names[0], *names[1]]
    pick = lambda n: rounded(F.col("x")[order.index(n)])
    return fused.select("sample_id", pick("1-URGENT").alias("urgent"), pick("5-LOW").alias("low"),
                        pick("click").alias("click"), pick("purchase").alias("purchase"))


@query("j7_attach_response", f"SELECT sample_id, feature, {r('value')} AS value, balance FROM mix JOIN response USING (sample_id)", ["mix", "response"])
def j7(spark, sf):
    joined = align.attach_response(standin.mix(spark, sf), standin.response(spark, sf))
    return joined.select("sample_id", "feature", rounded("value").alias("value"), "balance")


@query("j8_complement", ", " + SPLIT_SQL.format(source="share") + f"SELECT sample_id, feature, {r('value')} AS value FROM share WHERE sample_id NOT IN (SELECT sample_id FROM parts WHERE split = 'train')", ["share"])
def j8(spark, sf):
    cells = stored(standin.share(spark, sf), "cells")
    train = split.train_test(cells.select("sample_id").distinct(), 7).filter(F.col("split") == "train")
    return align.exclude(cells, train).select("sample_id", "feature", rounded("value").alias("value"))


@query("j9_prediction_columns", f"""
SELECT sample_id, {r("max(v) FILTER (profile = 'spend')")} AS spend, {r("max(v) FILTER (profile = 'mix')")} AS mix, {r("max(v) FILTER (profile = 'share')")} AS share
FROM (SELECT profile, sample_id, max(value) AS v FROM cells WHERE profile <> 'activity' GROUP BY profile, sample_id) GROUP BY sample_id""", list(ALL))
def j9(spark, sf):
    kept = ("spend", "mix", "share")
    top = standin.profiles(spark, sf, kept).groupBy("profile", "sample_id").agg(F.max("value").alias("prediction"))
    return align.prediction_columns(top, kept).select("sample_id", *[rounded(c).alias(c) for c in kept])


@query("j10_drop_duplicates", """
SELECT o_custkey, max(o_totalprice) FILTER (lo = 1) AS first_price, max(o_totalprice) FILTER (hi = 1) AS last_price FROM (
  SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lo,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS hi FROM orders) GROUP BY o_custkey""")
def j10(spark, sf):
    orders = standin.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    first = align.drop_duplicates(orders, ["o_custkey"], "o_orderkey", "first").withColumnRenamed("o_totalprice", "first_price")
    last = align.drop_duplicates(orders, ["o_custkey"], "o_orderkey", "last").withColumnRenamed("o_totalprice", "last_price")
    return first.select("o_custkey", "first_price").join(last.select("o_custkey", "last_price"), "o_custkey")


# ---- aggregation and quality -------------------------------------------------

@query("a1_audit_missing", """
SELECT profile, n_samples::bigint AS n_samples, n_features::bigint AS n_features,
       (n_samples * n_features - n_present)::bigint AS n_missing, n_samples * n_features > n_present AS any_missing
FROM (SELECT profile, count(DISTINCT sample_id) AS n_samples, count(DISTINCT feature) AS n_features, count(value) AS n_present FROM cells GROUP BY profile)""", list(ALL))
def a1(spark, sf):
    return quality.audit_missing(standin.profiles(spark, sf))


def grid_sql(source: str) -> str:
    return f"""grid AS (SELECT '{source}' AS profile, s.sample_id, f.feature, m.value
  FROM (SELECT DISTINCT sample_id FROM {source}) s CROSS JOIN (SELECT DISTINCT feature FROM {source}) f
  LEFT JOIN {source} m ON m.sample_id = s.sample_id AND m.feature = f.feature)"""


@query("a2_fill_constant", f", {grid_sql('mix')} SELECT profile, sample_id, feature, {r('coalesce(value, -1)')} AS value FROM grid", ["mix"])
def a2(spark, sf):
    return cells_out(quality.fill_constant(reshape.fill_grid(standin.mix(spark, sf)), -1.0))


def _along(name: str, method: str, sql_window: str):
    @query(name, f", {grid_sql('activity')} SELECT profile, sample_id, feature, {r(sql_window)} AS value FROM grid", ["activity"])
    def run(spark, sf):
        return cells_out(quality.fill_along(reshape.fill_grid(standin.activity(spark, sf)), method))
    return run


_along("a3_fill_forward", "ffill", "last_value(value IGNORE NULLS) OVER (PARTITION BY feature ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_along("a3_fill_backward", "bfill", "first_value(value IGNORE NULLS) OVER (PARTITION BY feature ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


@query("a4_sample_variance_filter", """
SELECT profile, feature, count(*)::bigint AS n_rows FROM cells
WHERE NOT regexp_matches(feature, '^Brand#1') OR feature IN (SELECT feature FROM cells GROUP BY profile, feature HAVING var_samp(log2(value + 1)) >= 1.8)
GROUP BY profile, feature""", list(ALL))
def a4(spark, sf):
    logged = scale.log_scale(stored(standin.profiles(spark, sf), "cells"))
    return quality.keep_var_samp(logged, 1.8, "^Brand#1").groupBy("profile", "feature").agg(F.count("*").alias("n_rows"))


@query("a5_sample_row_variance_filter", "SELECT profile, sample_id, count(*)::bigint AS n_rows FROM spend GROUP BY profile, sample_id HAVING var_samp(log2(value + 1)) >= 1.0", ["spend"])
def a5(spark, sf):
    logged = scale.log_scale(stored(standin.spend(spark, sf), "cells"))
    return quality.keep_sample_var(logged, 1.0).groupBy("profile", "sample_id").agg(F.count("*").alias("n_rows"))


@query("a6_population_variance_filter", """
SELECT profile, feature, count(*)::bigint AS n_rows FROM cells GROUP BY profile, feature HAVING var_pop(log2(value + 1)) > 0.02""", list(ALL))
def a6(spark, sf):
    logged = scale.log_scale(stored(standin.profiles(spark, sf), "cells"))
    return quality.keep_var_pop(logged, 0.02).groupBy("profile", "feature").agg(F.count("*").alias("n_rows"))


@query("a7_consensus_filter", f""", {grid_sql('spend')},
filled AS (SELECT profile, sample_id, feature, coalesce(log2(value + 1), 0) AS value FROM grid),
wide AS (SELECT * FROM filled WHERE feature IN (SELECT feature FROM filled GROUP BY feature HAVING var_samp(value) >= 1.0))
SELECT profile, sample_id, count(*)::bigint AS n_rows FROM wide GROUP BY profile, sample_id HAVING var_samp(value) >= 1.0""", ["spend"])
def a7(spark, sf):
    grid = scale.log_scale(reshape.fill_grid(stored(standin.spend(spark, sf), "cells")))
    return quality.consensus(grid, 1.0).groupBy("profile", "sample_id").agg(F.count("*").alias("n_rows"))


@query("a8_fill_mean", f", {grid_sql('activity')} SELECT profile, sample_id, feature, {r('coalesce(value, avg(value) OVER (PARTITION BY feature))')} AS value FROM grid", ["activity"])
def a8(spark, sf):
    return cells_out(quality.fill_mean(reshape.fill_grid(standin.activity(spark, sf))))


# ---- scaling -----------------------------------------------------------------

@query("m1_log_pseudo", f"SELECT sample_id, feature, {r('log2(value + 1)')} AS value FROM spend", ["spend"])
def m1(spark, sf):
    return scale.log_scale(standin.spend(spark, sf)).select("sample_id", "feature", rounded("value").alias("value"))


@query("m2_log10_response", f"SELECT sample_id, {r('log10(max_price)')} AS y FROM response WHERE max_price IS NOT NULL", ["response"])
def m2(spark, sf):
    outcome = labels.target(standin.response(spark, sf), "max_price").filter(F.col("y").isNotNull())
    return outcome.select("sample_id", rounded(scale.log10(F.col("y"))).alias("y"))


@query("m3_zscore", f"""
SELECT profile, sample_id, feature, {r('(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS value FROM (
  SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM cells WINDOW w AS (PARTITION BY profile, feature))""", list(ALL))
def m3(spark, sf):
    return cells_out(scale.zscore(stored(standin.profiles(spark, sf), "cells")))


MINMAX = "(value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE max(value) OVER w - min(value) OVER w END"


@query("m4_minmax", f"SELECT profile, sample_id, feature, {r(MINMAX)} AS value FROM cells WINDOW w AS (PARTITION BY profile, feature)", list(ALL))
def m4(spark, sf):
    return cells_out(scale.minmax(stored(standin.profiles(spark, sf), "cells")))


@query("m5_minmax_range", f"SELECT profile, sample_id, feature, {r('(' + MINMAX + ') * 4.0 - 2.0')} AS value FROM mix WINDOW w AS (PARTITION BY profile, feature)", ["mix"])
def m5(spark, sf):
    return cells_out(scale.minmax(standin.mix(spark, sf), -2.0, 2.0))


@query("m6_fit_on_train", ", " + SPLIT_SQL.format(source="share") + f""", st AS (
  SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM share JOIN parts USING (sample_id) WHERE split = 'train' GROUP BY feature)
SELECT split, sample_id, feature, {r('(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS value
FROM share JOIN parts USING (sample_id) LEFT JOIN st USING (feature)""", ["share"])
def m6(spark, sf):
    cells = stored(standin.share(spark, sf), "cells")
    parted = split.apply_split(cells, split.train_test(cells.select("sample_id").distinct(), 7))
    scaler = scale.fit_zscore(parted.filter(F.col("split") == "train"))
    return scaler.transform(parted).select("split", "sample_id", "feature", rounded("value").alias("value"))


# ---- splits, folds, draws ----------------------------------------------------

@query("k1_train_test", ", " + SPLIT_SQL.format(source="cells") + "SELECT profile, split, count(DISTINCT sample_id)::bigint AS n_samples, count(*)::bigint AS n_cells FROM cells JOIN parts USING (sample_id) GROUP BY profile, split", list(ALL))
def k1(spark, sf):
    cells = stored(standin.profiles(spark, sf), "cells")
    parted = split.apply_split(cells, split.train_test(cells.select("sample_id").distinct(), 7))
    per = parted.groupBy("profile", "split", "sample_id").agg(F.count("*").alias("n"))
    return per.groupBy("profile", "split").agg(F.count("*").alias("n_samples"), F.sum("n").alias("n_cells"))


@query("k2_train_test_ceil", f"""
SELECT sample_id, CASE WHEN k > n - ceil(0.2::double * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT sample_id, row_number() OVER (ORDER BY {md5_hash(10, 'sample_id')}, sample_id) AS k, count(*) OVER () AS n FROM response)""", ["response"])
def k2(spark, sf):
    return split.train_test_ceil(standin.response(spark, sf).select("sample_id"), 10)


@query("k3_shuffled_folds", f"SELECT sample_id, ntile(5) OVER (ORDER BY {md5_hash(10, 'sample_id')}, sample_id)::bigint AS fold FROM response", ["response"])
def k3(spark, sf):
    return split.shuffled_folds(standin.response(spark, sf).select("sample_id"), 5, 10)


@query("k4_contiguous_folds", "SELECT sample_id, ntile(7) OVER (ORDER BY sample_id)::bigint AS fold FROM response", ["response"])
def k4(spark, sf):
    return split.contiguous_folds(standin.response(spark, sf).select("sample_id"), 7)


@query("k6_random_features", f"""
SELECT profile, feature FROM (SELECT profile, feature, row_number() OVER (PARTITION BY profile ORDER BY {md5_hash(3, 'profile', 'feature')}, feature) AS k
  FROM (SELECT DISTINCT profile, feature FROM cells)) WHERE k <= 4""", list(ALL))
def k6(spark, sf):
    return split.random_features(split.feature_table(standin.profiles(spark, sf)), 4, 3)


@query("k7_random_features_repeated", f""", f AS (SELECT profile, feature, row_number() OVER (PARTITION BY profile ORDER BY feature) - 1 AS idx, count(*) OVER (PARTITION BY profile) AS p
  FROM (SELECT DISTINCT profile, feature FROM cells)),
d AS (SELECT DISTINCT profile, p, draw FROM f CROSS JOIN range(0, 10) AS q(draw))
SELECT d.profile, d.draw::bigint AS draw, f.feature FROM d JOIN f ON f.profile = d.profile AND f.idx = {md5_hash(3, 'd.profile', 'd.draw')} % d.p""", list(ALL))
def k7(spark, sf):
    return split.random_features_repeated(split.feature_table(standin.profiles(spark, sf)), 10, 3)


@query("k8_first_features", f"""
SELECT profile, sample_id, feature, {r('value')} AS value FROM cells SEMI JOIN (
  SELECT profile, feature FROM (SELECT profile, feature, row_number() OVER (PARTITION BY profile ORDER BY feature) AS k
    FROM (SELECT DISTINCT profile, feature FROM cells)) WHERE k <= 3) USING (profile, feature)""", list(ALL))
def k8(spark, sf):
    cells = stored(standin.profiles(spark, sf), "cells")
    kept = split.first_features(split.feature_table(cells), 3)
    return cells_out(align.restrict_features(cells, kept))


@query("k8_head_rows", "SELECT sample_id, balance FROM response ORDER BY sample_id LIMIT 10", ["response"])
def k8_head(spark, sf):
    return split.head_rows(standin.response(spark, sf).select("sample_id", "balance"), 10, "sample_id")


# ---- user function -----------------------------------------------------------

@query("u1_mutate", f"SELECT sample_id, feature, {r('value * 2 + 1')} AS value FROM share", ["share"])
def u1(spark, sf):
    affine = lambda df, a, b: df.withColumn("value", F.col("value") * a + b)
    return labels.mutate(standin.share(spark, sf), affine, 2, 1).select("sample_id", "feature", rounded("value").alias("value"))
