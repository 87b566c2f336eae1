"""Whole workflows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from profuse.functions.text import add_suffix
from profuse.operators import labels, quality, scale
from profuse.plans import cohort, prepare, reload
from profuse.plans.catalog_cells import CELLS_OUT, SPLIT_SQL, WHITELIST, cells_out, grid_sql, names_frame
from profuse.plans.registry import ALL, md5_hash, query, r, rounded
from profuse.session import stored
from profuse.sources import standin

LABEL_LENGTH = 16  # "S" + 12 digits + a three-character type code


@query("feature_summary", f"""
, scaled AS (SELECT feature, (v - min(v) OVER w) / CASE WHEN max(v) OVER w = min(v) OVER w THEN 1 ELSE max(v) OVER w - min(v) OVER w END AS v
  FROM (SELECT feature, log2(value + 1) AS v FROM spend) WINDOW w AS (PARTITION BY feature))
SELECT feature, count(*)::bigint AS n_samples, {r('avg(v)')} AS mean, {r('var_pop(v)')} AS variance FROM scaled GROUP BY feature HAVING var_pop(v) > 0.001""", ["spend"])
def feature_summary(spark, sf):
    """Log, scale and filter one profile, then summarise its features."""
    kept = quality.keep_var_pop(scale.minmax(scale.log_scale(stored(standin.spend(spark, sf), "cells"))), 0.001)
    return kept.groupBy("feature").agg(
        F.count("*").alias("n_samples"), rounded(F.avg("value")).alias("mean"), rounded(F.var_pop("value")).alias("variance"))


COHORT_SQL = """
owner AS (SELECT 'S' || lpad(c_custkey::varchar, 12, '0') AS base, CASE WHEN c_mktsegment = 'BUILDING' THEN '-02' ELSE '-01' END AS code,
  CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS available FROM customer),
packed AS (SELECT 'spend' AS profile, sample_id || code AS sample_id, trim(' ' || feature) AS feature, value
  FROM spend JOIN owner ON sample_id = base WHERE available = 'Yes' AND code <> '-02'),
meth AS (SELECT 'share' AS profile, sample_id || '-01' AS sample_id, 'met_' || feature AS feature, value FROM share),
portions AS (SELECT 'mix' AS profile, sample_id || '-01' AS sample_id, feature, value FROM mix),
antibody AS (SELECT 'activity' AS profile, sample_id || '-01' AS sample_id, feature || '_-_AB' AS feature, value FROM activity),
raw AS (SELECT * FROM packed UNION ALL SELECT * FROM meth UNION ALL SELECT * FROM portions UNION ALL SELECT * FROM antibody),
common AS (SELECT sample_id FROM (SELECT DISTINCT profile, sample_id FROM raw UNION SELECT 'response', sample_id || '-01' FROM response)
  GROUP BY sample_id HAVING count(*) = 5)"""


def owners(spark, sf):
    return standin.table(spark, sf, "customer").select(
        standin.sample_label("c_custkey").alias("sample_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "-02").otherwise("-01").alias("code"),
        F.when(F.col("c_acctbal") > 0, "Yes").otherwise("No").alias("available"))


def raw_layouts(spark, sf):
    """The four raw layouts, derived from the given tables."""
    packed = standin.spend(spark, sf).join(owners(spark, sf), "sample_id").select(
        F.concat("sample_id", "code").alias("sample_id"), "available", F.concat(F.lit(" "), "feature").alias("feature"), "value")
    share = standin.share(spark, sf)
    junk = share.select("sample_id").distinct().select("sample_id", F.lit("junk").alias("feature"), F.lit("Beta_Value").alias("text"))
    text_rows = share.select("sample_id", "feature", F.col("value").cast("string").alias("text")).unionByName(junk)
    text_rows = text_rows.withColumn("sample_id", add_suffix(F.col("sample_id")))
    mix = standin.mix(spark, sf)
    portions = mix.select(
        F.explode(F.array(*[F.struct(F.concat("sample_id", F.lit(tail)).alias("sample_id"), (F.col("value") * k).alias("value"),
                                     F.lit(k).alias("position"), F.lit(strand).alias("Strand"))
                            for k, tail, strand in ((1, "-01A-11R", "+"), (2, "-01A-21R", "+"), (3, "-01A-31R", "-"))])).alias("c"),
        "feature").select("c.*", "feature")
    antibody = standin.activity(spark, sf).select(
        F.concat("sample_id", F.lit("-01A-21")).alias("sample_id"), F.concat("feature", F.lit("|AB")).alias("feature"), "value")
    return packed, text_rows, portions, antibody


@query("w1_cohort_build", ", " + COHORT_SQL + f"SELECT profile, sample_id, feature, {r('value')} AS value FROM raw WHERE sample_id IN (SELECT sample_id FROM common)", [*ALL, "response"])
def w1(spark, sf):
    packed, text_rows, portions, antibody = raw_layouts(spark, sf)
    parts = [
        cohort.clean_packed(packed, "spend"), cohort.clean_text(text_rows, "share", "met_", "Beta_Value", 0.0),
        cohort.clean_portions(portions, "mix", LABEL_LENGTH), cohort.clean_antibody(antibody, "activity", LABEL_LENGTH)]
    return cells_out(cohort.build(parts, standin.response(spark, sf)))


NAME_LIST = [*WHITELIST, "AF", "NF", "1-URGENT", "5-LOW"]
NAME_LIST_SQL = "(" + ", ".join(f"'{n}'" for n in NAME_LIST) + ")"


def _mean_filled(source: str) -> str:
    return f"(SELECT profile, sample_id, feature, coalesce(value, avg(value) OVER (PARTITION BY feature)) AS value FROM g_{source})"


@query("w2_preparation", ", " + ",\n".join("g_" + grid_sql(s) .replace("grid AS", f"{s} AS", 1) for s in ("mix", "share", "activity")) + f""",
filled AS (SELECT profile, sample_id, feature, log2(value + 1) AS value FROM spend UNION ALL SELECT * FROM {_mean_filled('mix')}
  UNION ALL SELECT * FROM {_mean_filled('share')} UNION ALL SELECT * FROM {_mean_filled('activity')}),
scaled AS (SELECT profile, sample_id, feature, (value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE max(value) OVER w - min(value) OVER w END AS value
  FROM filled WINDOW w AS (PARTITION BY profile, feature)),
kept AS (SELECT * FROM (SELECT *, var_pop(value) OVER (PARTITION BY profile, feature) AS vp FROM scaled) WHERE vp > 0.001),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY profile ORDER BY feature) AS k FROM kept)
SELECT profile, sample_id, feature, {r('value')} AS value FROM placed
WHERE (profile <> 'activity' AND feature IN {NAME_LIST_SQL}) OR (profile = 'activity' AND k <= 3)""", ["spend", "mix", "share", "activity"])
def w2(spark, sf):
    profiles = {name: standin.BUILDERS[name](spark, sf) for name in standin.PROFILES}
    out = prepare.prepare(profiles, ["spend"], names_frame(spark, NAME_LIST), ["spend", "mix", "share"], {"activity": 3})
    return cells_out(out)


@query("w2_preparation_low_rank")
def w2_low_rank(spark, sf):
    """The same preparation with the low-rank imputer in place of feature means."""
    profiles = {name: standin.BUILDERS[name](spark, sf) for name in standin.PROFILES}
    out = prepare.prepare(profiles, ["spend"], names_frame(spark, NAME_LIST), ["spend", "mix", "share"], {"activity": 3}, method="low_rank")
    return cells_out(out)


@query("w3_reload", f"""
, kept AS (SELECT * FROM (SELECT *, var_pop(value) OVER (PARTITION BY profile, feature) AS vp FROM spend) WHERE vp > 1.0),
z AS (SELECT profile, sample_id, feature, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM kept WINDOW w AS (PARTITION BY profile, feature)),
f AS (SELECT profile, feature, row_number() OVER (PARTITION BY profile ORDER BY feature) - 1 AS idx, count(*) OVER (PARTITION BY profile) AS p
  FROM (SELECT DISTINCT profile, feature FROM z WHERE contains(feature, 'Brand#1') OR contains(feature, 'Brand#2'))),
d AS (SELECT DISTINCT profile, p, draw FROM f CROSS JOIN range(0, 4) AS q(draw)),
drawn AS (SELECT d.profile, d.draw, f.feature FROM d JOIN f ON f.profile = d.profile AND f.idx = {md5_hash(10, 'd.profile', 'd.draw')} % d.p),
y AS (SELECT sample_id, log10(max_price) AS y, row_number() OVER (ORDER BY {md5_hash(10, 'sample_id')}, sample_id) AS k, count(*) OVER () AS n FROM response WHERE max_price IS NOT NULL)
SELECT CASE WHEN k > n - ceil(0.2::double * n) THEN 'test' ELSE 'train' END AS split, z.sample_id, draw::bigint AS draw, z.feature, {r('value')} AS value, {r('y')} AS y
FROM z JOIN drawn USING (profile, feature) JOIN y ON y.sample_id = z.sample_id""", ["spend", "response"])
def w3(spark, sf):
    options = prepare.Reload(target="max_price", threshold=1.0, substrings=names_frame(spark, ["Brand#1", "Brand#2"]), draws=4)
    out = prepare.reload(standin.spend(spark, sf), standin.response(spark, sf), options)
    return out.select("split", "sample_id", "draw", "feature", rounded("value").alias("value"), rounded("y").alias("y"))


# Two features of each profile stay, so that their components have a closed form.
RELOAD_NAMES = ["Brand#12", "Brand#23", "AF", "RF", "URGENT", "LOW", "chas", "sign"]
RELOAD_RULES = {
    "spend": reload.ProfileRule(drop_id=True, select="exact", threshold=0.001),
    "mix": reload.ProfileRule(drop_id=True, select="contains", threshold=0.001),
    "share": reload.ProfileRule(drop_id=True, select="contains", threshold=0.001),
    "activity": reload.ProfileRule(repair=("-", "."), follows=True, select="contains", threshold=0.01)}


def saved_wide(spark, sf) -> dict:
    """The four profiles as saved tables: label, (repeated identifier,) one column per feature."""
    out = {}
    for name, build in standin.BUILDERS.items():
        cells = build(spark, sf)
        dotted = cells.withColumn("sample_id", F.concat(F.lit("S-" if name == "activity" else "S."), F.substring("sample_id", 2, 12)))
        wide = stored(dotted, "cells").groupBy("sample_id").pivot("feature").agg(F.max("value"))
        out[name] = wide if name == "activity" else wide.select("sample_id", F.col("sample_id").alias("X"), *wide.columns[1:])
    return out


@query("w3_reload_profiles", f"""
, listed AS (SELECT unnest({RELOAD_NAMES}) AS name),
lim AS (SELECT * FROM (VALUES ('spend', 0.001::double), ('mix', 0.001::double), ('share', 0.001::double), ('activity', 0.01::double)) AS t(profile, lim)),
led AS (SELECT DISTINCT sample_id FROM spend),
st AS (SELECT c.profile, c.feature, min(value) AS lo, CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END AS width,
  var_pop(value) FILTER (c.profile <> 'activity' OR led.sample_id IS NOT NULL) AS spread FROM cells c LEFT JOIN led USING (sample_id) GROUP BY c.profile, c.feature),
f AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY feature) AS k FROM st JOIN lim USING (profile)
  WHERE spread / (width * width) > lim AND EXISTS (SELECT 1 FROM listed WHERE CASE WHEN profile = 'spend' THEN feature = name ELSE contains(feature, name) END)),
v AS (SELECT c.profile, c.sample_id, coalesce(max((value - lo) / width) FILTER (k = 1), 0) AS a, coalesce(max((value - lo) / width) FILTER (k = 2), 0) AS b
  FROM cells c LEFT JOIN f USING (profile, feature) LEFT JOIN led USING (sample_id) WHERE c.profile <> 'activity' OR led.sample_id IS NOT NULL GROUP BY c.profile, c.sample_id),
m AS (SELECT profile, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, covar_pop(a, b) AS vc,
  (var_pop(a) + var_pop(b)) / 2 + sqrt(((var_pop(a) - var_pop(b)) / 2) ** 2 + covar_pop(a, b) ** 2) - var_pop(a) AS gap FROM v GROUP BY profile),
e AS (SELECT *, vc / sqrt(vc * vc + gap * gap) AS x, gap / sqrt(vc * vc + gap * gap) AS y FROM m),
s AS (SELECT *, CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS s1, CASE WHEN abs(y) >= abs(x) THEN -sign(y) ELSE sign(x) END AS s2 FROM e),
pc AS (SELECT profile, sample_id, 'pc1' AS component, s1 * ((a - ma) * x + (b - mb) * y) AS value FROM v JOIN s USING (profile)
  UNION ALL SELECT profile, sample_id, 'pc2', s2 * ((b - mb) * x - (a - ma) * y) FROM v JOIN s USING (profile)),
o AS (SELECT 'S.' || substr(sample_id, 2) AS sample_id, log10(max_price) AS y FROM response JOIN led USING (sample_id) WHERE max_price IS NOT NULL),
parts AS (SELECT *, row_number() OVER (ORDER BY {md5_hash(10, 'sample_id')}, sample_id) AS k, count(*) OVER () AS n FROM o)
SELECT CASE WHEN k > n - ceil(0.2::double * n) THEN 'test' ELSE 'train' END AS split, profile, parts.sample_id, component, {r('value')} AS value, {r('y')} AS y
FROM pc JOIN parts ON parts.sample_id = 'S.' || substr(pc.sample_id, 2)""", [*ALL, "response"])
def w3_profiles(spark, sf):
    """Identifier drop, label repair, min-max, name lists, alignment, variance limits per profile, two components, split."""
    options = reload.ProfileReload(target="max_price", reference="spend", rules=RELOAD_RULES, scaling="minmax",
                                   names=names_frame(spark, RELOAD_NAMES), components=2)
    outcome = standin.response(spark, sf).withColumn("sample_id", F.concat(F.lit("S."), F.substring("sample_id", 2, 12)))
    out = reload.reload_profiles(saved_wide(spark, sf), outcome, options)
    return out.select("split", "profile", "sample_id", F.col("feature").alias("component"), rounded("value").alias("value"), rounded("y").alias("y"))


DEMO = ["AF", "NO", "RF"]


@query("w4_demo_set", f"""
, kept AS (SELECT * FROM (SELECT *, var_pop(value) OVER (PARTITION BY feature) AS vp FROM mix WHERE feature IN ('AF', 'NO', 'RF')) WHERE vp > 10),
{SPLIT_SQL.format(source='kept')},
st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM kept JOIN parts USING (sample_id) WHERE split = 'train' GROUP BY feature)
SELECT split, sample_id, feature, {r('(value - m) / s')} AS value FROM kept JOIN parts USING (sample_id) JOIN st USING (feature)""", ["mix"])
def w4(spark, sf):
    return prepare.demo_set(stored(standin.mix(spark, sf), "cells"), DEMO, 10.0, 7).select(
        "split", "sample_id", "feature", rounded("value").alias("value"))


CODES = {"AUTOMOBILE": "-11", "BUILDING": "-02", "FURNITURE": "-10", "HOUSEHOLD": "-01", "MACHINERY": "-19"}
CODES_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items()) + " ELSE '-06' END"


@query("w5_normal_tissue", f"""
, coded AS (SELECT 'S' || lpad(c_custkey::varchar, 12, '0') AS base, {CODES_SQL} AS code FROM customer)
SELECT 'normal' AS profile, sample_id || code AS sample_id, 'mirna_' || feature AS feature, {r('value * 2')} AS value
FROM spend JOIN coded ON base = sample_id WHERE regexp_matches(code, '-1[0-9]$') AND feature IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 25)""", ["spend"])
def w5(spark, sf):
    code = F.lit("-06")
    for segment, value in CODES.items():
        code = F.when(F.col("c_mktsegment") == segment, F.lit(value)).otherwise(code)
    coded = standin.table(spark, sf, "customer").select(standin.sample_label("c_custkey").alias("sample_id"), code.alias("code"))
    raw = standin.spend(spark, sf).join(coded, "sample_id").select(
        F.explode(F.array(*[F.struct(F.concat("sample_id", "code", F.lit(tail)).alias("sample_id"), (F.col("value") * k).alias("value"),
                                     F.lit(k).alias("position")) for k, tail in ((1, "A-11R"), (2, "B-11R"))])).alias("c"),
        "feature").select("c.*", "feature")
    other = standin.table(spark, sf, "part").filter(F.col("p_size") > 25).select(F.concat(F.lit("mirna_"), "p_brand").alias("feature"))
    return cells_out(cohort.normal_tissue(raw, other, "normal", "mirna_", LABEL_LENGTH))
