"""The numbered queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from profuse.llm import hilbert, htmltext, itq, langid, linerules, mixing, packing, pii, simhash, spotsigs, squares, urlfilter, whitening
from profuse.llm.common import let, table, text_of, words

HELD_OUT = 5


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op2_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % HELD_OUT == 0, F.lit(False))
    model = langid.learn(docs.where(~left_out).select("doc_id", "text", "lang"))
    return langid.predict(docs, model, F.col("doc_id"), left_out.alias("held_out"))


def op4_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame, written: bool = False) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.PATTERN, written=written)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.places(mixing.mix(table(spark, sf_dir, "documents")))
    each = [F.get(c, F.lit(k)).alias(f"{name}_{k + 1}") for c, name in (("positions", "position"), ("places", "place")) for k in range(mixing.MOST)]
    return plan.select("doc_id", "size", "source_size", "target", "taken", *each)


def op10_url_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def planted_text() -> Column:
    """The text, or for one document in ten (by the checksum of its key) its words with a planted period."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        moved = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words(text_of()), periodic)).otherwise(text_of())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text().alias("text"))
    found = squares.find_runs(docs, "doc_id")
    # By start and period, so of equal exponents the first stays.
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    best = F.aggregate("runs", none, lambda a, b: F.when(more(a, b), b).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_next(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id")


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_itq, op3_language, op4_line_blocks, op5_pii, op6_hilbert, op7_line_rules, op8_packing, op9_mixing, op10_url_terms,
    op11_periodic_runs, op12_spotsigs, op13_whitening)}


def _rule_sql() -> str:
    """The longest fitting rule and its verdict."""
    cases = []
    for verdict, rule in sorted(urlfilter.RULES, key=lambda r: -len(r[1])):
        host, _, prefix = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{prefix}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")
    return "CASE " + " ".join(cases) + " END"


def _url_sql() -> str:
    # Words are the runs of ASCII letters and digits, so whole-word hits are equal list entries.
    strict = " + ".join(f"len(list_filter(runs, lambda x: x = '{t}'))" for t in urlfilter.STRICT)
    soft = " + ".join(f"list_contains(runs, '{t}')::int" for t in urlfilter.SOFT)
    return f"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS low, position('://' IN coalesce(url, '')) AS mark, coalesce(url, '') AS url FROM pages),
rests AS (SELECT page_id, low, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM parts),
hosts AS (SELECT page_id, low, rest, lower(regexp_extract(rest, '^[^/?#]*')) AS host FROM rests),
paths AS (SELECT page_id, low, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path,
                 regexp_extract_all(low, '[a-z0-9]+') AS runs FROM hosts),
judged AS (SELECT *, {_rule_sql()} AS fits, ({strict})::int AS n_strict, ({soft})::int AS n_soft FROM paths)
SELECT page_id, host, path, fits.rule AS rule, n_strict, n_soft,
       coalesce(fits.verdict, CASE WHEN n_strict > 0 OR n_soft >= {urlfilter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


#: The others hash, fit, iterate or draw in ways that SQL does not express; tests/llm holds their brute-force versions.
ORACLES: dict[str, str] = {"op10_url_terms": _url_sql()}
