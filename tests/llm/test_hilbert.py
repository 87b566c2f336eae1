import zlib
from collections import Counter

from pyspark.sql import functions as F

from profuse.llm import hilbert, queries

from .conftest import SF


def test_curve_visits_every_cell_once_by_unit_steps(spark):
    for n, bits in ((1, 4), (2, 4), (3, 3)):
        side = 1 << bits
        cells = spark.range(side ** n).select(*[F.expr(f"cast(id div {side ** k} % {side} as int)").alias(f"c{k}") for k in range(n)])
        rows = cells.select(*cells.columns, hilbert.curve_index([F.col(c) for c in cells.columns], bits).alias("h")).collect()
        path = sorted((r["h"], tuple(r)[:n]) for r in rows)
        assert [h for h, _ in path] == list(range(side ** n))
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for (_, a), (_, b) in zip(path, path[1:]))


def check(got, rows, n_shards=16):
    n = len(rows)
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len(text(r["text"])) + 1, zlib.crc32(text(r["text"]))) for r in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(n_shards)) and max(counts.values()) - min(counts[k] for k in range(n_shards)) <= 1 and sum(counts.values()) == n
    for shard, count in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(count))


def test_documents(spark):
    got = queries.op6_hilbert(spark, SF).collect()
    check(got, spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_curve_order(documents):
    got = sorted(hilbert.shards(documents).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in got] == sorted(r["curve"] for r in got)


def test_files_prune(spark, documents, tmp_path):
    placed = hilbert.shards(documents)
    hilbert.write(documents, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and set(back.columns) == {*documents.columns, "shard"}
    spread = lambda frame: frame.groupBy("shard").agg((F.max("n_chars") / F.min("n_chars")).alias("s")).agg(F.avg("s")).first()[0]
    assert spread(back) < 0.8 * spread(documents.withColumn("shard", F.col("doc_id") % 16))


def test_odd_rows(odd, empty):
    check(hilbert.shards(odd).collect(), odd.collect())
    assert hilbert.shards(empty).count() == 0
