"""A fitted scaler and a fitted model applied to a stream of files."""

from pyspark.sql import functions as F

from profuse.operators import gram, linear, scale
from profuse.session import scratch_path


def test_fitted_state_scores_a_stream(spark, rows):
    path = scratch_path(spark, "stream")
    rows.write.parquet(path)
    model = linear.ols(gram.moments(rows)["all"])
    batch = {r["sample_id"]: r["prediction"] for r in model.transform(rows).collect()}
    cells = rows.select(F.lit("p").alias("profile"), "sample_id", F.posexplode("x").alias("feature", "value")).withColumn(
        "feature", F.col("feature").cast("string"))
    scaler = scale.fit_minmax(cells)
    want = {(r["sample_id"], r["feature"]): r["value"] for r in scaler.transform(cells).collect()}
    source = spark.readStream.schema(rows.schema).parquet(path)
    streamed = source.select(F.lit("p").alias("profile"), "sample_id", F.posexplode("x").alias("feature", "value")).withColumn(
        "feature", F.col("feature").cast("string"))
    for name, frame in (("scored", model.transform(source)), ("scaled", scaler.transform(streamed))):
        run = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert {r["sample_id"]: r["prediction"] for r in spark.table("scored").collect()} == batch
    assert {(r["sample_id"], r["feature"]): r["value"] for r in spark.table("scaled").collect()} == want
