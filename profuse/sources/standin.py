"""Stand-in profiles: long cells computed from the given order tables.

``spend``, ``mix``, ``share`` and ``activity`` are four profiles over the same
customers; ``vector`` is a packed bundle; ``response`` is the outcome table.
Money is summed in whole ten-thousandths so that a sum does not depend on the
order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PROFILES = ("spend", "mix", "share", "activity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_label(key: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 12, "0"))


def _cells(df: DataFrame, profile: str, sample: str, feature: Column | str, value: Column) -> DataFrame:
    return df.select(
        F.lit(profile).alias("profile"), sample_label(sample).alias("sample_id"),
        (F.col(feature) if isinstance(feature, str) else feature).alias("feature"), value.alias("value"),
    )


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net revenue per customer and brand (about a quarter of the grid is absent)."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("bigint").alias("units"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    total = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey", "p_brand").agg(F.sum("units").alias("units"))
    )
    return _cells(total, "spend", "o_custkey", "p_brand", F.col("units").cast("double") / F.lit(10000.0))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per customer and return/line status."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    total = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"))
    )
    return _cells(total, "mix", "o_custkey", F.concat("l_returnflag", "l_linestatus"), F.col("quantity"))


def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a customer's orders per priority (values in [0, 1], rows sum to 1)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    per = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("o_custkey"))  # one row per priority
    return _cells(per, "share", "o_custkey", "o_orderpriority", F.col("n").cast("double") / total.cast("double"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per user and kind (a tenth of the customers)."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.sum(cents).alias("cents"), F.count("value").alias("n")
    )
    return _cells(per, "activity", "user_id", "event_type",
                  F.col("cents").cast("double") / (F.col("n").cast("double") * F.lit(100.0)))


BUILDERS = {"spend": spend, "mix": mix, "share": share, "activity": activity}


def profiles(spark: SparkSession, sf_dir: str, names=PROFILES) -> DataFrame:
    out = None
    for name in names:
        part = BUILDERS[name](spark, sf_dir)
        out = part if out is None else out.unionByName(part)
    return out


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome table: four numeric columns per customer, some without orders."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(cents).alias("cents"), F.max("o_totalprice").alias("max_price"), F.count("*").alias("n_orders")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    joined = customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        sample_label("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("balance"),
        (F.col("cents").cast("double") / (F.col("n_orders").cast("double") * F.lit(100.0))).alias("avg_price"),
        "max_price", F.col("n_orders").cast("double").alias("n_orders"),
    )


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
