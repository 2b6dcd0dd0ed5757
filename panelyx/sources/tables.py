"""Adapters from the star-schema tables to ticks and OHLCV rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: (ts, symbol, price, size, seq); seq orders ticks of one instant."""
    e = read(spark, sf_dir, "events")
    symbol = F.concat(F.lit("S"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"))
    return e.select(F.col("ts").cast("timestamp").alias("ts"), symbol.alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))


def line_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as daily OHLCV rows per symbol: close is the day's volume-weighted price, from exact decimal sums."""
    symbol = F.concat(F.lit("L"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 2, "0"))
    t = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("ts"), symbol.alias("symbol"), "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return t.groupBy("ts", "symbol").agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.count("*").alias("trades"),
    ).withColumn("open", F.col("close"))
