"""Bar files and bar tables.

Bar files are CSV, one per symbol: timestamp (unix seconds), open, high, low, close, volume, trades, with or without a
header; the symbol is in the file's name ("ABCUSD_60.csv"). All files of a glob are one scan. Tables are Parquet, one
partition a symbol; loads replace whole partitions (partitionOverwriteMode dynamic), which stands for the upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.panel import HOUR, densify

#: Columns of a bar file, of the bar tables, of the universe and of the run log.
RAW = ("timestamp", "open", "high", "low", "close", "volume", "trades")
BARS = T.StructType(
    [T.StructField("ts", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("symbol", "base_asset", "quote_asset")]
    + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume")]
    + [T.StructField("trades", T.LongType()), T.StructField("dollar_volume", T.DoubleType())]
)
UNIVERSE = T.StructType([T.StructField("rebalance_date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("liquidity_monthly", T.DoubleType())])
RUN_SUMMARY = "run_id string, started_at timestamp, finished_at timestamp, status string, n_rows long, n_symbols long, n_events long, message string"
RUN_EVENTS = "run_id string, event_type string, symbol string, ts timestamp, metric_value double, threshold double, notes string"


def name_parts(file_name: Column, minutes: int, excluded: tuple[str, ...] = ()) -> dict[str, Column]:
    """base, quote, symbol of a file name; null where it does not match or the base is excluded."""
    base = F.regexp_extract(F.upper(file_name), rf"^([A-Z0-9]+)USD_{minutes}\.CSV$", 1)
    base = F.when((base != "") & ~base.isin(*excluded) if excluded else base != "", base)
    return {"base_asset": base, "quote_asset": F.when(base.isNotNull(), "USD"), "symbol": F.concat(base, F.lit("/USD"))}


def file_of(symbol: str, minutes: int) -> str:
    return f"{symbol.replace('/', '')}_{minutes}.csv"


def read_raw(spark: SparkSession, path: str, minutes: int = 60, excluded: tuple[str, ...] = ()) -> DataFrame:
    """All rows of all matching files as numbers; what does not parse is null, header rows go with their null timestamp."""
    raw = spark.read.schema(", ".join(f"{n} string" for n in RAW)).csv(path, mode="PERMISSIVE").withColumns(name_parts(F.col("_metadata.file_name"), minutes, excluded))
    num = lambda n, kind="double": F.expr(f"try_cast({n} as {kind})")
    rows = raw.filter("symbol is not null").select("symbol", "base_asset", "quote_asset", num("timestamp").alias("t"), *(num(n).alias(n) for n in RAW[1:6]), num("trades").cast("long").alias("trades"))
    return rows.filter("t is not null").select(F.timestamp_seconds("t").alias("ts"), *(c for c in rows.columns if c != "t"))


def clean(rows: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with start < ts <= end, one for each (symbol, ts): the smallest by (open, high, low, close, volume, trades)."""
    if start is not None:
        rows = rows.filter(F.col("ts") > F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(*RAW[1:]))
    return rows.withColumn("n_", first).filter("n_ = 1").drop("n_")


def hourly(rows: DataFrame) -> DataFrame:
    """Cleaned rows -> the dense hourly table."""
    names = rows.select("symbol", "base_asset", "quote_asset").distinct()
    return densify(rows, HOUR).join(F.broadcast(names), "symbol").select(*BARS.fieldNames())  # one row a symbol


def minutes(rows: DataFrame) -> DataFrame:
    """Cleaned rows -> the sparse minute table: no gap is filled, rows without a close go, missing trades are 0."""
    return rows.filter("close is not null").withColumn("trades", F.coalesce("trades", F.lit(0))).withColumn("dollar_volume", F.col("close") * F.col("volume")).select(*BARS.fieldNames())


def save(rows: DataFrame, path: str) -> None:
    """Replaces the partitions of the symbols that occur in rows; other symbols stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def upsert(spark: SparkSession, rows: DataFrame, path: str, keys: tuple[str, ...] = ("ts", "symbol")) -> None:
    """Rows replace stored rows of the same keys; the touched symbols' partitions are rewritten from a finished copy."""
    try:
        old = spark.read.schema(BARS).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return save(rows, path)
    touched = old.join(rows.select("symbol").distinct(), "symbol", "left_semi").join(rows.select(*keys), list(keys), "left_anti")
    # A partition cannot be read while it is overwritten: the merged rows are checkpointed in the shared folder first.
    merged = touched.select(*BARS.fieldNames()).unionByName(rows.select(*BARS.fieldNames())).checkpoint()
    return save(merged, path)


def load_hourly(spark: SparkSession, glob: str, path: str, start=None, end=None, excluded: tuple[str, ...] = ()) -> DataFrame:
    save(hourly(clean(read_raw(spark, glob, 60, excluded), start, end)), path)
    return spark.read.schema(BARS).parquet(path)


def load_minutes(spark: SparkSession, glob: str, path: str, universe: DataFrame, start=None, end=None, mode: str = "if_empty") -> DataFrame:
    """Minute files of universe symbols; if_empty skips symbols that are stored, replace loads all."""
    if mode not in ("if_empty", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    if universe.isEmpty():
        raise ValueError("the universe is empty")
    rows = clean(read_raw(spark, glob, 1), start, end).join(F.broadcast(universe.select("symbol").distinct()), "symbol", "left_semi")
    if mode == "if_empty":
        try:
            rows = rows.join(spark.read.schema(BARS).parquet(path).select("symbol").distinct(), "symbol", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    save(minutes(rows), path)
    return spark.read.schema(BARS).parquet(path)


def fetch(spark: SparkSession, path: str, start=None, end=None, symbols: list[str] | None = None) -> DataFrame:
    """Range scan; the symbol list prunes partitions, the times are pushed to the files."""
    x = spark.read.schema(BARS).parquet(path)
    if start is not None:
        x = x.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        x = x.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return x if symbols is None else x.filter(F.col("symbol").isin(symbols))
