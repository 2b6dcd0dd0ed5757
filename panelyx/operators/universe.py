"""Monthly liquidity universe: the top names by trailing dollar volume at each month-end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_universe(rows: DataFrame, top_n: int = 30, lookback_days: int = 30, min_listing_days: int = 90, min_monthly: float = 50_000.0, min_week: float = 50_000.0, value: str = "dollar_volume") -> DataFrame:
    """(rebalance_date, symbol, rank, liquidity_monthly).

    A month-end d that occurs in the data ranks symbols by the mean of `value` over [d - lookback, d), if first seen
    before d - min_listing, with that mean and the last seven days' mean at their thresholds. The range join "row in the
    window of d" is an explode: a row can only lie in the windows of the next few month-ends. Ties rank by symbol.
    """
    day = F.to_date("ts")
    ends = rows.select(F.last_day(day).alias("d")).distinct()
    first = rows.groupBy("symbol").agg(F.min("ts").alias("first_ts"))
    months = range(-(-lookback_days // 28) + 1)
    near = rows.select("symbol", "ts", F.col(value).alias("v"), F.explode(F.array(*[F.last_day(F.add_months(day, k)) for k in months])).alias("d"))
    near = near.filter((F.col("ts") >= F.date_sub("d", lookback_days).cast("timestamp")) & (F.col("ts") < F.col("d").cast("timestamp")))
    week = F.col("ts") >= F.date_sub("d", 7).cast("timestamp")
    liq = near.groupBy("d", "symbol").agg(F.avg("v").alias("monthly"), F.avg(F.when(week, F.col("v"))).alias("week"))
    ok = liq.join(ends, "d", "left_semi").join(first, "symbol").filter((F.col("first_ts") < F.date_sub("d", min_listing_days).cast("timestamp")) & (F.col("monthly") >= min_monthly) & (F.col("week") >= min_week))
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("monthly"), "symbol"))
    return ok.select(F.col("d").alias("rebalance_date"), "symbol", rank.alias("rank"), F.col("monthly").alias("liquidity_monthly")).filter(F.col("rank") <= top_n)


def list_symbols(universe: DataFrame, as_of=None, top_n: int | None = None) -> DataFrame:
    """Distinct symbols of all snapshots, or of the latest one strictly before as_of."""
    u = universe if top_n is None else universe.filter(F.col("rank") <= top_n)
    if as_of is not None:
        latest = universe.filter(F.col("rebalance_date") < F.lit(as_of)).agg(F.max("rebalance_date").alias("rebalance_date"))
        u = u.join(F.broadcast(latest), "rebalance_date", "left_semi")
    return u.select("symbol").distinct()


def in_window(universe: DataFrame, start, end) -> DataFrame:
    """Snapshots whose date lies in [start, end]."""
    return universe.filter(F.col("rebalance_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def turnover(universe: DataFrame) -> DataFrame:
    """(rebalance_date, previous_date, turnover): share of the snapshot before that is no longer in."""
    dates = universe.select("rebalance_date").distinct().withColumn("previous_date", F.lag("rebalance_date").over(Window.orderBy("rebalance_date"))).filter("previous_date is not null")
    size = universe.groupBy("rebalance_date").agg(F.countDistinct("symbol").alias("n")).withColumnRenamed("rebalance_date", "previous_date")
    before = dates.join(universe.select(F.col("rebalance_date").alias("previous_date"), "symbol").distinct(), "previous_date")
    kept = before.join(universe.select("rebalance_date", "symbol").distinct(), ["rebalance_date", "symbol"], "left_semi").groupBy("rebalance_date").agg(F.count("*").alias("kept"))
    return dates.join(size, "previous_date").join(kept, "rebalance_date", "left").select("rebalance_date", "previous_date", (1 - F.coalesce("kept", F.lit(0)) / F.col("n")).alias("turnover"))
