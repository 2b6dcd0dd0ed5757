"""Panels: bars from ticks, dense grids, masks, decimation.

A panel is long: (ts, bar_id, symbol, values). Every symbol has a row for every bar of the panel; bar_id numbers the bars
that hold any close. Nothing is pivoted, so the number of columns does not follow the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_symbol, by_time, c

HOUR, DAY = 3600, 86400


def bar_start(ts: Column | str, seconds: int) -> Column:
    """The bar's label: its start. Bars are anchored at midnight UTC, so they must divide a day."""
    if seconds <= 0 or DAY % seconds:
        raise ValueError("a bar must divide a day")
    return F.timestamp_seconds(F.floor(F.unix_micros(c(ts)) / (seconds * 1_000_000)) * seconds)


def tick_bars(ticks: DataFrame, seconds: int = HOUR) -> DataFrame:
    """(ts, symbol, price, size, seq) -> OHLCV rows of the bars that traded."""
    at = F.struct("ts", "seq")
    return ticks.groupBy(bar_start("ts", seconds).alias("bar"), "symbol").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("trades"),
    ).withColumnRenamed("bar", "ts")


def densify(rows: DataFrame, seconds: int = HOUR) -> DataFrame:
    """Full grid per symbol from its first to its last row: close carried forward, missing OHL from close, no volume.

    Rows off the grid of the symbol's first row vanish, as they do in a reindex.
    """
    span = rows.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("ts"))
    carried = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    out = grid.join(rows, ["symbol", "ts"], "left").withColumn("close", carried)
    return out.select(
        "ts",
        "symbol",
        *(F.coalesce(x, "close").alias(x) for x in ("open", "high", "low")),
        "close",
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("trades", F.lit(0)).cast("long").alias("trades"),
    ).withColumn("dollar_volume", F.col("close") * F.col("volume"))


def check_long(rows: DataFrame, needed: tuple[str, ...] = ("ts", "symbol", "close")) -> DataFrame:
    """Raises ValueError for missing columns or repeated (ts, symbol)."""
    if missing := [x for x in needed if x not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    if not rows.groupBy("ts", "symbol").count().filter("count > 1").isEmpty():
        raise ValueError("repeated (ts, symbol)")
    return rows


def panel(rows: DataFrame, seconds: int) -> DataFrame:
    """OHLCV rows -> dense panel: last non-null close, summed volume and trades (NULL where no row), max high, min low."""
    agg = rows.groupBy(bar_start("ts", seconds).alias("ts_"), "symbol").agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
    ).withColumnRenamed("ts_", "ts")
    # The list of bars is a time series (one row a bar), the only thing that is ordered as a whole.
    bars = agg.filter("close is not null").select("ts").distinct().withColumn("bar_id", F.row_number().over(Window.orderBy("ts")) - 1)
    edge = bars.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    symbols = agg.groupBy("symbol").agg(F.lit(1).alias("one"))
    grid = symbols.join(F.broadcast(edge.withColumn("one", F.lit(1))), "one").select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("ts"))
    return grid.join(bars, "ts").join(agg, ["ts", "symbol"], "left").select("ts", "bar_id", "symbol", "close", "high", "low", "volume", "trades")


def traded(p: DataFrame) -> DataFrame:
    """Adds `traded`: the bar saw a trade; bars without rows did not."""
    return p.withColumn("traded", F.coalesce(F.col("trades") > 0, F.lit(False)))


def keep_traded(value: Column | str, lookback: int = 0, forward: int = 0) -> Column:
    """value where the symbol traded now, `lookback` bars ago and `forward` bars ahead."""
    if lookback < 0 or forward < 0:
        raise ValueError("offsets must not be negative")
    ok = F.col("traded")
    if lookback:
        ok = ok & F.lag("traded", lookback, False).over(by_symbol())
    if forward:
        ok = ok & F.lead("traded", forward, False).over(by_symbol())
    return F.when(ok, c(value))


def member_mask(p: DataFrame, universe: DataFrame | None) -> DataFrame:
    """Adds `member`: the symbol is in the latest snapshot that is tradable (a day after its date) at ts.

    As-of join: each bar is tagged with its snapshot on the series of bars, then an equi-join finds the members. Without
    a universe everything is a member; with an empty one nothing is.
    """
    if universe is None:
        return p.withColumn("member", F.lit(True))
    dates = universe.select(F.col("rebalance_date").alias("snap")).distinct().withColumn("ts", F.col("snap").cast("timestamp") + F.expr("interval 1 day"))
    times = p.select("ts").distinct().withColumn("snap", F.lit(None).cast("date")).withColumn("bar", F.lit(1))
    tagged = dates.withColumn("bar", F.lit(0)).unionByName(times).withColumn("snap", F.last("snap", ignorenulls=True).over(Window.orderBy("ts", "bar").rowsBetween(Window.unboundedPreceding, 0)))
    tagged = tagged.filter("bar = 1").select("ts", "snap")
    members = universe.select(F.col("rebalance_date").alias("snap"), "symbol", F.lit(True).alias("member")).distinct()
    return p.join(tagged, "ts", "left").join(members, ["snap", "symbol"], "left").drop("snap").withColumn("member", F.coalesce("member", F.lit(False)))


def in_universe(value: Column | str, mask: str | None = "member") -> Column:
    return c(value) if mask is None else F.when(F.col(mask), c(value))


def decimate(value: Column | str, n: int) -> Column:
    """Sample and hold: every row takes the value (null too) of the last row whose bar_id is a multiple of n."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return c(value)
    return F.first(c(value)).over(Window.partitionBy("symbol", F.floor(F.col("bar_id") / n)).orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0))


def align(reference: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-joins others (ts, symbol, values) onto the reference's grid."""
    for o in others:
        reference = reference.join(o.drop("bar_id"), ["ts", "symbol"], "left")
    return reference


def top_of_universe(universe: DataFrame, n: int) -> DataFrame:
    return universe.filter(F.col("rank") <= n)


def demean(value: Column | str, mask: Column | None = None) -> Column:
    x = c(value)
    return x - F.avg(x if mask is None else F.when(mask, x)).over(by_time())
