"""Spread estimators from highs and lows, and from closes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bar_return, by_symbol, div
from .panel import bar_start

#: Fixed value of the high-low estimator.
DENOMINATOR = 3.0 - 2.0 * math.sqrt(2.0)


def corwin_schultz(high: str = "high", low: str = "low", floor: bool = True) -> Column:
    """Proportional spread from two bars' ranges, at the second bar; NULL if either bar is invalid."""
    ok = (F.col(high) > 0) & (F.col(low) > 0) & (F.col(high) >= F.col(low))
    h, l = F.when(ok, F.col(high)), F.when(ok, F.col(low))
    h1, l1 = F.lag(h, 1).over(by_symbol()), F.lag(l, 1).over(by_symbol())
    both = h.isNotNull() & h1.isNotNull()
    sq = lambda a, b: F.pow(F.ln(a / b), F.lit(2.0))
    beta = sq(h1, l1) + sq(h, l)
    gamma = sq(F.greatest(h, h1), F.least(l, l1))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / DENOMINATOR - F.sqrt(gamma / DENOMINATOR)
    s = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return F.when(both, F.greatest(s, F.lit(0.0)) if floor else s)


def roll_spread(p: DataFrame, log: bool | str = True) -> DataFrame:
    """(symbol, roll_spread): from the lag-1 autocovariance of log returns; NULL where it is not negative or n < 3."""
    r = p.withColumn("r", bar_return("close", log=log)).filter("r is not null")
    x = r.withColumn("before", F.lag("r", 1).over(by_symbol()))
    pair = F.col("before").isNotNull()
    a, b = F.when(pair, F.col("r")), F.when(pair, F.col("before"))
    cov = div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)) * F.var_samp("r")
    return x.groupBy("symbol").agg(F.when(F.count("*") >= 3, cov).alias("cov")).select("symbol", F.when(F.col("cov") < 0, 2 * F.sqrt(-F.col("cov"))).alias("roll_spread"))


def half_spread_bps(spreads: DataFrame, value: str, stat: str = "median", min_obs: int = 30) -> DataFrame:
    """(symbol, half_spread_bps); NULL below min_obs estimates."""
    if stat not in ("median", "mean"):
        raise ValueError("stat must be median or mean")
    x = F.median(value) if stat == "median" else F.avg(value)
    return spreads.groupBy("symbol").agg(F.when(F.count(value) >= min_obs, x / 2.0 * 1e4).alias("half_spread_bps"))


def half_spread_from_rows(rows: DataFrame, seconds: int = 3600, stat: str = "mean", min_obs: int = 30) -> DataFrame:
    """Rows without trades are left out; high and low per bar; one estimate a pair of bars."""
    if missing := {"ts", "symbol", "high", "low", "trades"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    bars = rows.filter("trades > 0").groupBy(bar_start("ts", seconds).alias("bar"), "symbol").agg(F.max("high").alias("high"), F.min("low").alias("low")).withColumnRenamed("bar", "ts")
    # The pair must be of consecutive bars: a gap leaves no estimate.
    order = Window.partitionBy("symbol").orderBy("ts")
    bars = bars.withColumn("bar_id", F.row_number().over(order)).withColumn("next_to", F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(order) == seconds)
    return half_spread_bps(bars.withColumn("cs", F.when(F.col("next_to"), corwin_schultz())), "cs", stat, min_obs)
