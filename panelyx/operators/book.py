"""Books of weights: quantile, banded (hysteresis), beta-hedged; and backtests with costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_symbol, by_time, div, pct_rank
from .ic import periods_per_year


def _sides(long: Column, short: Column) -> Column:
    n = lambda m: F.count(F.when(m, 1)).over(by_time())
    return F.when(long, 1.0 / n(long)).otherwise(0.0) - F.when(short, 1.0 / n(short)).otherwise(0.0)


def _check(top: float, bottom: float) -> None:
    if not (0 < top < 1 and 0 < bottom < 1):
        raise ValueError("quantiles must lie in (0, 1)")


def quantile_weights(p: DataFrame, signal: str, top: float = 0.2, bottom: float = 0.2, out: str = "w") -> DataFrame:
    """Equal weight long in the top share by percentile rank and short in the bottom share."""
    _check(top, bottom)
    p = p.withColumn("pr", pct_rank(signal))
    long, short = F.coalesce(F.col("pr") >= F.lit(1.0 - top), F.lit(False)), F.coalesce(F.col("pr") <= F.lit(bottom), F.lit(False))
    return p.withColumn(out, F.when(long, 1.0 / F.count(F.when(long, 1)).over(by_time())).otherwise(0.0) - F.when(short, 1.0 / F.count(F.when(short, 1)).over(by_time())).otherwise(0.0)).drop("pr")


def _states(live: DataFrame, edges: tuple[float, float, float, float]) -> DataFrame:
    """Adds long and short where both bands can hold a name: it is then in neither.

    A row maps the state before it (0 out, 1 long, 2 short) to the one after it. Such maps are composed over ever longer
    stretches, 1, 2, 4, ... rows, by windows that share one sort; nothing is collected, however long the history.
    """
    enter_l, leave_l, enter_s, leave_s = edges
    pr, known = F.col("pr"), F.col("pr").isNotNull()
    for s in range(3):
        long, short = known & ((pr >= enter_l) | ((pr >= leave_l) & F.lit(s == 1))), known & ((pr <= enter_s) | ((pr <= leave_s) & F.lit(s == 2)))
        live = live.withColumn(f"m{s}", F.when(long & ~short, 1).when(short & ~long, 2).otherwise(0))
    rows = live.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < rows:
        live = live.withColumn("b_", F.lag(F.struct("m0", "m1", "m2"), step).over(by_symbol()))
        then = lambda x: F.when(x == 1, F.col("m1")).when(x == 2, F.col("m2")).otherwise(F.col("m0"))
        live = live.withColumns({f"m{s}": F.when(F.col("b_").isNull(), F.col(f"m{s}")).otherwise(then(F.col(f"b_.m{s}"))) for s in range(3)})
        step *= 2
    return live.withColumns({"long": F.col("m0") == 1, "short": F.col("m0") == 2}).drop("m0", "m1", "m2", "b_")


def banded_weights(p: DataFrame, signal: str, top: float = 0.2, bottom: float = 0.2, band: float = 0.0, out: str = "w") -> DataFrame:
    """Hysteresis: a name enters at the quantile and leaves beyond the band; a missing signal forces it out; a row without
    any signal repeats the weights before (0 at the start).

    A membership is the last event that was not "hold": 1 enters, 0 leaves. While long and short cannot hold at the same
    time (band < (1 - top - bottom) / 2) that is exact; for wider bands see _states.
    """
    _check(top, bottom)
    if band < 0:
        raise ValueError("the band must not be negative")
    enter_l, leave_l, enter_s, leave_s = 1.0 - top, 1.0 - top - band, bottom, bottom + band
    p = p.withColumn("pr", pct_rank(signal)).withColumn("any", F.count("pr").over(by_time()) > 0)
    live = p.filter("any")
    if leave_l > leave_s:
        event = lambda enter, leave: F.when(F.col("pr").isNull(), 0).when(enter, 1).when(leave, 0)
        held = lambda e: F.coalesce(F.last(e, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1
        live = live.withColumns({"el": event(F.col("pr") >= enter_l, F.col("pr") < leave_l), "es": event(F.col("pr") <= enter_s, F.col("pr") > leave_s)})
        live = live.withColumns({"long": held(F.col("el")), "short": held(F.col("es"))}).drop("el", "es")
    else:
        live = _states(live, (enter_l, leave_l, enter_s, leave_s))
    live = live.withColumn(out, _sides(F.col("long"), F.col("short"))).select("ts", "symbol", out)
    carried = F.coalesce(F.last(out, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return p.join(live, ["ts", "symbol"], "left").withColumn(out, carried).drop("pr", "any")


def banded_book(p: DataFrame, signal: str, holding: int, band: float, top: float = 0.2, bottom: float = 0.2, out: str = "w") -> DataFrame:
    """Banded membership on every holding-th bar, held in between."""
    h = max(int(holding), 1)
    decided = banded_weights(p.filter(F.col("bar_id") % h == 0), signal, top, bottom, band, out).select("symbol", F.col("bar_id").alias("at"), out)
    return p.withColumn("at", F.col("bar_id") - F.col("bar_id") % h).join(decided, ["symbol", "at"], "left").drop("at").withColumn(out, F.coalesce(out, F.lit(0.0)))


def portfolio_beta(p: DataFrame, w: str, beta: str) -> DataFrame:
    """(ts, portfolio_beta, beta_coverage)."""
    gross = F.sum(F.abs(w))
    return p.groupBy("ts").agg(F.sum(F.col(w) * F.col(beta)).alias("portfolio_beta"), div(F.sum(F.when(F.col(beta).isNotNull(), F.abs(w)).otherwise(0.0)), gross).alias("beta_coverage"))


def beta_hedged(p: DataFrame, w: str, beta: str, benchmark: str, fill: float = 1.0, max_hedge: float | None = None, normalize: bool = True, out: str = "hw") -> DataFrame:
    """Adds `out`: weights with a benchmark position that cancels the ex-ante beta, at the gross exposure of before.

    A dense panel that lacks the benchmark gets its rows.
    """
    if max_hedge is not None and max_hedge <= 0:
        raise ValueError("max_hedge must be positive")
    held = F.coalesce(F.col(w), F.lit(0.0)) != 0
    b = F.coalesce(F.col(beta), F.when(held, F.lit(float(fill))))
    bench = F.max(F.when(F.col("symbol") == benchmark, F.coalesce(F.col(beta), F.lit(float(fill)))))
    per = p.groupBy("ts").agg(F.sum(F.col(w) * b).alias("beta_p"), F.coalesce(bench, F.lit(float(fill))).alias("beta_b"), F.coalesce(F.sum(F.abs(w)), F.lit(0.0)).alias("gross"), F.max((F.col("symbol") == benchmark).cast("int")).alias("has"))
    hedge = div(-F.col("beta_p"), F.col("beta_b"))
    if max_hedge is not None:
        hedge = F.when(hedge.isNotNull(), F.greatest(F.lit(-float(max_hedge)), F.least(F.lit(float(max_hedge)), hedge)))
    per = per.withColumn("hedge", F.coalesce(hedge, F.lit(0.0)))
    rows = p.join(per, "ts").withColumn(out, F.when(F.col("symbol") == benchmark, F.coalesce(F.col(w), F.lit(0.0)) + F.col("hedge")).otherwise(F.col(w)))
    new = per.filter("has = 0").select("ts", F.lit(benchmark).alias("symbol"), F.col("hedge").alias(out), "gross")
    rows = rows.unionByName(new, allowMissingColumns=True)
    if normalize:
        after = F.sum(F.abs(out)).over(by_time())
        rows = rows.withColumn(out, F.col(out) * F.coalesce(div(F.col("gross"), after), F.lit(1.0)))
    return rows.drop("beta_p", "beta_b", "gross", "has", "hedge")


def leg_returns(p: DataFrame, w: str, realized: str) -> DataFrame:
    """(ts, long_leg, short_leg)."""
    leg = lambda x: F.coalesce(F.sum(x * F.col(realized)), F.lit(0.0))
    zero = F.lit(0.0)
    return p.groupBy("ts").agg(leg(F.when(F.col(w).isNotNull(), F.greatest(F.col(w), zero))).alias("long_leg"), leg(F.when(F.col(w).isNotNull(), F.least(F.col(w), zero))).alias("short_leg"))


def backtest_periods(p: DataFrame, w: str, realized: str, holding: int = 1, delay: int = 0, fee_bps: Column | float = 2.0, half_spread_bps: Column | float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ts, gross, costs, net, turnover, exposure): one row for each priced holding period.

    Weights act `delay` bars later; every holding-th bar is a period, counted from bar 0. A unit of |dw| pays the one-way
    fee and half a spread; the first period has no change to pay for. Changes are taken over all periods; then a period in
    which a held name has no return goes, with its costs, as do those before the first position. realized is a simple
    return over the holding period. Fees and spreads may be columns (per symbol or per configuration).
    """
    h = max(int(holding), 1)
    own = Window.partitionBy(*keys, "symbol").orderBy("bar_id")
    p = p.withColumn("w_", F.lag(w, delay).over(own) if delay else F.col(w)).filter(F.col("bar_id") % h == 0)
    rate = ((fee_bps if isinstance(fee_bps, Column) else F.lit(float(fee_bps))) + (half_spread_bps if isinstance(half_spread_bps, Column) else F.lit(float(half_spread_bps)))) * 1e-4
    w0 = F.coalesce("w_", F.lit(0.0))
    p = p.withColumn("dw", F.abs(w0 - F.lag(w0, 1).over(own))).withColumn("held", w0 != 0)
    per = p.groupBy(*keys, "ts").agg(
        F.sum(F.col("w_") * F.col(realized)).alias("gross"),
        F.coalesce(F.sum("dw"), F.lit(0.0)).alias("traded"),
        F.coalesce(F.sum(F.col("dw") * rate), F.lit(0.0)).alias("costs"),
        F.sum(F.abs(w0)).alias("exposure"),
        F.max(F.col("held") & F.col(realized).isNull()).alias("open_price"),
        F.max("held").alias("positioned"),
    )
    series = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    first = F.min(F.when(F.col("positioned"), F.col("ts"))).over(series)
    per = per.withColumn("first", first).filter("gross is not null and not open_price and (first is null or ts >= first)")
    return per.select(*keys, "ts", "gross", "costs", (F.col("gross") - F.col("costs")).alias("net"), (F.col("traded") * 0.5).alias("turnover"), "exposure")


def with_curves(periods: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds cum_gross, cum_net and drawdown (from the running maximum, which starts at the first value)."""
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = periods.withColumns({"cum_gross": F.product(1 + F.col("gross")).over(order), "cum_net": F.product(1 + F.col("net")).over(order)})
    return x.withColumn("drawdown", F.col("cum_net") / F.max("cum_net").over(order) - 1)


def backtest_metrics(periods: DataFrame, keys: tuple[str, ...] = (), per_year: float | None = None) -> DataFrame:
    """One row a key: Sharpe ratios, drawdown, turnover, costs, exposure, counts."""
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("ts")
    x = with_curves(periods, keys).withColumn("step", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)) / 1e6)
    ppy = F.lit(float(per_year)) if per_year else periods_per_year("step")
    sharpe = lambda v: F.sqrt(F.col("ppy")) * div(F.col(f"m_{v}"), F.col(f"s_{v}"))
    agg = x.groupBy(*keys).agg(
        ppy.alias("ppy"), *(f(v).alias(f"{k}_{v}") for v in ("net", "gross") for k, f in (("m", F.avg), ("s", F.stddev_samp))),
        F.min("drawdown").alias("max_drawdown_net"), F.avg("turnover").alias("mean_turnover"), F.avg("costs").alias("mean_cost_per_period"), F.avg("exposure").alias("mean_gross_exposure"), F.count("*").alias("n_periods"),
        F.max_by("cum_net", "ts").alias("last_net"),
    )
    return agg.select(
        *keys, F.col("ppy").alias("periods_per_year"), sharpe("net").alias("sharpe_net"), sharpe("gross").alias("sharpe_gross"), "max_drawdown_net", "mean_turnover",
        (F.col("mean_turnover") * F.col("ppy")).alias("annualized_turnover"), "mean_cost_per_period", "mean_gross_exposure", (F.col("last_net") - 1).alias("total_net_return"), "n_periods",
    )


def rolling_sharpe(periods: DataFrame, value: str, window: int, per_year: float) -> DataFrame:
    w = Window.orderBy("ts").rowsBetween(-(window - 1), 0)
    x = F.when(F.count(value).over(w) == window, div(F.avg(value).over(w), F.stddev_samp(value).over(w)))
    return periods.select("ts", (F.sqrt(F.lit(float(per_year))) * x).alias("rolling_sharpe"))


def rolling_mean_series(series: DataFrame, value: str, window: int) -> DataFrame:
    """Mean of the last `window` rows where at least nine tenths of them hold a value."""
    w = Window.orderBy("ts").rowsBetween(-(window - 1), 0)
    return series.select("ts", F.when(F.count(value).over(w) >= int(0.9 * window), F.avg(value).over(w)).alias("rolling_mean"))


def realized_betas(series: DataFrame, strategy: str, market: str, min_regime: int = 10) -> DataFrame:
    """One row: full-sample, up-market and down-market betas, correlation and counts."""
    s, m = F.col(strategy), F.col(market)
    x = series.filter(s.isNotNull() & m.isNotNull())

    def beta(cond: Column, least: int) -> Column:
        a, b = F.when(cond, s), F.when(cond, m)
        return F.when(F.count(b) >= least, div(F.covar_samp(a, b), F.var_samp(b)))

    up, down, every = m > 0, m < 0, F.lit(True)
    n = lambda cond: F.count(F.when(cond, 1))
    return x.agg(
        F.count("*").alias("n_obs"), beta(every, 2).alias("beta_full"), div(F.covar_pop(s, m), F.stddev_pop(s) * F.stddev_pop(m)).alias("corr_full"),
        n(up).alias("n_up"), n(down).alias("n_down"), beta(up, max(min_regime, 2)).alias("beta_up"), beta(down, max(min_regime, 2)).alias("beta_down"),
    )


def rolling_realized_beta(series: DataFrame, strategy: str, market: str, window: int = 20) -> DataFrame:
    """(ts, rolling_beta): covariance over variance of the last `window` rows that hold both; NULL before, or where the
    market does not vary."""
    if window < 2:
        raise ValueError("the window must be at least 2")
    w = Window.orderBy("ts").rowsBetween(-(window - 1), 0)  # one row a period
    x = series.filter(F.col(strategy).isNotNull() & F.col(market).isNotNull())
    beta = div(F.covar_samp(strategy, market).over(w), F.var_samp(market).over(w))
    return x.select("ts", F.when(F.count("*").over(w) == window, beta).alias("rolling_beta"))
