"""Time-series features as column expressions over a dense panel; features of one window share its sort.

`r` is the one-bar return column unless said otherwise. Lookbacks count panel rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bar_return, by_time, c, cross_section, div, full, masked_mean, rolling_mean, rolling_std, simple, trailing


def momentum_score(r: str, lookback: int, skip: int = 0, log: bool = True) -> Column:
    """Compounded return of the last `lookback` bars, ending `skip` bars ago."""
    w = Window.partitionBy("symbol").orderBy("bar_id").rowsBetween(-(lookback - 1) - skip, -skip)
    return F.when(F.count(r).over(w) == lookback, F.sum(r).over(w) if log else F.product(1 + F.col(r)).over(w) - 1)


def vol_adjusted(ret: str, window: int) -> dict[str, Column]:
    """Of a horizon-return column: rolling deviation, return over it, and the standardised return."""
    if window <= 1:
        raise ValueError("the window must exceed 1")
    sd = rolling_std(ret, window)
    return {"rolling_vol": sd, "ret_over_vol": div(c(ret), sd), "zscored_return": div(c(ret) - rolling_mean(ret, window), sd)}


def price_zscore(x: str, window: int) -> Column:
    return div(-(c(x) - rolling_mean(x, window)), rolling_std(x, window))


def bollinger_touch(x: str, window: int, n_std: float = 2.0) -> Column:
    m, s = rolling_mean(x, window), rolling_std(x, window)
    low, high = m - n_std * s, m + n_std * s
    return F.when(low.isNotNull() & c(x).isNotNull(), F.when(c(x) < low, 1.0).when(c(x) > high, -1.0).otherwise(0.0))


def vol_adjusted_move(x: str, r: str, horizon: int, window: int, log: bool | str = True) -> Column:
    return div(-bar_return(x, horizon, log=log), rolling_std(r, window))


def extreme_move(r: str, window: int, sigma: float) -> dict[str, Column]:
    z = div(c(r) - rolling_mean(r, window), rolling_std(r, window))
    far = F.abs(z) > sigma
    return {"extreme_z": -z, "extreme_reversal": F.when(far, -z), "extreme_magnitude": F.when(far, F.abs(z))}


def volume_ratio(volume: str, window: int, low: float = 0.1, high: float = 10.0) -> Column:
    x = div(c(volume), rolling_mean(volume, window))
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def vwap_distance(x: str, volume: str, window: int) -> Column:
    v = F.when(c(x).isNotNull(), c(volume))
    cv = c(x) * c(volume)
    vwap = div(full(cv, window, F.sum(cv).over(trailing(window))), full(v, window, F.sum(v).over(trailing(window))))
    return div(-(c(x) - vwap), c(x))


def ma_distance(x: str, window: int) -> Column:
    return div(-(c(x) - rolling_mean(x, window)), c(x))


def rsi_proxy(r: str, window: int) -> Column:
    gain = F.when(c(r).isNotNull(), F.greatest(c(r), F.lit(0.0)))
    loss = F.when(c(r).isNotNull(), F.greatest(-c(r), F.lit(0.0)))
    g, l = rolling_mean(gain, window), rolling_mean(loss, window)
    return 0.5 - div(g, g + l)


def range_position(x: str, window: int) -> Column:
    lo, hi = (full(x, window, f(c(x)).over(trailing(window))) for f in (F.min, F.max))
    return -(div(c(x) - lo, hi - lo) - 0.5)


def xsec_rank_of(z: str, min_assets: int) -> Column:
    """Minus the percentile rank across symbols; z must be a column of the frame."""
    return -cross_section(z, "rank", min_assets)


def relative_returns(p: DataFrame, ret: str, benchmark: str, space: str = "log", log: bool = True, mask: str | None = None) -> DataFrame:
    """Adds minus_xsec_mean and minus_benchmark of a return column, in log or simple space."""
    if space not in ("log", "simple"):
        raise ValueError("space must be log or simple")
    x = c(ret)
    if space == "simple" and log:
        x = simple(x)
    elif space == "log" and not log:
        x = F.ln(1 + x)
    bench = F.max(F.when(F.col("symbol") == benchmark, x)).over(by_time())
    return p.withColumns({"minus_xsec_mean": x - masked_mean(x, F.col(mask) if mask else None), "minus_benchmark": x - bench})


def market_index(p: DataFrame, ret: str, mode: str = "equal_weight", benchmark: str | None = None, mask: str | None = None, min_assets: int = 1) -> DataFrame:
    """(ts, market): mean over members, NULL below min_assets; or the benchmark's column."""
    if mode == "benchmark":
        return p.filter(F.col("symbol") == benchmark).select("ts", F.col(ret).alias("market"))
    if mode != "equal_weight":
        raise ValueError(f"unknown mode {mode!r}")
    x = F.when(F.col(mask), F.col(ret)) if mask else F.col(ret)
    return p.groupBy("ts").agg(F.when(F.count(x) >= min_assets, F.avg(x)).alias("market"))


def rolling_beta(r: str, m: str, window: int, min_periods: int | None = None, shrinkage: float = 0.0, target: float = 1.0) -> Column:
    """Cov / Var over pairs of the window; NULL below min_periods or at zero variance; shrunk linearly."""
    if not 0 <= shrinkage <= 1:
        raise ValueError("shrinkage must lie in [0, 1]")
    w = trailing(window)
    beta = F.when(F.regr_count(F.col(r), F.col(m)).over(w) >= (min_periods or window), F.regr_slope(F.col(r), F.col(m)).over(w))
    return (1 - shrinkage) * beta + shrinkage * target if shrinkage else beta


def residual_momentum(e: str, horizon: int, skip: int = 0) -> dict[str, Column]:
    w = Window.partitionBy("symbol").orderBy("bar_id").rowsBetween(-(horizon - 1) - skip, -skip)
    ok = F.count(e).over(w) == horizon
    s = F.when(ok, F.sum(e).over(w))
    return {"residual_momentum": s, "residual_momentum_scaled": div(s, F.when(ok, F.stddev_pop(e).over(w)))}


def composite(p: DataFrame, names: list[str], min_assets: int, min_features: int) -> DataFrame:
    """Adds `composite`: mean of the features' cross-sectional z-scores, NULL below min_features."""
    z = {f"z_{n}": cross_section(n, "zscore", min_assets) for n in names}
    p = p.withColumns(z)
    held = sum((F.col(k).isNotNull().cast("int") for k in z), F.lit(0))
    total = sum((F.coalesce(k, F.lit(0.0)) for k in z), F.lit(0.0))
    return p.withColumn("composite", F.when(held >= min_features, total / held)).drop(*z)


def reversal_family(p: DataFrame, out: str, family: str, lookback: int, vol_window: int = 14, log: bool | str = True, mask: str | None = None) -> DataFrame:
    """Adds `out`, one of four families at a lookback: minus the return, over the volatility if the family says so.

    The xsec families subtract the mean across symbols: xsec_reversal that of the mask's members, vol_adj_xsec_reversal
    that of all. p has close and r, the one-bar return.
    """
    if family not in REVERSAL_FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    p = p.withColumn(out, vol_adjusted_move("close", "r", lookback, vol_window, log) if family.startswith("vol_adj") else -bar_return("close", lookback, log=log))
    if "xsec" not in family:
        return p
    return p.withColumn(out, F.col(out) - masked_mean(out, F.col(mask) if mask and family == "xsec_reversal" else None))


#: Families of the reversal sweep; features with a horizon in their names (prefix); other features.
REVERSAL_FAMILIES = ("reversal", "xsec_reversal", "vol_adj_reversal", "vol_adj_xsec_reversal")
HORIZON_FEATURES = (*REVERSAL_FAMILIES, "vol_exhaustion", "vol_blowoff")
WINDOW_FEATURES = ("price_zscore", "bollinger_touch", "extreme_signed_z", "extreme_flag", "distance_from_vwap", "distance_from_ma", "rsi_proxy", "range_position", "xsec_rank_price_z")

#: Part of a feature's name, and the setting that holds its window.
FIXED_WINDOWS = {
    "price_zscore": "price_zscore_window_bars",
    "bollinger": "bollinger_window_bars",
    "rsi": "rsi_window_bars",
    "range": "range_position_window_bars",
    "xsec_rank_price_z": "price_zscore_window_bars",
}


def horizon_of(name: str) -> tuple[str, int | None]:
    """(name without its _h<n> ending, n or None)."""
    head, _, tail = name.rpartition("_h")
    return (head, int(tail)) if head and tail.isdigit() else (name, None)


def feature_lookback(name: str, settings) -> int:
    """The lookback of a feature for Newey-West lags: its horizon, else the window of its kind, else the reversal's."""
    horizon = horizon_of(name)[1]
    key = next((key for part, key in FIXED_WINDOWS.items() if part in name), "reversal_lookback_bars")
    return horizon if horizon is not None else int(getattr(settings, key))
