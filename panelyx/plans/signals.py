"""End-to-end signals from long OHLCV rows, and the resolver of feature names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bar_return, cross_section, div
from ..operators import features, panel
from .settings import ResearchSettings, seconds_of


def finish(p: DataFrame, raw: str, universe: DataFrame | None, transform: str, min_assets: int, rebalance: int) -> DataFrame:
    """Mask, transform across symbols, decimate: (ts, bar_id, symbol, close, raw, signal)."""
    p = panel.member_mask(p, universe).withColumn("masked", panel.in_universe(raw))
    p = p.withColumn("signal", cross_section("masked", transform, min_assets))
    return p.withColumn("signal", panel.decimate("signal", rebalance)).drop("masked")


def momentum_signal(rows: DataFrame, timeframe: str, lookback: int, skip: int = 0, universe: DataFrame | None = None, transform: str = "zscore", min_assets: int = 6, log: bool = True, rebalance: int = 1) -> DataFrame:
    p = panel.panel(panel.check_long(rows), seconds_of(timeframe)).withColumn("r", bar_return("close", log=log))
    return finish(p.withColumn("raw", features.momentum_score("r", lookback, skip, log)), "raw", universe, transform, min_assets, rebalance)


def reversal_signal(rows: DataFrame, timeframe: str, lookback: int, universe: DataFrame | None = None, transform: str = "rank", min_assets: int = 6, log: bool = True, rebalance: int = 1) -> DataFrame:
    p = panel.panel(panel.check_long(rows), seconds_of(timeframe))
    return finish(p.withColumn("raw", -bar_return("close", lookback, log=log)), "raw", universe, transform, min_assets, rebalance)


def residual_signal(p: DataFrame, returns: str, beta: str, market: str, horizon: int, skip: int = 0, feature: str = "residual_momentum_scaled", universe: DataFrame | None = None, transform: str = "zscore", min_assets: int = 6) -> DataFrame:
    p = p.withColumn("resid", F.col(returns) - F.col(beta) * F.col(market))
    return finish(p.withColumn("raw", features.residual_momentum("resid", horizon, skip)[feature]), "raw", universe, transform, min_assets, 1)


def feature_pack(p: DataFrame, horizons: list[int], benchmark: str, vol_window: int = 24, log: bool = True, space: str = "log", skip: int = 0, mask: str | None = None) -> DataFrame:
    """One wide-by-feature frame: core_h, and per horizon the relative and volatility-adjusted features.

    What looks along a symbol comes first for all horizons, then what looks across symbols: two exchanges in all.
    """
    p = p.withColumns({f"core_{h}": bar_return("close", h, skip, log) for h in horizons})
    p = p.withColumns({f"{n}_{h}": v for h in horizons for n, v in features.vol_adjusted(f"core_{h}", vol_window).items()})
    for h in horizons:
        p = features.relative_returns(p, f"core_{h}", benchmark, space, log, mask)
        p = p.withColumnsRenamed({n: f"{n}_{h}" for n in ("minus_xsec_mean", "minus_benchmark")})
    return p


#: Families of the pack and the variants each offers.
FAMILIES = {"core": ("core",), "relative": ("minus_xsec_mean", "minus_benchmark"), "vol_adjusted": ("rolling_vol", "ret_over_vol", "zscored_return"), "residual": ("residual_momentum", "residual_momentum_scaled"), "baseline": ("signal",)}


def feature_column(family: str, horizon: int | None = None, variant: str | None = None, available: list[int] | None = None) -> str:
    """The pack's column of a family, horizon and variant; KeyError names what is unknown."""
    if family not in FAMILIES:
        raise KeyError(f"unknown family {family!r}")
    if family == "baseline":
        return "signal"
    if horizon is None or (available is not None and horizon not in available):
        raise KeyError(f"unknown horizon {horizon!r}")
    variant = variant or FAMILIES[family][-1]
    if variant not in FAMILIES[family]:
        raise KeyError(f"unknown variant {variant!r} of {family}")
    return f"{variant}_{horizon}"


def reversal_feature(p: DataFrame, name: str, s: ResearchSettings, mask: str | None = None) -> DataFrame:
    """Adds the reversal feature of that name, as a column of that name; KeyError for an unknown one.

    p is a panel with r, the one-bar return. Names are a family of features.HORIZON_FEATURES with an ending _h<n>, or one
    of features.WINDOW_FEATURES; windows come from the settings (the moving average takes that of the volume-weighted price).
    """
    family, h = features.horizon_of(name)
    if h is not None and family in features.REVERSAL_FAMILIES:
        return features.reversal_family(p, name, family, h, s.vol_window_bars, s.log_returns, mask)
    if h is not None and family in features.HORIZON_FEATURES:
        move, ratio = -bar_return("close", h, log=s.log_returns), features.volume_ratio("volume", s.volume_window_bars)
        return p.withColumn(name, div(move, ratio) if family == "vol_exhaustion" else move * ratio)
    if name not in features.WINDOW_FEATURES:
        raise KeyError(f"unknown feature {name!r}")
    if name == "xsec_rank_price_z":
        p = p.withColumn(name, features.price_zscore("close", s.price_zscore_window_bars))
        return p.withColumn(name, features.xsec_rank_of(name, s.min_assets_per_timestamp))
    extreme = features.extreme_move("r", s.vol_window_bars, s.extreme_move_threshold_sigma)
    found = {
        "price_zscore": features.price_zscore("close", s.price_zscore_window_bars),
        "bollinger_touch": features.bollinger_touch("close", s.bollinger_window_bars),
        "extreme_signed_z": extreme["extreme_z"],
        "extreme_flag": extreme["extreme_reversal"],
        "distance_from_vwap": features.vwap_distance("close", "volume", s.vwap_window_bars),
        "distance_from_ma": features.ma_distance("close", s.vwap_window_bars),
        "rsi_proxy": features.rsi_proxy("r", s.rsi_window_bars),
        "range_position": features.range_position("close", s.range_position_window_bars),
    }
    return p.withColumn(name, found[name])


def reversal_names(horizons: tuple[int, ...]) -> list[str]:
    """Every reversal feature's name, families of all horizons first."""
    return [f"{f}_h{h}" for f in features.HORIZON_FEATURES for h in horizons] + list(features.WINDOW_FEATURES)
