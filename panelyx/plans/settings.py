"""Settings: frozen dataclasses with the engine's defaults, read from YAML and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from ..operators.quality import THRESHOLDS
from ..operators.selection import grid, ic_lag


@dataclass(frozen=True)
class Settings:
    """Data pipeline."""

    top_n: int = 30
    lookback_days: int = 30
    min_listing_days: int = 90
    min_liquidity_monthly_threshold: float = 50_000.0
    min_liquidity_7d_threshold: float = 50_000.0
    raw_dir: str = "raw"
    data_start_date: str | None = None
    data_end_date: str | None = None
    minute_data_enabled: bool = False
    minute_timeframe_minutes: int = 1
    minute_reload_mode: str = "if_empty"
    minute_consistency_sample_symbols: int = 5
    minute_consistency_rel_tol: float = 1e-6
    warning_thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    excluded_bases: tuple[str, ...] = ()

    def __post_init__(self):
        if self.minute_reload_mode not in ("if_empty", "replace"):
            raise ValueError("minute_reload_mode must be if_empty or replace")


@dataclass(frozen=True)
class ResearchSettings(Settings):
    """Signal research, on top of the data pipeline's settings. Names and defaults are fixed values: files rely on them."""

    reference_base_config: str | None = None
    signal_timeframe: str = "4h"
    ic_rebalance_bars: int = 1
    holding_period_bars: int = 1
    execution_delay_bars: int = 0
    use_minute_execution: bool = False
    execution_delay_minutes: int = 1
    execution_delay_minutes_grid: tuple[int, ...] = (0, 1, 5, 15, 30, 60)
    market_index_mode: str = "equal_weight"
    beta_window_bars: int = 90
    beta_min_periods_bars: int | None = None
    beta_shrinkage: float = 0.2
    beta_shrink_target: float = 1.0
    beta_hedge_enabled: bool = False
    max_hedge_weight: float | None = None
    momentum_lookback_bars: int = 6
    momentum_skip_bars: int = 0
    log_returns: bool = True
    vol_window_bars: int = 24
    benchmark_symbol: str = "XBT/USD"
    residual_space: str = "log"
    use_monthly_universe: bool = True
    max_assets: int | None = None
    cross_sectional_transform: str = "zscore"
    feature_horizons_bars: tuple[int, ...] = (1, 3, 6, 12)
    momentum_lookback_grid_bars: tuple[int, ...] = (1, 3, 6, 12)
    momentum_skip_grid_bars: tuple[int, ...] = (0,)
    holding_period_grid_bars: tuple[int, ...] = (1, 3)
    cross_sectional_transform_grid: tuple[str, ...] = ("rank", "zscore")
    universe_top_n_grid: tuple[int, ...] = (10, 20)
    min_assets_per_timestamp: int = 6
    top_quantile: float = 0.2
    bottom_quantile: float = 0.2
    fee_bps: float = 2.0
    half_spread_bps: float = 1.0
    fee_tier_grid_bps: tuple[float, ...] = ()
    rolling_window_bars: int = 60
    extreme_event_quantile: float = 0.99
    train_split_date: str | None = None
    reversal_lookback_bars: int = 2
    price_zscore_window_bars: int = 24
    bollinger_window_bars: int = 20
    vwap_window_bars: int = 24
    volume_window_bars: int = 24
    rsi_window_bars: int = 14
    range_position_window_bars: int = 12
    extreme_move_threshold_sigma: float = 2.0

    def __post_init__(self):
        super().__post_init__()
        put = lambda k, v: object.__setattr__(self, k, v)
        for k in ("residual_space", "market_index_mode"):
            put(k, getattr(self, k).lower())
        if self.residual_space not in ("log", "simple"):
            raise ValueError("residual_space must be log or simple")
        if self.use_minute_execution and self.execution_delay_bars > 0:
            raise ValueError("minute execution holds the delay already: execution_delay_bars must be 0")
        if self.market_index_mode not in ("equal_weight", "benchmark"):
            raise ValueError("market_index_mode must be equal_weight or benchmark")
        if not 0 <= self.beta_shrinkage <= 1:
            raise ValueError("beta_shrinkage must lie in [0, 1]")
        for k, kind in (("beta_min_periods_bars", int), ("max_hedge_weight", float), ("max_assets", int)):
            if getattr(self, k) is not None:
                put(k, kind(getattr(self, k)))
        for f in fields(self):
            if f.type.startswith("tuple[int"):
                put(f.name, tuple(map(int, getattr(self, f.name))))
        # The headline fee is always one of the tiers.
        put("fee_tier_grid_bps", tuple(sorted({*map(float, self.fee_tier_grid_bps), float(self.fee_bps)})))
        put("train_split_date", self.train_split_date or self.data_end_date)

    def backtest_options(self) -> dict:
        """What a sweep hands to its backtests."""
        return {"top": self.top_quantile, "bottom": self.bottom_quantile, "fee_bps": self.fee_bps, "half_spread_bps": self.half_spread_bps, "delay": self.execution_delay_bars, "log": self.log_returns}

    def reversal_configs(self, transforms: tuple[str, ...] | None = None) -> list[dict]:
        """The reversal sweep's axes: lookback, holding, transform, universe size; raw names the column `v<lookback>`."""
        axes = grid(lookback=list(self.momentum_lookback_grid_bars), top_n=list(self.universe_top_n_grid), holding=list(self.holding_period_grid_bars), transform=list(transforms or self.cross_sectional_transform_grid))
        return [c | {"raw": f"v{c['lookback']}", "lag": ic_lag(c["holding"], c["lookback"], self.ic_rebalance_bars)} for c in axes]

    def momentum_configs(self) -> list[dict]:
        """The momentum sweep's axes: horizon, skip, holding, transform, universe size; raw names the column `v<horizon>_<skip>`."""
        axes = grid(horizon=list(self.feature_horizons_bars), skip=list(self.momentum_skip_grid_bars), top_n=list(self.universe_top_n_grid), holding=list(self.holding_period_grid_bars), transform=list(self.cross_sectional_transform_grid))
        return [c | {"raw": f"v{c['horizon']}_{c['skip']}", "lag": ic_lag(c["holding"], c["horizon"], self.ic_rebalance_bars)} for c in axes]


def seconds_of(timeframe: str) -> int:
    """"4h", "24h", "15m", "1d" in seconds."""
    unit = {"m": 60, "h": 3600, "d": 86400}.get(timeframe[-1:])
    if not unit or not timeframe[:-1].isdigit():
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return int(timeframe[:-1]) * unit


def from_dict(kind: type, values: dict):
    """Unknown keys are refused; values take the type of the default (a date may be text or a timestamp)."""
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings: {sorted(extra)}")
    base = kind()
    cast = {}
    for k, v in values.items():
        like = getattr(base, k)
        cast[k] = v if like is None or v is None else (like | v if isinstance(like, dict) else tuple(v) if isinstance(like, tuple) else type(like)(v))
    return replace(base, **cast)


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load(kind: type, *paths: str):
    """Later files override earlier ones."""
    merged: dict = {}
    for p in paths:
        merged |= read_yaml(p)
    return from_dict(kind, merged)


def load_research(path: str, base: str | None = None) -> ResearchSettings:
    """A research file over its base file: the one given, else the one that it names (seen from the working folder)."""
    own = read_yaml(path)
    base = base or own.get("reference_base_config")
    return from_dict(ResearchSettings, (read_yaml(base) if base else {}) | own)


def as_rows(settings) -> list[tuple[str, str]]:
    """(name, value as JSON) of every setting, by name."""
    return sorted((f.name, json.dumps(getattr(settings, f.name), default=str, sort_keys=True)) for f in fields(settings))
