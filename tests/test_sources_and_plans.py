"""Bar files, bar tables, settings, the data pipeline and the streaming bars."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from panelyx.plans import pipeline, settings
from panelyx.sources import bars_csv
from panelyx.streaming.bars import stream_bars

T0 = int(dt.datetime(2023, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def write(folder, name, rows, header=False):
    with open(os.path.join(folder, name), "w") as f:
        if header:
            f.write("timestamp,open,high,low,close,volume,trades\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def hours(n, step=1, price=100.0):
    return [(T0 + 3600 * h, price, price + 1, price - 1, price + h % 2, 2000.0, 5) for h in range(0, n, step)]


def test_read_and_clean(spark, tmp_path):
    write(tmp_path, "ABCUSD_60.csv", [*hours(4), hours(1)[0], (T0 - 600, 1, 1, 1, 1, 1, 1), (T0 + 10**7, 1, 1, 1, 1, 1, 1)], header=True)
    write(tmp_path, "XYZUSD_60.csv", [(T0 + 60, "bad", 2, 1, 1.5, 1, None)])
    write(tmp_path, "EXCUSD_60.csv", hours(2))
    write(tmp_path, "ABCEUR_60.csv", hours(2))
    write(tmp_path, "NONUSD_60.csv", [])
    got = bars_csv.clean(bars_csv.read_raw(spark, f"{tmp_path}/*.csv", 60, ("EXC",)), "2022-12-31 23:59:59", "2023-01-02 23:59:59")
    rows = {(r.symbol, r.ts): r for r in got.collect()}
    assert sorted({s for s, _ in rows}) == ["ABC/USD", "XYZ/USD"] and len(rows) == 5
    odd = rows["XYZ/USD", dt.datetime(2023, 1, 1, 0, 1)]
    assert odd.open is None and odd.trades is None and odd.close == 1.5
    assert bars_csv.file_of("XBT/USD", 1) == "XBTUSD_1.csv"


def test_tables_replace_partitions_and_upsert(spark, tmp_path):
    write(tmp_path, "ABCUSD_60.csv", hours(6, 2))
    write(tmp_path, "DEFUSD_60.csv", hours(3))
    store = f"{tmp_path}/ohlcv"
    t = bars_csv.load_hourly(spark, f"{tmp_path}/*USD_60.csv", store)
    assert t.count() == 8 and t.filter("symbol = 'ABC/USD' and volume = 0").count() == 2
    one = t.filter("symbol = 'DEF/USD'").limit(1).withColumn("close", F.lit(7.0)).checkpoint()
    bars_csv.upsert(spark, one, store)
    t = spark.read.schema(bars_csv.BARS).parquet(store)
    assert t.count() == 8 and t.filter("close = 7").count() == 1
    assert bars_csv.fetch(spark, store, "2023-01-01 01:00:00", "2023-01-01 02:00:00", ["ABC/USD"]).count() == 2


def test_minute_loads(spark, tmp_path):
    write(tmp_path, "ABCUSD_1.csv", [(T0 + 60 * m, 1, 1, 1, c, 1, None) for m, c in ((0, 1.0), (1, None), (5, 2.0))])
    write(tmp_path, "OUTUSD_1.csv", [(T0, 1, 1, 1, 1, 1, 1)])
    u = spark.createDataFrame([("ABC/USD",)], "symbol string")
    t = bars_csv.load_minutes(spark, f"{tmp_path}/*USD_1.csv", f"{tmp_path}/m", u)
    assert sorted((r.ts.minute, r.trades, r.dollar_volume) for r in t.collect()) == [(0, 0, 1.0), (5, 0, 2.0)]
    assert bars_csv.load_minutes(spark, f"{tmp_path}/*USD_1.csv", f"{tmp_path}/m", u).count() == 2
    for bad in ({"universe": u.limit(0)}, {"universe": u, "mode": "other"}):
        with pytest.raises(ValueError):
            bars_csv.load_minutes(spark, f"{tmp_path}/*USD_1.csv", f"{tmp_path}/m", **bad)


def test_pipeline_runs_and_logs(spark, tmp_path):
    for k, name in enumerate(("ABC", "DEF", "GHI")):
        write(tmp_path, f"{name}USD_60.csv", hours(24 * 70, price=100.0 * (k + 1)))
    s = settings.from_dict(settings.Settings, {"raw_dir": str(tmp_path), "min_listing_days": 10, "min_liquidity_monthly_threshold": 1, "top_n": 2, "warning_thresholds": {"extreme_return_abs": 0.005}})
    store = f"{tmp_path}/store"
    run_id = pipeline.run(spark, s, store)
    log = spark.read.parquet(f"{store}/pipeline_run_summary").collect()
    assert [(r.run_id, r.status, r.n_symbols) for r in log] == [(run_id, "ok", 3)] and log[0].n_events > 0
    assert spark.read.parquet(f"{store}/monthly_universe").filter("rank > 2").count() == 0
    write(tmp_path, "BADUSD_60.csv", [(T0, 1, 0.5, 1, 1, 1, 1)])
    with pytest.raises(ValueError, match="bad_ohlc"):
        pipeline.run(spark, s, store)
    assert sorted(r.status for r in spark.read.parquet(f"{store}/pipeline_run_summary").collect()) == ["failed", "ok"]


BASE = """
top_n: 30
lookback_days: 30
raw_dir: data/raw
data_start_date: 2020-09-30 23:59:59+00:00
data_end_date: 2025-12-31 23:59:59+00:00
minute_data_enabled: true
warning_thresholds: {extreme_return_abs: 0.3, short_life_min_rows: 100}
excluded_bases: [USDT, EUR]
"""


def research(tmp_path, text):
    (tmp_path / "base.yaml").write_text(BASE)
    (tmp_path / "own.yaml").write_text(f"reference_base_config: {tmp_path}/base.yaml\n" + text)
    return settings.load_research(f"{tmp_path}/own.yaml")


def test_research_defaults(tmp_path):
    r = research(tmp_path, "")
    assert (r.signal_timeframe, r.beta_shrinkage, r.beta_min_periods_bars, r.max_hedge_weight, r.max_assets, r.beta_hedge_enabled) == ("4h", 0.2, None, None, None, False)
    assert r.feature_horizons_bars == r.momentum_lookback_grid_bars == (1, 3, 6, 12) and r.universe_top_n_grid == (10, 20) and r.holding_period_grid_bars == (1, 3)
    assert r.execution_delay_minutes == 1 and r.execution_delay_minutes_grid == (0, 1, 5, 15, 30, 60) and r.fee_tier_grid_bps == (2.0,)
    assert (r.reversal_lookback_bars, r.price_zscore_window_bars, r.bollinger_window_bars, r.rsi_window_bars, r.range_position_window_bars, r.extreme_move_threshold_sigma) == (2, 24, 20, 14, 12, 2.0)
    # the base file's own settings, and what follows from them
    assert r.top_n == 30 and r.minute_data_enabled and r.excluded_bases == ("USDT", "EUR") and r.warning_thresholds["extreme_return_abs"] == 0.3 and r.warning_thresholds["high_universe_turnover"] == 0.5
    assert r.train_split_date == r.data_end_date and str(r.data_end_date).startswith("2025-12-31")


def test_research_overrides(tmp_path):
    r = research(tmp_path, """
signal_timeframe: 24h
data_end_date: 2024-06-30 23:59:59+00:00
train_split_date: 2022-06-30 23:59:59+00:00
momentum_skip_grid_bars: [1, 2, 3]
feature_horizons_bars: [5, 10, 20]
holding_period_grid_bars: [1, 14]
cross_sectional_transform_grid: [rank]
universe_top_n_grid: [10, 20]
use_monthly_universe: false
max_assets: 20
beta_min_periods_bars: 70
max_hedge_weight: 2
beta_hedge_enabled: true
residual_space: SIMPLE
fee_bps: 10.0
fee_tier_grid_bps: [5.0, 40.0]
""")  # fmt: skip
    assert str(r.train_split_date).startswith("2022-06-30") and str(r.data_end_date).startswith("2024") and r.residual_space == "simple"
    assert r.max_assets == 20 and r.beta_min_periods_bars == 70 and r.max_hedge_weight == 2.0 and r.beta_hedge_enabled and not r.use_monthly_universe
    assert r.fee_tier_grid_bps == (5.0, 10.0, 40.0)
    assert r.backtest_options() == {"top": 0.2, "bottom": 0.2, "fee_bps": 10.0, "half_spread_bps": 1.0, "delay": 0, "log": True}
    configs = r.momentum_configs()
    assert len(configs) == 3 * 3 * 2 * 2 and configs[0] == {"horizon": 5, "skip": 1, "top_n": 10, "holding": 1, "transform": "rank", "raw": "v5_1", "lag": 4}
    assert len(r.reversal_configs()) == 4 * 2 * 2 and len(r.reversal_configs(("rank", "zscore"))) == 32
    assert dict(settings.as_rows(r))["momentum_skip_grid_bars"] == "[1, 2, 3]"


def test_settings(tmp_path):
    r = settings.from_dict(settings.ResearchSettings, {"fee_bps": "10", "fee_tier_grid_bps": [5, 20]})
    assert r.fee_bps == 10.0 and r.fee_tier_grid_bps == (5.0, 10.0, 20.0)
    for bad in ({"residual_space": "x"}, {"use_minute_execution": True, "execution_delay_bars": 1}, {"market_index_mode": "x"}, {"beta_shrinkage": 2}, {"unknown": 1}):
        with pytest.raises(ValueError):
            settings.from_dict(settings.ResearchSettings, bad)
    with pytest.raises(ValueError):
        settings.Settings(minute_reload_mode="x")
    assert [settings.seconds_of(x) for x in ("1h", "24h", "15m", "1d")] == [3600, 86400, 900, 86400]
    with pytest.raises(ValueError):
        settings.seconds_of("4x")


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    from panelyx.operators.panel import tick_bars

    rows = [(dt.datetime(2023, 1, 1, h, m), "A", float(h * 60 + m), 1.0, h * 60 + m) for h in range(4) for m in (1, 30, 59)]
    ticks = spark.createDataFrame(rows, "ts timestamp, symbol string, price double, size double, seq long")
    ticks.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    q = stream_bars(stream).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    names = ["ts", "symbol", "open", "high", "low", "close", "volume", "trades"]
    got = {tuple(r) for r in spark.table("bars").select(names).collect()}
    want = sorted(tuple(r) for r in tick_bars(ticks).select(names).collect())
    assert got == set(want[:3])  # the last bar waits for the watermark
