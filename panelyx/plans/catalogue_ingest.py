"""Queries over bar files, bar tables, checks, the run log and settings.

The files are written from `events` first: one a symbol, as an exchange would hand them out.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import panel, quality, spreads
from ..sources import bars_csv, scratch
from . import frames as S
from . import pipeline, settings
from .catalogue_events import CS, OHLCV
from .frames import EVENT_ROWS, TICKS, bars, dense, ntz, r8

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


FROM, UPTO = "2024-01-02 00:00:00", "2024-01-20 12:00:00"
HOURS = f"WITH {TICKS}, {bars('hour', 'hb')}"
KEPT = f"{HOURS}, kb AS (SELECT * FROM hb WHERE ts > TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{UPTO}')"
BAR = ", ".join(("ts", "symbol", "base_asset", "quote_asset", "open", "high", "low", "close", "volume", "trades", "dollar_volume"))


def _hours(spark, sf):
    return panel.tick_bars(S.event_ticks(spark, sf), panel.HOUR)


def _shown(rows):
    return ntz(rows.select(*bars_csv.BARS.fieldNames()).withColumn("dollar_volume", rounded("dollar_volume", 6)))


def table_sql(source: str, dollars: str = "close * volume") -> str:
    return f"SELECT ts, symbol || '/USD' AS symbol, symbol AS base_asset, 'USD' AS quote_asset, open, high, low, close, volume, trades, {r8(dollars, 'dollar_volume', 6)} FROM {source}"


@add("ingest_hourly", f"{KEPT}, {dense('kb', 'rows_', 'HOUR')} {table_sql('rows_')}")
def ingest_hourly(spark, sf):
    """Files with headers -> the dense hourly table, read back."""
    files = scratch.write_bar_files(_hours(spark, sf), scratch.folder(spark, "files"), 60, header=True)
    return _shown(bars_csv.load_hourly(spark, f"{files}/*USD_60.csv", scratch.folder(spark, "ohlcv"), FROM, UPTO))


@add("ingest_clean", f"""{HOURS}, rw AS (SELECT ts, symbol, CASE WHEN epoch(ts) // 3600 % 7 = 0 THEN NULL ELSE open END AS open, high, low, close, volume, trades FROM hb
UNION ALL SELECT ts, symbol, open + 1, high, low, close, volume, trades FROM hb WHERE epoch(ts) // 3600 % 5 = 0 UNION ALL SELECT * FROM hb WHERE epoch(ts) // 3600 % 3 = 0)
SELECT ts, symbol || '/USD' AS symbol, symbol AS base_asset, 'USD' AS quote_asset, open, high, low, close, volume, trades FROM rw WHERE symbol <> 'S03' AND ts > TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{UPTO}'
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY open NULLS FIRST, high, low, close, volume, trades) = 1""")
def ingest_clean(spark, sf):
    """Raw files with text for numbers, repeated rows, header lines, an excluded base and other files beside them."""
    b = _hours(spark, sf)
    k = F.floor(F.unix_seconds("ts") / 3600)
    text = lambda df, first=None: df.select("symbol", F.concat_ws(",", F.unix_seconds("ts").cast("string"), first if first is not None else F.col("open").cast("string"), *(F.col(n).cast("string") for n in bars_csv.RAW[2:])).alias("line"))
    lines = text(b, F.when(k % 7 == 0, "n/a").otherwise(F.col("open").cast("string"))).unionByName(text(b.filter(k % 5 == 0).withColumn("open", F.col("open") + 1))).unionByName(text(b.filter(k % 3 == 0)))
    lines = lines.unionByName(b.select("symbol", F.lit(",".join(bars_csv.RAW)).alias("line")).distinct())
    files = lines.withColumn("file", F.concat("symbol", F.lit("USD_60.csv"))).unionByName(lines.withColumn("file", F.concat("symbol", F.lit("EUR_60.csv"))))
    path = scratch.write_lines(files, scratch.folder(spark, "files"))
    return ntz(bars_csv.clean(bars_csv.read_raw(spark, f"{path}/*.csv", 60, ("S03",)), FROM, UPTO).select("ts", "symbol", "base_asset", "quote_asset", *bars_csv.RAW[1:]))


@add("upsert_bars", f"""{HOURS}, {dense('hb', 'rows_', 'HOUR')}, old AS (SELECT * FROM rows_ WHERE symbol < 'S12'), new AS (SELECT * REPLACE (close + 5 AS close, 1.5 AS volume) FROM rows_ WHERE symbol >= 'S08' AND hour(ts) % 4 = 0)
SELECT {BAR} FROM ({table_sql('(SELECT * FROM old ANTI JOIN new USING (ts, symbol) UNION ALL SELECT * FROM new) z')})""")
def upsert_bars(spark, sf):
    """New rows replace stored ones of their keys; symbols that are not stored yet come in."""
    rows = S.hourly_rows(spark, sf).withColumns({"base_asset": F.col("symbol"), "quote_asset": F.lit("USD"), "symbol": F.concat("symbol", F.lit("/USD"))})
    store = scratch.folder(spark, "ohlcv")
    bars_csv.upsert(spark, rows.filter("symbol < 'S12'"), store)
    new = rows.filter("symbol >= 'S08' and hour(ts) % 4 = 0").withColumns({"close": F.col("close") + 5, "volume": F.lit(1.5)}).withColumn("dollar_volume", F.col("close") * F.col("volume"))
    bars_csv.upsert(spark, new, store)
    return _shown(spark.read.schema(bars_csv.BARS).parquet(store))


MINUTES = f"WITH {TICKS}, {bars('minute', 'mb')}"


@add("ingest_minutes", f"""{MINUTES} {table_sql("mb WHERE symbol < 'S06' AND ts > TIMESTAMP '" + FROM + "' AND (symbol >= 'S03' OR ts <= TIMESTAMP '" + UPTO + "')")}""")
def ingest_minutes(spark, sf):
    """Two loads of universe symbols: the second, with a later end, leaves symbols alone that are stored already."""
    files = scratch.write_bar_files(S.minute_rows(spark, sf), scratch.folder(spark, "files"), 1)
    store = scratch.folder(spark, "ohlcv_1m")
    names = lambda k: spark.createDataFrame([(f"S{i:02d}/USD",) for i in range(k)], "symbol string")
    bars_csv.load_minutes(spark, f"{files}/*USD_1.csv", store, names(3), FROM, UPTO)
    return _shown(bars_csv.load_minutes(spark, f"{files}/*USD_1.csv", store, names(6), FROM, None))


@add("fetch_range", f"{HOURS} {table_sql('''hb WHERE symbol IN ('S02', 'S11') AND ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00' ''')}")
def fetch_range(spark, sf):
    """A range scan of a stored table: the symbols prune partitions, the times are pushed down."""
    rows = _hours(spark, sf).withColumns({"base_asset": F.col("symbol"), "quote_asset": F.lit("USD"), "symbol": F.concat("symbol", F.lit("/USD")), "dollar_volume": F.col("close") * F.col("volume")})
    store = scratch.folder(spark, "ohlcv")
    bars_csv.save(rows.select(*bars_csv.BARS.fieldNames()), store)
    return _shown(bars_csv.fetch(spark, store, "2024-01-10 06:00:00", "2024-01-12 18:00:00", ["S02/USD", "S11/USD"]))


@add("file_names", """WITH f AS (SELECT DISTINCT (CASE user_id % 3 WHEN 0 THEN lower(event_type) WHEN 1 THEN upper(event_type) ELSE 'x-' || event_type END) || (CASE user_id % 2 WHEN 0 THEN 'usd' ELSE 'EUR' END) || '_' || (CASE event_id % 2 WHEN 0 THEN 60 ELSE 1 END) || '.csv' AS file FROM events),
g AS (SELECT file, nullif(regexp_extract(upper(file), '^([A-Z0-9]+)USD_60\\.CSV$', 1), '') AS b FROM f), h AS (SELECT file, CASE WHEN b <> 'CLICK' THEN b END AS b FROM g)
SELECT file, b AS base_asset, CASE WHEN b IS NOT NULL THEN 'USD' END AS quote_asset, b || '/USD' AS symbol, replace(b || '/USD', '/', '') || '_60.csv' AS written_as FROM h""")
def file_names(spark, sf):
    """The parts of file names of all kinds, and the names that symbols are written under."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("user_id") % 3 == 0, F.lower("event_type")).when(F.col("user_id") % 3 == 1, F.upper("event_type")).otherwise(F.concat(F.lit("x-"), "event_type"))
    file = F.concat(kind, F.when(F.col("user_id") % 2 == 0, "usd").otherwise("EUR"), F.lit("_"), F.when(F.col("event_id") % 2 == 0, "60").otherwise("1"), F.lit(".csv"))
    parts = bars_csv.name_parts(F.col("file"), 60, ("CLICK",))
    x = e.select(file.alias("file")).distinct().select("file", *(v.alias(k) for k, v in parts.items()))
    tail = bars_csv.file_of("/USD", 60)
    return x.withColumn("written_as", F.concat("base_asset", F.lit(tail)))


@add("pipeline_run", f"""{EVENT_ROWS}, {bars('minute', 'mb')}, u AS (SELECT DISTINCT symbol FROM rows_)
SELECT 'ok' AS status, (SELECT count(*) FROM rows_) AS n_rows, (SELECT count(*) FROM u) AS n_symbols, (SELECT count(*) FROM u) AS n_events, (SELECT count(*) FROM u) AS n_universe, (SELECT count(*) FROM mb) AS n_minutes""")
def pipeline_run(spark, sf):
    """The whole data pipeline from files: load, universe, checks, minutes, warnings, run log."""
    files = scratch.write_bar_files(_hours(spark, sf), scratch.folder(spark, "files"), 60)
    scratch.write_bar_files(S.minute_rows(spark, sf), f"{files}/minutes", 1)
    store = scratch.folder(spark, "store")
    wide = {"extreme_return_abs": 1e9, "liquidity_collapse_ratio": -1.0, "lifecycle_start_late_days": 1000, "lifecycle_end_early_days": 1000, "short_life_min_rows": 10**6, "large_symbol_gap_hours": 1}
    s = settings.from_dict(settings.Settings, {"raw_dir": f"{files}{{,/minutes}}", "top_n": 1000, "min_listing_days": -400, "lookback_days": 400, "min_liquidity_monthly_threshold": 0, "min_liquidity_7d_threshold": 0, "minute_data_enabled": True, "warning_thresholds": wide})
    run_id = pipeline.run(spark, s, store)
    log = spark.read.schema(bars_csv.RUN_SUMMARY).parquet(f"{store}/pipeline_run_summary").filter(F.col("run_id") == run_id)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    u = one(spark.read.schema(bars_csv.UNIVERSE).parquet(f"{store}/monthly_universe").filter("rank <= 1000").select("symbol").distinct(), "n_universe")
    m = one(spark.read.schema(bars_csv.BARS).parquet(f"{store}/ohlcv_1m"), "n_minutes")
    return log.select("status", "n_rows", "n_symbols", "n_events").crossJoin(u).crossJoin(m)  # one row each


@add("checks_report", f"""{EVENT_ROWS}, {bars('minute', 'mb')} SELECT * FROM (VALUES ('hourly', 'bad_ohlc', 0), ('hourly', 'duplicate_keys', 0), ('hourly', 'gaps_sample', 0), ('hourly', 'negative_vals', 0), ('hourly', 'null_rows', 0),
('minute', 'bad_ohlc', 0), ('minute', 'duplicate_keys', 0), ('minute', 'negative_vals', 0), ('minute', 'null_rows', 0)) t(rows_of, check_name, n_found)
UNION ALL SELECT 'faulty', 'bad_ohlc', (SELECT count(*) FROM rows_ WHERE hour(ts) = 3) UNION ALL SELECT 'faulty', 'duplicate_keys', (SELECT count(*) FROM rows_ WHERE hour(ts) = 4)
UNION ALL SELECT 'faulty', 'negative_vals', (SELECT count(*) FROM rows_ WHERE hour(ts) = 5) UNION ALL SELECT 'faulty', 'null_rows', (SELECT count(*) FROM rows_ WHERE hour(ts) = 6)""")
def checks_report(spark, sf):
    """run_checks on sound rows (hourly, minute), and what it finds in rows with faults put in."""
    rows = S.hourly_rows(spark, sf)
    hour = F.hour("ts")
    faulty = rows.withColumns({"high": F.when(hour == 3, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(hour == 5, -1.0).otherwise(F.col("volume")), "open": F.when(hour != 6, F.col("open"))})
    faulty = faulty.unionByName(rows.filter(hour == 4))
    found = [("hourly", k, n) for k, n in quality.run_checks(rows).items()] + [("minute", k, n) for k, n in quality.run_checks(S.minute_rows(spark, sf), gap_check=False).items()]
    found += [("faulty", k, n) for k, n in quality.count_checks(faulty, gap_check=False).items()]
    return spark.createDataFrame(found, "rows_of string, check_name string, n_found int")


@add("half_spread_from_rows", f"""WITH {TICKS}, {bars('hour', 'hb')}, {dense('hb', 'rows_', 'HOUR')},
b AS (SELECT time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01') AS ts, symbol, max(high) AS high, min(low) AS low FROM rows_ WHERE trades > 0 GROUP BY ALL),
v AS (SELECT ts, symbol, CASE WHEN high > 0 AND low > 0 AND high >= low THEN high END AS h, CASE WHEN high > 0 AND low > 0 AND high >= low THEN low END AS l FROM b),
v1 AS (SELECT *, lag(h) OVER w AS h1, lag(l) OVER w AS l1, ts - lag(ts) OVER w = INTERVAL 4 HOUR AS near FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
v2 AS (SELECT *, ln(h / l) ** 2 + ln(h1 / l1) ** 2 AS be, ln(greatest(h, h1) / least(l, l1)) ** 2 AS ga FROM v1),
cs AS (SELECT symbol, near, {CS} AS s FROM (SELECT *, (sqrt(2 * be) - sqrt(be)) / {spreads.DENOMINATOR!r} - sqrt(ga / {spreads.DENOMINATOR!r}) AS al FROM v2))
SELECT symbol, {r8('CASE WHEN count(s) FILTER (WHERE near) >= 20 THEN avg(s) FILTER (WHERE near) / 2 * 1e4 END', 'half_spread_bps', 6)} FROM cs GROUP BY symbol""")
def half_spread_from_rows(spark, sf):
    x = spreads.half_spread_from_rows(S.hourly_rows(spark, sf).select(*OHLCV), 4 * 3600, "mean", 20)
    return x.select("symbol", rounded("half_spread_bps", 6).alias("half_spread_bps"))


#: A research file's content, and what it must become (fixed values).
RESEARCH = {"signal_timeframe": "24h", "holding_period_bars": 20, "momentum_lookback_bars": 30, "momentum_skip_bars": 1, "vol_window_bars": 14, "beta_min_periods_bars": 70, "feature_horizons_bars": [5, 10, 20, 40, 60], "momentum_skip_grid_bars": [1, 2, 3],
            "holding_period_grid_bars": [1, 3, 5, 10, 14, 21, 30, 40], "cross_sectional_transform_grid": ["rank"], "max_assets": 20, "cross_sectional_transform": "rank", "fee_bps": 10.0, "fee_tier_grid_bps": [5.0, 20.0, 40.0], "data_end_date": "2024-06-30 23:59:59"}
EXPECTED = {
    "signal_timeframe": '"24h"', "holding_period_bars": "20", "momentum_lookback_bars": "30", "beta_min_periods_bars": "70", "beta_shrinkage": "0.2", "beta_window_bars": "90", "max_hedge_weight": "null",
    "feature_horizons_bars": "[5, 10, 20, 40, 60]", "universe_top_n_grid": "[10, 20]", "fee_tier_grid_bps": "[5.0, 10.0, 20.0, 40.0]", "train_split_date": '"2024-06-30 23:59:59"', "use_monthly_universe": "true",
    "execution_delay_minutes_grid": "[0, 1, 5, 15, 30, 60]", "extreme_move_threshold_sigma": "2.0", "max_assets": "20", "minute_reload_mode": '"if_empty"', "lookback_days": "30",
}
BACKTEST = '{"bottom": 0.2, "delay": 0, "fee_bps": 10.0, "half_spread_bps": 1.0, "log": true, "top": 0.2}'


@add("research_settings", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in EXPECTED.items()) + ") t(setting, value) UNION ALL SELECT 'n_momentum_configs', '240' UNION ALL SELECT 'n_reversal_configs', '64' UNION ALL SELECT 'backtest_options', '" + BACKTEST + "'")
def research_settings(spark, sf):
    s = settings.from_dict(settings.ResearchSettings, RESEARCH)
    rows = [r for r in settings.as_rows(s) if r[0] in EXPECTED]
    return spark.createDataFrame([*rows, ("n_momentum_configs", str(len(s.momentum_configs()))), ("n_reversal_configs", str(len(s.reversal_configs()))), ("backtest_options", json.dumps(s.backtest_options(), sort_keys=True))], "setting string, value string")
