"""The data pipeline: load, universe, checks, minute data, warnings, run log."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import quality
from ..operators.universe import monthly_universe
from ..sources import bars_csv
from .settings import Settings


def build_universe(rows: DataFrame, s: Settings) -> DataFrame:
    return monthly_universe(rows, s.top_n, s.lookback_days, s.min_listing_days, s.min_liquidity_monthly_threshold, s.min_liquidity_7d_threshold)


def run(spark: SparkSession, s: Settings, store: str) -> str:
    """Runs everything under `store`, always logs the run, and returns its id; a failure is raised after it is logged."""
    run_id, started = str(uuid.uuid4()), datetime.datetime.now(datetime.timezone.utc)
    status, message, metrics, events = "failed", "", (0, 0), None
    try:
        hourly = bars_csv.load_hourly(spark, f"{s.raw_dir}/*USD_60.csv", f"{store}/ohlcv", s.data_start_date, s.data_end_date, s.excluded_bases)
        build_universe(hourly, s).write.mode("overwrite").parquet(f"{store}/monthly_universe")
        universe = spark.read.schema(bars_csv.UNIVERSE).parquet(f"{store}/monthly_universe")
        quality.run_checks(hourly)
        if s.minute_data_enabled:
            minute = bars_csv.load_minutes(spark, f"{s.raw_dir}/*USD_{s.minute_timeframe_minutes}.csv", f"{store}/ohlcv_1m", universe, s.data_start_date, s.data_end_date, s.minute_reload_mode)
            quality.run_checks(minute, gap_check=False)
            found = quality.cross_timeframe(hourly, minute, universe, s.minute_consistency_sample_symbols, s.minute_consistency_rel_tol).first()
            if found.mismatched:
                raise ValueError(f"{found.mismatched} of {found.compared} hours differ from their minutes")
        events = quality.event_log(hourly, universe, s.warning_thresholds)
        metrics = tuple(quality.run_metrics(hourly).first())
        status = "ok"
    except Exception as e:
        message = str(e)[:1000]
        raise
    finally:
        log(spark, store, run_id, started, status, metrics, events, message)
    return run_id


def log(spark: SparkSession, store: str, run_id: str, started, status: str, metrics: tuple, events: DataFrame | None, message: str) -> None:
    """Appends the run's summary and events; a failing log never hides the run's own outcome."""
    from pyspark.sql import functions as F

    try:
        n = 0
        if events is not None:
            events.select(F.lit(run_id).alias("run_id"), "*").write.mode("append").parquet(f"{store}/pipeline_run_events")
            n = spark.read.schema(bars_csv.RUN_EVENTS).parquet(f"{store}/pipeline_run_events").filter(F.col("run_id") == run_id).count()
        row = (run_id, started, datetime.datetime.now(datetime.timezone.utc), status, *metrics, n, message)
        spark.createDataFrame([row], bars_csv.RUN_SUMMARY).write.mode("append").parquet(f"{store}/pipeline_run_summary")
    except Exception as e:
        print(f"the run could not be logged: {e}")
