"""Tumbling OHLCV bars from a stream of ticks: the streaming form of panel.tick_bars (an addition of this engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """ticks: streaming (ts, symbol, price, size, seq). Ticks later than `late` behind the newest are dropped; append mode
    emits a bar once the watermark has passed its end."""
    at = F.struct("ts", "seq")
    bar = F.window("ts", f"{seconds} seconds")
    out = ticks.withWatermark("ts", late).groupBy(bar.alias("w"), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trades")
    )
    return out.select(F.col("w.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume", "trades")
