"""Execution prices some minutes after the signal: bucket closes, carried-forward panels, delay sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, log_return


def exec_closes(minutes: DataFrame, delay_minutes: int, start=None, end=None, symbols: list[str] | None = None) -> DataFrame:
    """(bucket_ts, symbol, exec_close): the last close of each hour that is shifted by the delay.

    The scan's end is extended by an hour and the delay, so that the last bucket is whole.
    """
    if delay_minutes < 0:
        raise ValueError("the delay must not be negative")
    x = minutes
    if start is not None:
        x = x.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        x = x.filter(F.col("ts") < F.lit(end).cast("timestamp") + F.expr(f"interval {60 + delay_minutes} minutes"))
    if symbols is not None:
        x = x.filter(F.col("symbol").isin(symbols))
    bucket = F.date_trunc("hour", F.col("ts") - F.expr(f"interval {delay_minutes} minutes"))
    return x.groupBy(bucket.alias("bucket_ts"), "symbol").agg(F.max_by("close", "ts").alias("exec_close"))


def exec_closes_sweep(minutes: DataFrame, delays: list[int]) -> DataFrame:
    """The same for several delays in one job: (delay, bucket_ts, symbol, exec_close)."""
    if min(delays) < 0:
        raise ValueError("delays must not be negative")
    x = minutes.withColumn("delay", F.explode(F.array(*[F.lit(int(d)) for d in delays])))
    bucket = F.date_trunc("hour", F.timestamp_micros(F.unix_micros("ts") - F.col("delay") * 60_000_000))
    return x.groupBy("delay", bucket.alias("bucket_ts"), "symbol").agg(F.max_by("close", "ts").alias("exec_close"))


def exec_panel(p: DataFrame, closes: DataFrame, fallback: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds exec_close, fill ('direct', 'locf', 'fallback' or NULL) and direct to a panel's cells (a copy of them per key).

    Buckets are carried forward over the hours they and the panel cover, never backwards; the signal's own close fills
    what is left if fallback is set.
    """
    cells = p.select("ts", "bar_id", "symbol", "close")
    for k in keys:  # the keys are configurations: few, known values
        values = [r[0] for r in closes.select(k).distinct().orderBy(k).collect()]
        cells = cells.withColumn(k, F.explode(F.array(*map(F.lit, values))))
    on = [*keys, "ts", "symbol"]
    every = cells.withColumn("cell", F.lit(True)).join(closes.withColumnRenamed("bucket_ts", "ts"), on, "full_outer")
    order = Window.partitionBy(*keys, "symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("carried", F.last("exec_close", ignorenulls=True).over(order)).filter("cell")
    fill = F.when(F.col("exec_close").isNotNull(), "direct").when(F.col("carried").isNotNull(), "locf")
    price = F.coalesce("exec_close", "carried")
    if fallback:
        fill = F.coalesce(fill, F.when(F.col("close").isNotNull(), "fallback"))
        price = F.coalesce(price, "close")
    return every.select(*keys, "ts", "bar_id", "symbol", "close", price.alias("exec_price"), fill.alias("fill"), F.col("exec_close").isNotNull().alias("direct")).withColumnRenamed("exec_price", "exec_close")


def fill_counts(x: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    n = lambda v: F.count(F.when(F.col("fill") == v, 1))
    return x.groupBy(*keys).agg(F.count("*").alias("cells"), n("direct").alias("direct_cells"), n("locf").alias("locf_cells"), n("fallback").alias("fallback_cells"), F.count(F.when(F.col("fill").isNull(), 1)).alias("empty_cells"))


def exec_forward(x: DataFrame, holding: int, log: bool | str = True, direct_only: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds exec_fwd: return of the execution closes over the holding period, with direct fills at both ends if asked."""
    if holding <= 0:
        raise ValueError("the holding period must be positive")
    w = Window.partitionBy(*keys, "symbol").orderBy("bar_id")
    r = log_return(div(F.lead("exec_close", holding).over(w), F.col("exec_close")), log)
    if direct_only:
        r = F.when(F.col("direct") & F.lead("direct", holding, False).over(w), r)
    return x.withColumn("exec_fwd", r)


def zero_delay_mismatch(p: DataFrame, closes: DataFrame) -> DataFrame:
    """One row: hours compared, hours that differ, largest relative difference of zero-delay closes and panel closes."""
    both = p.filter("volume > 0").join(closes.withColumnRenamed("bucket_ts", "ts"), ["ts", "symbol"])
    rel = F.abs(div(F.col("exec_close") - F.col("close"), F.col("close")))
    return both.agg(F.count("*").alias("compared"), F.count(F.when(rel > 0, 1)).alias("n_mismatch"), F.max(rel).alias("max_rel_diff"))


def assert_zero_delay(p: DataFrame, closes: DataFrame, rtol: float = 1e-9) -> None:
    row = zero_delay_mismatch(p, closes).first()
    if row.max_rel_diff is not None and row.max_rel_diff >= rtol:
        raise AssertionError(f"zero-delay closes differ from the bars' closes by up to {row.max_rel_diff}")


class ExecutionPrices:
    """Close panels per delay, made once each and kept persisted until release()."""

    def __init__(self, minutes: DataFrame, p: DataFrame):
        self.minutes, self.panel, self.held = minutes, p, {}

    def close_panel(self, delay: int) -> DataFrame:
        if delay not in self.held:
            self.held[delay] = exec_panel(self.panel, exec_closes(self.minutes, delay)).persist()
        return self.held[delay]

    def diagnostics(self, delay: int) -> DataFrame:
        return fill_counts(self.close_panel(delay))

    def forward_returns(self, delay: int, holding: int, log: bool | str = True) -> DataFrame:
        return exec_forward(self.close_panel(delay), holding, log, direct_only=True)

    def release(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()

