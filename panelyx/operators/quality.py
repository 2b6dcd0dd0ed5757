"""Data-quality checks and warnings over OHLCV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div
from .universe import turnover

#: Default warning thresholds.
THRESHOLDS = {
    "extreme_return_abs": 0.2,
    "large_symbol_gap_hours": 1,
    "liquidity_collapse_ratio": 0.2,
    "lifecycle_start_late_days": 90,
    "lifecycle_end_early_days": 90,
    "short_life_min_rows": 2160,
    "high_universe_turnover": 0.5,
}


def _own():
    return Window.partitionBy("symbol").orderBy("ts")


def duplicate_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ts", "symbol").count().filter("count > 1").agg(F.count("*").alias("n"))


def fault_counts() -> list[Column]:
    """Aggregates: null_rows, bad_ohlc, negative_vals."""
    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    missing = o.isNull() | h.isNull() | l.isNull() | c.isNull() | F.col("volume").isNull()
    return [n(missing).alias("null_rows"), n((h < F.greatest(o, c)) | (l > F.least(o, c)) | (h < l)).alias("bad_ohlc"), n((F.col("volume") < 0) | (F.col("trades") < 0)).alias("negative_vals")]


def row_faults(rows: DataFrame) -> DataFrame:
    """One row of counts in one pass."""
    return rows.agg(*fault_counts())


def gaps(rows: DataFrame, hours: float = 1.0) -> DataFrame:
    """(symbol, ts, gap_hours) of rows that follow their predecessor by more than `hours`."""
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(_own())) / 3.6e9
    return rows.select("symbol", "ts", gap.alias("gap_hours")).filter(F.col("gap_hours") > hours)


def count_checks(rows: DataFrame, gap_check: bool = True) -> dict[str, int]:
    """Counts of all checks from one pass: faults are summed per key, whose repeats and gaps follow from the same rows."""
    per = rows.groupBy("ts", "symbol").agg(F.count("*").alias("n_"), *fault_counts())
    late = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(_own()) > 3_600_000_000
    per = per.withColumn("late_", late if gap_check else F.lit(False))
    total = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("null_rows", "bad_ohlc", "negative_vals")]
    found = per.agg(*total, F.count(F.when(F.col("n_") > 1, 1)).alias("duplicate_keys"), F.count(F.when(F.col("late_"), 1)).alias("gaps_sample")).first().asDict()
    return found if gap_check else {k: v for k, v in found.items() if k != "gaps_sample"}


def run_checks(rows: DataFrame, gap_check: bool = True) -> dict[str, int]:
    """The counts; raises ValueError that lists those which are not zero."""
    found = count_checks(rows, gap_check)
    if bad := {k: v for k, v in found.items() if v}:
        raise ValueError(f"data checks failed: {bad}")
    return found


def cross_timeframe(hourly: DataFrame, minutes: DataFrame, universe: DataFrame, symbols: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """One row: compared and mismatched hours of the most liquid symbols (best mean rank), last minute close against hourly."""
    top = universe.groupBy("symbol").agg(F.avg("rank").alias("r")).orderBy("r", "symbol").limit(symbols).select("symbol")
    hours = minutes.join(F.broadcast(top), "symbol", "left_semi").groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("minute_close"))
    both = hourly.filter("volume > 0").join(hours, ["symbol", "ts"])
    far = F.abs(div(F.col("minute_close") - F.col("close"), F.col("close"))) > tolerance
    return both.agg(F.count("*").alias("compared"), F.count(F.when(far, 1)).alias("mismatched"))


def extreme_returns(rows: DataFrame, threshold: float = 0.2, universe: DataFrame | None = None) -> DataFrame:
    """(symbol, ts, ret) with |close / previous close - 1| at the threshold, of universe symbols."""
    rows = rows if universe is None else rows.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    ret = div(F.col("close"), F.lag("close").over(_own())) - 1
    return rows.select("symbol", "ts", ret.alias("ret")).filter(F.abs("ret") >= threshold)


def liquidity_collapse(rows: DataFrame, ratio: float = 0.2) -> DataFrame:
    """(symbol, day, last_7d, prev_30d): first days on which the 7-day mean falls below `ratio` of the 30 days before.

    Rows (days) are counted, not dates; days without a full history before are removed before onsets are found.
    """
    daily = rows.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.avg("dollar_volume").alias("v"))
    w = Window.partitionBy("symbol").orderBy("day")
    x = daily.withColumns({"last_7d": F.avg("v").over(w.rowsBetween(-6, 0)), "prev_30d": F.avg("v").over(w.rowsBetween(-36, -7))}).filter("prev_30d is not null")
    x = x.withColumn("low", F.col("last_7d") < ratio * F.col("prev_30d")).withColumn("before", F.lag("low", 1, False).over(w))
    return x.filter("low and not before").select("symbol", "day", "last_7d", "prev_30d")


def lifecycle(rows: DataFrame, late_days: int = 90, early_days: int = 90, min_rows: int = 2160) -> DataFrame:
    """(symbol, start_late_days, end_early_days, n_rows, is_late, is_early, is_short), whole days against the table's span."""
    per = rows.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n_rows"))
    every = per.agg(F.min("a").alias("first"), F.max("b").alias("last"))
    days = lambda x, y: F.floor((F.unix_seconds(y) - F.unix_seconds(x)) / 86400).cast("long")
    x = per.withColumn("one", F.lit(1)).join(F.broadcast(every.withColumn("one", F.lit(1))), "one")  # one row
    x = x.select("symbol", days(F.col("first"), F.col("a")).alias("start_late_days"), days(F.col("b"), F.col("last")).alias("end_early_days"), "n_rows")
    return x.withColumns({"is_late": F.col("start_late_days") > late_days, "is_early": F.col("end_early_days") > early_days, "is_short": F.col("n_rows") < min_rows})


def event_log(rows: DataFrame, universe: DataFrame | None, t: dict | None = None) -> DataFrame:
    """All warnings in one schema: (event_type, symbol, ts, metric_value, threshold, notes).

    Warnings about a row share one pass in the symbol's order, those about a symbol one aggregate; each row or symbol is
    exploded to the warnings that apply to it.
    """
    t = THRESHOLDS | (t or {})
    none = F.lit(None).cast("timestamp")

    def event(cond: Column, kind: str, metric: Column, threshold: float, notes: Column, ts: Column = none) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("event_type"), ts.alias("ts"), metric.cast("double").alias("metric_value"), F.lit(float(threshold)).alias("threshold"), notes.alias("notes")))

    def events(df: DataFrame, *found: Column) -> DataFrame:
        x = df.select("symbol", F.explode(F.array(*found)).alias("x")).filter("x is not null")
        return x.select("x.event_type", "symbol", "x.ts", "x.metric_value", "x.threshold", "x.notes")

    listed = rows.withColumn("in_", F.lit(True)) if universe is None else rows.join(F.broadcast(universe.select("symbol", F.lit(True).alias("in_")).distinct()), "symbol", "left")  # one row a symbol
    ret = div(F.col("close"), F.lag("close").over(_own())) - 1
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(_own())) / 3.6e9
    out = events(
        listed.withColumns({"ret": ret, "gap_hours": gap}),
        event(F.col("in_") & (F.abs("ret") >= t["extreme_return_abs"]), "extreme_return", F.col("ret"), t["extreme_return_abs"], F.lit("return beyond the threshold"), F.col("ts")),
        event(F.col("gap_hours") > t["large_symbol_gap_hours"], "large_symbol_gap", F.col("gap_hours"), t["large_symbol_gap_hours"], F.lit("hours since the row before"), F.col("ts")),
    )
    days = lambda n, text: F.format_string(f"%d {text}", n)
    out = out.unionByName(events(
        lifecycle(rows, t["lifecycle_start_late_days"], t["lifecycle_end_early_days"], t["short_life_min_rows"]),
        event(F.col("is_late"), "starts_late", F.col("start_late_days"), t["lifecycle_start_late_days"], days("start_late_days", "days after the first row")),
        event(F.col("is_early"), "ends_early", F.col("end_early_days"), t["lifecycle_end_early_days"], days("end_early_days", "days before the last row")),
        event(F.col("is_short"), "short_life", F.col("n_rows"), t["short_life_min_rows"], days("n_rows", "rows")),
    ))
    low = event(F.lit(True), "liquidity_collapse", div(F.col("last_7d"), F.col("prev_30d")), t["liquidity_collapse_ratio"], F.lit("7-day mean against the 30 days before"), F.col("day").cast("timestamp"))
    out = out.unionByName(events(liquidity_collapse(rows, t["liquidity_collapse_ratio"]), low))
    if universe is None:
        return out
    left = event(F.col("turnover") > t["high_universe_turnover"], "high_universe_turnover", F.col("turnover"), t["high_universe_turnover"], F.lit("share of the snapshot before that left"), F.col("rebalance_date").cast("timestamp"))
    return out.unionByName(events(turnover(universe).withColumn("symbol", F.lit(None).cast("string")), left))


def run_metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))
