"""Sweeps over signal configurations: one Spark plan for all of them, with the configuration as a group key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cross_section, forward_return, pct_rank
from ..operators import book, ic, panel
from .frames import held


def explode_configs(p: DataFrame, configs: list[dict], label: Callable[[dict], str], ranks: DataFrame | None) -> DataFrame:
    """p: a panel with the configurations' raw signals. A cell for each configuration: its signal (masked by its universe,
    transformed across symbols) and forward return, with (config, holding, nw) as keys.

    A configuration is a dict: raw (column), holding, transform, top_n (with ranks), lag (of Newey-West).
    """
    p = p.withColumns({f"fwd_{h}": forward_return("close", h) for h in sorted({c["holding"] for c in configs})})
    for n in sorted({c["top_n"] for c in configs if ranks is not None}):
        p = panel.member_mask(p, panel.top_of_universe(ranks, n)).withColumnRenamed("member", f"in_{n}")

    def one(c: dict):
        v = F.col(c["raw"]) if ranks is None else F.when(F.col(f"in_{c['top_n']}"), F.col(c["raw"]))
        return F.struct(F.lit(label(c)).alias("config"), F.lit(c["transform"]).alias("transform"), F.lit(c["holding"]).alias("holding"), F.lit(c["lag"]).alias("nw"), v.alias("v"), F.col(f"fwd_{c['holding']}").alias("fwd"))

    cells = p.select("ts", "bar_id", "symbol", F.explode(F.array(*map(one, configs))).alias("x")).select("ts", "bar_id", "symbol", "x.*")
    part = Window.partitionBy("config", "ts")
    by = {m: cross_section("v", m, c_min, part) for m, c_min in (("rank", 6), ("zscore", 6), ("none", 6))}
    sig = F.when(F.col("transform") == "rank", by["rank"]).when(F.col("transform") == "zscore", by["zscore"]).otherwise(by["none"])
    return cells.withColumn("sig", F.round(sig, 8)).drop("v", "transform")


def run_grid(p: DataFrame, configs: list[dict], label: Callable[[dict], str], ranks: DataFrame | None = None, top: float = 0.2, bottom: float = 0.2, fee_bps: float = 10.0, half_spread_bps: float = 1.0) -> DataFrame:
    """(config, n_obs, mean_ic, t_stat_ic_nw, sharpe_net, n_periods) of every configuration, best mean IC first."""
    cells = held(explode_configs(p, configs, label, ranks))  # read by the IC and the backtest
    series = held(ic.ic_series(cells, "sig", "fwd", keys=("config", "nw")))
    stats = ic.ic_summary(series, keys=("config", "nw")).join(ic.newey_west(series, "ic", F.col("nw"), ("config", "nw"), {c["lag"] for c in configs}), ["config", "nw"], "left")
    part = Window.partitionBy("config", "ts")
    ranked = cells.withColumn("pr", pct_rank("sig", part))
    long, short = F.coalesce(F.col("pr") >= F.lit(1.0 - top), F.lit(False)), F.coalesce(F.col("pr") <= F.lit(bottom), F.lit(False))
    side = lambda m: F.when(m, 1.0 / F.count(F.when(m, 1)).over(part)).otherwise(0.0)
    weighted = ranked.withColumns({"w": side(long) - side(short), "realized": F.exp("fwd") - 1})
    stepped = weighted.filter(F.col("bar_id") % F.col("holding") == 0)  # each configuration by its own holding period
    m = book.backtest_metrics(book.backtest_periods(stepped, "w", "realized", 1, fee_bps=fee_bps, half_spread_bps=half_spread_bps, keys=("config",)), ("config",))
    out = stats.join(m, "config", "left").select("config", "n_obs", "mean_ic", (F.col("mean_ic") / F.col("nw_se")).alias("t_stat_ic_nw"), "sharpe_net", F.coalesce("n_periods", F.lit(0)).alias("n_periods"))
    return out.orderBy(F.desc("mean_ic"), F.desc("sharpe_net"), "config")


def evaluate(p: DataFrame, raw: str, lookback: int, holding: int, transform: str = "zscore", decimation: int = 1, split=None, **backtest) -> DataFrame:
    """One configuration: IC on every decimation-th bar with the lag that fits, its halves at `split`, and the backtest."""
    lag = (max(holding, lookback) - 1) // decimation
    cells = explode_configs(p, [{"raw": raw, "holding": holding, "transform": transform, "top_n": 0, "lag": lag}], lambda c: raw, None)
    series = ic.ic_series(cells.filter(F.col("bar_id") % decimation == 0), "sig", "fwd")
    out = ic.ic_summary(series, nw_lag=lag).select("n_obs", "mean_ic", "t_stat_ic_nw", F.lit(1).alias("one"))
    if split is not None:
        side = lambda c, n: F.avg(F.when(c, F.col("ic"))).alias(n)
        early = F.col("ts") <= F.lit(split).cast("timestamp")
        out = out.join(series.agg(side(early, "train_ic"), side(~early, "test_ic")).withColumn("one", F.lit(1)), "one")
    weighted = book.quantile_weights(cells, "sig").withColumn("realized", F.exp("fwd") - 1)
    m = book.backtest_metrics(book.backtest_periods(weighted, "w", "realized", holding, **backtest)).withColumn("one", F.lit(1))
    return out.join(m, "one", "left").drop("one")


def surface(results: DataFrame, rows: str, columns: str, value: str, values: list) -> DataFrame:
    """Mean of a value over a grid's two axes; the column axis has the given values."""
    return results.groupBy(rows).pivot(columns, values).agg(F.avg(value))
