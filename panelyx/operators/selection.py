"""Selection-bias corrections, walk-forward folds and grids."""

from __future__ import annotations

import math
from itertools import product
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div
from .ic import ic_summary

_N = NormalDist()
#: Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329


def max_over_trials_pvalue(t_stat: float, n_trials: int) -> float:
    """Chance that the best of n independent trials exceeds t under the null."""
    if n_trials < 1:
        raise ValueError("n_trials must be at least 1")
    return 1.0 - _N.cdf(t_stat) ** n_trials


def expected_max_sharpe(n_trials: int, var_sharpe: float, mean_sharpe: float = 0.0) -> float:
    if n_trials < 1 or var_sharpe < 0:
        raise ValueError("n_trials must be at least 1 and the variance not negative")
    if n_trials == 1:
        return mean_sharpe
    z = (1 - EULER) * _N.inv_cdf(1 - 1 / n_trials) + EULER * _N.inv_cdf(1 - 1 / (n_trials * math.e))
    return mean_sharpe + math.sqrt(var_sharpe) * z


def probabilistic_sharpe_ratio(sharpe: float, benchmark: float, n_obs: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    var = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    if n_obs < 2 or var <= 0:
        return math.nan
    return _N.cdf((sharpe - benchmark) * math.sqrt(n_obs - 1) / math.sqrt(var))


def deflated_sharpe_ratio(sharpe: float, n_obs: int, n_trials: int, var_sharpe: float, skew: float = 0.0, kurt: float = 3.0, mean_sharpe: float = 0.0) -> float:
    return probabilistic_sharpe_ratio(sharpe, expected_max_sharpe(n_trials, var_sharpe, mean_sharpe), n_obs, skew, kurt)


def sample_moments(value: str) -> tuple[Column, Column]:
    """Aggregates: bias-corrected skewness, and bias-corrected kurtosis + 3."""
    n, g1, g2 = F.count(value).cast("double"), F.skewness(value), F.kurtosis(value)
    return (
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))),
        F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6) + 3),
    )


def with_folds(series: DataFrame, n_folds: int, embargo: int = 0) -> DataFrame:
    """Adds fold (1-based) and pos to rows ordered by ts; the first `embargo` rows of later folds are dropped.

    Fold k holds positions floor(n (k-1) / F) to floor(n k / F).
    """
    if n_folds < 2 or embargo < 0:
        raise ValueError("at least two folds, and no negative embargo")
    x = series.withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1).withColumn("n_", F.count("*").over(Window.partitionBy(F.lit(1))))
    edge = lambda k: F.floor(F.col("n_") * F.lit(k) / F.lit(n_folds))
    fold, start = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in range(n_folds, 0, -1):
        inside = (F.col("pos") >= edge(k - 1)) & (F.col("pos") < edge(k))
        fold, start = F.when(inside, k).otherwise(fold), F.when(inside, edge(k - 1)).otherwise(start)
    x = x.withColumns({"fold": fold, "fold_start": start}).drop("n_")
    return x.filter((F.col("fold") == 1) | (F.col("pos") >= F.col("fold_start") + embargo))


def walk_forward_ic(series: DataFrame, n_folds: int = 5, embargo: int = 0, nw_lag: int = 0, value: str = "ic") -> DataFrame:
    folds = with_folds(series.filter(F.col(value).isNotNull()), n_folds, embargo)
    span = folds.groupBy("fold").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return span.join(ic_summary(folds, value, nw_lag, ("fold",)).select("fold", "n_obs", "mean_ic", "t_stat_ic_nw"), "fold")


def walk_forward_sharpe(returns: DataFrame, value: str, per_year: float, n_folds: int = 5, embargo: int = 0) -> DataFrame:
    x = with_folds(returns, n_folds, embargo).filter(F.col(value).isNotNull())
    return x.groupBy("fold").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_obs"), (F.sqrt(F.lit(float(per_year))) * div(F.avg(value), F.stddev_samp(value))).alias("sharpe_net"))


def walk_forward_selection(series: DataFrame, n_folds: int = 5, embargo: int = 0, value: str = "ic") -> tuple[DataFrame, DataFrame]:
    """series: (config, ts, ic). Returns (per fold: the config with the best mean before it, its mean before and in it), and
    the out-of-sample observations (fold, ts, config, ic). Ties go to the config of the smaller name."""
    times = with_folds(series.select("ts").distinct(), n_folds, 0)
    embargoed = times.filter((F.col("fold") == 1) | (F.col("pos") >= F.col("fold_start") + embargo))
    first = embargoed.filter("fold > 1").groupBy("fold").agg(F.min("pos").alias("first_pos"))
    seen = series.filter(F.col(value).isNotNull()).join(times.select("ts", "pos"), "ts")
    # Sums up to each fold's stop: folds are few, so each observation is sent to the folds after it.
    past = seen.join(F.broadcast(first), F.col("pos") < F.greatest(F.col("first_pos") - embargo, F.lit(0))).groupBy("fold", "config").agg(F.avg(value).alias("selection_mean_ic"))
    best = past.withColumn("rn", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("selection_mean_ic"), "config"))).filter("rn = 1").drop("rn")
    oos = seen.join(embargoed.select("ts", "fold"), "ts").join(best.select("fold", "config"), ["fold", "config"]).select("fold", "ts", "config", value)
    table = best.join(oos.groupBy("fold").agg(F.avg(value).alias("oos_mean_ic"), F.count("*").alias("oos_n_obs")), "fold", "left")
    return table.select("fold", F.col("config").alias("selected_config"), "selection_mean_ic", "oos_mean_ic", F.coalesce("oos_n_obs", F.lit(0)).alias("oos_n_obs")), oos


def train_test(series: DataFrame, split, value: str = "ic", nw_lag: int = 0) -> DataFrame:
    """(side, n_obs, mean_ic, t_stat_ic_nw): up to and including split, and after it."""
    x = series.withColumn("side", F.when(F.col("ts") <= F.lit(split).cast("timestamp"), "train").otherwise("test"))
    return ic_summary(x, value, nw_lag, ("side",)).select("side", "n_obs", "mean_ic", "t_stat_ic_nw")


def reversal_label(lookback: int, holding: int, transform: str, top_n: int) -> str:
    return f"lb{lookback}_h{holding}_{transform}_top{top_n}"


def momentum_label(horizon: int, skip: int, holding: int, transform: str, top_n: int) -> str:
    return f"R{horizon}_s{skip}_h{holding}_{transform}_top{top_n}"


def grid(**axes: list) -> list[dict]:
    return [dict(zip(axes, v, strict=True)) for v in product(*axes.values())]


def ic_lag(holding: int, lookback: int, decimation: int = 1) -> int:
    """Overlap of an IC series that is sampled every `decimation` bars."""
    return (max(holding, lookback) - 1) // max(decimation, 1)
