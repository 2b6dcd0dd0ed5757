"""Information coefficients: correlation of signal and forward return across symbols, and statistics of the series.

Pairs are made first and ranked second. A time with pairs but fewer than min_assets, or with a constant side, has a NULL
coefficient; a time without pairs is absent. Series-level steps (one row a bar and configuration) may order their rows as
a whole; cell-level steps never do. Any number of configurations are scored in one job: `keys` are extra group columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, guarded_corr, pct_rank


def ic_series(cells: DataFrame, signal: str, forward: str, method: str = "spearman", min_assets: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ts, n_pairs, ic)."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method!r}")
    pairs = cells.filter(F.col(signal).isNotNull() & F.col(forward).isNotNull()).select(*keys, "ts", F.col(signal).alias("x"), F.col(forward).alias("y"))
    if method == "spearman":
        part = Window.partitionBy(*keys, "ts")
        pairs = pairs.withColumns({"x": pct_rank("x", part), "y": pct_rank("y", part)})
    return pairs.groupBy(*keys, "ts").agg(F.count("*").alias("n_pairs"), F.when(F.count("*") >= min_assets, guarded_corr("x", "y")).alias("ic"))


def numbered(series: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Non-null observations with their number i per key."""
    order = Window.partitionBy(*keys).orderBy("ts") if keys else Window.orderBy("ts")
    return series.filter(F.col(value).isNotNull()).withColumn("i", F.row_number().over(order))


def newey_west(series: DataFrame, value: str, lag: int | Column, keys: tuple[str, ...] = (), lags: set[int] | None = None) -> DataFrame:
    """(keys, nw_se): Bartlett-weighted standard error of the mean; lags count surviving observations; NULL if not positive.

    lag may be a column that is constant within a key; lags are then the values it takes. The weights fall linearly, so
    the weighted sum of the L observations before one is that of two plain sums over the window of L rows: no pairs are
    made, and everything runs in the order of the series.
    """
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    lags = {int(lag)} if lags is None else lags
    lag = lag if isinstance(lag, Column) else F.lit(int(lag))
    e = numbered(series, value, keys).withColumns({"n": F.count("*").over(part), "e": F.col(value) - F.avg(value).over(part)})
    e = e.select(*keys, "i", "n", "e", lag.cast("int").alias("asked")).withColumn("ie", F.col("i") * F.col("e"))
    L = F.least("asked", F.col("n").cast("int") - 1)
    before = F.lit(0.0)
    for k in sorted(x for x in lags if x > 0):
        rows = part.orderBy("i").rowsBetween(-k, -1)
        plain, by_place = (F.coalesce(F.sum(x).over(rows), F.lit(0.0)) for x in ("e", "ie"))
        before = F.when(F.col("asked") == k, plain - (F.col("i") * plain - by_place) / (L + 1)).otherwise(before)
    own = e.withColumn("before", before).groupBy(*keys).agg(F.max("n").alias("n"), (F.sum(F.col("e") * F.col("e")) + 2 * F.sum(F.col("e") * F.col("before"))).alias("total"))
    var = F.col("total") / F.col("n")
    return own.select(*keys, F.when(var > 0, F.sqrt(var / F.col("n"))).alias("nw_se"))


def ic_summary(series: DataFrame, value: str = "ic", nw_lag: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n_obs, mean_ic, median_ic, std_ic, t_stat_ic, t_stat_ic_nw, p05, p95). At lag 0 both t are the plain one."""
    x = series.filter(F.col(value).isNotNull())
    agg = x.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.avg(value).alias("mean_ic"), F.median(value).alias("median_ic"), F.stddev_samp(value).alias("std_ic"),
        F.percentile(value, 0.05).alias("p05"), F.percentile(value, 0.95).alias("p95"),
    ).withColumn("t_stat_ic", div(F.col("mean_ic") * F.sqrt("n_obs"), F.col("std_ic")))
    if not nw_lag:
        return agg.withColumn("t_stat_ic_nw", F.col("t_stat_ic"))
    se = newey_west(series, value, nw_lag, keys)
    agg = agg.join(se, list(keys), "left") if keys else agg.withColumn("one", F.lit(1)).join(se.withColumn("one", F.lit(1)), "one", "left").drop("one")
    return agg.withColumn("t_stat_ic_nw", F.col("mean_ic") / F.col("nw_se")).drop("nw_se")


def feature_ic(cells: DataFrame, signal: str, forward: str, tradable: str | None = None, nw_lag: int = 0, min_assets: int = 6) -> DataFrame:
    """One row: the summary of a feature's IC; with a tradable forward return also that IC and what is lost to it."""
    row = ic_summary(ic_series(cells, signal, forward, min_assets=min_assets), nw_lag=nw_lag)
    if tradable is None:
        return row
    other = ic_summary(ic_series(cells, signal, tradable, min_assets=min_assets), nw_lag=nw_lag).select(F.col("mean_ic").alias("tradable_ic"), F.col("t_stat_ic_nw").alias("tradable_t_nw"), F.lit(1).alias("one"))
    return row.withColumn("one", F.lit(1)).join(other, "one", "left").drop("one").withColumn("haircut", 1 - div(F.col("tradable_ic"), F.col("mean_ic")))


def decay_table(cells: DataFrame) -> DataFrame:
    """(signal, holding, t) -> per signal: holding of the largest t, that t, t at the shortest holding, and the holding at
    which t first falls below 1 (linearly interpolated; NULL if it never does)."""
    w = Window.partitionBy("signal").orderBy("holding")
    x = cells.withColumns({"t0": F.lag("t").over(w), "h0": F.lag("holding").over(w)})
    cross = F.when((F.col("t") < 1) & (F.col("t0") >= 1), F.col("h0") + (F.col("t0") - 1) / (F.col("t0") - F.col("t")) * (F.col("holding") - F.col("h0")))
    return x.groupBy("signal").agg(F.max_by("holding", "t").alias("peak_holding"), F.max("t").alias("peak_t"), F.min_by("t", "holding").alias("first_t"), F.min(cross).alias("decay_holding"))


def correlation(series: DataFrame, other: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson of two series on their common times."""
    return series.select("ts", a).join(other.select("ts", b), "ts").filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(guarded_corr(a, b).alias("corr"), F.count("*").alias("n_obs"))


def quantile_buckets(cells: DataFrame, signal: str, forward: str, n: int) -> DataFrame:
    """Adds `quantile` to paired cells: right-closed buckets between linearly interpolated edges of each time.

    Edges that coincide are one; a time whose values are all equal has no bucket. Edges are exact: at k (m - 1) / n the
    sorted value itself if that is whole, else the interpolation of its neighbours.
    """
    if n < 2:
        raise ValueError("at least two quantiles are needed")
    pairs = cells.filter(F.col(signal).isNotNull() & F.col(forward).isNotNull())
    edge = F.expr(
        f"transform(sequence(1, {n - 1}), k -> if((k * (size(s) - 1)) % {n} = 0, s[cast(k * (size(s) - 1) div {n} as int)],"
        f" s[cast(k * (size(s) - 1) div {n} as int)] + (s[cast(k * (size(s) - 1) div {n} as int) + 1] - s[cast(k * (size(s) - 1) div {n} as int)]) * ((k * (size(s) - 1)) % {n}) / {n}.0D))"
    )
    # One row a time with the sorted values across symbols: as wide as the cross-section, not as the panel.
    edges = pairs.groupBy("ts").agg(F.sort_array(F.collect_list(signal)).alias("s")).withColumn("edges", F.array_distinct(F.concat(F.array(F.expr("s[0]")), edge, F.array(F.expr("s[size(s) - 1]"))))).select("ts", "edges")
    placed = pairs.join(edges, "ts").filter(F.size("edges") > 1)
    v = F.col(signal)
    return placed.withColumn("quantile", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < v)))).drop("edges")


def quantile_means(buckets: DataFrame, forward: str) -> DataFrame:
    return buckets.groupBy("quantile").agg(F.avg(forward).alias("mean_fwd_ret"), F.count("*").alias("n_cells"))


def quantile_spread(buckets: DataFrame, forward: str, n: int) -> DataFrame:
    """(ts, spread): top minus bottom bucket; NULL where either is absent."""
    mean_of = lambda q: F.avg(F.when(F.col("quantile") == q, F.col(forward)))
    return buckets.groupBy("ts").agg((mean_of(n) - mean_of(1)).alias("spread"))


def periods_per_year(step: str = "step") -> Column:
    """Aggregate: 365 days over the median step (seconds to the row before); 365 without a positive one."""
    median = F.median(step)
    return F.coalesce(F.lit(365.0 * 86400.0) / F.when(median > 0, median), F.lit(365.0))


def index_spacing(series: DataFrame, keys: tuple[str, ...] = (), ratio: float = 0.1) -> DataFrame:
    """(keys, n, median_step, mean_step, periods_per_year, irregular) of a series' times.

    irregular: mean and median step differ by more than `ratio` of the median, so that annualised figures mislead and
    periods per year should be given instead. False where there are no two times.
    """
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("ts")
    x = series.select(*keys, "ts").distinct().withColumn("step", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)) / 1e6)
    x = x.groupBy(*keys).agg(F.count("*").alias("n"), F.median("step").alias("median_step"), F.avg("step").alias("mean_step"), periods_per_year().alias("periods_per_year"))
    return x.withColumn("irregular", F.coalesce(F.abs(div(F.col("mean_step") - F.col("median_step"), F.col("median_step"))) > ratio, F.lit(False)))
