"""Queries over the daily panel of `lineitem`, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import IEEE, bar_return, cross_section, forward_return, rounded
from ..operators import book, features, ic, panel, quality, selection, universe
from . import frames as S
from . import grids
from .catalogue_events import METRICS, backtest_sql, lag, metrics_sql, rank_sql, ret, roll, show_metrics, shown, w, weights_sql
from .frames import LINE_MEMBER, LINE_PANEL, LINE_ROWS, ntz, r8, universe_sql
from .settings import ResearchSettings

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def skipped(agg: str, x: str, n: int, skip: int) -> str:
    span = f"(PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)"
    return f"(CASE WHEN count({x}) OVER {span} = {n} THEN {agg}({x}) OVER {span} END)"


UNIVERSE = f"{LINE_ROWS}, {universe_sql()}"


@add("monthly_universe", f"{UNIVERSE} SELECT rebalance_date, symbol, rank, {r8('liquidity_monthly', 'liquidity_monthly', 4)} FROM u")
def monthly_universe(spark, sf):
    return S.line_universe(spark, sf).select("rebalance_date", "symbol", "rank", rounded("liquidity_monthly", 4).alias("liquidity_monthly"))


@add("universe_mask", f"{LINE_MEMBER} SELECT ts, symbol, member FROM m")
def universe_mask(spark, sf):
    return ntz(panel.member_mask(S.line_panel(spark, sf), S.line_universe(spark, sf)).select("ts", "symbol", "member"))


@add("universe_turnover", f"""{UNIVERSE}, d AS (SELECT rebalance_date, lag(rebalance_date) OVER (ORDER BY rebalance_date) AS previous_date FROM (SELECT DISTINCT rebalance_date FROM u))
SELECT rebalance_date, previous_date, {r8('1 - (SELECT count(*) FROM u a JOIN u b USING (symbol) WHERE a.rebalance_date = d.rebalance_date AND b.rebalance_date = d.previous_date) / (SELECT count(*) FROM u WHERE u.rebalance_date = d.previous_date)::DOUBLE', 'turnover')}
FROM d WHERE previous_date IS NOT NULL""")
def universe_turnover(spark, sf):
    return universe.turnover(S.line_universe(spark, sf)).select("rebalance_date", "previous_date", rounded("turnover").alias("turnover"))


@add("universe_symbols", f"{UNIVERSE} SELECT DISTINCT symbol FROM u WHERE rank <= 5 AND rebalance_date = (SELECT max(rebalance_date) FROM u WHERE rebalance_date < DATE '1998-06-30')")
def universe_symbols(spark, sf):
    import datetime

    return universe.list_symbols(S.line_universe(spark, sf), datetime.date(1998, 6, 30), 5)


@add("range_scan", f"{LINE_ROWS} SELECT ts, symbol, {r8('close', 'close')}, volume FROM rows_ WHERE ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-31' AND symbol IN ('L01', 'L02', 'L05')")
def range_scan(spark, sf):
    x = S.daily_rows(spark, sf).filter(F.col("ts").between("1998-01-01", "1998-03-31") & F.col("symbol").isin("L01", "L02", "L05"))
    return ntz(x.select("ts", "symbol", rounded("close").alias("close"), "volume"))


@add("momentum_score", f"{LINE_PANEL}, q AS (SELECT *, exp(r) AS f FROM p) SELECT ts, symbol, {r8(skipped('sum', 'r', 10, 1), 'log_score')}, {r8(roll('product', 'f', 10) + ' - 1', 'simple_score', 7)} FROM q")
def momentum_score(spark, sf):
    p = S.line_panel(spark, sf).withColumn("sr", F.exp("r") - 1)
    return ntz(p.select("ts", "symbol", rounded(features.momentum_score("r", 10, 1)).alias("log_score"), rounded(features.momentum_score("sr", 10, log=False), 7).alias("simple_score")))


@add("relative_momentum", f"""{LINE_MEMBER}, f AS (SELECT ts, symbol, member, {ret(5)} AS x FROM m)
SELECT ts, symbol, {r8('x - avg(x) FILTER (WHERE member) OVER (PARTITION BY ts)', 'minus_xsec_mean')}, {r8("x - max(x) FILTER (WHERE symbol = 'L01') OVER (PARTITION BY ts)", 'minus_benchmark')} FROM f""")
def relative_momentum(spark, sf):
    p = panel.member_mask(S.line_panel(spark, sf).withColumn("x", bar_return("close", 5, log=IEEE)), S.line_universe(spark, sf))
    return shown(features.relative_returns(p, "x", "L01", mask="member"), minus_xsec_mean="minus_xsec_mean", minus_benchmark="minus_benchmark")


@add("vol_adjusted_features", f"""{LINE_PANEL}, f AS (SELECT *, {ret(5)} AS x FROM p), g AS (SELECT ts, symbol, x, {roll('avg', 'x', 14)} AS m, {roll('stddev_pop', 'x', 14)} AS s FROM f)
SELECT ts, symbol, {r8('s', 'rolling_vol')}, {r8('x / nullif(s, 0)', 'ret_over_vol', 6)}, {r8('(x - m) / nullif(s, 0)', 'zscored_return', 6)} FROM g""")
def vol_adjusted_features(spark, sf):
    p = S.line_panel(spark, sf).withColumn("x", bar_return("close", 5, log=IEEE))
    v = features.vol_adjusted("x", 14)
    return ntz(p.select("ts", "symbol", rounded(v["rolling_vol"]).alias("rolling_vol"), *(rounded(v[k], 6).alias(k) for k in ("ret_over_vol", "zscored_return"))))


MARKET = "mk AS (SELECT ts, CASE WHEN count(r) FILTER (WHERE member) >= 5 THEN avg(r) FILTER (WHERE member) END AS market FROM m GROUP BY ts)"


@add("market_index", f"{LINE_MEMBER}, {MARKET} SELECT ts, {r8('market', 'market')} FROM mk")
def market_index(spark, sf):
    return ntz(features.market_index(_members(spark, sf), "r", mask="member", min_assets=5).select("ts", rounded("market").alias("market")))


def _members(spark, sf) -> DataFrame:
    return S.held(panel.member_mask(S.line_panel(spark, sf), S.line_universe(spark, sf)))


def _betas(spark, sf) -> DataFrame:
    p = _members(spark, sf)
    m = features.market_index(p, "r", mask="member", min_assets=5)
    p = p.join(m, "ts").withColumn("beta", features.rolling_beta("r", "market", 60, 45, 0.2))
    return S.held(p.withColumn("resid", F.col("r") - F.col("beta") * F.col("market")))


BETA = f"""{LINE_MEMBER}, {MARKET}, j AS (SELECT m.*, mk.market FROM m JOIN mk USING (ts)),
b AS (SELECT *, 0.8 * CASE WHEN regr_count(r, market) OVER {w(60)} >= 45 THEN CASE WHEN regr_sxx(r, market) OVER {w(60)} = 0 THEN NULL ELSE regr_slope(r, market) OVER {w(60)} END END + 0.2 AS beta FROM j),
e AS (SELECT *, r - beta * market AS resid FROM b)"""


@add("rolling_betas", f"{BETA} SELECT ts, symbol, {r8('beta', 'beta', 6)} FROM e")
def rolling_betas(spark, sf):
    return shown(_betas(spark, sf), 6, beta="beta")


@add("residual_returns", f"{BETA} SELECT ts, symbol, {r8('resid', 'resid', 6)} FROM e")
def residual_returns(spark, sf):
    return shown(_betas(spark, sf), 6, resid="resid")


@add("residual_momentum", f"""{BETA}, f AS (SELECT ts, symbol, {skipped('sum', 'resid', 20, 1)} AS a, {skipped('stddev_pop', 'resid', 20, 1)} AS s FROM e)
SELECT ts, symbol, {r8('a', 'residual_momentum', 6)}, {r8('a / nullif(s, 0)', 'residual_momentum_scaled', 6)} FROM f""")
def residual_momentum(spark, sf):
    return shown(_betas(spark, sf), 6, **features.residual_momentum("resid", 20, 1))


@add("beta_summary", f"""{BETA}, d AS (SELECT ts, median(beta) AS b FROM e GROUP BY ts)
SELECT (SELECT {r8('median(b)', 'median_beta', 6).split(' AS ')[0]} FROM d) AS median_beta, {r8('count(beta) / count(*)::DOUBLE', 'coverage')} FROM e""")
def beta_summary(spark, sf):
    x = _betas(spark, sf).groupBy("ts").agg(F.median("beta").alias("b"), F.count("beta").alias("n"), F.count("*").alias("k"))
    return x.agg(rounded(F.median("b"), 6).alias("median_beta"), rounded(F.sum("n") / F.sum("k").cast("double")).alias("coverage"))


SIGNAL = f"""{LINE_MEMBER}, sg AS (SELECT *, CASE WHEN member THEN round({skipped('sum', 'r', 5, 1)}, 10) END AS sig,
  ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0)) AS fwd, ln(lead(close, 1) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0)) AS fwd1 FROM m)"""


def _signal(spark, sf) -> DataFrame:
    p = S.with_forward(S.with_forward(S.line_panel(spark, sf).withColumn("raw", F.round(features.momentum_score("r", 5, 1), 10)), 5), 1, "fwd1")
    return S.held(panel.member_mask(p, S.line_universe(spark, sf)).withColumn("sig", panel.in_universe("raw")))


def _ics(spark, sf) -> DataFrame:
    return S.held(ic.ic_series(_signal(spark, sf), "sig", "fwd"))


@add("momentum_signal", f"""{SIGNAL}, z AS (SELECT *, CASE WHEN count(sig) OVER (PARTITION BY ts) >= 6 THEN (sig - avg(sig) OVER (PARTITION BY ts)) / nullif(stddev_pop(sig) OVER (PARTITION BY ts), 0) END AS z FROM sg)
SELECT ts, symbol, {r8('z', 'signal', 6)} FROM z""")
def momentum_signal(spark, sf):
    return shown(_signal(spark, sf), 6, signal=cross_section("sig", "zscore", 6))


@add("xsec_rank", f"{SIGNAL} SELECT ts, symbol, {r8('CASE WHEN count(sig) OVER (PARTITION BY ts) >= 6 THEN ' + rank_sql('sig') + ' END', 'rank_')} FROM sg")
def xsec_rank(spark, sf):
    return shown(_signal(spark, sf), rank_=cross_section("sig", "rank", 6))


@add("decimated_signal", f"""{SIGNAL} SELECT ts, symbol, first_value(sig) OVER (PARTITION BY symbol, bar_id // 3 ORDER BY bar_id) + 0.0 AS held FROM sg""")
def decimated_signal(spark, sf):
    return shown(_signal(spark, sf), 10, held=panel.decimate("sig", 3))


@add("demeaned_forward", f"{SIGNAL}, f AS (SELECT ts, symbol, CASE WHEN member THEN fwd END AS f FROM sg) SELECT ts, symbol, {r8('f - avg(f) OVER (PARTITION BY ts)', 'demeaned_fwd')} FROM f")
def demeaned_forward(spark, sf):
    p = _signal(spark, sf).withColumn("f", panel.in_universe("fwd"))
    return shown(p, demeaned_fwd=panel.demean("f"))


def pairs_sql(source: str = "sg", x: str = "sig", y: str = "fwd", keys: str = "", name: str = "ics", rank: bool = True) -> str:
    k = f"{keys}, " if keys else ""
    part = f"{k}ts"
    a, b = (rank_sql(v, part) for v in ("x", "y")) if rank else ("x", "y")
    return f"""{name}_p AS (SELECT {k}ts, {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), {name}_r AS (SELECT {k}ts, {a} AS x, {b} AS y FROM {name}_p),
{name} AS (SELECT {k}ts, count(*) AS n_pairs, CASE WHEN count(*) >= 6 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS ic FROM {name}_r GROUP BY {k}ts)"""


def summary_sql(source: str, nw_lag: str, keys: str = "", name: str = "sm", value: str = "ic") -> str:
    """nw_lag: an expression over the keys."""
    k, on = (f"{keys}, ", f"USING ({keys})") if keys else ("", "ON true")
    part = f"PARTITION BY {keys}" if keys else ""
    same = "".join(f" AND a.{x.strip()} = b.{x.strip()}" for x in keys.split(",")) if keys else ""
    return f"""{name}_e AS (SELECT {k}{value} - avg({value}) OVER ({part}) AS e, row_number() OVER ({part} ORDER BY ts) AS i, count(*) OVER ({part}) AS n, least({nw_lag}, count(*) OVER ({part}) - 1) AS lg FROM {source} WHERE {value} IS NOT NULL),
{name}_x AS (SELECT {'a.' + keys + ',' if keys else ''} sum((1 - (a.i - b.i) / (a.lg + 1.0)) * a.e * b.e) AS x FROM {name}_e a JOIN {name}_e b ON a.i > b.i AND a.i - b.i <= a.lg{same} {'GROUP BY a.' + keys if keys else ''}),
{name}_o AS (SELECT {k}sum(e * e) AS o, max(n) AS n FROM {name}_e {'GROUP BY ' + keys if keys else ''}),
{name}_v AS (SELECT {k}(o + 2 * coalesce(x, 0)) / n AS v, n FROM {name}_o LEFT JOIN {name}_x {on}),
{name} AS (SELECT s.*, CASE WHEN v > 0 THEN mean_ic / sqrt(v / n) END AS nw FROM (SELECT {k}count(*) AS n_obs, avg({value}) AS mean_ic, median({value}) AS median_ic, stddev_samp({value}) AS std_ic, avg({value}) * sqrt(count(*)) / nullif(stddev_samp({value}), 0) AS t,
  quantile_cont({value}, 0.05) AS p05, quantile_cont({value}, 0.95) AS p95 FROM {source} WHERE {value} IS NOT NULL {'GROUP BY ' + keys if keys else ''}) s JOIN {name}_v {on})"""


SUMMARY = f"n_obs, {r8('mean_ic', 'mean_ic')}, {r8('median_ic', 'median_ic')}, {r8('std_ic', 'std_ic')}, {r8('t', 't_stat_ic', 6)}, {r8('nw', 't_stat_ic_nw', 6)}, {r8('p05', 'p05')}, {r8('p95', 'p95')}"


def show_summary(x: DataFrame, *keys: str) -> DataFrame:
    six = ("t_stat_ic", "t_stat_ic_nw")
    return x.select(*keys, "n_obs", *(rounded(n, 6 if n in six else 8).alias(n) for n in ("mean_ic", "median_ic", "std_ic", "t_stat_ic", "t_stat_ic_nw", "p05", "p95")))


@add("ic_spearman", f"{SIGNAL}, {pairs_sql()} SELECT ts, n_pairs, {r8('ic', 'ic')} FROM ics")
def ic_spearman(spark, sf):
    return ntz(_ics(spark, sf).select("ts", "n_pairs", rounded("ic").alias("ic")))


@add("ic_pearson", f"{SIGNAL}, {pairs_sql(rank=False)} SELECT ts, n_pairs, {r8('ic', 'ic')} FROM ics")
def ic_pearson(spark, sf):
    return ntz(ic.ic_series(_signal(spark, sf), "sig", "fwd", "pearson").select("ts", "n_pairs", rounded("ic").alias("ic")))


@add("ic_summary", f"{SIGNAL}, {pairs_sql()}, {summary_sql('ics', '4')} SELECT {SUMMARY} FROM sm")
def ic_summary(spark, sf):
    return show_summary(ic.ic_summary(_ics(spark, sf), nw_lag=4))


@add("newey_west", f"{SIGNAL}, {pairs_sql()}, {summary_sql('ics', '60')} SELECT {r8('mean_ic / nw', 'nw_se')} FROM sm")
def newey_west(spark, sf):
    return ic.newey_west(_ics(spark, sf), "ic", 60).select(rounded("nw_se").alias("nw_se"))


HOLDS = (1, 3, 5, 10)
LOOKS = (5, 20)


@add("ic_decay_matrix", f"""{LINE_PANEL}, sg AS ({' UNION ALL '.join(f"SELECT ts, {k} AS lookback, {h} AS holding, round({roll('sum', 'r', k)}, 10) AS sig, ln(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0)) AS fwd FROM p" for k in LOOKS for h in HOLDS)}),
c AS (SELECT *, 'R' || lookback || '_H' || holding AS config FROM sg), {pairs_sql('c', keys='config')}, x AS (SELECT *, CAST(regexp_extract(config, 'R(\\d+)', 1) AS INT) AS lookback, CAST(regexp_extract(config, 'H(\\d+)', 1) AS INT) AS holding FROM ics),
{summary_sql('x', 'greatest(lookback, holding) - 1', 'config')} SELECT config, n_obs, {r8('mean_ic', 'mean_ic')}, {r8('nw', 't_stat_ic_nw', 6)} FROM sm""")
def ic_decay_matrix(spark, sf):
    """All cells in one job: (lookback, holding) is a group key."""
    p = S.line_panel(spark, sf).withColumns({f"m{k}": F.round(features.momentum_score("r", k), 10) for k in LOOKS} | {f"f{h}": forward_return("close", h, IEEE) for h in HOLDS})
    cells = p.select("ts", F.explode(F.array(*[F.struct(F.lit(f"R{k}_H{h}").alias("config"), F.lit(max(k, h) - 1).alias("nw"), F.col(f"m{k}").alias("sig"), F.col(f"f{h}").alias("fwd")) for k in LOOKS for h in HOLDS])).alias("x")).select("ts", "x.*")
    series = S.held(ic.ic_series(cells, "sig", "fwd", keys=("config", "nw")))
    se = ic.newey_west(series, "ic", F.col("nw"), ("config", "nw"), {max(k, h) - 1 for k in LOOKS for h in HOLDS})
    s = ic.ic_summary(series, keys=("config", "nw")).join(se, ["config", "nw"])
    return s.select("config", "n_obs", rounded("mean_ic").alias("mean_ic"), rounded(F.col("mean_ic") / F.col("nw_se"), 6).alias("t_stat_ic_nw"))


def bucket_sql(n: int = 5) -> str:
    k = lambda j: f"({j} * (len(s) - 1))"
    edges = ", ".join(f"CASE WHEN {k(j)} % {n} = 0 THEN s[{k(j)} // {n} + 1] ELSE s[{k(j)} // {n} + 1] + (s[{k(j)} // {n} + 2] - s[{k(j)} // {n} + 1]) * ({k(j)} % {n}) / {n}.0::DOUBLE END" for j in range(1, n))
    return f"""qp AS (SELECT ts, symbol, sig, fwd FROM sg WHERE sig IS NOT NULL AND fwd IS NOT NULL), qs AS (SELECT ts, list(sig ORDER BY sig) AS s FROM qp GROUP BY ts),
qe AS (SELECT ts, list_distinct([s[1], {edges}, s[len(s)]]) AS ed FROM qs),
qb AS (SELECT qp.*, greatest(1, len(list_filter(ed, lambda e: e < sig))) AS quantile FROM qp JOIN qe USING (ts) WHERE len(ed) > 1)"""


def _buckets(spark, sf, n: int = 5) -> DataFrame:
    return ic.quantile_buckets(_signal(spark, sf), "sig", "fwd", n)


@add("quantile_means", f"{SIGNAL}, {bucket_sql()} SELECT CAST(quantile AS INTEGER) AS quantile, {r8('avg(fwd)', 'mean_fwd_ret')}, count(*) AS n_cells FROM qb GROUP BY quantile")
def quantile_means(spark, sf):
    return ic.quantile_means(_buckets(spark, sf), "fwd").select("quantile", rounded("mean_fwd_ret").alias("mean_fwd_ret"), "n_cells")


@add("quantile_spread", f"{SIGNAL}, {bucket_sql()} SELECT ts, {r8('avg(fwd) FILTER (WHERE quantile = 5) - avg(fwd) FILTER (WHERE quantile = 1)', 'spread')} FROM qb GROUP BY ts")
def quantile_spread(spark, sf):
    return ntz(ic.quantile_spread(_buckets(spark, sf), "fwd", 5).select("ts", rounded("spread").alias("spread")))


@add("quantile_monotonicity", f"{SIGNAL}, {bucket_sql()}, qm AS (SELECT quantile, avg(fwd) AS m FROM qb GROUP BY quantile) SELECT {r8('covar_pop(quantile, m) / nullif(stddev_pop(quantile) * stddev_pop(m), 0)', 'monotonicity', 6)} FROM qm")
def quantile_monotonicity(spark, sf):
    from ..functions.columns import guarded_corr

    m = ic.quantile_means(_buckets(spark, sf), "fwd").withColumn("q", F.col("quantile").cast("double"))
    return m.agg(rounded(guarded_corr("q", "mean_fwd_ret"), 6).alias("monotonicity"))


WEIGHTS = f"{SIGNAL}, {weights_sql('sg', 'wt')}"


def _weights(spark, sf) -> DataFrame:
    return book.quantile_weights(_signal(spark, sf), "sig").withColumn("realized", F.exp("fwd") - 1)


@add("quantile_weights", f"{WEIGHTS} SELECT ts, symbol, {r8('w', 'w')} FROM wt")
def quantile_weights(spark, sf):
    return shown(_weights(spark, sf), w="w")


RETURNS = f"{WEIGHTS}, rl AS (SELECT *, exp(fwd) - 1 AS realized FROM wt)"
PERIODS = f"ts, {r8('gross', 'gross')}, {r8('costs', 'costs')}, {r8('net', 'net')}, {r8('turnover', 'turnover')}, {r8('exposure', 'exposure')}"


def _periods(spark, sf, **kw) -> DataFrame:
    return book.backtest_periods(_weights(spark, sf), "w", "realized", 5, **({"fee_bps": 10.0} | kw))


@add("backtest_periods", f"{RETURNS}, {backtest_sql('rl', 5)} SELECT {PERIODS} FROM bt")
def backtest_periods(spark, sf):
    return ntz(_periods(spark, sf).select("ts", *(rounded(c).alias(c) for c in ("gross", "costs", "net", "turnover", "exposure"))))


@add("backtest_metrics", f"{RETURNS}, {backtest_sql('rl', 5)}, {metrics_sql()} SELECT {METRICS} FROM bt_m")
def backtest_metrics(spark, sf):
    return show_metrics(book.backtest_metrics(_periods(spark, sf)))


@add("bar_delay_sweep", f"{RETURNS}, d AS (SELECT k AS delay, ts, bar_id, symbol, realized, CASE WHEN k = 0 THEN w ELSE {lag('w', 1)} END AS w FROM rl, (SELECT unnest([0]) AS k) UNION ALL SELECT 1, ts, bar_id, symbol, realized, {lag('w', 1)} FROM rl), {backtest_sql('d', 5, keys='delay')}, {metrics_sql(keys='delay')} SELECT CAST(delay AS INTEGER) AS delay, {METRICS} FROM bt_m")
def bar_delay_sweep(spark, sf):
    x = _weights(spark, sf).withColumn("w1", F.lag("w", 1).over(Window.partitionBy("symbol").orderBy("bar_id")))
    x = x.withColumn("d", F.explode(F.array(F.struct(F.lit(0).alias("delay"), F.col("w").alias("v")), F.struct(F.lit(1).alias("delay"), F.col("w1").alias("v"))))).withColumns({"delay": F.col("d.delay"), "v": F.col("d.v")})
    return show_metrics(book.backtest_metrics(book.backtest_periods(x, "v", "realized", 5, fee_bps=10.0, keys=("delay",)), ("delay",)), "delay")


@add("fee_tiers", f"{RETURNS}, f AS (SELECT rl.*, fee FROM rl, (SELECT unnest([5, 10, 20, 40]) AS fee)), {backtest_sql('f', 5, fee='fee', keys='fee')}, {metrics_sql(keys='fee')} SELECT CAST(fee AS INTEGER) AS fee, {METRICS} FROM bt_m")
def fee_tiers(spark, sf):
    """One job: the fee is a key."""
    x = _weights(spark, sf).withColumn("fee", F.explode(F.array(*[F.lit(v) for v in (5, 10, 20, 40)])))
    return show_metrics(book.backtest_metrics(book.backtest_periods(x, "w", "realized", 5, fee_bps=F.col("fee"), keys=("fee",)), ("fee",)), "fee")


@add("per_asset_costs", f"{RETURNS}, h AS (SELECT *, CAST(substr(symbol, 2) AS INT) * 0.5 AS hs FROM rl), {backtest_sql('h', 5, spread='hs')} SELECT {PERIODS} FROM bt")
def per_asset_costs(spark, sf):
    x = _weights(spark, sf).withColumn("hs", F.substring("symbol", 2, 2).cast("int") * 0.5)
    p = book.backtest_periods(x, "w", "realized", 5, fee_bps=10.0, half_spread_bps=F.col("hs"))
    return ntz(p.select("ts", *(rounded(c).alias(c) for c in ("gross", "costs", "net", "turnover", "exposure"))))


@add("leg_returns", f"{RETURNS} SELECT ts, {r8('coalesce(sum(greatest(w, 0) * realized), 0)', 'long_leg')}, {r8('coalesce(sum(least(w, 0) * realized), 0)', 'short_leg')} FROM rl GROUP BY ts")
def leg_returns(spark, sf):
    return ntz(book.leg_returns(_weights(spark, sf), "w", "realized").select("ts", rounded("long_leg").alias("long_leg"), rounded("short_leg").alias("short_leg")))


@add("drawdown", f"{RETURNS}, {backtest_sql('rl', 5)}, dr AS (SELECT ts, sum(ln(1 + net / 1000)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM bt) SELECT ts, {r8('exp(c - max(c) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1', 'drawdown')} FROM dr")
def drawdown(spark, sf):
    """Of a book at a thousandth of its size, so that the synthetic returns stay on scale."""
    x = _periods(spark, sf).withColumns({"net": F.col("net") / 1000, "gross": F.col("gross") / 1000})
    return ntz(book.with_curves(x).select("ts", rounded("drawdown").alias("drawdown")))


@add("rolling_sharpe", f"""{RETURNS}, {backtest_sql('rl', 5)} SELECT ts, {r8('CASE WHEN count(net) OVER (ORDER BY ts ROWS 19 PRECEDING) = 20 THEN sqrt(73) * avg(net) OVER (ORDER BY ts ROWS 19 PRECEDING) / nullif(stddev_samp(net) OVER (ORDER BY ts ROWS 19 PRECEDING), 0) END', 'rolling_sharpe', 6)} FROM bt""")
def rolling_sharpe(spark, sf):
    return ntz(book.rolling_sharpe(_periods(spark, sf), "net", 20, 73.0).select("ts", rounded("rolling_sharpe", 6).alias("rolling_sharpe")))


@add("rolling_ic_mean", f"{SIGNAL}, {pairs_sql()} SELECT ts, {r8('CASE WHEN count(ic) OVER (ORDER BY ts ROWS 19 PRECEDING) >= 18 THEN avg(ic) OVER (ORDER BY ts ROWS 19 PRECEDING) END', 'rolling_mean')} FROM ics")
def rolling_ic_mean(spark, sf):
    return ntz(book.rolling_mean_series(_ics(spark, sf), "ic", 20).select("ts", rounded("rolling_mean").alias("rolling_mean")))


def _beta_book(spark, sf) -> DataFrame:
    sig = _signal(spark, sf).select("ts", "symbol", "sig")
    return S.held(book.quantile_weights(_betas(spark, sf).join(sig, ["ts", "symbol"]), "sig"))


BOOK = f"{BETA}, sg AS (SELECT *, CASE WHEN member THEN round({skipped('sum', 'r', 5, 1)}, 10) END AS sig FROM e), {weights_sql('sg', 'wt')}"
PBETA = "pb AS (SELECT ts, sum(w * beta) AS pbeta, sum(abs(w)) FILTER (WHERE beta IS NOT NULL) AS cov, sum(abs(w)) AS g FROM wt GROUP BY ts)"


@add("portfolio_beta", f"{BOOK}, {PBETA} SELECT ts, {r8('pbeta', 'portfolio_beta', 6)}, {r8('coalesce(cov, 0) / nullif(g, 0)', 'beta_coverage', 6)} FROM pb")
def portfolio_beta(spark, sf):
    x = book.portfolio_beta(_beta_book(spark, sf), "w", "beta")
    return ntz(x.select("ts", rounded("portfolio_beta", 6).alias("portfolio_beta"), rounded("beta_coverage", 6).alias("beta_coverage")))


HEDGE = """hp AS (SELECT ts, sum(w * coalesce(beta, CASE WHEN coalesce(w, 0) <> 0 THEN 1.0 END)) AS bp, max(CASE WHEN symbol = 'L01' THEN coalesce(beta, 1.0) END) AS bb, coalesce(sum(abs(w)), 0) AS g FROM wt GROUP BY ts),
hw AS (SELECT wt.ts, wt.bar_id, symbol, beta, g, CASE WHEN symbol = 'L01' THEN coalesce(w, 0) + coalesce(-bp / nullif(coalesce(bb, 1.0), 0), 0) ELSE w END AS h FROM wt JOIN hp USING (ts)),
hn AS (SELECT *, h * coalesce(g / nullif(sum(abs(h)) OVER (PARTITION BY ts), 0), 1.0) AS hw FROM hw)"""


@add("beta_hedged_weights", f"{BOOK}, {HEDGE} SELECT ts, symbol, {r8('hw', 'hw', 6)} FROM hn")
def beta_hedged_weights(spark, sf):
    return shown(book.beta_hedged(_beta_book(spark, sf), "w", "beta", "L01"), 6, hw="hw")


@add("hedge_check", f"{BOOK}, {HEDGE}, c AS (SELECT ts, abs(sum(hw * beta)) AS b, bool_and(coalesce(hw, 0) = 0 OR beta IS NOT NULL) AS covered FROM hn GROUP BY ts) SELECT count(*) FILTER (WHERE covered) AS covered_bars, count(*) FILTER (WHERE covered AND b > 1e-10) AS violations FROM c")
def hedge_check(spark, sf):
    h = book.beta_hedged(_beta_book(spark, sf), "w", "beta", "L01")
    c = h.groupBy("ts").agg(F.abs(F.sum(F.col("hw") * F.col("beta"))).alias("b"), F.min((F.coalesce("hw", F.lit(0.0)) == 0) | F.col("beta").isNotNull()).alias("covered"))
    return c.agg(F.count(F.when(F.col("covered"), 1)).alias("covered_bars"), F.count(F.when(F.col("covered") & (F.col("b") > 1e-10), 1)).alias("violations"))


@add("realized_betas", f"""{RETURNS}, {backtest_sql('rl', 5)}, mk AS (SELECT ts, avg(fwd) AS mf FROM sg WHERE member GROUP BY ts), x AS (SELECT net AS s, mf AS m FROM bt JOIN mk USING (ts) WHERE net IS NOT NULL AND mf IS NOT NULL)
SELECT count(*) AS n_obs, {r8('covar_samp(s, m) / nullif(var_samp(m), 0)', 'beta_full', 6)}, {r8('covar_pop(s, m) / nullif(stddev_pop(s) * stddev_pop(m), 0)', 'corr_full', 6)}, count(*) FILTER (WHERE m > 0) AS n_up, count(*) FILTER (WHERE m < 0) AS n_down,
{r8('CASE WHEN count(*) FILTER (WHERE m > 0) >= 10 THEN covar_samp(s, m) FILTER (WHERE m > 0) / nullif(var_samp(m) FILTER (WHERE m > 0), 0) END', 'beta_up', 6)}, {r8('CASE WHEN count(*) FILTER (WHERE m < 0) >= 10 THEN covar_samp(s, m) FILTER (WHERE m < 0) / nullif(var_samp(m) FILTER (WHERE m < 0), 0) END', 'beta_down', 6)} FROM x""")
def realized_betas(spark, sf):
    mk = _signal(spark, sf).filter("member").groupBy("ts").agg(F.avg("fwd").alias("mf"))
    x = book.realized_betas(_periods(spark, sf).join(mk, "ts"), "net", "mf")
    return x.select(*(rounded(c, 6).alias(c) if c.startswith(("beta", "corr")) else c for c in x.columns))


@add("train_test_ic", f"{SIGNAL}, {pairs_sql()}, tt AS (SELECT *, CASE WHEN ts <= TIMESTAMP '1998-12-31' THEN 'train' ELSE 'test' END AS side FROM ics), {summary_sql('tt', '4', 'side')} SELECT side, n_obs, {r8('mean_ic', 'mean_ic')}, {r8('nw', 't_stat_ic_nw', 6)} FROM sm")
def train_test_ic(spark, sf):
    x = selection.train_test(_ics(spark, sf), "1998-12-31", nw_lag=4)
    return x.select("side", "n_obs", rounded("mean_ic").alias("mean_ic"), rounded("t_stat_ic_nw", 6).alias("t_stat_ic_nw"))


def folds_sql(source: str, embargo: int, name: str = "fd") -> str:
    return f"""{name}_n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS nn FROM {source}),
{name} AS (SELECT * FROM (SELECT *, (SELECT max(k) FROM range(1, 6) t(k) WHERE pos >= nn * (k - 1) // 5) AS fold FROM {name}_n) WHERE fold = 1 OR pos >= nn * (fold - 1) // 5 + {embargo})"""


@add("walk_forward_ic", f"{SIGNAL}, {pairs_sql()}, v AS (SELECT * FROM ics WHERE ic IS NOT NULL), {folds_sql('v', 5)}, {summary_sql('fd', '4', 'fold')} SELECT CAST(fold AS INTEGER) AS fold, start, \"end\", n_obs, {r8('mean_ic', 'mean_ic')}, {r8('nw', 't_stat_ic_nw', 6)} FROM sm JOIN (SELECT fold, min(ts) AS start, max(ts) AS \"end\" FROM fd GROUP BY fold) USING (fold)")
def walk_forward_ic(spark, sf):
    x = selection.walk_forward_ic(_ics(spark, sf), 5, 5, 4)
    return ntz(x.select("fold", "start", "end", "n_obs", rounded("mean_ic").alias("mean_ic"), rounded("t_stat_ic_nw", 6).alias("t_stat_ic_nw")), "start", "end")


@add("walk_forward_sharpe", f"{RETURNS}, {backtest_sql('rl', 5)}, {folds_sql('bt', 1)} SELECT CAST(fold AS INTEGER) AS fold, min(ts) AS start, max(ts) AS \"end\", count(*) AS n_obs, {r8('sqrt(73) * avg(net) / nullif(stddev_samp(net), 0)', 'sharpe_net', 6)} FROM fd GROUP BY fold")
def walk_forward_sharpe(spark, sf):
    x = selection.walk_forward_sharpe(_periods(spark, sf), "net", 73.0, 5, 1)
    return ntz(x.select("fold", "start", "end", "n_obs", rounded("sharpe_net", 6).alias("sharpe_net")), "start", "end")


def _ic_by_lookback(spark, sf) -> DataFrame:
    p = S.with_forward(S.line_panel(spark, sf), 5).withColumns({f"m{k}": F.round(features.momentum_score("r", k), 10) for k in (3, 5, 10)})
    cells = p.select("ts", "fwd", F.explode(F.array(*[F.struct(F.lit(f"lb{k:02d}").alias("config"), F.col(f"m{k}").alias("sig")) for k in (3, 5, 10)])).alias("x")).select("ts", "fwd", "x.*")
    return S.held(ic.ic_series(cells, "sig", "fwd", keys=("config",)))


SELECTION = f"""{LINE_PANEL}, c AS ({' UNION ALL '.join(f"SELECT ts, 'lb{k:02d}' AS config, round({roll('sum', 'r', k)}, 10) AS sig, ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0)) AS fwd FROM p" for k in (3, 5, 10))}),
{pairs_sql('c', keys='config')}, t AS (SELECT DISTINCT ts FROM ics), tn AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS nn FROM t),
tf AS (SELECT *, (SELECT max(k) FROM range(1, 6) q(k) WHERE pos >= nn * (k - 1) // 5) AS fold FROM tn), te AS (SELECT * FROM tf WHERE fold = 1 OR pos >= nn * (fold - 1) // 5 + 5),
ff AS (SELECT fold, min(pos) AS fp FROM te WHERE fold > 1 GROUP BY fold), sn AS (SELECT i.config, i.ts, i.ic, tn.pos FROM ics i JOIN tn USING (ts) WHERE ic IS NOT NULL),
ps AS (SELECT fold, config, avg(ic) AS sel FROM sn JOIN ff ON pos < greatest(fp - 5, 0) GROUP BY ALL), bs AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sel DESC, config) = 1)"""


@add("walk_forward_selection", f"{SELECTION} SELECT CAST(bs.fold AS INTEGER) AS fold, bs.config AS selected_config, {r8('any_value(sel)', 'selection_mean_ic')}, {r8('avg(sn.ic)', 'oos_mean_ic')}, count(sn.ic) AS oos_n_obs FROM bs LEFT JOIN (sn JOIN te USING (ts)) ON te.fold = bs.fold AND sn.config = bs.config GROUP BY bs.fold, bs.config")
def walk_forward_selection(spark, sf):
    t, _ = selection.walk_forward_selection(_ic_by_lookback(spark, sf), 5, 5)
    return t.select("fold", "selected_config", rounded("selection_mean_ic").alias("selection_mean_ic"), rounded("oos_mean_ic").alias("oos_mean_ic"), "oos_n_obs")


def _grid(spark, sf, raw: dict, configs: list[dict], label) -> DataFrame:
    p = S.line_panel(spark, sf).withColumns({k: F.round(v, 10) for k, v in raw.items()})
    x = grids.run_grid(p, configs, label, S.line_universe(spark, sf, max(c["top_n"] for c in configs)))
    return x.select("config", "n_obs", rounded("mean_ic").alias("mean_ic"), rounded("t_stat_ic_nw", 6).alias("t_stat_ic_nw"), rounded("sharpe_net", 6).alias("sharpe_net"), "n_periods")


def grid_sql(cells: str) -> str:
    """cells: SELECTs of ts, bar_id, symbol, config, transform, holding, lg, v, fwd."""
    return f"""{LINE_PANEL}, {universe_sql()}, sp AS (SELECT t.ts, max(d.rebalance_date) AS snap FROM nb t JOIN (SELECT DISTINCT rebalance_date FROM u) d ON CAST(d.rebalance_date AS TIMESTAMP) + INTERVAL 1 DAY <= t.ts GROUP BY t.ts),
pm AS (SELECT p.*, u.rank AS urank FROM p LEFT JOIN sp USING (ts) LEFT JOIN u ON u.rebalance_date = sp.snap AND u.symbol = p.symbol), c0 AS ({cells}),
c1 AS (SELECT *, count(v) OVER (PARTITION BY config, ts) AS nv, {rank_sql('v', 'config, ts')} AS rv, (v - avg(v) OVER (PARTITION BY config, ts)) / nullif(stddev_pop(v) OVER (PARTITION BY config, ts), 0) AS zv FROM c0),
c AS (SELECT *, CASE WHEN nv >= 6 THEN round(CASE transform WHEN 'rank' THEN rv WHEN 'zscore' THEN zv ELSE v END, 8) END AS sig FROM c1), cl AS (SELECT DISTINCT config, lg FROM c0),
{pairs_sql('c', keys='config')}, x AS (SELECT ics.*, lg FROM ics JOIN cl USING (config)), {summary_sql('x', 'x.lg', 'config')},
{weights_sql('c', 'wt', 'config, ts')}, st AS (SELECT config, ts, bar_id, symbol, w, exp(fwd) - 1 AS realized FROM wt WHERE bar_id % holding = 0), {backtest_sql('st', 1, keys='config')}, {metrics_sql(keys='config')}
SELECT sm.config, n_obs, {r8('mean_ic', 'mean_ic')}, {r8('nw', 't_stat_ic_nw', 6)}, {r8('sqrt(ppy) * sn', 'sharpe_net', 6)}, coalesce(n, 0) AS n_periods FROM sm LEFT JOIN bt_m USING (config)"""


REVERSAL = ResearchSettings(momentum_lookback_grid_bars=(1, 2, 4, 6), holding_period_grid_bars=(1, 2, 3, 4), cross_sectional_transform_grid=("rank",), universe_top_n_grid=(8, 10)).reversal_configs()
MOMENTUM = [c | {"raw": f"v{c['horizon']}_{c['skip']}", "lag": selection.ic_lag(c["holding"], c["horizon"])} for c in selection.grid(horizon=[5, 10], skip=[1], holding=[5], transform=["zscore", "none"], top_n=[8, 10])]


def reversal_label(c: dict) -> str:
    return selection.reversal_label(c["lookback"], c["holding"], c["transform"], c["top_n"])


def momentum_label(c: dict) -> str:
    return selection.momentum_label(c["horizon"], c["skip"], c["holding"], c["transform"], c["top_n"])


def _cells_sql(configs: list[dict], label, raw) -> str:
    fwd = lambda h: f"ln(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0))"
    return " UNION ALL ".join(f"SELECT ts, bar_id, symbol, '{label(c)}' AS config, '{c['transform']}' AS transform, {c['holding']} AS holding, {c['lag']} AS lg, CASE WHEN urank <= {c['top_n']} THEN round({raw(c)}, 10) END AS v, {fwd(c['holding'])} AS fwd FROM pm" for c in configs)


@add("reversal_grid", grid_sql(_cells_sql(REVERSAL, reversal_label, lambda c: f"-({ret(c['lookback'])})")))
def reversal_grid(spark, sf):
    return _grid(spark, sf, {c["raw"]: -bar_return("close", c["lookback"], log=IEEE) for c in REVERSAL}, REVERSAL, reversal_label)


@add("momentum_grid", grid_sql(_cells_sql(MOMENTUM, momentum_label, lambda c: skipped("sum", "r", c["horizon"], c["skip"]))))
def momentum_grid(spark, sf):
    return _grid(spark, sf, {f"v{h}_1": features.momentum_score("r", h, 1) for h in (5, 10)}, MOMENTUM, momentum_label)


FEATURES = {"reversal_h1": (lambda: -bar_return("close", 1, log=IEEE), f"-({ret(1)})"), "ret_5": (lambda: bar_return("close", 5, log=IEEE), ret(5)), "momentum_10": (lambda: features.momentum_score("r", 10), roll("sum", "r", 10)), "price_z_20": (lambda: features.price_zscore("close", 20), f"-(close - {roll('avg', 'close', 20)}) / nullif({roll('stddev_pop', 'close', 20)}, 0)")}


@add("feature_scan", f"""{LINE_MEMBER}, c AS ({' UNION ALL '.join(f"SELECT ts, '{k}' AS feature, CASE WHEN member THEN round({s}, 6) END AS sig, fwd FROM (SELECT *, ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0)) AS fwd FROM m)" for k, (_, s) in FEATURES.items())}),
{pairs_sql('c', keys='feature')}, {summary_sql('ics', '9', 'feature')} SELECT feature, {SUMMARY} FROM sm""")
def feature_scan(spark, sf):
    """All features in one job: the feature is a key."""
    p = S.with_forward(S.line_panel(spark, sf), 5).withColumns({k: F.round(f(), 6) for k, (f, _) in FEATURES.items()})
    p = panel.member_mask(p, S.line_universe(spark, sf))
    cells = p.select("ts", "fwd", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.when(F.col("member"), F.col(k)).alias("sig")) for k in FEATURES])).alias("x")).select("ts", "fwd", "x.*")
    return show_summary(ic.ic_summary(S.held(ic.ic_series(cells, "sig", "fwd", keys=("feature",))), nw_lag=9, keys=("feature",)), "feature")


@add("signal_coverage", f"""{SIGNAL}, d AS (SELECT ts, count(sig) OVER (PARTITION BY ts) AS k, abs(coalesce(sig, 0) - lag(coalesce(sig, 0)) OVER (PARTITION BY symbol ORDER BY bar_id)) AS dv FROM sg) SELECT ts, max(k) AS coverage, {r8('0.5 * coalesce(sum(dv), 0)', 'turnover_proxy', 6)} FROM d GROUP BY ts""")
def signal_coverage(spark, sf):
    p = _signal(spark, sf)
    z = F.coalesce("sig", F.lit(0.0))
    p = p.withColumn("dv", F.abs(z - F.lag(z, 1).over(Window.partitionBy("symbol").orderBy("bar_id"))))
    return ntz(p.groupBy("ts").agg(F.count("sig").alias("coverage"), rounded(0.5 * F.coalesce(F.sum("dv"), F.lit(0.0)), 6).alias("turnover_proxy")))


@add("benchmark_curve", f"{LINE_PANEL} SELECT ts, {r8('close / first_value(close) OVER (ORDER BY ts)', 'curve')} FROM p WHERE symbol = 'L01' AND close IS NOT NULL")
def benchmark_curve(spark, sf):
    x = S.line_panel(spark, sf).filter("symbol = 'L01' and close is not null")
    return ntz(x.select("ts", rounded(F.col("close") / F.first("close").over(Window.partitionBy("symbol").orderBy("ts"))).alias("curve")))


@add("warn_lifecycle", f"""{LINE_ROWS}, s AS (SELECT symbol, min(ts) AS a, max(ts) AS b, count(*) AS n_rows FROM rows_ GROUP BY symbol), g AS (SELECT min(a) AS f, max(b) AS l FROM s)
SELECT symbol, CAST(floor(epoch(a - f) / 86400) AS BIGINT) AS start_late_days, CAST(floor(epoch(l - b) / 86400) AS BIGINT) AS end_early_days, n_rows, floor(epoch(a - f) / 86400) > 2 AS is_late, floor(epoch(l - b) / 86400) > 2 AS is_early, n_rows < 2160 AS is_short FROM s, g""")
def warn_lifecycle(spark, sf):
    return quality.lifecycle(S.daily_rows(spark, sf), 2, 2)


COLLAPSE = """dl AS (SELECT symbol, CAST(ts AS DATE) AS day, avg(dollar_volume) AS v FROM rows_ GROUP BY ALL),
dw AS (SELECT *, avg(v) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS last_7d, avg(v) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 36 PRECEDING AND 7 PRECEDING) AS prev_30d FROM dl),
df AS (SELECT *, last_7d < 0.5 * prev_30d AS low FROM dw WHERE prev_30d IS NOT NULL), dc AS (SELECT * FROM (SELECT *, lag(low, 1, false) OVER (PARTITION BY symbol ORDER BY day) AS before FROM df) WHERE low AND NOT before)"""


@add("warn_liquidity_collapse", f"{LINE_ROWS}, {COLLAPSE} SELECT symbol, day, {r8('last_7d', 'last_7d', 3)}, {r8('prev_30d', 'prev_30d', 3)} FROM dc")
def warn_liquidity_collapse(spark, sf):
    return quality.liquidity_collapse(S.daily_rows(spark, sf), 0.5).select("symbol", "day", rounded("last_7d", 3).alias("last_7d"), rounded("prev_30d", 3).alias("prev_30d"))


@add("event_log_union", f"""{UNIVERSE}, {COLLAPSE}, x AS (SELECT ts, symbol, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM rows_ WHERE symbol IN (SELECT symbol FROM u)),
s AS (SELECT symbol, min(ts) AS a, max(ts) AS b, count(*) AS n_rows FROM rows_ GROUP BY symbol), g AS (SELECT min(a) AS f, max(b) AS l FROM s),
d AS (SELECT rebalance_date, lag(rebalance_date) OVER (ORDER BY rebalance_date) AS pd FROM (SELECT DISTINCT rebalance_date FROM u)),
tu AS (SELECT rebalance_date, 1 - (SELECT count(*) FROM u a JOIN u b USING (symbol) WHERE a.rebalance_date = d.rebalance_date AND b.rebalance_date = d.pd) / (SELECT count(*) FROM u WHERE u.rebalance_date = d.pd)::DOUBLE AS t FROM d WHERE pd IS NOT NULL),
ev AS (SELECT 'extreme_return' AS k, symbol, ts, ret AS v FROM x WHERE abs(ret) >= 1.5
UNION ALL SELECT 'large_symbol_gap', symbol, ts, h FROM (SELECT symbol, ts, epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 3600 AS h FROM rows_) WHERE h > 24
UNION ALL SELECT 'liquidity_collapse', symbol, CAST(day AS TIMESTAMP), last_7d / nullif(prev_30d, 0) FROM dc
UNION ALL SELECT 'starts_late', symbol, NULL, floor(epoch(a - f) / 86400) FROM s, g WHERE floor(epoch(a - f) / 86400) > 2
UNION ALL SELECT 'ends_early', symbol, NULL, floor(epoch(l - b) / 86400) FROM s, g WHERE floor(epoch(l - b) / 86400) > 2
UNION ALL SELECT 'short_life', symbol, NULL, n_rows FROM s WHERE n_rows < 2160
UNION ALL SELECT 'high_universe_turnover', NULL, CAST(rebalance_date AS TIMESTAMP), t FROM tu WHERE t > 0.3)
SELECT k AS event_type, symbol, ts, {r8('v', 'metric_value', 6)} FROM ev""")
def event_log_union(spark, sf):
    t = {"extreme_return_abs": 1.5, "large_symbol_gap_hours": 24, "liquidity_collapse_ratio": 0.5, "lifecycle_start_late_days": 2, "lifecycle_end_early_days": 2, "high_universe_turnover": 0.3}
    x = quality.event_log(S.daily_rows(spark, sf), S.line_universe(spark, sf), t)
    return ntz(x.select("event_type", "symbol", "ts", rounded("metric_value", 6).alias("metric_value")))


@add("sample_moments", f"{RETURNS}, {backtest_sql('rl', 5)} SELECT {r8('skewness(net)', 'skew', 6)}, {r8('kurtosis(net) + 3', 'kurt', 6)} FROM bt")
def sample_moments(spark, sf):
    a, b = selection.sample_moments("net")
    return _periods(spark, sf).agg(rounded(a, 6).alias("skew"), rounded(b, 6).alias("kurt"))

