"""Study-level queries: tables that a research script prints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import IEEE, bar_return, rounded
from ..operators import book, execution, features, ic, panel, spreads, universe
from . import catalogue_lines as L
from . import frames as S
from . import grids
from .catalogue_events import CS_CTE, METRICS, REV2, backtest_sql, exec_sql, metrics_sql, show_metrics, weights_sql
from .catalogue_lines import BOOK, HEDGE, PBETA, pairs_sql, summary_sql
from .frames import EVENT_PANEL, LINE_PANEL, r8

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@add("feature_ic_row", f"""{exec_sql('5')}, c AS (SELECT p.ts, p.symbol, {REV2} AS sig, ln(lead(close, 2) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0)) AS fwd FROM p),
j AS (SELECT c.*, ef.exec_any AS ex FROM c JOIN ef USING (ts, symbol)), {pairs_sql('j')}, {summary_sql('ics', '1')}, {pairs_sql('j', y='ex', name='icx')}, {summary_sql('icx', '1', name='sx')}
SELECT sm.n_obs, {r8('sm.mean_ic', 'mean_ic')}, {r8('sm.nw', 't_stat_ic_nw', 6)}, {r8('sx.mean_ic', 'tradable_ic')}, {r8('sx.nw', 'tradable_t_nw', 6)}, {r8('1 - sx.mean_ic / nullif(sm.mean_ic, 0)', 'haircut', 6)} FROM sm, sx""")
def feature_ic_row(spark, sf):
    p = S.with_forward(S.event_panel(spark, sf).withColumn("sig", F.round(-bar_return("close", 2, log=IEEE), 10)), 2)
    ex = execution.exec_forward(execution.exec_panel(p, execution.exec_closes(S.minute_rows(spark, sf), 5)), 2, IEEE, direct_only=False).select("ts", "symbol", "exec_fwd")
    x = ic.feature_ic(p.join(ex, ["ts", "symbol"]), "sig", "fwd", "exec_fwd", 1)
    return x.select("n_obs", rounded("mean_ic").alias("mean_ic"), rounded("t_stat_ic_nw", 6).alias("t_stat_ic_nw"), rounded("tradable_ic").alias("tradable_ic"), rounded("tradable_t_nw", 6).alias("tradable_t_nw"), rounded("haircut", 6).alias("haircut"))


@add("decay_table", f"""WITH x AS (SELECT regexp_extract(config, '^(R\\d+)', 1) AS signal, CAST(regexp_extract(config, 'H(\\d+)', 1) AS INTEGER) AS holding, t_stat_ic_nw AS t FROM ({L.ORACLES['ic_decay_matrix']})),
y AS (SELECT *, lag(t) OVER w AS t0, lag(holding) OVER w AS h0 FROM x WINDOW w AS (PARTITION BY signal ORDER BY holding))
SELECT signal, arg_max(holding, t) AS peak_holding, {r8('max(t)', 'peak_t', 6)}, {r8('arg_min(t, holding)', 'first_t', 6)}, {r8('min(CASE WHEN t < 1 AND t0 >= 1 THEN h0 + (t0 - 1) / (t0 - t) * (holding - h0) END)', 'decay_holding', 4)} FROM y GROUP BY signal""")
def decay_table(spark, sf):
    x = L.QUERIES["ic_decay_matrix"](spark, sf).select(F.regexp_extract("config", r"^(R\d+)", 1).alias("signal"), F.regexp_extract("config", r"H(\d+)", 1).cast("int").alias("holding"), F.col("t_stat_ic_nw").alias("t"))
    d = ic.decay_table(x)
    return d.select("signal", "peak_holding", rounded("peak_t", 6).alias("peak_t"), rounded("first_t", 6).alias("first_t"), rounded("decay_holding", 4).alias("decay_holding"))


@add("market_correlation", f"""{L.RETURNS}, {backtest_sql('rl', 5)}, mk AS (SELECT ts, avg(r) AS m FROM p GROUP BY ts), x AS (SELECT net AS a, m AS b FROM bt JOIN mk USING (ts) WHERE net IS NOT NULL AND m IS NOT NULL)
SELECT {r8('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)', 'corr', 6)}, count(*) AS n_obs FROM x""")
def market_correlation(spark, sf):
    m = features.market_index(S.line_panel(spark, sf), "r")
    x = ic.correlation(L._periods(spark, sf), m, "net", "market")
    return x.select(rounded("corr", 6).alias("corr"), "n_obs")


@add("universe_window", f"{L.UNIVERSE} SELECT rebalance_date, symbol, rank FROM u WHERE rebalance_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def universe_window(spark, sf):
    return universe.in_window(S.line_universe(spark, sf), "1997-01-01", "1997-12-31").select("rebalance_date", "symbol", "rank")


def beta_sql(window: int, least: int) -> str:
    w = L.w(window)
    return f"CASE WHEN regr_count(r, market) OVER {w} >= {least} THEN CASE WHEN regr_sxx(r, market) OVER {w} = 0 THEN NULL ELSE regr_slope(r, market) OVER {w} END END"


SWEEP = [(w, s) for w in (30, 60) for s in (0.0, 0.2, 0.5)]


@add("beta_sweep", f"""{L.LINE_MEMBER}, {L.MARKET}, j AS (SELECT m.*, mk.market FROM m JOIN mk USING (ts)), b AS (SELECT ts, symbol, {beta_sql(30, 20)} AS b30, {beta_sql(60, 45)} AS b60 FROM j)
{' UNION ALL '.join(f"SELECT {w} AS window_bars, CAST({s} AS DOUBLE) AS shrinkage, {r8(f'avg((1 - {s}) * b{w} + {s})', 'mean_beta', 6)}, {r8(f'stddev_samp((1 - {s}) * b{w} + {s})', 'std_beta', 6)}, count(b{w}) AS n FROM b" for w, s in SWEEP)}""")
def beta_sweep(spark, sf):
    """Windows are columns of one pass, shrinkage is a key."""
    p = L._members(spark, sf)
    p = p.join(features.market_index(p, "r", mask="member", min_assets=5), "ts").withColumns({"b30": features.rolling_beta("r", "market", 30, 20), "b60": features.rolling_beta("r", "market", 60, 45)})
    x = p.select(F.explode(F.array(*[F.struct(F.lit(w).alias("window_bars"), F.lit(s).alias("shrinkage"), ((1 - s) * F.col(f"b{w}") + s).alias("b")) for w, s in SWEEP])).alias("x")).select("x.*")
    return x.groupBy("window_bars", "shrinkage").agg(rounded(F.avg("b"), 6).alias("mean_beta"), rounded(F.stddev_samp("b"), 6).alias("std_beta"), F.count("b").alias("n"))


@add("hedge_variants", f"""{BOOK}, {HEDGE}, fr AS (SELECT ts, symbol, exp(ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0))) - 1 AS realized FROM p),
v AS (SELECT 'plain' AS variant, wt.ts, wt.bar_id, wt.symbol, w, realized FROM wt JOIN fr USING (ts, symbol) UNION ALL SELECT 'hedged', hn.ts, hn.bar_id, hn.symbol, hw, realized FROM hn JOIN fr USING (ts, symbol)),
{backtest_sql('v', 5, keys='variant')}, {metrics_sql(keys='variant')} SELECT variant, {METRICS} FROM bt_m""")
def hedge_variants(spark, sf):
    """The variant is a key of one backtest."""
    p = book.beta_hedged(L._beta_book(spark, sf), "w", "beta", "L01")
    f = S.with_forward(S.line_panel(spark, sf), 5).select("ts", "symbol", (F.exp("fwd") - 1).alias("realized"))
    x = p.join(f, ["ts", "symbol"]).withColumn("v", F.explode(F.array(F.struct(F.lit("plain").alias("variant"), F.col("w").alias("u")), F.struct(F.lit("hedged").alias("variant"), F.col("hw").alias("u"))))).withColumns({"variant": F.col("v.variant"), "u": F.col("v.u")})
    return show_metrics(book.backtest_metrics(book.backtest_periods(x, "u", "realized", 5, fee_bps=10.0, keys=("variant",)), ("variant",)), "variant")


@add("ex_ante_beta", f"""{BOOK}, {PBETA}, a AS (SELECT ts, abs(pbeta) AS b FROM pb WHERE pbeta IS NOT NULL) SELECT {r8('avg(b)', 'mean_abs_beta', 6)}, {r8('quantile_cont(b, 0.95)', 'p95_abs_beta', 6)}, count(*) AS n_bars FROM a""")
def ex_ante_beta(spark, sf):
    x = book.portfolio_beta(L._beta_book(spark, sf), "w", "beta").filter("portfolio_beta is not null").withColumn("b", F.abs("portfolio_beta"))
    return x.agg(rounded(F.avg("b"), 6).alias("mean_abs_beta"), rounded(F.percentile("b", 0.95), 6).alias("p95_abs_beta"), F.count("*").alias("n_bars"))


@add("stale_artifact", f"""{EVENT_PANEL}, c AS (SELECT *, {REV2} AS sig, ln(lead(close, 1) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0)) AS fwd, coalesce(trades > 0, false) AS tr FROM p),
k AS (SELECT 'all' AS cells, ts, symbol, sig, fwd FROM c UNION ALL SELECT 'traded', ts, symbol, CASE WHEN tr THEN sig END, fwd FROM c), {pairs_sql('k', keys='cells')}, {summary_sql('ics', '1', 'cells')}
SELECT cells, n_obs, {r8('mean_ic', 'mean_ic')}, {r8('nw', 't_stat_ic_nw', 6)} FROM sm""")
def stale_artifact(spark, sf):
    p = panel.traded(S.with_forward(S.event_panel(spark, sf).withColumn("sig", F.round(-bar_return("close", 2, log=IEEE), 10)), 1))
    x = p.withColumn("v", F.explode(F.array(F.struct(F.lit("all").alias("cells"), F.col("sig").alias("u")), F.struct(F.lit("traded").alias("cells"), panel.keep_traded("sig").alias("u"))))).select("ts", "symbol", "fwd", "v.*")
    s = ic.ic_summary(ic.ic_series(x, "u", "fwd", keys=("cells",)), nw_lag=1, keys=("cells",))
    return s.select("cells", "n_obs", rounded("mean_ic").alias("mean_ic"), rounded("t_stat_ic_nw", 6).alias("t_stat_ic_nw"))


@add("bounce_floor", f"""{EVENT_PANEL}, {CS_CTE}, hs AS (SELECT symbol, CASE WHEN count(s) >= 30 THEN avg(s) / 2 * 1e4 END AS h FROM cs GROUP BY symbol),
sg AS (SELECT *, {REV2} AS sig, lead(close, 1) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0) - 1 AS realized FROM p), {weights_sql('sg', 'wt')}, {backtest_sql('wt', 1)}
SELECT {r8('avg(gross) * 1e4', 'gross_bps', 4)}, {r8('2 * avg(turnover) * (SELECT avg(h) FROM hs)', 'floor_bps', 4)} FROM bt""")
def bounce_floor(spark, sf):
    p = S.event_panel(spark, sf).withColumns({"sig": F.round(-bar_return("close", 2, log=IEEE), 10), "fwd": F.col("close")})
    p = S.with_forward(p, 1).withColumn("realized", F.exp("fwd") - 1).withColumn("cs", spreads.corwin_schultz())
    bt = book.backtest_periods(book.quantile_weights(p, "sig"), "w", "realized", 1, fee_bps=10.0).agg(F.avg("gross").alias("g"), F.avg("turnover").alias("t"), F.lit(1).alias("one"))
    h = spreads.half_spread_bps(p, "cs", "mean").agg(F.avg("half_spread_bps").alias("h"), F.lit(1).alias("one"))
    return bt.join(h, "one").select(rounded(F.col("g") * 1e4, 4).alias("gross_bps"), rounded(2 * F.col("t") * F.col("h"), 4).alias("floor_bps"))


@add("grid_surface", f"""WITH g AS ({L.ORACLES['reversal_grid']}), x AS (SELECT CAST(regexp_extract(config, 'lb(\\d+)', 1) AS INTEGER) AS lookback, CAST(regexp_extract(config, '_h(\\d+)', 1) AS INTEGER) AS holding, mean_ic FROM g)
SELECT lookback, {r8('avg(mean_ic) FILTER (WHERE holding = 1)', 'h1', 7)}, {r8('avg(mean_ic) FILTER (WHERE holding = 3)', 'h3', 7)} FROM x GROUP BY lookback""")
def grid_surface(spark, sf):
    g = L.QUERIES["reversal_grid"](spark, sf).select(F.regexp_extract("config", r"lb(\d+)", 1).cast("int").alias("lookback"), F.regexp_extract("config", r"_h(\d+)", 1).cast("int").alias("holding"), "mean_ic")
    x = grids.surface(g, "lookback", "holding", "mean_ic", [1, 3])
    return x.select("lookback", rounded("1", 7).alias("h1"), rounded("3", 7).alias("h3"))


@add("evaluate_config", f"""{LINE_PANEL}, v AS (SELECT *, round({L.skipped('sum', 'r', 5, 1)}, 10) AS v, ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_id) / nullif(close, 0)) AS fwd FROM p),
sg AS (SELECT *, round(CASE WHEN count(v) OVER (PARTITION BY ts) >= 6 THEN (v - avg(v) OVER (PARTITION BY ts)) / nullif(stddev_pop(v) OVER (PARTITION BY ts), 0) END, 8) AS sig FROM v), d AS (SELECT * FROM sg WHERE bar_id % 2 = 0), {pairs_sql('d')}, {summary_sql('ics', '2')},
{weights_sql('sg', 'wt')}, rl AS (SELECT *, exp(fwd) - 1 AS realized FROM wt), {backtest_sql('rl', 5)}, {metrics_sql()}, tt AS (SELECT avg(ic) FILTER (WHERE ts <= TIMESTAMP '1998-12-31') AS a, avg(ic) FILTER (WHERE ts > TIMESTAMP '1998-12-31') AS b FROM ics)
SELECT n_obs, {r8('mean_ic', 'mean_ic')}, {r8('nw', 't_stat_ic_nw', 6)}, {r8('a', 'train_ic')}, {r8('b', 'test_ic')}, {r8('sqrt(ppy) * sn', 'sharpe_net', 6)}, n AS n_periods FROM sm, bt_m, tt""")
def evaluate_config(spark, sf):
    p = S.line_panel(spark, sf).withColumn("v5", F.round(features.momentum_score("r", 5, 1), 10))
    x = grids.evaluate(p, "v5", 5, 5, decimation=2, split="1998-12-31", fee_bps=10.0)
    return x.select("n_obs", *(rounded(c, 6 if c in ("t_stat_ic_nw", "sharpe_net") else 8).alias(c) for c in ("mean_ic", "t_stat_ic_nw", "train_ic", "test_ic", "sharpe_net")), "n_periods")
