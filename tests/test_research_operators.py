"""IC, books, backtests, execution, selection, universe and quality operators."""

import datetime as dt
import math
import random
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyx.operators import book, execution, ic, panel, quality, selection, universe

from .test_panel_operators import at, close_to, long, wide


def cells(spark, n=120, m=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for s in range(m):
            a = round(float(rng.normal()), 1) if rng.random() < 0.7 and i % 40 != 5 else None
            if i == 7:
                a = 1.0
            b = float(rng.normal()) if rng.random() < 0.9 else None
            rows.append((at(i), i, f"S{s:02d}", a, b))
    return spark.createDataFrame(rows, "ts timestamp, bar_id int, symbol string, sig double, fwd double")


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_ic_against_pandas(spark, method):
    df = cells(spark)
    got = {r.ts: (r.n_pairs, r.ic) for r in ic.ic_series(df, "sig", "fwd", method).collect()}
    pdf = df.toPandas().dropna()
    assert set(got) == set(pdf.ts)
    for t, g in pdf.groupby("ts"):
        want = None
        x, y = (g.sig.rank(), g.fwd.rank()) if method == "spearman" else (g.sig, g.fwd)
        if len(g) >= 6 and x.nunique() > 1:
            want = np.corrcoef(x, y)[0, 1]
        n, v = got[t]
        assert n == len(g) and (v is None) == (want is None) and (v is None or abs(v - want) < 1e-10)


def test_ic_summary_and_newey_west(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=200)) * 0.01
    df = spark.createDataFrame([(at(i), None if i == 50 else float(v)) for i, v in enumerate(x)], "ts timestamp, ic double")
    y = np.delete(x, 50)
    e, n, lag = y - y.mean(), len(y), 7
    var = (e @ e + 2 * sum((1 - k / (lag + 1)) * (e[k:] @ e[:-k]) for k in range(1, lag + 1))) / n
    s = ic.ic_summary(df, nw_lag=lag).first()
    close_to([s.mean_ic, s.std_ic, s.t_stat_ic_nw, s.p05, s.median_ic], [y.mean(), y.std(ddof=1), y.mean() / math.sqrt(var / n), np.quantile(y, 0.05), np.median(y)])
    plain = ic.ic_summary(df).first()
    assert plain.n_obs == 199 and plain.t_stat_ic == plain.t_stat_ic_nw
    short = ic.newey_west(df.limit(3), "ic", 50).first().nw_se  # the lag is cut to what there is
    assert short is None or short > 0


def test_quantile_buckets(spark):
    p = long(spark, {f"S{i}": [float(i), 1.0] for i in range(10)}).withColumn("fwd", F.col("close") / 10)
    b = ic.quantile_buckets(p, "close", "fwd", 5)
    got = {r.symbol: r["quantile"] for r in b.filter("bar_id = 0").collect()}
    assert [got[f"S{i}"] for i in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert b.filter("bar_id = 1").count() == 0  # all equal: no bucket
    assert math.isclose(ic.quantile_spread(b, "fwd", 5).first().spread, 0.8)
    with pytest.raises(ValueError):
        ic.quantile_buckets(p, "close", "fwd", 1)


def signal(spark, rows):
    return long(spark, dict(zip("ABCDE", zip(*rows)))).withColumnRenamed("close", "sig")


def slow_banded(rows, band, top=0.2, bottom=0.2):
    ranks = pd.DataFrame(rows).rank(axis=1, pct=True).to_numpy()
    out, long_, short = np.zeros(ranks.shape), np.zeros(ranks.shape[1], bool), np.zeros(ranks.shape[1], bool)
    for i, r in enumerate(ranks):
        ok = ~np.isnan(r)
        if not ok.any():
            out[i] = out[i - 1] if i else 0
            continue
        long_ = ok & ((r >= 1.0 - top) | (long_ & (r >= 1.0 - top - band)))
        short = ok & ((r <= bottom) | (short & (r <= bottom + band)))
        both = long_ & short
        long_, short = long_ & ~both, short & ~both
        out[i] = long_ / max(long_.sum(), 1) - short / max(short.sum(), 1)
    return out


@pytest.mark.parametrize("band", [0.0, 0.1, 0.2, 0.35, 0.5])
def test_banded_weights_against_a_loop(spark, band):
    rng = random.Random(5)
    rows = [[None if rng.random() < 0.15 or i in (0, 9) else rng.gauss(0, 1) for _ in range(5)] for i in range(40)]
    got = wide(book.banded_weights(signal(spark, rows), "sig", band=band), "w")
    want = slow_banded([[np.nan if v is None else v for v in r] for r in rows], band)
    for k, s in enumerate("ABCDE"):
        close_to(got[s], want[:, k].tolist())


def test_weights_are_balanced_and_unbanded_is_plain(spark):
    df = cells(spark, 40).filter("bar_id <> 5")  # a row without a signal repeats the banded weights
    w = book.quantile_weights(df, "sig")
    for r in w.groupBy("ts").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("gross")).collect():
        # Ties can leave a side empty, or both.
        assert math.isclose(r.gross, 2) and abs(r.net) < 1e-9 or math.isclose(r.gross, 1) and math.isclose(abs(r.net), 1) or r.gross == r.net == 0
    assert wide(book.banded_weights(df, "sig"), "w") == wide(w, "w")
    with pytest.raises(ValueError):
        book.quantile_weights(df, "sig", top=1.0)


def test_banded_book_holds_between_decisions(spark):
    rng = random.Random(6)
    p = signal(spark, [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)])
    b = wide(book.banded_book(p, "sig", 4, 0.1), "w")
    assert all(v[i] == v[i - i % 4] for v in b.values() for i in range(12))


def weights(spark, wide_w, realized):
    p = long(spark, wide_w).withColumnRenamed("close", "w")
    r = long(spark, realized).withColumnRenamed("close", "realized").drop("ts")
    return p.join(r, ["symbol", "bar_id"])


def test_backtest_accounting(spark):
    p = weights(spark, {"A": [0.0, 0.5, 0.5, -0.5, 0.5], "B": [0.0, -0.5, -0.5, 0.5, -0.5]}, {"A": [0.0, 0.1, None, 0.1, 0.2], "B": [0.0, 0.0, 0.1, -0.1, 0.0]})
    got = book.backtest_periods(p, "w", "realized", fee_bps=10.0, half_spread_bps=0.0).orderBy("ts").collect()
    # Flat rows before the first position go; bar 2 cannot be priced and goes with its costs; the change into bar 3 is from bar 2.
    assert [r.ts for r in got] == [at(1), at(3), at(4)]
    close_to([r.gross for r in got], [0.05, -0.1, 0.1])
    close_to([r.costs for r in got], [0.001, 0.002, 0.002])
    close_to([r.turnover for r in got], [0.5, 1.0, 1.0])
    open_ = weights(spark, {"A": [1.0, 1.0]}, {"A": [0.1, 0.1]})
    assert [r.costs for r in book.backtest_periods(open_, "w", "realized").collect()] == [0.0, 0.0]  # a book that is open at the start pays no entry
    free = book.backtest_periods(p, "w", "realized", fee_bps=0.0, half_spread_bps=0.0).collect()
    assert all(r.gross == r.net for r in free)


def test_backtest_steps_and_delay(spark):
    p = weights(spark, {"A": [1.0, -1.0, 1.0, -1.0, 1.0]}, {"A": [0.1] * 5})
    close_to([r.gross for r in book.backtest_periods(p, "w", "realized", holding=2).orderBy("ts").collect()], [0.1] * 3)
    close_to([r.gross for r in book.backtest_periods(p, "w", "realized", delay=1).orderBy("ts").collect()], [0.1, -0.1, 0.1, -0.1])


def test_metrics_and_drawdown(spark):
    x = spark.createDataFrame([(at(i, 24), g, 0.0, g, 0.1, 1.0) for i, g in enumerate([-0.5, 0.1, -0.2, 0.3])], "ts timestamp, gross double, costs double, net double, turnover double, exposure double")
    m = book.backtest_metrics(x).first()
    r = np.array([-0.5, 0.1, -0.2, 0.3])
    close_to([m.periods_per_year, m.sharpe_net, m.max_drawdown_net, m.total_net_return], [365.0, math.sqrt(365) * r.mean() / r.std(ddof=1), -0.2, np.prod(1 + r) - 1])
    one = book.backtest_metrics(x.limit(1)).first()
    assert one.sharpe_net is None and one.n_periods == 1 and one.periods_per_year == 365.0


def test_hedge_cancels_the_beta(spark):
    rng = random.Random(7)
    syms = ["A", "B", "C", "X"]
    p = long(spark, {s: [rng.uniform(-1, 1) for _ in range(6)] for s in syms}).withColumnRenamed("close", "w")
    p = p.withColumn("beta", F.when(F.col("symbol") == "X", 1.2).when(F.col("symbol") == "A", 0.5).when(F.col("symbol") == "B", 2.0))
    h = book.beta_hedged(p, "w", "beta", "X")
    for r in h.withColumn("b", F.coalesce("beta", F.lit(1.0))).groupBy("ts").agg(F.sum(F.col("hw") * F.col("b")).alias("b"), F.sum(F.abs("hw")).alias("g"), F.sum(F.abs("w")).alias("g0")).collect():
        assert abs(r.b) < 1e-10 and math.isclose(r.g, r.g0)
    new = book.beta_hedged(p.filter("symbol <> 'X'"), "w", "beta", "X", normalize=False)
    assert new.filter("symbol = 'X'").count() == 6
    cover = book.portfolio_beta(p, "w", "beta").first()
    assert 0 < cover.beta_coverage < 1
    with pytest.raises(ValueError):
        book.beta_hedged(p, "w", "beta", "X", max_hedge=0)


def test_execution_panel_fills_forward_only(spark):
    p = long(spark, {"AAA": [100.0 + i for i in range(6)], "BBB": [50.0 + i for i in range(6)]}, hours=1)
    closes = spark.createDataFrame([(at(i, 1), "AAA", 100.0 + i) for i in range(6)] + [(at(i, 1), "BBB", 50.0 + i) for i in (1, 3, 4, 5)], "bucket_ts timestamp, symbol string, exec_close double")
    x = execution.exec_panel(p, closes, fallback=False)
    assert wide(x, "exec_close")["BBB"] == [None, 51.0, 51.0, 53.0, 54.0, 55.0]
    c = execution.fill_counts(x).first()
    assert (c.cells, c.direct_cells, c.locf_cells, c.fallback_cells, c.empty_cells) == (12, 10, 1, 0, 1)
    assert wide(execution.exec_panel(p, closes), "fill")["BBB"][0] == "fallback"
    f = wide(execution.exec_forward(x, 1, log=False), "exec_fwd")
    assert f["BBB"][:3] == [None, None, None] and math.isclose(f["BBB"][3], 54 / 53 - 1)
    execution.assert_zero_delay(p.withColumn("volume", F.lit(1.0)), closes)
    with pytest.raises(AssertionError):
        execution.assert_zero_delay(p.withColumns({"volume": F.lit(1.0), "close": F.col("close") * 1.01}), closes)
    with pytest.raises(ValueError):
        execution.exec_closes(closes, -1)
    cache = execution.ExecutionPrices(spark.createDataFrame([(at(0, 1), "AAA", 1.0)], "ts timestamp, symbol string, close double"), p)
    assert cache.close_panel(0) is cache.close_panel(0) and cache.diagnostics(0).first().direct_cells == 1
    cache.release()


def test_bucket_closes_shift_by_the_delay(spark):
    m = spark.createDataFrame([(dt.datetime(2023, 1, 1, h, mi), "A", float(100 * h + mi)) for h in (0, 1) for mi in (0, 4, 5, 59)], "ts timestamp, symbol string, close double")
    got = {r.bucket_ts: r.exec_close for r in execution.exec_closes(m, 5).collect()}
    assert got == {dt.datetime(2022, 12, 31, 23): 4.0, dt.datetime(2023, 1, 1, 0): 104.0, dt.datetime(2023, 1, 1, 1): 159.0}
    sweep = execution.exec_closes_sweep(m, [0, 5]).filter("delay = 5").collect()
    assert {r.bucket_ts: r.exec_close for r in sweep} == got


def test_selection_closed_forms():
    n = NormalDist()
    assert math.isclose(selection.max_over_trials_pvalue(2.0, 1), 1 - n.cdf(2.0))
    assert selection.max_over_trials_pvalue(2.0, 50) > selection.max_over_trials_pvalue(2.0, 5)
    assert selection.expected_max_sharpe(1, 4.0, 0.3) == 0.3 and selection.expected_max_sharpe(100, 1.0) > selection.expected_max_sharpe(10, 1.0) > 0
    assert math.isclose(selection.probabilistic_sharpe_ratio(0.1, 0.1, 50), 0.5)
    assert selection.deflated_sharpe_ratio(0.1, 100, 20, 0.01) < selection.probabilistic_sharpe_ratio(0.1, 0.0, 100)
    for bad in (lambda: selection.max_over_trials_pvalue(1, 0), lambda: selection.expected_max_sharpe(0, 1)):
        with pytest.raises(ValueError):
            bad()
    assert selection.reversal_label(2, 3, "zscore", 8) == "lb2_h3_zscore_top8" and len(selection.grid(a=[1, 2], b=[3, 4, 5])) == 6 and selection.ic_lag(3, 2, 1) == 2


def test_folds_and_selection(spark):
    s = spark.createDataFrame([(at(i), float(i)) for i in range(11)], "ts timestamp, ic double")
    folds = {}
    for r in selection.with_folds(s, 3, 1).orderBy("ts").collect():
        folds.setdefault(r.fold, []).append(int(r.ic))
    assert folds == {1: [0, 1, 2], 2: [4, 5, 6], 3: [8, 9, 10]}
    with pytest.raises(ValueError):
        selection.with_folds(s, 1)
    lucky = [(at(i), "lucky", 0.5 if i < 20 else -0.5) for i in range(40)] + [(at(i), "steady", 0.1) for i in range(40)]
    table, oos = selection.walk_forward_selection(spark.createDataFrame(lucky, "ts timestamp, config string, ic double"), 4)
    got = {r.fold: (r.selected_config, r.oos_mean_ic) for r in table.collect()}
    assert got[2] == ("lucky", 0.5) and got[3] == ("lucky", -0.5) and oos.count() == 30


def test_moments_are_bias_corrected(spark):
    x = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0, 3.0)], "x double")
    got = x.agg(*(c.alias(k) for c, k in zip(selection.sample_moments("x"), "ab"))).first()
    close_to([got.a, got.b - 3], [pd.Series([1, 2, 4, 10, 3]).skew(), pd.Series([1, 2, 4, 10, 3]).kurt()])


def test_universe_windows(spark):
    rng = random.Random(8)
    rows = [(dt.datetime(2023, 1, 1) + dt.timedelta(days=d), f"S{k}", rng.uniform(0, 10) * k) for d in range(200) for k in range(1, 6) if not (k == 5 and d < 100)]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, dollar_volume double")
    got = universe.monthly_universe(df, 3, 30, 40, 5.0, 5.0)
    pdf = df.toPandas()
    want = set()
    for end in {(t + pd.offsets.MonthEnd(0)).normalize() for t in pdf.ts}:
        w = pdf[(pdf.ts >= end - pd.Timedelta(days=30)) & (pdf.ts < end)]
        first = pdf.groupby("symbol").ts.min()
        liq = w.groupby("symbol").dollar_volume.mean()
        week = w[w.ts >= end - pd.Timedelta(days=7)].groupby("symbol").dollar_volume.mean()
        ok = [(v, s) for s, v in liq.items() if v >= 5 and week.get(s, -1) >= 5 and first[s] < end - pd.Timedelta(days=40)]
        want |= {(end.date(), s, k + 1) for k, (v, s) in enumerate(sorted(ok, key=lambda x: (-x[0], x[1]))[:3])}
    assert {(r.rebalance_date, r.symbol, r["rank"]) for r in got.collect()} == want
    last = sorted({d for d, _, _ in want})[-1]
    assert {r.symbol for r in universe.list_symbols(got, last, 1).collect()} == {s for d, s, k in want if d == sorted({d for d, _, _ in want})[-2] and k == 1}


def test_quality_checks(spark):
    row = lambda h, **kw: {"ts": at(h, 1), "symbol": "A", "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0, "trades": 1} | kw
    schema = "ts timestamp, symbol string, open double, high double, low double, close double, volume double, trades int"
    good = spark.createDataFrame([row(h) for h in range(3)], schema)
    assert set(quality.run_checks(good).values()) == {0}
    bad = spark.createDataFrame([row(0), row(0), row(1, high=0.5), row(2, close=None), row(5, volume=-1.0)], schema)
    with pytest.raises(ValueError, match="duplicate_keys"):
        quality.run_checks(bad)
    f = quality.row_faults(bad).first()
    assert (f.null_rows, f.bad_ohlc, f.negative_vals) == (1, 1, 1) and quality.gaps(bad).count() == 1
    assert quality.extreme_returns(spark.createDataFrame([row(0), row(1, close=2.0), row(2, close=2.0)], schema), 0.5).count() == 1


def test_liquidity_collapse_onset(spark):
    rows = [(at(d, 24), "A", 100.0 if d < 60 else 1.0) for d in range(80)]
    got = quality.liquidity_collapse(spark.createDataFrame(rows, "ts timestamp, symbol string, dollar_volume double")).collect()
    assert len(got) == 1 and got[0].day == at(65, 24).date()


def test_catalogue_is_complete_and_oracles_parse(spark):
    from panelyx.plans.catalogue import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) == set(ORACLES)
    con = duckdb.connect()
    for t, cols in {"events": "ts timestamp, event_id bigint, user_id bigint, event_type varchar, value double", "lineitem": "l_shipdate timestamp, l_suppkey bigint, l_quantity double, l_extendedprice double"}.items():
        con.sql(f"create table {t} ({cols})")
    for sql in ORACLES.values():
        con.sql(f"explain {sql}")


def test_index_spacing(spark):
    import datetime as dt

    day = lambda k: dt.datetime(2023, 1, 1) + dt.timedelta(days=k)
    rows = [("even", day(k)) for k in range(10)] + [("gap", day(k)) for k in (0, 1, 2, 3, 30)] + [("one", day(0))]
    got = {r.k: r for r in ic.index_spacing(spark.createDataFrame(rows, "k string, ts timestamp"), ("k",)).collect()}
    assert (got["even"].periods_per_year, got["even"].irregular) == (365.0, False)
    assert (got["gap"].periods_per_year, got["gap"].irregular, got["gap"].mean_step) == (365.0, True, 7.5 * 86400)
    assert (got["one"].n, got["one"].periods_per_year, got["one"].irregular) == (1, 365.0, False)


def test_align_and_top(spark):
    p = long(spark, {"A": [1.0, 2.0]})
    other = p.filter("bar_id = 1").select("ts", "symbol", F.lit(9.0).alias("v"))
    assert wide(panel.align(p, other), "v")["A"] == [None, 9.0]
    u = spark.createDataFrame([("A", 1), ("B", 3)], "symbol string, rank int")
    assert panel.top_of_universe(u, 2).count() == 1
