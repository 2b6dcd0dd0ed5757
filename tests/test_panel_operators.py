"""Panel, return, feature and cross-section operators on tiny frames with hand-made expectations."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyx.functions import columns as C
from panelyx.operators import features, panel, spreads
from panelyx.plans import settings, signals

T0 = dt.datetime(2023, 1, 1)


def at(i, hours=4):
    return T0 + dt.timedelta(hours=hours * i)


def long(spark, wide, hours=4):
    """{symbol: values} -> panel rows (ts, bar_id, symbol, close)."""
    rows = [(at(i, hours), i, s, v) for s, vs in wide.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "ts timestamp, bar_id int, symbol string, close double")


def wide(df, value):
    out = {}
    for r in df.orderBy("bar_id").collect():
        out.setdefault(r.symbol, []).append(r[value])
    return out


def close_to(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)), (a, b)


@pytest.fixture()
def doubling(spark):
    return long(spark, {"AAA": [1.0, 2.0, 4.0, 8.0], "BBB": [10.0, 20.0, 40.0, 80.0], "CCC": [3.0, 6.0, 12.0, 24.0]})


def test_bar_returns(doubling):
    r = wide(doubling.withColumn("r", C.bar_return("close")), "r")
    for s in r:
        close_to(r[s], [None] + [math.log(2)] * 3)
    close_to(wide(doubling.withColumn("r", C.bar_return("close", 2, 1, log=False)), "r")["AAA"], [None, None, None, 3.0])
    close_to(wide(doubling.withColumn("r", C.forward_return("close", 2)), "r")["AAA"], [2 * math.log(2)] * 2 + [None] * 2)
    for bad in (lambda: C.bar_return("close", 0), lambda: C.bar_return("close", 1, -1), lambda: C.forward_return("close", 0)):
        with pytest.raises(ValueError):
            bad()


def test_zero_price_and_missing_price_give_null(spark):
    p = long(spark, {"AAA": [1.0, 0.0, 2.0, None, 3.0]})
    assert wide(p.withColumn("r", C.bar_return("close")), "r")["AAA"] == [None] * 5


def test_rolling_windows_are_full_or_null(spark):
    p = long(spark, {"AAA": [0.1, 0.2, 0.3, 0.3, 0.3, 0.3], "BBB": [1.0, None, 3.0, 4.0, 5.0, 6.0]})
    x = p.withColumns({"m": C.rolling_mean("close", 3), "s": C.rolling_std("close", 3)})
    assert wide(x, "s")["AAA"][4:] == [0.0, 0.0]  # a flat window is exactly flat
    close_to(wide(x, "m")["BBB"], [None, None, None, None, 4.0, 5.0])


def test_deviation_survives_a_level_collapse(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([1e6 * (1 + 0.01 * rng.normal(size=60)), 1 + 0.01 * rng.normal(size=60)])
    got = wide(long(spark, {"AAA": v.tolist()}).withColumn("s", C.rolling_std("close", 24)), "s")["AAA"]
    for i in range(90, 120):
        assert math.isclose(got[i], v[i - 23 : i + 1].std(), rel_tol=1e-9)


def test_rank_and_zscore_across_symbols(spark):
    p = long(spark, {"A": [1.0, 5.0], "B": [2.0, 5.0], "C": [2.0, None], "D": [4.0, 5.0]})
    x = p.withColumns({"k": C.cross_section("close", "rank", 3), "z": C.cross_section("close", "zscore", 3), "few": C.cross_section("close", "rank", 5)})
    k, z = wide(x, "k"), wide(x, "z")
    assert [k[s][0] for s in "ABCD"] == [0.25, 0.625, 0.625, 1.0] and k["C"][1] is None and k["A"][1] == 2 / 3
    assert [z[s][1] for s in "ABCD"] == [None] * 4  # no spread, no score
    close_to([z["D"][0]], [(4 - 2.25) / np.std([1, 2, 2, 4])])
    assert all(v is None for vs in wide(x, "few").values() for v in vs)
    with pytest.raises(ValueError):
        C.cross_section("close", "median", 3)


def test_panel_keeps_row_lags_over_missing_bars(spark):
    rows = spark.createDataFrame([(at(0), "A", 1.0), (at(1), "A", 2.0), (at(3), "A", 4.0), (at(1), "B", 5.0), (at(3), "B", None)], "ts timestamp, symbol string, close double")
    rows = rows.withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0), "trades": F.lit(1)})
    p = panel.panel(rows, 4 * 3600)
    assert [(r.bar_id, r.ts) for r in p.select("bar_id", "ts").distinct().orderBy("bar_id").collect()] == [(0, at(0)), (1, at(1)), (2, at(3))]
    assert wide(p, "close") == {"A": [1.0, 2.0, 4.0], "B": [None, 5.0, None]}
    with pytest.raises(ValueError):
        panel.panel(rows, 5 * 3600)


def test_densify_carries_only_the_close(spark):
    rows = spark.createDataFrame([(at(h, 1), "A", 100.0 + h, 1.0, 2) for h in (0, 1, 3)], "ts timestamp, symbol string, close double, volume double, trades int")
    rows = rows.withColumns({"open": F.lit(None).cast("double"), "high": F.col("close") + 1, "low": F.lit(None).cast("double")})
    got = panel.densify(rows).orderBy("ts").collect()
    assert [(r.close, r.volume, r.trades, r.open, r.high) for r in got] == [(100, 1, 2, 100, 101), (101, 1, 2, 101, 102), (101, 0, 0, 101, 101), (103, 1, 2, 103, 104)]
    assert panel.densify(rows.limit(0)).count() == 0


def test_check_long(spark):
    ok = spark.createDataFrame([(at(0), "A", 1.0)], "ts timestamp, symbol string, close double")
    assert panel.check_long(ok) is ok
    for bad in (ok.union(ok), ok.drop("close")):
        with pytest.raises(ValueError):
            panel.check_long(bad)


def test_traded_mask(spark):
    p = long(spark, {"A": [1.0, 2.0, 3.0, 4.0]}).withColumn("trades", F.when(F.col("bar_id") == 1, 0).when(F.col("bar_id") == 2, None).otherwise(3))
    t = panel.traded(p)
    assert wide(t, "traded")["A"] == [True, False, False, True]
    assert wide(t.withColumn("k", panel.keep_traded("close", 1)), "k")["A"] == [None] * 4
    assert wide(t.withColumn("k", panel.keep_traded("close")), "k")["A"] == [1.0, None, None, 4.0]
    with pytest.raises(ValueError):
        panel.keep_traded("close", -1)


def test_universe_mask_is_tradable_the_day_after(spark):
    p = long(spark, {"AAA": [1.0] * 3, "BBB": [1.0] * 3, "CCC": [1.0] * 3}, hours=24)
    u = spark.createDataFrame([(dt.date(2023, 1, 1), "AAA"), (dt.date(2023, 1, 1), "BBB"), (dt.date(2023, 1, 2), "AAA"), (dt.date(2023, 1, 2), "CCC")], "rebalance_date date, symbol string")
    assert wide(panel.member_mask(p, u), "member") == {"AAA": [False, True, True], "BBB": [False, True, False], "CCC": [False, False, True]}
    assert {v for vs in wide(panel.member_mask(p, None), "member").values() for v in vs} == {True}
    assert {v for vs in wide(panel.member_mask(p, u.limit(0)), "member").values() for v in vs} == {False}


def test_decimation_holds_nulls_too(spark):
    p = long(spark, {"A": [1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0]})
    assert wide(p.withColumn("d", panel.decimate("close", 2)), "d")["A"] == [1.0, 1.0, 3.0, 3.0, None, None, 7.0]
    assert wide(p.withColumn("d", panel.decimate("close", 1)), "d") == wide(p, "close")


def test_momentum_score_log_and_simple(doubling):
    p = doubling.withColumn("r", C.bar_return("close")).withColumn("sr", F.exp("r") - 1)
    close_to(wide(p.withColumn("m", features.momentum_score("r", 2, 1)), "m")["AAA"], [None, None, None, 2 * math.log(2)])
    close_to(wide(p.withColumn("m", features.momentum_score("sr", 2, log=False)), "m")["AAA"], [None, None, 3.0, 3.0])


def test_betas_are_recovered_and_shrunk(spark):
    rng = random.Random(2)
    m = [rng.gauss(0, 1) for _ in range(40)]
    p = long(spark, {"A": [2.0 * x for x in m], "B": [-0.5 * x for x in m], "M": m})
    p = p.withColumn("market", F.max(F.when(F.col("symbol") == "M", F.col("close"))).over(C.by_time()))
    b = wide(p.withColumn("b", features.rolling_beta("close", "market", 20)), "b")
    assert b["A"][18] is None
    close_to(b["A"][19:], [2.0] * 21)
    close_to(wide(p.withColumn("b", features.rolling_beta("close", "market", 20, shrinkage=0.5)), "b")["B"][19:], [0.25] * 21)
    flat = p.withColumn("market", F.lit(1.0))
    assert wide(flat.withColumn("b", features.rolling_beta("close", "market", 20)), "b")["A"] == [None] * 40
    with pytest.raises(ValueError):
        features.rolling_beta("close", "market", 20, shrinkage=1.5)


def test_features_on_a_rising_series(spark):
    p = long(spark, {"A": [float(2**i) for i in range(8)]}).withColumn("r", C.bar_return("close")).withColumn("volume", F.lit(1.0))
    x = p.withColumns({"rsi": features.rsi_proxy("r", 3), "pos": features.range_position("close", 3), "touch": features.bollinger_touch("close", 3, 1.0), "vw": features.vwap_distance("close", "volume", 2), "q": features.volume_ratio("volume", 3)})
    last = x.filter("bar_id = 7").first()
    assert last.rsi == -0.5 and last.pos == -0.5 and last.touch == -1.0 and last.q == 1.0
    assert math.isclose(last.vw, -(128 - 96) / 128)


def test_relative_returns(spark):
    p = long(spark, {"A": [0.1], "B": [0.3], "XBT/USD": [0.2]}).withColumn("in_", F.col("symbol") != "B")
    x = features.relative_returns(p, "close", "XBT/USD", mask="in_").collect()
    got = {r.symbol: (r.minus_xsec_mean, r.minus_benchmark) for r in x}
    assert math.isclose(got["B"][0], 0.15) and math.isclose(got["A"][1], -0.1)
    with pytest.raises(ValueError):
        features.relative_returns(p, "close", "XBT/USD", space="square")


def test_composite_of_equal_and_opposite_features(spark):
    p = long(spark, {s: [v] for s, v in zip("ABCDEF", [1.0, 2.0, 4.0, 7.0, 11.0, None])}).withColumns({"same": F.col("close"), "opposite": -F.col("close")})
    z = wide(p.withColumn("z", C.zscore("close")), "z")
    same = wide(features.composite(p, ["close", "same"], 3, 2), "composite")
    for s in "ABCDE":
        close_to(same[s], z[s])
    assert all(abs(v[0]) < 1e-12 for s, v in wide(features.composite(p, ["close", "opposite"], 3, 2), "composite").items() if s != "F") and same["F"] == [None]


def test_pure_bounce_spread_is_recovered(spark):
    s = 0.02
    p = long(spark, {"A": [100.0] * 50}).withColumns({"high": F.lit(100 * (1 + s / 2)), "low": F.lit(100 * (1 - s / 2))})
    x = p.withColumn("cs", spreads.corwin_schultz())
    v = wide(x, "cs")["A"]
    true = 2 * (math.exp(math.log((1 + s / 2) / (1 - s / 2))) - 1) / (1 + math.exp(math.log((1 + s / 2) / (1 - s / 2))))
    assert v[0] is None and all(math.isclose(y, true, rel_tol=1e-6) for y in v[1:])
    assert math.isclose(spreads.half_spread_bps(x, "cs").first().half_spread_bps, true / 2 * 1e4, rel_tol=1e-6)
    assert spreads.half_spread_bps(x, "cs", min_obs=60).first().half_spread_bps is None


def test_roll_spread_of_a_bouncing_price(spark):
    rng = random.Random(3)
    v = [100 * math.exp(0.01 * rng.choice([-1, 1])) for _ in range(800)]
    got = spreads.roll_spread(long(spark, {"A": v, "B": [float(2**i) for i in range(800)]})).collect()
    got = {r.symbol: r.roll_spread for r in got}
    assert abs(got["A"] - 0.02) < 0.002 and got["B"] is None


RESEARCH = settings.from_dict(settings.ResearchSettings, {"price_zscore_window_bars": 7, "bollinger_window_bars": 6, "rsi_window_bars": 5, "range_position_window_bars": 4, "vol_window_bars": 3, "vwap_window_bars": 8, "volume_window_bars": 9, "reversal_lookback_bars": 2, "extreme_move_threshold_sigma": 0.5})


@pytest.mark.parametrize(
    ("name", "want"),
    [*((f"{f}_h{h}", h) for f in features.HORIZON_FEATURES for h in (1, 12)), ("price_zscore", 7), ("bollinger_touch", 6), ("extreme_signed_z", 2), ("extreme_flag", 2),
     ("distance_from_vwap", 2), ("distance_from_ma", 2), ("rsi_proxy", 5), ("range_position", 4), ("xsec_rank_price_z", 7), ("other", 2)],
)
def test_feature_lookbacks(name, want):
    assert features.feature_lookback(name, RESEARCH) == want


def test_resolvers(spark):
    assert signals.feature_column("relative", 5, "minus_benchmark") == "minus_benchmark_5" and signals.feature_column("baseline") == "signal"
    for bad in (("none", 5, None), ("core", None, None), ("core", 5, "other")):
        with pytest.raises(KeyError):
            signals.feature_column(*bad)
    rng = np.random.default_rng(2)
    p = long(spark, {s: [100 * math.exp(x) for x in np.cumsum(0.02 * rng.normal(size=20))] for s in "ABCDEFG"})
    p = p.withColumns({"r": C.bar_return("close"), "volume": 1 + F.col("bar_id") % 3, "odd": F.col("symbol").isin("A", "C")})
    names = signals.reversal_names((1, 3))
    for n in names:
        p = signals.reversal_feature(p, n, RESEARCH, "odd")
    rows = p.collect()
    assert len(names) == 21 and all(any(r[n] is not None for r in rows) for n in names)
    by = {(r.bar_id, r.symbol): r for r in rows}
    for t in (5, 12, 19):
        rets = {s: math.log(by[t, s].close / by[t - 3, s].close) for s in "ABCDEFG"}
        for s in "ABCDEFG":
            r = by[t, s]
            assert math.isclose(r.reversal_h3, -rets[s]) and math.isclose(r.xsec_reversal_h3, -(rets[s] - (rets["A"] + rets["C"]) / 2), abs_tol=1e-12)
            sd = {x: np.std([by[t - k, x].r for k in range(3)]) for x in "ABCDEFG"}
            mean = np.mean([rets[x] / sd[x] for x in "ABCDEFG"])
            assert math.isclose(r.vol_adj_reversal_h3, -rets[s] / sd[s], rel_tol=1e-9) and math.isclose(r.vol_adj_xsec_reversal_h3, -(rets[s] / sd[s] - mean), rel_tol=1e-7, abs_tol=1e-9)
    for bad in ("none_h3", "reversal", "price_z", "reversal_hx"):
        with pytest.raises(KeyError):
            signals.reversal_feature(p, bad, RESEARCH)
    with pytest.raises(ValueError):
        features.reversal_family(p, "x", "none", 2)


def test_signals_end_to_end(spark):
    rng = np.random.default_rng(42)
    rows = []
    for k, s in enumerate(["AAA", "BBB", "CCC", "DDD", "EEE", "FFF"]):
        v = 100 * np.exp(np.cumsum(np.linspace(0.1, -0.1, 6)[k] + 0.005 * rng.normal(size=10)))
        rows += [(at(i), s, float(x), float(x), float(x), 1.0, 1) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, close double, high double, low double, volume double, trades int")
    m = wide(signals.momentum_signal(df, "4h", 3), "signal")
    assert m["AAA"][-1] > m["CCC"][-1] > m["FFF"][-1] and m["AAA"][2] is None
    r = wide(signals.reversal_signal(df, "4h", 2, rebalance=2), "signal")
    assert r["AAA"][-1] < r["FFF"][-1] and r["AAA"][8] == r["AAA"][9]
    pack = signals.feature_pack(panel.panel(df, 4 * 3600), [1, 2], "AAA", 3)
    assert {"core_1", "minus_xsec_mean_2", "zscored_return_1"} <= set(pack.columns) and pack.count() == 60
