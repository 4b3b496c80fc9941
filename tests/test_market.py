"""Hand-checkable cases of features, simulation, metrics and validation."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import bars as B
from barline.operators import features as X
from barline.operators import joins as J
from barline.operators import journal as L
from barline.operators import metrics as M
from barline.operators import signals as G
from barline.operators import simulate as S
from barline.operators import validation as V
from barline.sources import candles as C


def frame(spark, closes, volume=100.0, minutes=5, symbol="T", spread=0.0005, rows=None):
    start = dt.datetime(2024, 1, 1)
    rows = rows or [
        (symbol, start + dt.timedelta(minutes=minutes * i), float(o), max(o, c) * (1 + spread), min(o, c) * (1 - spread), float(c), float(volume))
        for i, (o, c) in enumerate(zip([closes[0], *closes[:-1]], closes))
    ]
    return spark.createDataFrame(rows, C.SCHEMA)


def last(df):
    return df.orderBy("ts").collect()[-1]


def test_moving_average_needs_full_window(spark):
    df = frame(spark, [1, 2, 3, 4, 5]).withColumn("m", X.sma("close", 3))
    assert [r.m for r in df.orderBy("ts").collect()] == [None, None, 2.0, 3.0, 4.0]


def test_refreshed_bar_replaces(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("T", t, 1.0, 1), ("T", t, 2.0, 2)], "symbol string, ts timestamp, close double, seq long")
    assert [r.close for r in B.keep_last(df, ["symbol", "ts"], "seq").collect()] == [2.0]


def test_sessions(spark):
    df = spark.createDataFrame([(h,) for h in (2, 8, 15, 20, 23)], "h int").withColumn("s", X.session(F.col("h")))
    assert [r.s for r in df.collect()] == ["asia", "london", "ny-overlap", "ny", "off-hours"]


def test_cvd_and_order_flow(spark):
    start = dt.datetime(2024, 1, 1)
    moves = [1, 1, 1, -1, -1]
    rows = [("T", start + dt.timedelta(minutes=5 * i), 100.0, 102.0, 98.0, 100.0 + m, 1000.0) for i, m in enumerate(moves)]
    r = last(X.flow(frame(spark, None, rows=rows)))
    assert (r.cvd_full, r.aggressor_bias) == (1000.0, "buy")
    o = last(X.order_flow(frame(spark, None, rows=rows)))
    assert (o.cvd_approx, o.buy_share) == (1000.0, 0.6)


def naive_features(bars, lookback=5):
    """Per-bar definitions in plain Python for the structure features."""
    out = []
    for n in range(1, len(bars) + 1):
        b = bars[:n]
        hs = [b[i]["high"] for i in range(lookback, n - lookback) if b[i]["high"] >= max(x["high"] for x in b[i - lookback : i + lookback + 1])]
        ls = [b[i]["low"] for i in range(lookback, n - lookback) if b[i]["low"] <= min(x["low"] for x in b[i - lookback : i + lookback + 1])]
        both = bool(hs and ls)
        out.append((hs[-1] if hs else None, ls[-1] if ls else None, max(hs[-3:]) if both else None, min(ls[-3:]) if both else None))
    return out


def test_structure_against_plain_python(spark):
    df = C.random_walk(spark, 150, seed=3)
    got = X.structure(df).orderBy("ts").collect()
    want = naive_features([r.asDict() for r in df.orderBy("ts").collect()])
    assert [(r.swing_high, r.swing_low, r.range_high, r.range_low) for r in got] == want


def test_long_percentile_against_plain_python(spark):
    df = C.random_walk(spark, 120, seed=5)
    got = X.moving_share(df, "close", 30, "share").orderBy("ts").collect()
    closes = [r.close for r in got]
    for i, r in enumerate(got):
        window = closes[max(0, i - 29) : i + 1]
        assert r.share == pytest.approx(sum(v <= closes[i] + 1e-12 for v in window) / len(window))


def test_no_lookahead(spark):
    df = C.random_walk(spark, 300)
    cut = dt.datetime(2024, 1, 8)
    build = lambda b: G.momentum(X.structure(X.flow(b))).select("symbol", "ts", "cvd_full", "last_bos", "direction", "stop")
    assert V.lookahead_leaks(df, cut, build).count() == 0


def test_chunked_windows_equal_whole(spark):
    df = C.random_walk(spark, 800)
    keep = ["ts", "ma50", "ret20_bp", "atr14"]
    a = X.confluence(df).select(*keep)
    b = B.by_time_chunks(df, X.confluence, 7, 200).select(*keep)
    near = a.alias("a").join(b.alias("b"), "ts").where("abs(a.ma50 - b.ma50) > 1e-9 or abs(a.atr14 - b.atr14) > 1e-9 or (a.ma50 is null) <> (b.ma50 is null)")
    assert a.count() == b.count() and near.count() == 0


def test_features_by_chunks_equal_one_chunk(spark):
    """Chunks of two days against one chunk that holds the whole history, for every feature."""
    walk = C.random_walk(spark, 500, seed=9)
    for kinds in ([X.INDICATORS, X.FLOW, X.STRUCTURE], [X.accumulation_of(), X.CONFLUENCE]):
        one, many = ({r.ts: r for r in X.together(walk, kinds, days).collect()} for days in (10**6, 2))
        assert one.keys() == many.keys() and len(one) == 500
        for ts, want in one.items():
            for c, v in want.asDict().items():
                assert many[ts][c] == (pytest.approx(v, abs=1e-5) if isinstance(v, float) else v), (ts, c)


def test_gaps_keep_their_place_in_history(spark):
    df = frame(spark, [100.0 + 10 * i for i in range(60)])
    got = last(X.fair_value_gaps(df))
    assert [g["index"] for g in got.bullish_fvgs] == [55, 56, 57, 58, 59]


def test_positions_see_only_days_that_reach_a_level(spark):
    """Two days without a hit lie between the entry and the first target, and three more before the stop."""
    start = dt.datetime(2024, 1, 1)
    path = [(0, 100.0), (1, 101.0), (2, 99.5), (3, 106.0), (4, 104.0), (5, 103.0), (6, 102.0), (7, 94.0), (8, 120.0)]
    prices = spark.createDataFrame([("T", start + dt.timedelta(days=n, hours=5), p) for n, p in path], "symbol string, ts timestamp, price double")
    rows = [("a", "T", start, "long", 100.0, 4.0, 95.0, 105.0, 110.0, 130.0), ("b", "T", start + dt.timedelta(days=3), "short", 106.0, 4.0, 119.0, 100.0, 95.0, 90.0)]
    positions = spark.createDataFrame(rows, "position_id string, symbol string, entry_ts timestamp, direction string, entry double, size double, sl double, tp1 double, tp2 double, tp3 double")
    got = sorted((r.position_id, (r.ts - start).days, r.event, r.size, r.status) for r in S.manage_positions(positions, prices).collect())
    assert got == [("a", 3, "TP1", 1.0, "PARTIALLY_CLOSED"), ("a", 7, "SL", 4.0, "CLOSED"), ("b", 7, "TP1", 1.0, "PARTIALLY_CLOSED"), ("b", 7, "TP2", 1.0, "PARTIALLY_CLOSED"), ("b", 8, "SL", 4.0, "CLOSED")]


def orders(spark, closes, at, direction, stop, target, spread=0.0):
    df = frame(spark, closes, spread=spread)
    t = df.orderBy("ts").collect()[at].ts
    on = F.col("ts") == F.lit(t)
    return df.withColumns({"direction": F.when(on, direction), "stop": F.when(on, stop), "target": F.when(on, target)})


FREE = S.Costs(0, 0, 0, 0, 0, 0, 0, 0)


def test_target_stop_and_end(spark):
    up = S.simulate(orders(spark, [100, 101, 102, 103, 104, 105], 0, "long", 90.0, 104.0), ["symbol"], FREE, 300).first()
    assert (up.entry_price, up.exit_price, up.exit_reason) == (100.0, 104.0, "TP") and up.pnl == pytest.approx(0.04)
    down = S.simulate(orders(spark, [100, 100, 100, 95, 95], 0, "long", 96.0, 200.0), ["symbol"], FREE, 300).first()
    assert down.exit_reason == "SL" and down.pnl == pytest.approx(-0.04)
    end = S.simulate(orders(spark, [100, 101, 102], 0, "long", 50.0, 200.0), ["symbol"], FREE, 300).collect()
    assert [r.exit_reason for r in end] == ["EOD"]


def test_fills_at_the_next_open_and_late(spark):
    df = orders(spark, [100, 101, 103, 104], 1, "long", 50.0, 500.0)
    r = S.simulate(df, ["symbol"], FREE, 300).first()
    assert r.entry_price == 101.0 and r.entry_time == df.orderBy("ts").collect()[2].ts
    late = S.simulate(df, ["symbol"], S.Costs(0, 0, 0, 0, 0, 0, 0, 300), 300).first()
    assert late.entry_price == 103.0


def test_costs():
    c = S.Costs()
    assert (c.side_bp(False), c.side_bp(True), c.side_bp(False, True)) == (9.5, 26.0, 6.0)
    assert (c.funding_bp(8, "long"), c.funding_bp(8, "short")) == (1.5, -1.5)


def test_equity_has_one_point_more_and_compounds(spark):
    s = G.momentum(C.random_walk(spark, 400, vol=0.01))
    eq = S.equity_curve(s, ["symbol"]).orderBy("seq").collect()
    trades = S.simulate(s, ["symbol"]).orderBy("entry_time").collect()
    assert len(eq) == 401 and trades
    assert eq[-1].equity == pytest.approx(math.prod(1 + t.pnl for t in trades))


def test_one_position_at_a_time(spark):
    s = G.two_lower_closes_short(C.random_walk(spark, 500, seed=9, vol=0.004))
    t = S.simulate(s, ["symbol"]).orderBy("entry_time").collect()
    assert all(a.exit_time <= b.entry_time for a, b in zip(t, t[1:]))


def test_drawdown_and_metrics_match_pandas(spark):
    eq = [1, 1.2, 0.8, 0.9, 1.1]
    df = spark.createDataFrame([("T", i, float(v)) for i, v in enumerate(eq)], "symbol string, seq long, equity double")
    r = M.curve_metrics(df, ["symbol"], 86400).first()
    ret = pd.Series(eq).pct_change().dropna()
    assert r.max_drawdown == pytest.approx(-1 / 3)
    assert r.sharpe == pytest.approx(ret.mean() / ret.std() * math.sqrt(365))
    assert r["skew"] == pytest.approx(ret.skew()) and r.kurt == pytest.approx(ret.kurt() + 3)


def test_deflated_sharpe_and_ruin(spark):
    df = spark.createDataFrame([(3.0, 10, 500), (0.05, 1000, 200)], "sr double, n int, m int")
    a, b = (r.p for r in df.select(M.deflated_sharpe(F.col("sr"), F.col("n"), F.col("m"), F.lit(0.0), F.lit(3.0)).alias("p")).collect())
    assert a > 0.9 and b < 0.5
    assert M.ruin_probability(-0.2, 1, 20, 200, 1.0) > 0.5
    assert M.ruin_probability(0.3, 1, 20, 200, 1.0) < 0.2
    assert M.ruin_probability(0.3, 1, 20, 0, 1.0) == 0.0


def test_pbo_extremes(spark):
    def pbo(flip):
        rows = [(s, k, k, (9 - k) if flip else k) for s in range(20) for k in range(10)]
        return M.overfitting_probability(spark.createDataFrame(rows, "split int, strategy int, is_rank int, oos_rank int"), "split", "strategy").first().pbo
    assert (pbo(False), pbo(True)) == (0.0, 1.0)


def test_combinations_reuse_group_runs(spark):
    s = G.momentum(C.random_walk(spark, 400, vol=0.01)).withColumn("strategy", F.lit("m"))
    assert V.combos(spark, 10, 2).select("combo").distinct().count() == 45
    paths = V.cpcv(spark, s, 5, 2).collect()
    assert len(paths) == 10
    each = {r.grp: r.n for r in S.simulate(V._groups_by(s, ["strategy", "symbol"], 5), ["strategy", "symbol", "grp"]).groupBy("grp").agg(F.count("*").alias("n")).collect()}
    from itertools import combinations
    want = [sum(each.get(g, 0) for g in c) for c in combinations(range(5), 2)]
    assert [r.oos_trades for r in sorted(paths, key=lambda r: r.combo)] == want


def test_purged_training_leaves_a_gap(spark):
    p = V.purged_training(C.random_walk(spark, 400), [1], 4, horizon=30, embargo_pct=0.01).orderBy("i").collect()
    train = [r.i for r in p if r.train]
    assert max(i for i in train if i < 100) == 69 and min(i for i in train if i > 199) == 234


def test_asof_and_levels(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([("T", t(0), 1), ("T", t(5), 2), ("T", t(9), 3)], "symbol string, ts timestamp, id int")
    right = spark.createDataFrame([("T", t(1), 10.0), ("T", t(5), 20.0)], "symbol string, ts timestamp, v double")
    got = J.asof_backward(left, right, ["symbol"], ["v"]).orderBy("id").collect()
    assert [r.v for r in got] == [None, 20.0, 20.0]
    lagged = J.asof_backward(left, right, ["symbol"], ["v"], lag_seconds=180).orderBy("id").collect()
    assert [r.v for r in lagged] == [None, 10.0, 20.0]


def test_scale_out(spark):
    pos = spark.createDataFrame([("a", "T", dt.datetime(2024, 1, 1), "long", 2000.0, 1.0, 1995.0, 2003.0, 2006.0, 2012.0)],
                                "position_id string, symbol string, entry_ts timestamp, direction string, entry double, size double, sl double, tp1 double, tp2 double, tp3 double")
    def events(*prices):
        rows = [("T", dt.datetime(2024, 1, 1, 0, i), p) for i, p in enumerate(prices)]
        return [(r.event, r.size, r.status) for r in S.manage_positions(pos, spark.createDataFrame(rows, "symbol string, ts timestamp, price double")).collect()]
    assert events(2003.5) == [("TP1", 0.25, "PARTIALLY_CLOSED")]
    assert events(1990.0) == [("SL", 1.0, "CLOSED")]
    assert [e[0] for e in events(2015.0)] == ["TP1", "TP2", "TP3"] and events(2015.0)[-1][2] == "CLOSED"


def test_gate_cools_down(spark):
    rows = [("T", dt.datetime(2024, 1, 1, 0, m), True, None, "asia", "CPI" if m == 20 else None) for m in (0, 2, 6, 20)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, volume_spike boolean, last_bos string, session string, news_event string")
    assert [r.reason for r in G.cycle_gate(df).orderBy("ts").collect()] == ["volume_spike", "cooldown", "volume_spike", "news_kill:CPI"]


def test_ks_pvalue_by_permutations():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 6), rng.normal(1, 1, 5)

    def dist(x, y):
        z = np.sort(np.concatenate([x, y]))
        return np.abs(np.searchsorted(np.sort(x), z, "right") / len(x) - np.searchsorted(np.sort(y), z, "right") / len(y)).max()

    from itertools import combinations
    z = np.concatenate([a, b])
    d = dist(a, b)
    hits = [dist(z[list(c)], np.delete(z, list(c))) >= d - 1e-12 for c in combinations(range(11), 6)]
    assert L.ks_pvalue(d, 6, 5) == pytest.approx(np.mean(hits))


def test_drift_without_live_trades(spark):
    empty = spark.createDataFrame([], "k string, at long, r_multiple double")
    bt = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("a", 2.0)], "k string, r_multiple double")
    r = L.drift(empty, bt, "k").first()
    assert (r.verdict, r.ci_low, r.ci_high, r.ks_pvalue) == ("healthy", 0.0, 1.0, 1.0)


def test_similarity():
    assert L.alike({"a": 1, "b": {"c": "xy"}}, {"a": 1, "b": {"c": "xy"}}) == 1.0
    assert L.alike({"a": 1}, {"b": 1}) == 0.0


def test_asof_by_spans_equals_asof(spark):
    """Dealing out by spans of time changes no row, with keys and without, and with null keys."""
    rng = np.random.default_rng(5)
    at = lambda n: [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 5000, n)]
    left = spark.createDataFrame([("AB"[i % 2], t, i) for i, t in enumerate(at(200))], "k string, ts timestamp, id long")
    right = spark.createDataFrame([("AB"[i % 2], t, float(i)) for i, t in enumerate(at(40))], "k string, ts timestamp, v double").dropDuplicates(["k", "ts"])
    for keys in (["k"], []):
        r = right if keys else right.groupBy("ts").agg(F.max("v").alias("v"))
        whole, cut = (J.asof_backward(left, r, keys, ["v"], lag_seconds=90, bucket_seconds=b).select("id", "v") for b in (None, 3600))
        assert whole.exceptAll(cut).count() == 0 and cut.count() == 200
    assert J.asof_backward(left, right.limit(0), ["k"], ["v"], bucket_seconds=60).where("v is null").count() == 200


def test_medians_of_large_groups_are_in_no_single_task(spark):
    """Exact medians from counts, also where a sketch's bounds are wide, values repeat or groups are tiny; no state holds a group's values."""
    import random
    import statistics

    rng = random.Random(5)
    rows = [(i % 2, rng.choice([1.0, 2.0, 3.0]), rng.lognormvariate(0, 3), None) for i in range(3001)] + [(None, 9.0, 9.0, 1.0), (0, None, None, 7.0), (0, 5.0, -1.0, 8.0)]
    df = spark.createDataFrame(rows, "win int, a double, b double, c double").repartition(3)
    out = L.winner_loser_medians(df, ["a", "b", "c"])
    assert "percentile(" not in out._jdf.queryExecution().analyzed().toString()
    got = {r.feature: (r.winners, r.losers) for r in out.collect()}
    mid = lambda j, w: statistics.median([r[j] for r in rows if r[0] == w and r[j] is not None] or [math.nan])
    assert got["a"] == (mid(1, 1), mid(1, 0)) and got["c"] == (None, 7.5)
    assert got["b"] == pytest.approx((mid(2, 1), mid(2, 0)), rel=1e-12)
    long = df.where("b is not null and win is not null").select("win", F.col("b").alias("x"))
    coarse = {r.win: r["median"] for r in L.medians(long, ["win"], accuracy=100).collect()}
    assert coarse == pytest.approx({w: mid(2, w) for w in (0, 1)}, rel=1e-12)


def test_gates_of_changed_settings_on_their_edge(spark):
    """Values that equal their gates but for the rounding of their sums pass; those beyond fail."""
    from barline.operators import validation as V

    mean = lambda x, n: sum([x] * n) / n
    noisy = next(mean(0.04, n) for n in range(3, 999) if mean(0.04, n) * 5 > 0.2)
    cols = "id int, base_sharpe double, shadow_sharpe double, shadow_pbo double, shadow_dsr double, base_ruin double, shadow_ruin double, worst_regime_drop double"
    rows = [(1, 0.2, 0.3, noisy * 5, 0.95 - 1e-16, 0.3, 0.1 + 0.2, 0.1), (2, 0.2, 0.2999, 0.2001, 0.9499, 0.3, 0.3001, 0.1001), (3, None, 0.3, None, 0.99, 0.1, 0.05, None)]
    got = {r.id: (r.fail_reasons, r.passed) for r in V.shadow_verdict(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ([], True), 2: (["sharpe_delta", "pbo", "dsr", "ruin_prob", "regime"], False), 3: ([], True)}


def test_first_target_of_a_list(spark):
    """Of several targets the first in the list that the bar reaches counts; the stop goes before them."""
    hour = lambda i: dt.datetime(2024, 1, 1, i)
    bars = [(100, 100, 100, 100, "long", 90.0, [110.0, 104.0]), (100, 105, 99, 105, None, None, None), (105, 120, 105, 118, None, None, None)]
    rows = [("T", hour(i), *map(float, b[:4]), *b[4:]) for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, direction string, stop double, target array<double>")
    r = S.simulate(df, ["symbol"]).collect()
    assert [(x.exit_reason, x.exit_price) for x in r] == [("TP", 104.0)]
    stopped = df.withColumn("low", F.when(F.hour("ts") == 1, 80.0).otherwise(F.col("low")))
    assert [x.exit_reason for x in S.simulate(stopped, ["symbol"]).collect()] == ["SL"]


def test_curves_below_zero_keep_their_sign(spark):
    seg = spark.createDataFrame([("T", g, i, e) for g, es in enumerate([(1.0, -2.0), (1.0, 3.0), (1.0, -1.0)]) for i, e in enumerate(es)], "symbol string, grp int, seq int, equity double")
    got = V.stitched(seg, ["symbol"], "grp").orderBy("grp", "seq").collect()
    assert [round(r.equity, 9) for r in got] == [1.0, -2.0, -2.0, -6.0, -6.0, 6.0]


def test_sessions_open_on_awake_cycles_alone(spark):
    """A session that opens in a cooldown is noticed by the next awake cycle."""
    at = lambda m: dt.datetime(2024, 1, 1, 7, m)
    rows = [("T", at(0), True, None, "asia", None), ("T", at(2), False, None, "london", None), ("T", at(6), False, None, "london", None), ("T", at(20), False, "bear", "london", None), ("T", at(40), False, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, volume_spike boolean, last_bos string, session string, news_event string")
    assert [r.reason for r in G.cycle_gate(df).orderBy("ts").collect()] == ["volume_spike", "cooldown", "session_open_london", "bos_bear", "no_trigger"]


def test_first_touches_down_the_pyramid(spark):
    """The same days as a look at every later day; each level meets few rows."""
    import datetime as dt
    import random

    from barline.operators import simulate

    rng = random.Random(6)
    start = dt.datetime(2019, 11, 20)
    prices, p = [], 100.0
    for i in range(1500):
        p += rng.choice([-1, 0, 1]) * rng.random()
        prices.append(("S", start + dt.timedelta(days=i, hours=rng.randint(0, 23)), p))
    rows = []
    for i in range(60):
        at = start + dt.timedelta(days=rng.randint(0, 1450), hours=5)
        side = rng.choice([1, -1])
        e = prices[(at - start).days][2]
        rows.append((f"p{i}", "S", at, "long" if side > 0 else "short", e, 10.0, e - side * rng.randint(1, 30), e + side * 1.0, e + side * rng.randint(2, 25), None))
    pos = spark.createDataFrame(rows, "position_id string, symbol string, entry_ts timestamp, direction string, entry double, size double, sl double, tp1 double, tp2 double, tp3 double")
    ticks = spark.createDataFrame(prices, "symbol string, ts timestamp, price double")
    got = {(r.position_id, r.level): r.day for r in simulate.first_touches(pos, ticks, ("sl", "tp1", "tp2", "tp3")).collect()}
    want = {}
    for i, _, at, direction, _, _, *levels in rows:
        for name, level in zip(("sl", "tp1", "tp2", "tp3"), levels):
            above = (direction == "long") == (name != "sl")
            days = [t.date() for _, t, x in prices if t.date() > at.date() and level is not None and (x >= level if above else x <= level)]
            if days:
                want[i, name] = min(days)
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert len(want) > 80


def test_joined_segments_are_the_stitched_curve(spark):
    """Summaries of segments give what the points of the joined curve give, also behind a lost segment and for single points."""
    import random

    from barline.operators import metrics, validation

    rng = random.Random(12)
    rows = []
    for grp in range(5):
        e = 100.0
        for seq in range([30, 1, 40, 25, 2][grp]):
            rows.append(("S", grp, seq, e, "TP" if seq % 7 == 3 else None))
            e *= 1 + rng.uniform(-0.05, 0.05)
    curve = spark.createDataFrame(rows, "symbol string, grp int, seq long, equity double, exit_reason string")
    picks = validation.combos(spark, 5, 2)
    keys = ["symbol", "combo", "test"]
    got = validation.joined_segments(validation.segment_summaries(curve, ["symbol", "grp"]).join(picks, "grp"), keys, "grp", 252)
    points = validation.stitched(curve.join(picks, "grp"), keys, "grp")
    ordered = points.withColumn("seq", F.col("grp") * 1000 + F.col("seq"))
    want = metrics.returns_of(ordered, keys).groupBy(*keys).agg(metrics.sharpe("ret", 252).alias("sharpe"), F.count("exit_reason").alias("trades"))
    shape = lambda df: sorted((r.combo, r.test, round(r.sharpe, 8), r.trades) for r in df.collect())
    assert shape(got) == shape(want) and len(shape(got)) == 20
    flat = curve.withColumn("equity", F.lit(100.0))
    assert {r.sharpe for r in validation.joined_segments(validation.segment_summaries(flat, ["symbol", "grp"]).join(picks, "grp"), keys, "grp", 252).collect()} == {0.0}
