"""Queries over candles built from `events`: features, joins, signals, simulation, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import features as X
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import signals as G
from ..operators import simulate as S
from ..operators import validation as V
from ..sources.scan import table, ticks
from ..streaming import tape
from .shape import KEY, NOW, R, ROWS, bars_sql, r, shown

HOUR = 3600


def candles(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_from_ticks(ticks(spark, d))


def q_bars(spark, d):
    return shown(candles(spark, d))


def q_bars_indicators(spark, d):
    return shown(X.together(candles(spark, d), [X.INDICATORS]))


def q_resample(spark, d):
    return shown(B.resample(candles(spark, d), "4 hours"))


def q_refresh(spark, d):
    """The newest version of each hour's bar, when each of its ticks is a refreshed bar."""
    t = ticks(spark, d).withColumn("bar", F.date_trunc("hour", "ts"))
    arrival = t.select("symbol", "bar", "price", F.struct("ts", "event_id").alias("at"))
    return shown(B.keep_last(arrival, ["symbol", "bar"], "at").select("symbol", F.col("bar").alias("ts"), "price"))


def q_validate(spark, d):
    odd = candles(spark, d).withColumn("low", F.when(F.hour("ts") == 3, F.col("high") + 1).otherwise(F.col("low")))
    odd = odd.withColumn("volume", F.when(F.hour("ts") == 5, -F.col("volume")).otherwise(F.col("volume")))
    return B.bad_candles(odd).groupBy("symbol", "rule").agg(F.count("*").alias("n"))


def q_timeframe(spark, d):
    return B.timeframe_minutes(candles(spark, d)).select("symbol", F.col("minutes").cast("long").alias("minutes"))


def q_accumulation(spark, d):
    keep = ["symbol", "ts", "clv", "ad", "ad_extreme", "ad_turning_up", "ad_improving", "ma", "ma_rising", "volume_average", "volume_spike", "volume_ratio"]
    return shown(X.accumulation(candles(spark, d)).select(*keep).withColumn("ma_rising", F.col("ma_rising").cast("double")))


def q_flow(spark, d):
    keep = ["symbol", "ts", "cvd_full", "cvd_recent", "volume_total", "volume_avg", "flow_spike", "flow_ratio", "close_vs_open_bp", "aggressor_bias"]
    return shown(X.flow(candles(spark, d)).select(*keep))


def q_order_flow(spark, d):
    return shown(X.order_flow(candles(spark, d)).select("symbol", "ts", "cvd_approx", "cvd_divergence", "buy_share", "large_prints"))


def q_context(spark, d):
    return shown(X.context(candles(spark, d)).select("symbol", "ts", "session", "day_of_week", "hour_utc", "atr", "atr_percentile"))


def q_vol_regime(spark, d):
    return shown(X.vol_regime(candles(spark, d)).select("symbol", "ts", "atr_14", "atr_percentile_90d", "expansion_score", "slope_bp", "regime"))


def q_structure(spark, d):
    keep = ["symbol", "ts", "swing_high", "swing_low", "last_bos", "range_high", "range_low", "midpoint", "in_premium"]
    return shown(X.structure(candles(spark, d)).select(*keep).withColumn("in_premium", F.col("in_premium").cast("double")))


def q_fvg(spark, d):
    df = X.fair_value_gaps(candles(spark, d))
    side = lambda n, c: df.select("symbol", "ts", F.lit(n).alias("side"), F.posexplode(c).alias("nth", "g"))
    both = side("bull", "bullish_fvgs").union(side("bear", "bearish_fvgs"))
    return shown(both.select("symbol", "ts", "side", "nth", F.col("g.low").alias("low"), F.col("g.high").alias("high"), F.col("g.index").alias("index")))


CONFLUENCE = ["symbol", "ts", "ma50", "ma200", "ma50_slope_bp", "dist_ma50_bp", "below_ma200", "atr_pct", "ret20_bp", "london", "ny", "ny_overlap"]


def q_confluence(spark, d):
    return shown(X.together(candles(spark, d), [X.CONFLUENCE]).select(*CONFLUENCE))


def q_confluence_chunked(spark, d):
    """The same by chunks of time: many window partitions for one symbol."""
    whole = B.by_time_chunks(candles(spark, d), X.confluence, days=10, lookback=220)
    return shown(whole.select("symbol", "ts", "ma50", "ma50_slope_bp", "ret20_bp", "atr_pct"))


def q_correlation(spark, d):
    base = X.daily_returns(candles(spark, d))
    got = X.rolling_correlation(base.where("symbol = 'purchase'"), base.where("symbol <> 'purchase'"), 14)
    return shown(got.withColumn("day", F.col("day").cast("string")))


def q_macro_regime(spark, d):
    """The second to fourth symbol as the three macro series, all others as assets."""
    base = X.daily_returns(candles(spark, d))
    names = sorted(r[0] for r in base.select("symbol").distinct().collect())  # symbols are a short list
    series = names[1:4]
    got = X.rolling_correlation(base.where(~F.col("symbol").isin(series)), base.where(F.col("symbol").isin(series)), 14)
    wide = got.groupBy("symbol", "day").pivot("series", series).agg(F.first("corr"))
    return wide.select("symbol", F.col("day").cast("string").alias("day"), X.macro_regime(*map(F.col, series)).alias("regime"))


def q_asof(spark, d):
    """Each purchase with the last click at or before it."""
    t = ticks(spark, d)
    left = t.where("symbol = 'purchase'").select("ts", "event_id")
    right = t.where("symbol = 'click'").groupBy("ts").agg(F.max("event_id").alias("click_id"), F.max_by("price", "event_id").alias("click_price"))
    return shown(J.asof_backward(left, right, [], ["click_id", "click_price"], bucket_seconds=24 * HOUR))


def q_news(spark, d):
    """Hourly bars within 15 minutes of a large error event."""
    t = ticks(spark, d)
    events = t.where("symbol = 'error' and price > 90").select(F.concat(F.lit("E"), "event_id").alias("name"), F.col("ts").alias("event_ts"), F.lit("high").alias("impact"))
    left = candles(spark, d).select("symbol", "ts").withColumn("key", F.concat_ws("|", "symbol", "ts"))
    return shown(J.first_event_in_window(left, events, "key").select("symbol", "ts", "in_news", "event_name"))


def q_trailing(spark, d):
    return shown(J.trailing_window(candles(spark, d), "close", 5, "m").select("symbol", "ts", "m_n", (F.col("m_mean") * F.col("m_n")).alias("m_sum")))


def q_intent(spark, d):
    """Crowding, side bias and alignment from proxies: daily balance by order status and priority."""
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))).alias("commercial_net"),
        F.sum(F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))).alias("managed_net"),
    )
    c, m = X.side_bias(F.col("commercial_net")), X.side_bias(F.col("managed_net"))
    rate = F.col("commercial_net") / 1e9
    return o.select(F.col("day").cast("string").alias("day"), c.alias("commercial_bias"), m.alias("managed_bias"), X.cot_alignment(c, m).alias("alignment"), X.funding_skew(rate).alias("skew"))


SIGNAL = ["symbol", "ts", "direction", "stop", "target"]


def _signals(spark, d, name):
    soft = {"retracement_short": {}, "retracement_short_filtered": {"min_downslope_bp": 1.0, "min_recent_down_bp": 1.0, "ma_slow": 100}, "momentum": {}, "two_lower_closes_short": {}}
    return G.STRATEGIES[name](candles(spark, d), **soft[name])


def q_signal(name):
    return lambda spark, d: shown(_signals(spark, d, name).where("direction is not null").select(*SIGNAL))


def q_gate(spark, d):
    df = X.together(candles(spark, d), [X.FLOW, X.STRUCTURE])
    packs = df.select("symbol", "ts", F.col("flow_spike").alias("volume_spike"), "last_bos", X.session(F.hour("ts")).alias("session"),
                      F.when(F.hour("ts") == 12, "NOON").alias("news_event"))
    got = G.cycle_gate(packs, cooldown_seconds=2 * HOUR)
    return shown(got.select("symbol", "ts", "fired", "reason"))


def q_spikes(spark, d):
    got = G.spikes(X.accumulation(candles(spark, d), extreme=1e9), quiet_bp=1e5)
    return shown(got.select("symbol", "ts", "spike", "spike_price", "consolidating", "bouncing"))


def q_rule_signals(spark, d):
    """Bounces confirmed by the bar's own moving average and accumulation, in the place of wider timeframes."""
    bars = X.accumulation(candles(spark, d), extreme=1e9).withColumn("h1_prev_close", F.lag("close").over(B.over()))
    as_wide = {"m15_ma": "ma", "m15_ad": "ad", "m15_ad_improving": "ad_improving", "m30_close": "close", "m30_ma": "ma", "h1_close": "close", "h1_ma_slow": "ma", "h1_ma_slow_rising": "ma_rising"}
    bars = bars.withColumns({new: F.col(old) for new, old in as_wide.items()})
    got = G.rule_signals(bars, F.lit(10000.0), G.timeframes_confirm(), 6 * HOUR, quiet_bp=1e9)
    return shown(got.select("symbol", "ts", "spike_price", "entry", "stop_loss", "tp1", "tp2", "tp3", "position_size", "confidence"))


def q_live_flow(spark, d):
    """The newest event of each type as a snapshot of the stream."""
    t = ticks(spark, d)
    signed = F.when(F.col("event_id") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    s = t.select("symbol", F.struct("ts", "event_id").alias("ts"), F.col("price").alias("cvd_full"), signed.alias("cvd_recent"), (F.col("size") / 100).alias("ob_imbalance"),
                 F.lit(None).cast("double").alias("ob_spread"), F.array("event_id").alias("sweeps"), F.lit(None).cast("array<bigint>").alias("prints"))
    return shown(X.live_flow(s))


def q_timeframes(spark, d):
    """Hourly bars confirmed by 4-hour and 12-hour ones that were closed before them."""
    base = X.accumulation(candles(spark, d))

    def wide(every, hours, prefix):
        w = X.accumulation(B.resample(candles(spark, d), every))
        return w.select("symbol", (F.col("ts") + F.expr(f"interval {hours} hours")).alias("ts"), F.col("close").alias(f"{prefix}_close"), F.lag("close").over(B.over()).alias(f"{prefix}_prev_close"),
                        F.col("ma").alias(f"{prefix}_ma"), F.col("ad").alias(f"{prefix}_ad"), F.col("ad_improving").alias(f"{prefix}_ad_improving"), F.col("ma_rising").alias(f"{prefix}_ma_rising"))

    m15 = wide("2 hours", 2, "m15")
    h = wide("4 hours", 4, "h1").withColumnsRenamed({"h1_ma": "h1_ma_slow", "h1_ma_rising": "h1_ma_slow_rising"})
    df = J.asof_backward(base.select("symbol", "ts", "volume_spike", "ad_improving", "ma_rising"), m15, ["symbol"], ["m15_ma", "m15_ad", "m15_ad_improving", "m15_close"])
    df = df.withColumnsRenamed({"m15_close": "m30_close"}).withColumn("m30_ma", F.col("m15_ma"))
    df = J.asof_backward(df, h, ["symbol"], ["h1_close", "h1_prev_close", "h1_ma_slow", "h1_ma_slow_rising"])
    return shown(df.select("symbol", "ts", G.timeframes_confirm().alias("confirmed"), G.confidence_score().alias("confidence")))


def q_setup_tags(spark, d):
    df = X.together(candles(spark, d), [X.FLOW, X.STRUCTURE]).withColumns({"session": X.session(F.hour("ts")), "volume_spike": F.col("flow_spike")})
    return shown(df.select("symbol", "ts", F.array_join(G.setup_tags(), ",").alias("tags")))


def q_trades(spark, d):
    return shown(S.simulate(_signals(spark, d, "momentum").withColumn("news", F.hour("ts") == 12), ["symbol"], bar_seconds=HOUR))


def q_equity(spark, d):
    return shown(S.equity_curve(_signals(spark, d, "momentum"), ["symbol"], bar_seconds=HOUR))


def q_trade_metrics(spark, d):
    s = _signals(spark, d, "momentum")
    return shown(M.curve_metrics(S.folded(s, ["symbol"], bar_seconds=HOUR), ["symbol"], HOUR, *M.trade_aggregates()))


def q_curve_metrics(spark, d):
    """Statistics of each symbol's closes as an equity curve."""
    eq = candles(spark, d).select("symbol", F.row_number().over(B.over()).alias("seq"), F.col("close").alias("equity")).where("equity > 0")
    return shown(M.curve_metrics(eq, ["symbol"], HOUR))


def q_deflated(spark, d):
    eq = candles(spark, d).select("symbol", F.row_number().over(B.over()).alias("seq"), F.col("close").alias("equity")).where("equity > 0")
    m = M.curve_metrics(eq, ["symbol"], HOUR)
    return shown(m.select("symbol", M.deflated_sharpe(F.col("mean_ret") / F.col("sd_ret"), F.lit(10), F.col("n_ret"), F.col("skew"), F.col("kurt")).alias("dsr")))


def q_ruin(spark, d):
    s = M.trade_summary(S.simulate(_signals(spark, d, "momentum"), ["symbol"], bar_seconds=HOUR), ["symbol"])
    return M.ruin_of(s, ["symbol"])


def q_walk_forward_folds(spark, d):
    n = candles(spark, d).groupBy("symbol").agg(F.count("*").alias("n"))
    return shown(V.walk_forward_folds(n, 200, 50, 50))


def q_walk_forward(spark, d):
    return shown(V.walk_forward(_signals(spark, d, "momentum"), 200, 100, 100))


def q_cv_groups(spark, d):
    g = V.groups(candles(spark, d), 10)
    return shown(g.groupBy("symbol", "grp").agg(F.min("i").alias("lo"), F.max("i").alias("hi")))


def q_purged(spark, d):
    p = V.purged_training(candles(spark, d), [2, 7], 10)
    return shown(p.groupBy("symbol", "grp").agg(F.sum(F.col("train").cast("int")).alias("n_train")))


def q_stitched(spark, d):
    """Hourly closes by group, stitched into one curve over the odd groups."""
    g = V.groups(candles(spark, d).where("close > 0"), 10).where("grp % 2 = 1")
    seg = g.select("symbol", "grp", F.col("i").alias("seq"), F.col("close").alias("equity"))
    return shown(V.stitched(seg, ["symbol"], "grp"))


def _two(spark, d):
    a = _signals(spark, d, "momentum").select(*SIGNAL, "open", "high", "low", "close").withColumn("strategy", F.lit("momentum"))
    b = _signals(spark, d, "two_lower_closes_short").select(*SIGNAL, "open", "high", "low", "close").withColumn("strategy", F.lit("toy"))
    return a.unionByName(b)


def q_cpcv(spark, d):
    return shown(V.cpcv(spark, _two(spark, d), 6, 2))


def q_verdict(spark, d):
    got = V.evaluate(spark, _two(spark, d), (200, 100, 100), 6, 2, n_trials=2)
    return shown(got.select("symbol", "sharpe", "dsr", "wfe_pass_ratio", "min_wfe", "oos_trades", "pbo", F.array_join("fail_reasons", ",").alias("fail_reasons"), "verdict"))


def q_pbo(spark, d):
    """Overfitting of choosing the best segment by one half-year's orders and judging it by the next."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    half = F.month("o_orderdate") <= 6
    s = o.groupBy(F.year("o_orderdate").alias("split"), F.col("c_mktsegment").alias("strategy")).agg(
        F.sum(F.when(half, F.col("o_totalprice")).otherwise(0.0)).alias("a"), F.sum(F.when(~half, F.col("o_totalprice")).otherwise(0.0)).alias("b"))
    ranked = M.ranks(M.ranks(s, "split", "strategy", "a", "is_rank"), "split", "strategy", "b", "oos_rank")
    return shown(M.overfitting_probability(ranked, "split", "strategy"))


def q_lookahead(spark, d):
    """Rows up to the middle that change when later bars are poisoned: none of the features, and of a build that reads
    one bar ahead (to show that the audit sees it) one for each symbol with bars on both sides."""
    base = candles(spark, d)
    at = base.agg((F.timestamp_seconds(F.floor((F.min("ts").cast("double") + F.max("ts").cast("double")) / 2))).alias("t")).first().t

    def leaks(build, name):
        clean, bad = (B.time_slice(build(x), None, at) for x in (base, V.poisoned(base, at)))
        return clean.exceptAll(bad).agg(F.lit(name).alias("build"), F.count("*").alias("n_leaks"))

    ahead = lambda x: x.select("symbol", "ts", F.lead("open").over(B.over()).alias("open"))
    return leaks(build_ts, "features").unionByName(leaks(ahead, "one bar ahead"))


def build_ts(base):
    return shown(X.together(base, [X.CONFLUENCE, X.FLOW, X.STRUCTURE])).select("symbol", "ts", "ma50", "ret20_bp", "cvd_full", "last_bos")


def q_positions(spark, d):
    t = ticks(spark, d)
    first = t.groupBy("symbol").agg(F.min_by("price", F.struct("ts", "event_id")).alias("entry"), F.min("ts").alias("entry_ts"))
    sign = F.when(F.col("symbol") < "l", 1.0).otherwise(-1.0)
    pos = first.select(F.concat(F.lit("p-"), "symbol").alias("position_id"), "symbol", "entry_ts", F.when(sign > 0, "long").otherwise("short").alias("direction"), "entry",
                       F.lit(4.0).alias("size"), (F.col("entry") - sign * 60).alias("sl"), *((F.col("entry") + sign * x).alias(f"tp{i}") for i, x in enumerate((5, 15, 40), 1)))
    return shown(S.manage_positions(pos, t.select("symbol", "ts", "price")))


def q_costs(spark, d):
    """Round-trip cost of every line item as a position held until shipping."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    hours = (F.col("l_shipdate").cast("timestamp").cast("double") - F.col("o_orderdate").cast("timestamp").cast("double")) / 3600
    cost = S.Costs().round_trip_column(F.when(F.col("l_returnflag") == "R", "short").otherwise("long"), F.col("l_linestatus") == "O", hours, F.col("l_quantity") > 25)
    return shown(li.groupBy("l_returnflag", "l_linestatus").agg(F.avg(cost).alias("cost_bp"), F.count("*").alias("n")))


def q_risk_plan(spark, d):
    plan = S.risk_plan(F.col("p_retailprice"), F.lit(10000.0), F.when(F.col("p_size") > 25, "short").otherwise("long"), max_units=12)
    return shown(table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in plan.items())))


def q_book(spark, d):
    """Order books from orders of a day: open ones bid, others ask; features of the best five levels."""
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.collect_list(F.when(F.col("o_orderstatus") == "O", F.struct(F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 10).cast("double").alias("size"), "o_orderkey"))).alias("b"),
        F.collect_list(F.when(F.col("o_orderstatus") != "O", F.struct(F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 10).cast("double").alias("size"), "o_orderkey"))).alias("a"),
    )
    sides = o.select("day", F.sort_array("b", asc=False).alias("bids"), F.sort_array("a").alias("asks"))
    return shown(J.book_features(sides).select(F.col("day").cast("string").alias("day"), "bid_size", "ask_size", "imbalance", "spread"))


def q_large_prints(spark, d):
    """Ticks larger than 1.5 times the median of the 200 before them, after 50."""
    t = ticks(spark, d).select("symbol", "ts", F.col("event_id").alias("seq"), F.lit("buy").alias("side"), "price", "size")
    return shown(tape.batch_tape(t, factor=1.5).where("print_ratio is not null").select("symbol", F.col("seq").alias("event_id"), F.col("print_ratio").alias("ratio")))



QUERIES = {
    "bars_ohlcv": q_bars, "bars_indicators": q_bars_indicators, "bars_resample": q_resample, "bars_refresh": q_refresh, "bars_validate": q_validate, "bars_timeframe": q_timeframe,
    "feat_accumulation": q_accumulation, "feat_flow": q_flow, "feat_order_flow": q_order_flow, "feat_context": q_context, "feat_vol_regime": q_vol_regime,
    "feat_structure": q_structure, "feat_fvg": q_fvg, "feat_confluence": q_confluence, "feat_confluence_chunked": q_confluence_chunked, "feat_correlation": q_correlation,
    "feat_macro_regime": q_macro_regime, "feat_intent": q_intent, "join_asof": q_asof, "join_news_interval": q_news, "join_trailing_window": q_trailing,
    **{f"signal_{n}": q_signal(n) for n in G.STRATEGIES}, "gate_cycle": q_gate, "pattern_spikes": q_spikes, "signal_rules": q_rule_signals, "feat_live_flow": q_live_flow, "signal_timeframes": q_timeframes, "signal_setup_tags": q_setup_tags,
    "sim_trades": q_trades, "sim_equity": q_equity, "metrics_trades": q_trade_metrics, "metrics_curve": q_curve_metrics, "metrics_deflated_sharpe": q_deflated, "metrics_ruin": q_ruin,
    "metrics_pbo": q_pbo, "cv_walk_forward_folds": q_walk_forward_folds, "cv_walk_forward": q_walk_forward, "cv_groups": q_cv_groups, "cv_purged": q_purged, "cv_stitched": q_stitched,
    "cv_combinatorial": q_cpcv, "verdict_promotion": q_verdict, "audit_lookahead": q_lookahead, "positions_exits": q_positions, "costs_round_trip": q_costs, "risk_plan": q_risk_plan,
    "book_features": q_book, "tape_large_prints": q_large_prints,
}

_SIGN = "sign(close - open) * volume"
_TR = "case when lag(close) over w is not null then greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr"
_TRS = f"""{bars_sql()}, t0 as (select *, {_TR}, row_number() over w as rn from bars window w as (partition by symbol order by ts)),
t1 as (select *, count(tr) {ROWS} as n_tr from t0)"""
_SESSION = "case when hour(ts) >= 13 and hour(ts) < 16 then 'ny-overlap' when hour(ts) >= 7 and hour(ts) < 16 then 'london' when hour(ts) < 9 then 'asia' when hour(ts) >= 13 and hour(ts) < 22 then 'ny' else 'off-hours' end"


def _atr(n, cast=""):
    return f"case when n_tr >= {n} then avg(tr) {R(n - 1)} else 0.0 end"


_CONF = f"""{bars_sql()}, c0 as (select *, case when count(*) {R(49)} >= 50 then avg(close) {R(49)} end as ma50, case when count(*) {R(199)} >= 200 then avg(close) {R(199)} end as ma200,
  greatest(high - low, abs(high - lag(close) {KEY}), abs(low - lag(close) {KEY})) as tr0, high - low as hl, lag(close, 20) {KEY} as ago from bars),
c1 as (select *, coalesce(tr0, hl) as tr from c0),
c2 as (select *, case when count(*) {R(13)} >= 14 then avg(tr) {R(13)} end as atr14, lag(ma50, 20) {KEY} as ma_ago from c1)"""

_STRUCT = f"""{bars_sql()}, s0 as (select *, row_number() {KEY} as rn,
  count(*) over (partition by symbol order by ts rows between 5 preceding and 5 following) as around,
  max(high) over (partition by symbol order by ts rows between 5 preceding and 5 following) as hh,
  min(low) over (partition by symbol order by ts rows between 5 preceding and 5 following) as ll from bars),
piv as (select symbol, rn + 5 as rn, case when high >= hh then high end as ph, case when low <= ll then low end as pl from s0 where around = 11),
h as (select symbol, rn, ph, max(ph) over (partition by symbol order by rn rows between 2 preceding and current row) as rh from piv where ph is not null),
l as (select symbol, rn, pl, min(pl) over (partition by symbol order by rn rows between 2 preceding and current row) as rl from piv where pl is not null),
s1 as (select s0.*, h.ph as swing_high, h.rh, l.pl as swing_low, l.rl from s0 asof left join h on s0.symbol = h.symbol and s0.rn >= h.rn asof left join l on s0.symbol = l.symbol and s0.rn >= l.rn)"""

_DAILY = f"""{bars_sql()}, dl as (select symbol, ts::date as day, last(close order by ts) as c from bars group by symbol, ts::date),
dr as (select symbol, day, c / lag(c) over (partition by symbol order by day) - 1 as ret from dl),
ret as (select * from dr where ret is not null)"""


def _rolled(left, right):
    return f"""co as (select m.symbol as series, a.symbol, a.day, case when count(*) over v >= 7 then corr(a.ret, m.ret) over v end as corr
 from ret a join ret m on a.day = m.day and {left} and {right} window v as (partition by m.symbol, a.symbol order by a.day rows between 13 preceding and current row))"""


_SIG = "strftime(ts, '%Y-%m-%d %H:%M:%S') as ts"
_MOM = f"""{_TRS}, m0 as (select *, case when count(*) {R(49)} >= 50 then avg(close) {R(49)} end as ma, case when n_tr >= 14 then avg(tr) {R(13)} end as atr, lag(close, 20) {KEY} as ago,
  max(high) over (partition by symbol order by ts rows between 10 preceding and 1 preceding) as ph, min(low) over (partition by symbol order by ts rows between 10 preceding and 1 preceding) as pl from t1),
m1 as (select *, (close - ago) / ago * 10000 as mom, greatest(1.5 * atr, close * 25 / 10000.0) as room from m0 where ma is not null and atr > 0 and ago is not null)"""

_EQ = f"""{bars_sql()}, e0 as (select symbol, row_number() {KEY} as seq, close as equity from bars), e1 as (select * from e0 where equity > 0),
e2 as (select *, equity / lag(equity) over w - 1 as ret, equity / max(equity) over (partition by symbol order by seq rows unbounded preceding) - 1 as dd from e1 window w as (partition by symbol order by seq))"""

_GROUPS = f"""{bars_sql()}, g0 as (select *, row_number() {KEY} - 1 as i, count(*) over (partition by symbol) as n from bars),
b as (select symbol, n, g as grp, floor(g * n / 10.0)::bigint as lo, floor((g + 1) * n / 10.0)::bigint - 1 as hi from (select distinct symbol, n from g0), range(10) t(g))"""

ORACLE = {
    "bars_ohlcv": f"with {bars_sql()} select symbol, {NOW}, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('volume')} from bars",
    "bars_indicators": f"""with {_TRS} select symbol, {NOW}, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('volume')},
  {r(f'case when count(*) {R(49)} >= 50 then avg(close) {R(49)} end', 'sma50')}, {r(_atr(14), 'atr14')}, {r(f'sum({_SIGN}) {ROWS}', 'cvd')}, {_SESSION} as session from t1""",
    "bars_resample": f"""with {bars_sql()} select symbol, strftime(time_bucket(interval '4 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as ts, {r('first(open order by ts)', 'open')}, {r('max(high)', 'high')},
  {r('min(low)', 'low')}, {r('last(close order by ts)', 'close')}, {r('sum(volume)', 'volume')} from bars group by symbol, time_bucket(interval '4 hours', ts, timestamp '1970-01-01')""",
    "bars_refresh": f"with {bars_sql()} select symbol, {NOW}, {r('close', 'price')} from bars",
    "bars_validate": f"""with {bars_sql()}, o as (select symbol, case when hour(ts) = 3 then 'high below low' when hour(ts) = 5 and volume > 0 then 'negative volume' end as rule from bars)
  select symbol, rule, count(*) as n from o where rule is not null group by symbol, rule""",
    "bars_timeframe": f"""with {bars_sql()}, s as (select symbol, date_diff('minute', lag(ts) {KEY}, ts) as step from bars), c as (select symbol, step, count(*) as n from s where step is not null group by symbol, step)
  select symbol, greatest(1, first(step order by n desc, step))::bigint as minutes from c group by symbol""",
    "feat_accumulation": f"""with {bars_sql()}, a0 as (select *, case when high = low then 0.0 else (2 * close - high - low) / (high - low) end as clv, row_number() {KEY} as rn, count(*) {R(19)} as c20, avg(volume) {R(19)} as m20, avg(close) {R(19)} as a20 from bars),
  a1 as (select *, round(sum(clv * volume) {ROWS}, 6) as ad, case when c20 >= 20 then a20 end as ma from a0)
  select symbol, {NOW}, {r('clv')}, {r('ad')}, coalesce(rn >= 3 and max(ad) {R(2)} < -50, false)::int as ad_extreme, coalesce(lag(ad) {KEY} < lag(ad, 2) {KEY} and ad > lag(ad) {KEY}, false)::int as ad_turning_up,
  coalesce(rn >= 4 and lag(ad, 2) {KEY} < lag(ad) {KEY} and lag(ad) {KEY} < ad, false)::int as ad_improving, {r('ma')}, (ma > lag(ma) {KEY})::int::double as ma_rising, {r('case when c20 >= 20 then m20 end', 'volume_average')},
  (c20 >= 20 and volume > 2 * m20)::int as volume_spike, {r('case when m20 > 0 then volume / m20 else 1.0 end', 'volume_ratio')} from a1""",
    "feat_flow": f"""with {bars_sql()}, f as (select *, sum({_SIGN}) {R(9)} as recent, avg(volume) {R(19)} as m from bars)
  select symbol, {NOW}, {r(f'sum({_SIGN}) {ROWS}', 'cvd_full')}, {r('recent', 'cvd_recent')}, {r(f'sum(volume) {ROWS}', 'volume_total')}, {r('m', 'volume_avg')}, (volume > 2 * m)::int as flow_spike,
  {r('case when m > 0 then volume / m else 1.0 end', 'flow_ratio')}, {r('(close - open) / case when open = 0 then 1.0 else open end * 10000', 'close_vs_open_bp')},
  case when recent > 0 then 'buy' when recent < 0 then 'sell' else 'neutral' end as aggressor_bias from f""",
    "feat_order_flow": f"""with {bars_sql()}, o0 as (select *, {_SIGN} as s, sum({_SIGN}) {ROWS} as cum, sum(close - open) {ROWS} as path from bars),
  o1 as (select *, sum(s) {R(19)} as cvd, sum(case when s > 0 then s else 0 end) {R(19)} as buy, sum(abs(s)) {R(19)} as tot, stddev_pop(cum) {R(19)} as sc, stddev_pop(path) {R(19)} as sp,
    corr(cum, path) {R(19)} as cr, count(*) {R(19)} as c, list(volume) {R(19)} as vs, median(volume) {R(19)} as mid from o0)
  select symbol, {NOW}, {r('cvd', 'cvd_approx')}, {r('case when c < 2 or sc < 1e-12 or sp < 1e-12 then 0.0 else greatest(-1.0, least(1.0, cr)) end', 'cvd_divergence')},
  {r('case when tot > 0 then buy / tot else 0.5 end', 'buy_share')}, len(list_filter(vs, lambda x: x > 2.5 * mid and mid > 0))::bigint as large_prints from o1""",
    "feat_context": f"""with {_TRS}, x as (select *, {_atr(14)} as atr from t1), y as (select *, list(case when n_tr >= 14 then atr end) {R(499)} as seen from x)
  select symbol, {NOW}, {_SESSION} as session, dayname(ts) as day_of_week, hour(ts)::bigint as hour_utc, {r('atr')},
  {r('case when n_tr >= 15 then len(list_filter(seen, lambda a: a is not null and a <= atr + 1e-12)) / len(list_filter(seen, lambda a: a is not null)) end', 'atr_percentile')} from y""",
    "feat_vol_regime": f"""with {_TRS}, x as (select *, {_atr(14)} as a14, {_atr(50)} as a50, avg(close) {R(19)} as m, regr_slope(close, rn) {R(19)} as sl,
    list(case when n_tr >= 14 then avg_tr end) over (partition by symbol order by ts rows between 2159 preceding and current row) as seen from (select *, avg(tr) {R(13)} as avg_tr from t1)),
  y as (select *, case when n_tr >= 50 then a50 else a14 end as lg from x),
  z as (select *, case when lg > 0 then a14 / lg else 1.0 end as raw, case when n_tr < 14 or m = 0 then 0.0 else sl / m * 10000 end as slope from y)
  select symbol, {NOW}, {r('a14', 'atr_14')}, {r('case when n_tr >= 14 then len(list_filter(seen, lambda a: a is not null and a <= a14 + 1e-12)) / len(list_filter(seen, lambda a: a is not null)) else 0.0 end', 'atr_percentile_90d')},
  {r('case when n_tr >= 14 then least(raw, 3.0) / 3 else 0.0 end', 'expansion_score')}, {r('slope', 'slope_bp')},
  case when n_tr < 14 then 'ranging' when raw > 1.65 then 'expansion' when abs(slope) < 5 then 'ranging' when slope > 0 then 'trending_up' else 'trending_down' end as regime from z""",
    "feat_structure": f"""with {_STRUCT} select symbol, {NOW}, {r('swing_high')}, {r('swing_low')}, case when close > swing_high then 'bull' when close < swing_low then 'bear' end as last_bos,
  {r('case when swing_low is not null then rh end', 'range_high')}, {r('case when swing_high is not null then rl end', 'range_low')}, {r('(rh + rl) / 2', 'midpoint')}, (close > (rh + rl) / 2)::int::double as in_premium from s1""",
    "feat_fvg": f"""with {bars_sql()}, f0 as (select *, row_number() {KEY} - 1 as rn, lag(high, 2) {KEY} as h2, lag(low, 2) {KEY} as l2 from bars),
  gaps as (select symbol, rn as g, 'bull' as side, h2 as low, low as high from f0 where h2 < low union all select symbol, rn, 'bear', high, l2 from f0 where l2 > high),
  j as (select f0.symbol, f0.ts, gaps.*exclude(symbol), row_number() over (partition by f0.symbol, f0.ts, gaps.side order by g desc) as back, count(*) over (partition by f0.symbol, f0.ts, gaps.side) as c
    from f0 join gaps on gaps.symbol = f0.symbol and g between f0.rn - 49 and f0.rn)
  select symbol, {NOW}, side, (least(c, 5) - back)::bigint as nth, {r('low')}, {r('high')}, g::bigint as index from j where back <= 5""",
    "feat_confluence": f"""with {_CONF} select symbol, {NOW}, {r('ma50')}, {r('ma200')}, {r('(ma50 - ma_ago) / ma50 * 10000', 'ma50_slope_bp')}, {r('(close - ma50) / ma50 * 10000', 'dist_ma50_bp')},
  coalesce(close < ma200, false)::int::bigint as below_ma200, {r('atr14 / close * 10000', 'atr_pct')}, {r('(close / ago - 1) * 10000', 'ret20_bp')}, (hour(ts) between 7 and 15)::int::bigint as london,
  (hour(ts) between 13 and 21)::int::bigint as ny, (hour(ts) between 13 and 15)::int::bigint as ny_overlap from c2""",
    "feat_confluence_chunked": f"""with {_CONF} select symbol, {NOW}, {r('ma50')}, {r('(ma50 - ma_ago) / ma50 * 10000', 'ma50_slope_bp')}, {r('(close / ago - 1) * 10000', 'ret20_bp')}, {r('atr14 / close * 10000', 'atr_pct')} from c2""",
    "feat_correlation": f"with {_DAILY}, {_rolled(chr(97) + '.symbol = ' + repr('purchase'), 'm.symbol <> ' + repr('purchase'))} select symbol, series, day::varchar as day, {r('corr')} from co",
    "feat_macro_regime": f"""with {_DAILY}, names as (select symbol, row_number() over (order by symbol) as k from (select distinct symbol from ret)),
  co as (select a.symbol, n.k, a.day, case when count(*) over v >= 7 then corr(a.ret, m.ret) over v end as corr from ret a join names na on a.symbol = na.symbol and na.k not between 2 and 4 join ret m on a.day = m.day join names n on n.symbol = m.symbol and n.k between 2 and 4
    window v as (partition by a.symbol, n.k order by a.day rows between 13 preceding and current row)),
  wd as (select symbol, day, max(case when k = 2 then corr end) as d, max(case when k = 3 then corr end) as u, max(case when k = 4 then corr end) as s from co group by symbol, day)
  select symbol, day::varchar as day, case when d is null and u is null and s is null then 'unknown' when coalesce(abs(d), 0) < 0.2 and coalesce(abs(u), 0) < 0.2 and coalesce(abs(s), 0) < 0.2 then 'decoupled'
   when d < -0.3 and s < -0.3 then 'haven_bid' when d < -0.2 and s > 0.2 then 'risk_on' when d > 0.2 and s < -0.2 then 'risk_off' else 'decoupled' end as regime from wd""",
    "feat_intent": """with o as (select o_orderdate::date as day, sum(case when o_orderstatus = 'O' then o_totalprice else -o_totalprice end) as c, sum(case when o_orderpriority < '3' then o_totalprice else -o_totalprice end) as m from orders group by 1)
  select day::varchar as day, case when c > 0 then 'long' when c < 0 then 'short' else 'neutral' end as commercial_bias, case when m > 0 then 'long' when m < 0 then 'short' else 'neutral' end as managed_bias,
  case when c = 0 or m = 0 then null when (c > 0) = (m > 0) then 'aligned' else 'commercials_vs_specs' end as alignment, case when c / 1e9 > 1e-4 then 'long-crowded' when c / 1e9 < -1e-4 then 'short-crowded' else 'neutral' end as skew from o""",
    "join_asof": f"""with {bars_sql()}, cl as (select t, max(event_id) as click_id, arg_max(price, event_id) as click_price from ticks where symbol = 'click' group by t)
  select strftime(p.t, '%Y-%m-%d %H:%M:%S') as ts, event_id, click_id, {r('click_price')} from ticks p asof left join cl on p.t >= cl.t where symbol = 'purchase'""",
    "join_news_interval": f"""with {bars_sql()}, ev as (select 'E' || event_id as name, t from ticks where symbol = 'error' and price > 90),
  hit as (select symbol, ts, first(name order by t, name) as event_name from bars join ev on ts >= t - interval '15 minutes' and ts <= t + interval '15 minutes' group by symbol, ts)
  select b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as ts, (event_name is not null)::int as in_news, event_name from bars b left join hit on b.symbol = hit.symbol and b.ts = hit.ts""",
    "join_trailing_window": f"with {bars_sql()} select symbol, {NOW}, count(close) over v as m_n, {r('sum(close) over v', 'm_sum')} from bars window v as (partition by symbol order by ts range between interval 5 days preceding and current row)",
    "signal_retracement_short": f"""with {bars_sql()}, a as (select *, case when count(*) {R(49)} >= 50 then avg(close) {R(49)} end as ma from bars), c as (select *, lag(ma, 9) {KEY} as f, lag(ma, 4) {KEY} as mid, high * 1.001 as stop from a)
  select symbol, {_SIG}, 'short' as direction, {r('stop')}, {r('close - 2 * (stop - close)', 'target')} from c where ma < f and ma < mid and high >= ma * (1 - 0.0015) and close < ma and stop > close""",
    "signal_retracement_short_filtered": f"""with {bars_sql()}, a as (select *, case when count(*) {R(49)} >= 50 then avg(close) {R(49)} end as ma, case when count(*) {R(99)} >= 100 then avg(close) {R(99)} end as slow, lag(close, 20) {KEY} as ago, high * 1.001 as stop from bars),
  c as (select *, count(ma) {ROWS} as n, first_value(ma ignore nulls) {R(21)} as oldest from a)
  select symbol, {_SIG}, 'short' as direction, {r('stop')}, {r('close - 2 * (stop - close)', 'target')} from c where slow is not null and n >= 20 and close < slow and (ma - oldest) / ma * 10000 <= -1 and high >= ma * (1 - 0.0015)
   and close < ma and (ago is null or (close - ago) / ago * 10000 <= -1) and not hour(ts) between 13 and 15 and stop > close""",
    "signal_momentum": f"""with {_MOM} select symbol, {_SIG}, case when close > ma then 'long' else 'short' end as direction, {r('case when close > ma then close - room else close + room end', 'stop')}, {r('case when close > ma then close + room else close - room end', 'target')}
  from m1 where (close > ma and mom >= 100 and close > ph) or (close < ma and mom <= -100 and close < pl)""",
    "signal_two_lower_closes_short": f"""with {bars_sql()}, a as (select *, lag(close) {KEY} as p, lag(close, 2) {KEY} as q, close * 1.005 as stop from bars)
  select symbol, {_SIG}, 'short' as direction, {r('stop')}, {r('close - 2 * (stop - close)', 'target')} from a where close < p and p < q and stop > close""",
    "signal_setup_tags": f"""with {_STRUCT}, v as (select *, avg(volume) {R(19)} as m from s1)
  select symbol, {NOW}, concat_ws(',', nullif({_SESSION}, 'off-hours'), case when volume > 2 * m then 'spike' end, case when close > swing_high then 'bos' end) as tags from v""",
    "metrics_curve": f"""with {_EQ}, m as (select symbol, avg(ret) as mean_ret, stddev_samp(ret) as sd_ret, count(ret) as n_ret, skewness(ret) as skew, kurtosis(ret) + 3 as kurt, min(dd) as max_drawdown,
    stddev_samp(case when ret < 0 then ret end) as down, last(equity order by seq) / first(equity order by seq) - 1 as total_return from e2 group by symbol)
  select symbol, {r('mean_ret / sd_ret * sqrt(8760)', 'sharpe')}, {r('mean_ret / down * sqrt(8760)', 'sortino')}, {r('max_drawdown')}, {r('mean_ret')}, {r('sd_ret')}, n_ret, {r('skew')}, {r('kurt')}, {r('total_return')},
  {r('mean_ret * 252 / abs(max_drawdown)', 'calmar')} from m""",
    "metrics_pbo": f"""with s as (select year(o_orderdate) as split, c_mktsegment as strategy, sum(case when month(o_orderdate) <= 6 then o_totalprice else 0.0 end) as a, sum(case when month(o_orderdate) > 6 then o_totalprice else 0.0 end) as b
    from orders join customer on o_custkey = c_custkey group by 1, 2),
  k as (select *, row_number() over (partition by split order by a, strategy) - 1 as ra, row_number() over (partition by split order by b, strategy) - 1 as rb, count(*) over (partition by split) as n from s),
  best as (select split, arg_max(rb, ra) as oos, max(n) as n from k group by split)
  select count(*) as n_splits, {r('avg(case when abs(oos - (n - 1) / 2) < 1e-9 then 0.5 when oos < (n - 1) / 2 then 1.0 else 0.0 end)', 'pbo')} from best where n >= 2""",
    "cv_walk_forward_folds": f"""with {bars_sql()}, c as (select symbol, count(*) as n from bars group by symbol),
  z as (select symbol, n, case when n < 250 then greatest(1, floor(n * 0.7::double)) else 200 end::bigint as i, n < 250 as short from c), y as (select *, case when short then greatest(1, n - i) else 50 end::bigint as o from z),
  x as (select *, case when short then o else 50 end as hop from y), f as (select symbol, i, o, hop, unnest(range(0, n - i - o + 1, hop)) as pos from x)
  select symbol, (pos / hop)::bigint as step, 'is' as part, pos as lo, pos + i - 1 as hi from f union all select symbol, (pos / hop)::bigint, 'oos', pos + i, pos + i + o - 1 from f""",
    "cv_groups": f"with {_GROUPS} select symbol, grp::bigint as grp, lo, hi from b where hi >= lo",
    "cv_purged": f"""with {_GROUPS}, e as (select *, greatest(1, round(n * 0.01)) as emb from b where grp in (2, 7) and hi >= lo),
  t as (select g0.symbol, g0.i, max((g0.i between e.lo - 30 and e.hi + 30 + emb)::int) as hit from g0 join e on e.symbol = g0.symbol group by 1, 2)
  select t.symbol, b.grp::bigint as grp, sum(1 - hit)::bigint as n_train from t join b on b.symbol = t.symbol and t.i between b.lo and b.hi group by 1, 2""",
    "cv_stitched": f"""with {bars_sql()}, g0 as (select *, row_number() {KEY} - 1 as i, count(*) over (partition by symbol) as n from bars where close > 0),
  b as (select symbol, g as grp, floor(g * n / 10.0)::bigint as lo, floor((g + 1) * n / 10.0)::bigint - 1 as hi from (select distinct symbol, n from g0), range(10) t(g)),
  s as (select g0.symbol, b.grp, i as seq, close from g0 join b on b.symbol = g0.symbol and i between lo and hi and b.grp % 2 = 1),
  e as (select symbol, grp, first(close order by seq) as f, last(close order by seq) / first(close order by seq) as growth from s group by 1, 2),
  p as (select *, coalesce(product(growth) over (partition by symbol order by grp rows between unbounded preceding and 1 preceding), 1.0) as before from e)
  select s.symbol, s.grp::bigint as grp, s.seq, {r('close / f * before', 'equity')} from s join p on p.symbol = s.symbol and p.grp = s.grp""",
    "audit_lookahead": f"""with {bars_sql()}, m as (select to_timestamp(floor((epoch(min(ts)) + epoch(max(ts))) / 2))::timestamp as cut from bars),
  a as (select *, lead(open) {KEY} as ahead, lead(ts) {KEY} as later from bars)
  select 'features' as build, 0::bigint as n_leaks union all select 'one bar ahead', count(*) from a, m where ts <= cut and later > cut and ahead <> 0""",
    "costs_round_trip": f"""with x as (select l_returnflag, l_linestatus, 2 * (case when l_linestatus = 'O' then 20.5 else 4.0 end + case when l_quantity > 25 then 2.0 else 5.5 end)
    + case when l_returnflag = 'R' then -1 else 1 end * 1.5 * greatest(date_diff('microsecond', o_orderdate, l_shipdate) / 3600e6, 0.0) / 8 as cost from lineitem join orders on l_orderkey = o_orderkey)
  select l_returnflag, l_linestatus, {r('avg(cost)', 'cost_bp')}, count(*) as n from x group by 1, 2""",
    "risk_plan": f"""with x as (select p_partkey, p_retailprice as e, case when p_size > 25 then -1.0 else 1.0 end as s from part)
  select p_partkey, {r('e - s * e * 50 / 10000', 'stop_loss')}, {r('e + s * e * 35 / 10000', 'tp1')}, {r('e + s * e * 70 / 10000', 'tp2')}, {r('e + s * e * 120 / 10000', 'tp3')}, {r('least(100 / (e * 50 / 10000), 12)', 'position_size')}, {r('100.0::double', 'risk_amount')} from x""",
    "book_features": f"""with o as (select o_orderdate::date as day, o_orderstatus = 'O' as bid, o_totalprice as p, (o_custkey % 10)::double as s, o_orderkey as k from orders),
  n as (select *, case when bid then row_number() over (partition by day, bid order by p desc, s desc, k desc) else row_number() over (partition by day, bid order by p, s, k) end as l from o),
  b as (select day, coalesce(sum(case when bid and l <= 5 then s end), 0.0) as bid_size, coalesce(sum(case when not bid and l <= 5 then s end), 0.0) as ask_size, max(case when not bid and l = 1 then p end) - max(case when bid and l = 1 then p end) as spread from n group by day)
  select day::varchar as day, {r('bid_size')}, {r('ask_size')}, {r('case when bid_size + ask_size > 0 then (bid_size - ask_size) / (bid_size + ask_size) else 0.0 end', 'imbalance')}, {r('spread')} from b""",
    "tape_large_prints": f"""with {bars_sql()}, x as (select *, median(size) over v as mid, count(size) over v as n from ticks window v as (partition by symbol order by t, event_id rows between 200 preceding and 1 preceding))
  select symbol, event_id, {r('size / mid', 'ratio')} from x where n >= 50 and mid > 0 and size > 1.5 * mid""",
}
