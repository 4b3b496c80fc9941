"""Queries of the desk's tables and of small predicates, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bars as B
from ..operators import desk as K
from ..operators import joins as J
from ..operators import journal as L
from ..operators import signals as G
from ..operators import validation as V
from ..sources import stores as D
from ..sources.scan import table, ticks
from .market import candles
from .records import _PROPOSALS, _STATS, proposals, trades
from .shape import NOW, bars_sql, r, shown

DAY = "2024-01-20 00:00:00"


def _reports(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k, F.when(k % 9 == 0, "SKIP").otherwise("TAKE").alias("decision"), F.when(k % 13 == 0, "STALE").when(k % 41 == 0, "OLD").otherwise("FRESH").alias("data_quality"),
        F.when(k % 4 == 1, "n/a").when(k % 4 == 2, "short").when(k % 43 == 0, "up").otherwise("long").alias("direction"), F.when(k % 37 != 0, "markup").alias("regime"),
        F.when(k % 7 != 0, F.col("c_name")).alias("trapped_party"), F.when(k % 6 == 0, "short").otherwise("A close above the prior session high on rising volume voids it").alias("kill_thesis"),
        F.lit(3.5).alias("rr_minimum"), F.when(k % 17 == 0, 0.95).otherwise(0.8).alias("confidence"), F.lit(0.4).alias("flow"), F.lit(0.4).alias("structure"), F.lit(0.0).alias("context"), F.lit(0.0).alias("intent"),
        F.col("c_acctbal").alias("zone_low"), F.when(k % 29 != 0, F.col("c_acctbal") * F.when(k % 31 == 0, 0.9).otherwise(1.0212765957446808)).alias("zone_high"), (F.col("c_acctbal") * 1.1).alias("first_target"),
    )


_REPORTS = """rp as (select c_custkey, case when c_custkey % 9 = 0 then 'SKIP' else 'TAKE' end as decision, case when c_custkey % 13 = 0 then 'STALE' when c_custkey % 41 = 0 then 'OLD' else 'FRESH' end as dq,
  case when c_custkey % 4 = 1 then 'n/a' when c_custkey % 4 = 2 then 'short' when c_custkey % 43 = 0 then 'up' else 'long' end as direction, c_custkey % 37 <> 0 as regime, c_custkey % 7 <> 0 as trapped, c_custkey % 6 <> 0 as kill,
  case when c_custkey % 17 = 0 then 0.95 else 0.8 end::double as conf, c_acctbal as low, case when c_custkey % 29 <> 0 then c_acctbal * case when c_custkey % 31 = 0 then 0.9::double else 1.0212765957446808::double end end as high, c_acctbal * 1.1 as tp from customer)"""


def q_faults(spark, d):
    return _reports(spark, d).select("c_custkey", F.array_join(K.report_faults(), ",").alias("faults"))


def q_report_signal(spark, d):
    got = K.report_signal(_reports(spark, d), F.lit(10000.0), F.lit(False))
    return shown(got.select("c_custkey", "entry_price", "stop_loss", "tp1", "tp2", "tp3", "position_size", "side", "signal_confidence"))


def _reviewed(spark, d):
    ideas = proposals(spark, d).drop("n", "expectancy_r").withColumns({
        "setup": F.element_at(F.array(*map(F.lit, ("AF", "RF", "none"))), (F.col("id") % 3 + 1).cast("int")), "conviction": (F.col("id") % 5 + 1).cast("int"),
    })
    return K.review(ideas, L.setup_stats(trades(spark, d)), 10000.0)


_REVIEW = f"""{_STATS}, {_PROPOSALS}, q0 as (select pr.* exclude (n, expectancy_r), case id % 3 when 0 then 'AF' when 1 then 'RF' else 'none' end as setup, id % 5 + 1 as conviction from pr),
q1 as (select q0.*, coalesce(s.n, 0) as n, coalesce(expectancy_r, 0) as ex, coalesce(win_rate, 0) as w, coalesce(avg_win_r, 0) as up, abs(coalesce(avg_loss_r, 0)) as down, abs(target - entry) / nullif(abs(entry - stop), 0) as rr from q0 left join stats s on s.setup = q0.setup),
q2 as (select *, concat_ws(',', case when open_positions >= 1 then 'block:one_position' end, case when account_dd_pct >= 20 then 'block:drawdown_halt' end, case when day_pnl_pct <= -4 then 'block:daily_loss_cap' end, case when in_news then 'block:news_window' end,
   case when coalesce(rr, 0) < 2 then 'block:risk_reward' end, case when length(trim(kill_thesis)) < 25 or kill_thesis ilike '%gut feel%' then 'block:kill_thesis' end,
   case when not ((direction = 'long' and stop < entry) or (direction = 'short' and stop > entry)) then 'block:stop_side' end) as blocks,
  concat_ws(',', case when length(trim(thesis)) < 20 then 'warn:thesis_present' end, case when n >= 8 and ex < 0 then 'warn:setup_track_record' end) as warns,
  case when down > 0 and up > 0 and w > 0 then greatest(0.0, w - (1 - w) / (up / down)) else 0.0 end as fk from q1),
q3 as (select *, case when blocks <> '' then 'BLOCK' when warns <> '' then 'APPROVE_WITH_WARNINGS' else 'APPROVE' end as decision, case when n < 20 then 0.5 when fk <= 0 then 0.25 else greatest(0.25, least(2.0, fk * 25)) end as base from q2),
q4 as (select *, round(greatest(0.25, least(2.0, base * (0.7 + (conviction - 1) * (0.45 / 4)))), 3) as risk_pct from q3),
q5 as (select *, case when decision = 'BLOCK' then 0.0 else round(case when abs(entry - stop) > 0 then 10000.0 * risk_pct / 100 / abs(entry - stop) else 0 end, 6) end as size,
  case when decision = 'BLOCK' then blocks else concat_ws(',', nullif(warns, ''), case when coalesce(rr, 0) >= 3 then 'asymmetry' end, case when n >= 20 and ex > 0 then 'proven edge' end) end as coaching from q4)"""


def q_review(spark, d):
    return shown(_reviewed(spark, d).select("id", "decision", "risk_pct", "size", F.array_join("coaching", ",").alias("coaching")))


def q_commit(spark, d):
    return shown(K.committed(_reviewed(spark, d), DAY).select("trade_id", "setup", "risk_pct", "size", "opened_at", "status"))


def q_analysis(spark, d):
    got = K.analysis_outcome(_reviewed(spark, d), F.col("id") % 11 / 10.0, F.col("setup") != "none")
    return shown(got.select("id", "conviction", "outcome"))


def q_opened(spark, d):
    return shown(K.opened(_reviewed(spark, d).where("decision <> 'BLOCK'")))


def q_change(spark, d):
    b = candles(spark, d)
    return shown(b.select("symbol", "ts", K.change_since(b, "volume", 2 * 3600).alias("delta")))


def q_pack(spark, d):
    return shown(K.feature_pack(candles(spark, d), {"h4": ("4 hours", 14400), "h12": ("12 hours", 43200)}))


def _wide(name, seconds):
    first = f"to_timestamp(floor(epoch(ts) / {seconds}) * {seconds})::timestamp"
    w = "over (partition by symbol order by ts rows between 9 preceding and current row)"
    return f"""{name}0 as (select symbol, {first} as ts, first(open order by ts) as open, last(close order by ts) as close, sum(volume) as volume from bars group by symbol, {first}),
{name} as (select symbol, ts + interval {seconds} seconds as ts, close, sum(sign(close - open) * volume) over (partition by symbol order by ts rows unbounded preceding) as cvd, sum(sign(close - open) * volume) {w} as recent from {name}0)"""


def _flow_columns(t, prefix=""):
    bias = f"case when {t}.recent > 0 then 'buy' when {t}.recent < 0 then 'sell' when {t}.recent = 0 then 'neutral' end as {prefix}aggressor_bias"
    return f"{r(f'{t}.close', prefix + 'close')}, {r(f'{t}.cvd', prefix + 'cvd_full')}, {bias}"


def q_filter_stats(spark, d):
    li = table(spark, d, "lineitem").select("l_shipdate", F.when(F.col("l_returnflag") == "R", "SKIP").otherwise("TAKE").alias("action"), (F.col("l_linestatus") == "O").alias("cached"))
    return shown(K.filter_statistics(li.withColumn("year", F.year("l_shipdate")), ["year"]))


def q_filter_alpha(spark, d):
    li = table(spark, d, "lineitem").withColumn("arm", F.when(F.col("l_linestatus") == "O", "filtered").otherwise("baseline"))
    arms = li.groupBy("l_suppkey", "arm").agg(F.avg("l_discount").alias("total_return"), F.sum("l_tax").alias("cost"))
    return shown(K.filter_alpha(arms, "l_suppkey", 10000.0))


def q_upcoming(spark, d):
    events = ticks(spark, d).where("symbol = 'error'").select(F.concat(F.lit("E"), "event_id").alias("name"), F.col("ts").alias("event_ts"))
    return shown(J.upcoming(events, DAY, 24))


def q_fresh(spark, d):
    return shown(B.is_fresh(ticks(spark, d).where("event_id % 7 < 5").select("symbol", "ts"), DAY, 86400 * 15))


def q_stale(spark, d):
    return K.stale(ticks(spark, d).where(F.col("ts") < F.lit("2024-01-10").cast("timestamp")), DAY, 60)


def q_first(spark, d):
    t = ticks(spark, d).withColumn("bar", F.date_trunc("hour", "ts")).select("symbol", "bar", "price", F.struct("ts", "event_id").alias("at"))
    return shown(B.keep_first(t, ["symbol", "bar"], "at").select("symbol", F.col("bar").alias("ts"), "price"))


def q_predicates(spark, d):
    """Basis points, reward to risk and the drift filter over parts."""
    p = table(spark, d, "part")
    e, s = F.col("p_retailprice"), F.col("p_size")
    return shown(p.select("p_partkey", T.bp_between(e, e + s - 25).alias("bp"), T.bp_to_price(e, s).alias("distance"), L.reward_risk(e, e - s, e + 60).alias("rr"), G.too_far(e + s - 25, e, 80.0).alias("too_far")))


def q_open_positions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("position_id"), F.col("o_orderdate").alias("entry_ts"), F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "PARTIALLY_CLOSED").otherwise("CLOSED").alias("status"))
    return D.open_positions(o).select("position_id", "status")


def q_shadow(spark, d):
    """Gates of changed against base settings, from two years of each supplier's line items."""
    li = table(spark, d, "lineitem")
    side = lambda n, c, test: F.avg(F.when(test, F.col(c))).alias(n)
    base, new = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    pairs = li.groupBy("l_suppkey").agg(
        (F.avg(F.when(base, F.col("l_discount"))) * 20).alias("base_sharpe"), (F.avg(F.when(new, F.col("l_discount"))) * 20).alias("shadow_sharpe"), (F.avg(F.when(new, F.col("l_tax"))) * 5).alias("shadow_pbo"),
        (1 - F.avg(F.when(new, F.col("l_tax"))) * 1.2).alias("shadow_dsr"), side("base_ruin", "l_tax", base), side("shadow_ruin", "l_tax", new), (F.max(F.when(new, F.col("l_discount"))) - 0.01).alias("worst_regime_drop"),
    )
    return shown(V.shadow_verdict(pairs).select("l_suppkey", F.array_join("fail_reasons", ",").alias("fail_reasons"), "passed"))


QUERIES = {
    "desk_report_faults": q_faults, "desk_report_signal": q_report_signal, "desk_review": q_review, "desk_commit": q_commit, "desk_analysis": q_analysis, "desk_opened": q_opened, "desk_stale": q_stale,
    "feat_change_since": q_change, "feat_pack": q_pack, "experiments_filter_stats": q_filter_stats, "experiments_filter_alpha": q_filter_alpha, "calendar_upcoming": q_upcoming, "bars_fresh": q_fresh,
    "bars_keep_first": q_first, "signal_predicates": q_predicates, "positions_open": q_open_positions, "verdict_shadow": q_shadow,
}

_ENTRY = "(low + high) / 2"
ORACLE = {
    "desk_report_faults": f"""with {_REPORTS} select c_custkey, concat_ws(',', case when dq = 'OLD' then 'data_quality' end, case when direction = 'up' then 'direction' end, case when not regime then 'regime' end, case when high is null then 'zone_incomplete' end,
  case when low <= 0 or high <= 0 then 'zone_not_positive' end, case when low > high then 'zone_order' end) as faults from rp""",
    "desk_report_signal": f"""with {_REPORTS} select c_custkey, {r(_ENTRY, 'entry_price')}, {r(f'{_ENTRY} - {_ENTRY} * 50 / 10000', 'stop_loss')}, {r('tp', 'tp1')}, {r(f'{_ENTRY} + {_ENTRY} * 70 / 10000', 'tp2')}, {r(f'{_ENTRY} + {_ENTRY} * 120 / 10000', 'tp3')}, {r(f'100 / ({_ENTRY} * 50 / 10000)', 'position_size')},
  case when direction = 'short' then 'short' else 'long' end as side, {r('least(conf, 0.9)', 'signal_confidence')} from rp where decision = 'TAKE' and dq = 'FRESH' and direction <> 'up' and regime and low > 0 and high > 0 and low <= high and trapped and kill and conf <= 0.9""",
    "desk_review": f"with {_REVIEW} select id, decision, {r('risk_pct')}, {r('size')}, coaching from q5",
    "desk_commit": f"with {_REVIEW} select id::varchar as trade_id, setup, {r('risk_pct')}, {r('size')}, '{DAY}' as opened_at, 'OPEN' as status from q5 where decision <> 'BLOCK'",
    "desk_analysis": f"""with {_REVIEW} select id, greatest(1, least(5, round_even(id % 11 / 10.0 * 5, 0)))::bigint as conviction, case when setup = 'none' then 'NO_SETUP' when decision = 'BLOCK' then 'BLOCKED' else 'SENT' end as outcome from q5""",
    "desk_opened": f"with {_REVIEW} select 'p-' || id as position_id, 'ENTRY' as event, direction, {r('entry', 'price')}, {r('size')}, 'OPEN' as status from q5 where decision <> 'BLOCK'",
    "desk_stale": f"select event_type as symbol, (epoch(timestamp '{DAY}') - floor(epoch(max(ts))))::bigint as age from events where ts < timestamp '2024-01-10' group by 1",
    "feat_change_since": f"""with {bars_sql()} select symbol, {NOW}, {r("volume - last(volume) over (partition by symbol order by ts range between interval 4 hours preceding and interval 2 hours preceding)", 'delta')} from bars""",
    "feat_pack": f"""with {bars_sql()}, fb as (select symbol, ts, close, sum(sign(close - open) * volume) over (partition by symbol order by ts rows unbounded preceding) as cvd,
    sum(sign(close - open) * volume) over (partition by symbol order by ts rows between 9 preceding and current row) as recent from bars), {_wide('wa', 14400)}, {_wide('wb', 43200)}
  select fb.symbol, strftime(fb.ts, '%Y-%m-%d %H:%M:%S') as ts, {_flow_columns('fb')}, {_flow_columns('wa', 'h4_')}, {_flow_columns('wb', 'h12_')}
  from fb asof left join wa on wa.symbol = fb.symbol and fb.ts >= wa.ts asof left join wb on wb.symbol = fb.symbol and fb.ts >= wb.ts""",
    "experiments_filter_stats": f"""select year(l_shipdate) as year, count(*) as n_decisions, sum((l_returnflag <> 'R')::bigint)::bigint as approved, sum((l_returnflag = 'R')::bigint)::bigint as filtered_out, sum((l_linestatus = 'O')::bigint)::bigint as cache_hits,
  sum((l_linestatus <> 'O')::bigint)::bigint as cache_misses, {r("avg((l_linestatus = 'O')::int)", 'cache_hit_rate')} from lineitem group by 1""",
    "experiments_filter_alpha": f"""with a as (select l_suppkey, avg(case when l_linestatus = 'O' then l_discount end) - avg(case when l_linestatus <> 'O' then l_discount end) as alpha, sum(case when l_linestatus = 'O' then l_tax end) as cost from lineitem group by 1)
  select l_suppkey, {r('alpha', 'filter_alpha')}, {r('alpha * 10000 - cost', 'net_alpha')} from a""",
    "calendar_upcoming": f"select 'E' || event_id as name, strftime(ts, '%Y-%m-%d %H:%M:%S') as event_ts from events where event_type = 'error' and ts >= timestamp '{DAY}' and ts <= timestamp '{DAY}' + interval 24 hours",
    "bars_fresh": f"select event_type as symbol, (epoch(timestamp '{DAY}') - epoch(max(ts)) <= 1296000)::int as fresh from events where event_id % 7 < 5 group by 1",
    "bars_keep_first": "select event_type as symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as ts, round(first(value order by ts, event_id), 6) as price from events group by event_type, date_trunc('hour', ts)",
    "signal_predicates": f"""select p_partkey, {r('case when p_retailprice + p_size - 25 = 0 then 0 else abs(25 - p_size) / (p_retailprice + p_size - 25) * 10000 end', 'bp')}, {r('p_size / 10000.0 * p_retailprice', 'distance')},
  {r('case when p_size > 0 then 60.0 / p_size else 0 end', 'rr')}, (abs(p_size - 25) / p_retailprice * 10000 > 80)::int as too_far from part""",
    "positions_open": "select o_orderkey as position_id, case when o_orderstatus = 'O' then 'OPEN' else 'PARTIALLY_CLOSED' end as status from orders where o_orderstatus in ('O', 'P')",
    "verdict_shadow": """with p as (select l_suppkey, avg(case when l_linestatus = 'F' then l_discount end) * 20 as bs, avg(case when l_linestatus = 'O' then l_discount end) * 20 as ss, avg(case when l_linestatus = 'O' then l_tax end) as nt,
    avg(case when l_linestatus = 'F' then l_tax end) as bt, max(case when l_linestatus = 'O' then l_discount end) - 0.01 as dr from lineitem group by 1),
  f as (select l_suppkey, concat_ws(',', case when ss - bs < 0.1 then 'sharpe_delta' end, case when nt * 5 > 0.2 then 'pbo' end, case when 1 - nt * 1.2 < 0.95 then 'dsr' end, case when nt > bt then 'ruin_prob' end, case when dr > 0.1 then 'regime' end) as fail_reasons from p)
  select l_suppkey, fail_reasons, (fail_reasons = '')::int as passed from f""",
}
