"""DuckDB SQL for queries that fold over bars: recursive CTEs that go from bar to bar."""

from __future__ import annotations

from .market import _GROUPS, _MOM, _SESSION, _STRUCT
from .shape import KEY, NOW, R, ROWS, bars_sql, r

_MOM_SIDE = """case when close > ma then 'long' else 'short' end as direction, case when close > ma then close - room else close + room end as stop,
  case when close > ma then close + room else close - room end as target"""
#: Orders of the momentum strategy on every bar.
_MOM_ORDERS = f"""{_MOM}, mo as (select symbol, ts, {_MOM_SIDE} from m1 where (close > ma and mom >= 100 and close > ph) or (close < ma and mom <= -100 and close < pl)),
om as (select bars.*, direction, stop, target from bars left join mo on mo.symbol = bars.symbol and mo.ts = bars.ts)"""
#: Orders of the toy strategy.
_TOY_ORDERS = f"""ta as (select *, lag(close) {KEY} as p, lag(close, 2) {KEY} as q, close * 1.005 as st from bars),
ot as (select symbol, ts, open, high, low, close, volume, case when close < p and p < q and st > close then 'short' end as direction, st as stop, close - 2 * (st - close) as target from ta)"""


def fold_sql(orders: str) -> str:
    """z: a row for each point of k's equity (i, ts, equity) and the trade that ended there (reason null: none), from the
    rows k, ts, OHLC, direction, stop, target, news of `orders`. Costs and latency are the defaults, bars are hours."""
    late = 1.5 / 3600
    enter = f"(b.open + case when z.wd = 'long' then (b.high - b.open) * {late} else (b.low - b.open) * {late} end) * (1 + case when z.wd = 'long' then 1 else -1 end * b.side / 1e4)"
    now = lambda waited, kept: f"case when z.wd is not null then {waited} else {kept} end"
    held = lambda c: f"case when reason is null then {c} end as {c}"
    return f"""sb as (select *, row_number() over (partition by k order by ts) as i, count(*) over (partition by k) as n, case when news then 20.5 else 4.0 end + 5.5 as side from {orders}),
z as (select k, 0::bigint as i, min(ts) as ts, null::varchar as hd, null::double as entry, null::timestamp as entered, null::double as hs, null::double as ht, null::double as risk,
  null::varchar as wd, null::double as ws, null::double as wt, 1.0::double as equity, null::varchar as reason, null::varchar as xd, null::double as xe, null::timestamp as xt, null::double as price, null::double as pnl, null::double as rm, null::double as hours
  from sb group by k
 union all
 select k, i, ts, {held('hd')}, {held('entry')}, {held('entered')}, {held('hs')}, {held('ht')}, {held('risk')}, case when reason is not null or hd is null then direction end, stop, target,
  equity * (1 + coalesce(pnl, 0)), reason, hd, entry, entered, price, pnl, rm, hours
 from (select *, sg * (price * (1 - sg * side / 1e4) - entry) / entry - sg * 1.5 * greatest(hours, 0.0) / 8 / 1e4 as pnl, case when reason is not null then case when risk > 0 then sg * (price - entry) / risk else 0.0 end end as rm
 from (select *, case reason when 'SL' then hs when 'TP' then ht when 'EOD' then close end as price, case when reason is not null then (epoch(ts) - epoch(entered)) / 3600.0 end as hours
 from (select *, case when hd = 'long' then 1 else -1 end as sg, case when hd is null then null when (hd = 'long' and low <= hs) or (hd = 'short' and high >= hs) then 'SL'
   when (hd = 'long' and high >= ht) or (hd = 'short' and low <= ht) then 'TP' when i = n then 'EOD' end as reason
 from (select b.k, b.i, b.n, b.ts, b.high, b.low, b.close, b.direction, b.stop, b.target, b.side, z.equity, coalesce(z.wd, z.hd) as hd, {now(enter, 'z.entry')} as entry, {now('b.ts', 'z.entered')} as entered,
   {now('z.ws', 'z.hs')} as hs, {now('z.wt', 'z.ht')} as ht, {now(f"greatest(case when z.wd = 'long' then 1 else -1 end * ({enter} - z.ws), {enter} * 5e-4)", 'z.risk')} as risk
   from z join sb b on b.k = z.k and b.i = z.i + 1)))))"""


def curve_sql(points: str, keys: str, order: str = "i") -> str:
    """cm: statistics of equity curves, and of the trades that end on their points."""
    w = f"partition by {keys} order by {order}"
    return f"""cr as (select *, equity / lag(equity) over ({w}) - 1 as ret, equity / max(equity) over ({w} rows unbounded preceding) - 1 as dd from {points}),
cm as (select {keys}, coalesce(case when stddev_samp(ret) > 0 then avg(ret) / stddev_samp(ret) * sqrt(8760) end, 0) as sharpe, avg(ret) as mean_ret, stddev_samp(ret) as sd_ret, count(ret) as n_ret, min(dd) as max_drawdown,
  coalesce(case when stddev_samp(case when ret < 0 then ret end) > 0 then avg(ret) / stddev_samp(case when ret < 0 then ret end) * sqrt(8760) end, 0) as sortino,
  case when stddev_samp(ret) > 0 then skewness(ret) end as skew, case when stddev_samp(ret) > 0 then kurtosis(ret) + 3 end as kurt, last(equity order by {order}) / first(equity order by {order}) - 1 as total_return,
  count(reason) as n_trades, avg((pnl > 0)::int) as win_rate, coalesce(sum(case when pnl > 0 then pnl end), 0) as won, sum(case when pnl < 0 then pnl end) as lost, avg(rm) as mean_r, coalesce(stddev_samp(rm), 0) as std_r, avg(hours) as mean_hold_hours
  from cr group by {keys})"""


_NOON = "sn as (select symbol as k, *, hour(ts) = 12 as news from om)"
_PLAIN = "sp as (select symbol as k, *, false as news from om)"
_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_FOLDS = """cn as (select symbol, count(*) as n from bars group by symbol),
fz as (select symbol, n, case when n < 300 then greatest(1, floor(n * 0.7::double)) else 200 end::bigint as a, n < 300 as short from cn), fy as (select *, case when short then greatest(1, n - a) else 100 end::bigint as o from fz),
fx as (select *, case when short then o else 100 end as hop from fy), ff as (select symbol, a, o, hop, unnest(range(0, n - a - o + 1, hop)) as pos from fx),
fd as (select symbol, (pos / hop)::bigint as step, 'is' as part, pos as lo, pos + a - 1 as hi from ff union all select symbol, (pos / hop)::bigint, 'oos', pos + a, pos + a + o - 1 from ff)"""

#: Accumulation (every level of it is extreme here) and what the spike pattern sees of each bar; then its fold, with bars
#: passed over after a confirmed bounce. Spans of five bars, 80 bp at least for a spike, less than so many bp for calm (#).
_SPIKES = f"""{bars_sql()}, a0 as (select *, case when high = low then 0.0 else (2 * close - high - low) / (high - low) end as clv, row_number() {KEY} as i, count(*) {R(19)} as c20, avg(volume) {R(19)} as m20, avg(close) {R(19)} as a20 from bars),
a1 as (select *, round(sum(clv * volume) {ROWS}, 6) as ad, case when c20 >= 20 then a20 end as ma, min(low) {R(4)} as lo, max(high) {R(4)} as hi from a0),
a2 as (select *, lag(ad) {KEY} as p, lag(ad, 2) {KEY} as q, lag(close) {KEY} as pc, lag(ma) {KEY} as pm from a1),
a3 as (select *, i >= 5 and case when lo = 0 then 0.0 else (hi - lo) / lo * 10000 end >= 80 as hit, i >= 5 and case when lo = 0 then 0.0 else (hi - lo) / lo * 10000 end < # as quiet,
  coalesce(p < q and ad > p and close > ma, false) as up, coalesce(i >= 4 and q < p and p < ad, false) as improving from a2),
a4 as (select *, coalesce(ma is not null and (ad >= 0 or improving) and close >= ma * 0.995, false) and not coalesce(close < ma and pc < ma and not ma > pm, false) as good from a3)"""


def spike_sql(good: str, pause: int, quiet: str) -> str:
    """z: a row for each bar with spike, price, calm, bounce and sig."""
    return f"""{_SPIKES.replace("#", quiet)}, z as (select symbol, 0::bigint as i, null::timestamp as ts, null::double as kept, 0::bigint as since, null::timestamp as wakes, false as spike, null::double as price, false as calm, false as bounce, false as sig from a4 group by symbol
 union all
 select symbol, i, ts, case when not sig then price end, held_at, case when sig then ts + interval '{pause} seconds' else wakes end, spike, price, calm, bounce, sig
 from (select *, bounce and good as sig from (select *, calm and up as bounce from (select *, awake and price is not null and quiet as calm
 from (select *, case when i - held_at <= 30 or not awake then locked end as price from (select *, case when spike then lo else kept end as locked, case when spike then i else since end as held_at
 from (select *, awake and hit and kept is distinct from lo as spike from (select b.symbol, b.i, b.ts, b.lo, b.hit, b.quiet, b.up, {good} as good, z.kept, z.since, z.wakes, z.wakes is null or b.ts >= z.wakes as awake
   from z join a4 b on b.symbol = z.symbol and b.i = z.i + 1))))))))"""


ORACLE = {
    "pattern_spikes": f"with recursive {spike_sql('false', 0, '1e5')} select symbol, {NOW}, spike::int as spike, {r('price', 'spike_price')}, calm::int as consolidating, bounce::int as bouncing from z where i > 0",
    "signal_rules": f"""with recursive {spike_sql('b.good', 21600, '1e9')}, e as (select a4.*, z.price, greatest(a4.close, z.price * 1.001) as entry from z join a4 using (symbol, i) where z.sig)
  select symbol, {NOW}, {r('price', 'spike_price')}, {r('entry')}, {r('entry - entry * 50 / 10000', 'stop_loss')}, {r('entry + entry * 35 / 10000', 'tp1')}, {r('entry + entry * 70 / 10000', 'tp2')}, {r('entry + entry * 120 / 10000', 'tp3')},
  {r('100.0 / (entry * 50 / 10000)', 'position_size')}, {r('least(0.95, 0.6::double + case when c20 >= 20 and volume > 2 * m20 then 0.1 else 0 end + case when improving then 0.1 else 0 end + case when ma > pm then 0.05 else 0 end)', 'confidence')} from e where entry <> 0""",
    "feat_live_flow": f"""with {bars_sql()}, n as (select symbol, arg_max(struct_pack(e := event_id, p := price, s := size), (t, event_id)) as v from ticks group by symbol),
  m as (select symbol, v.p as p, v.s as s, case when v.e % 2 = 0 then v.s else -v.s end as c from n)
  select symbol, {r('p', 'cvd_full')}, {r('c', 'cvd_recent')}, case when c > 0 then 'buy' when c < 0 then 'sell' else 'neutral' end as aggressor_bias, {r('s / 100', 'ob_imbalance')}, null::double as ob_spread, 1::bigint as n_sweeps, 0::bigint as n_prints, 'live' as source from m""",
    "sim_trades": f"""with recursive {_MOM_ORDERS}, {_NOON}, {fold_sql('sn')}
  select k as symbol, {_TIME.format('xt')} as entry_time, {_TIME.format('ts')} as exit_time, xd as direction, {r('xe', 'entry_price')}, {r('price', 'exit_price')}, 1.0::double as size, {r('pnl')}, {r('rm', 'r_multiple')},
  {r('hours', 'hold_hours')}, reason as exit_reason from z where reason is not null""",
    "sim_equity": f"with recursive {_MOM_ORDERS}, {_PLAIN}, {fold_sql('sp')} select k as symbol, i as seq, {NOW}, {r('equity')} from z",
    "metrics_trades": f"""with recursive {_MOM_ORDERS}, {_PLAIN}, {fold_sql('sp')}, {curve_sql('z', 'k')}
  select k as symbol, {r('sharpe')}, {r('sortino')}, {r('max_drawdown')}, {r('mean_ret')}, {r('sd_ret')}, n_ret, {r('skew')}, {r('kurt')}, {r('total_return')}, n_trades, {r('win_rate')},
  {r("case when lost < 0 then won / abs(lost) when won > 0 then 'infinity'::double else 0 end", 'profit_factor')}, {r('mean_r')}, {r('std_r')}, {r('mean_hold_hours')},
  {r('case when max_drawdown = 0 then 0 else mean_ret * 252 / abs(max_drawdown) end', 'calmar')} from cm""",
    "cv_walk_forward": f"""with recursive {_MOM_ORDERS}, {_FOLDS}, oi as (select *, row_number() {KEY} - 1 as bar from om),
  sw as (select oi.symbol || '|' || step || '|' || part as k, oi.*, step, part, false as news from oi join fd on fd.symbol = oi.symbol and bar between lo and hi),
  {fold_sql('sw')}, {curve_sql('z', 'k')},
  p as (select split_part(k, '|', 1) as symbol, split_part(k, '|', 2)::bigint as step, split_part(k, '|', 3) as part, sharpe, total_return from cm),
  q as (select symbol, step, max(case when part = 'is' then total_return end) as a, max(case when part = 'oos' then total_return end) as b, max(case when part = 'is' then sharpe end) as sa, max(case when part = 'oos' then sharpe end) as sb from p group by 1, 2)
  select symbol, step, {r('a', 'is_return')}, {r('sa', 'is_sharpe')}, {r('b', 'oos_return')}, {r('sb', 'oos_sharpe')}, {r('case when a > 0 and b > 0 then b / a else 0 end', 'wfe')} from q""",
    "cv_combinatorial": f"""with recursive {_MOM_ORDERS}, {_TOY_ORDERS},
  two as (select 'momentum' as strategy, symbol, ts, open, high, low, close, direction, stop, target from om union all select 'toy', symbol, ts, open, high, low, close, direction, stop, target from ot),
  nb as (select *, row_number() over (partition by strategy, symbol order by ts) - 1 as bar, count(*) over (partition by strategy, symbol) as bars_n from two),
  sg as (select strategy || '|' || symbol || '|' || g as k, nb.*, false as news from nb, range(6) t(g) where bar between floor(g * bars_n / 6.0) and floor((g + 1) * bars_n / 6.0) - 1),
  {fold_sql('sg')}, pt as (select split_part(k, '|', 1) as strategy, split_part(k, '|', 2) as symbol, split_part(k, '|', 3)::bigint as grp, i, equity, reason, pnl, rm, hours from z),
  cb as (select row_number() over (order by a, b) - 1 as combo, a, b from range(6) x(a), range(6) y(b) where a < b),
  pk as (select combo, g as grp, g in (a, b) as test from cb, range(6) t(g)),
  gr as (select strategy, symbol, grp, first(equity order by i) as f, last(equity order by i) / first(equity order by i) as growth from pt group by 1, 2, 3),
  pr as (select *, coalesce(product(growth) over (partition by strategy, symbol, combo, test order by grp rows between unbounded preceding and 1 preceding), 1.0) as before from gr join pk using (grp)),
  path as (select strategy, symbol, combo, test, row_number() over (partition by strategy, symbol, combo, test order by grp, i) as i, equity / f * before as equity, reason, pnl, rm, hours from pt join pr using (strategy, symbol, grp)),
  {curve_sql('path', 'strategy, symbol, combo, test')}
  select strategy, symbol, combo, {r('max(case when not test then sharpe end)', 'is_sharpe')}, {r('max(case when test then sharpe end)', 'oos_sharpe')}, max(case when test then n_trades end) as oos_trades from cm group by 1, 2, 3""",
    "gate_cycle": f"""with recursive {_STRUCT}, gp as (select symbol, ts, row_number() {KEY} as i, coalesce(volume > 2 * avg(volume) {R(19)}, false) as spike, case when close > swing_high then 'bull' when close < swing_low then 'bear' end as bos,
    {_SESSION} as session, hour(ts) = 12 as killed from s1),
  gz as (select symbol, 0::bigint as i, null::timestamp as ts, null::timestamp as last, null::varchar as seen, false as fired, ''::varchar as reason from gp group by symbol
  union all
  select symbol, i, ts, case when fired then ts else last end, case when awake then session else seen end, fired,
    case when killed then 'news_kill:NOON' when not awake then 'cooldown' when fired then concat_ws(',', case when spike then 'volume_spike' end, 'bos_' || bos, opened) else 'no_trigger' end
  from (select *, awake and (spike or bos is not null or opened is not null) as fired from (select b.*, z.last, z.seen, not b.killed and (z.last is null or epoch(b.ts) - epoch(z.last) >= 7200) as awake,
    case when b.session in ('london', 'ny', 'ny-overlap') and b.session is distinct from z.seen then 'session_open_' || b.session end as opened from gz z join gp b on b.symbol = z.symbol and b.i = z.i + 1)))
  select symbol, {NOW}, fired::int as fired, reason from gz where i > 0""",
    "positions_exits": f"""with t as (select event_type as symbol, ts, event_id, value as price from events), f as (select symbol, first(price order by ts, event_id) as entry, case when symbol < 'l' then 1.0 else -1.0 end as sg from t group by symbol),
  lv as (select *, unnest([0, 1, 2, 3]) as kind from f), lx as (select *, entry + sg * case kind when 0 then -60 when 1 then 5 when 2 then 15 else 40 end as level from lv),
  hit as (select lx.symbol, kind, any_value(level) as level, any_value(entry) as entry, any_value(sg) as sg, min(ts) as ts, first(price order by ts, event_id) as price
    from lx join t on t.symbol = lx.symbol and case when kind = 0 then lx.sg * (level - price) >= 0 else lx.sg * (price - level) >= 0 end group by 1, 2),
  x as (select hit.*, s.ts as stopped, d.ts as done from hit left join hit s on s.symbol = hit.symbol and s.kind = 0 left join hit d on d.symbol = hit.symbol and d.kind = 3)
  select 'p-' || symbol as position_id, {NOW}, case kind when 0 then 'SL' else 'TP' || kind end as event, {r('case when kind = 0 then price else level end', 'price')}, case when kind = 0 then 4.0 else 1.0 end::double as size,
  {r('sg * (case when kind = 0 then price else level end - entry) * case when kind = 0 then 4 else 1 end', 'pnl')}, case when kind in (0, 3) then 'CLOSED' else 'PARTIALLY_CLOSED' end as status
  from x where case when kind = 0 then done is null or ts <= done else stopped is null or ts < stopped end""",
}
