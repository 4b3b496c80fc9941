"""Queries that write the given tables to stores and read them again, search notes, and put lenses together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bars as B
from ..operators import desk as K
from ..operators import features as X
from ..operators import signals as G
from ..operators import validation as V
from ..sources import candles as C
from ..sources import stores as D
from ..sources.scan import table, ticks
from ..sources.scratch import fresh_path, removed, saved, shared_dir
from ..streaming import live
from . import folds, market
from .feeds import _CHAIN
from .records import trades
from .shape import bars_sql, r, shown


def q_store(spark, d):
    """Bars of the first 20 days, then those from the 16th on with another volume appended: the newest row of each bar, in a range of time."""
    root = fresh_path(spark, "store")
    store = D.DatasetStore(spark, root)
    b = market.candles(spark, d)
    day = F.dayofmonth("ts")
    store.write("candles/hour", b.where(day <= 20))
    store.write("candles/hour", b.where(day > 15).withColumn("volume", F.col("volume") + 0.5), "append", ["symbol", "ts"])
    if store.names() != ["candles/hour"]:
        raise ValueError(f"unexpected datasets {store.names()}")
    kept = store.cached(lambda: store.read("candles/hour", "2024-01-10", "2024-01-25 12:00:00"), name="range")
    out, _ = saved(store.cached(lambda: 1 / 0, name="range").select(*kept.columns), "stored")  # the second time nothing is built
    removed(spark, root)
    return shown(out.select("symbol", "ts", "open", "high", "low", "close", "volume"))


def q_journal_lines(spark, d):
    """Trades appended to a journal of JSON lines in two halves and read from a day on."""
    path = fresh_path(spark, "journal")
    t = trades(spark, d).select("trade_id", "setup", "status", "r_multiple", "ts", "l_linenumber")
    for half in (t.where("l_linenumber <= 3"), t.where("l_linenumber > 3")):
        D.append_lines(half.drop("l_linenumber"), path)
    back, _ = saved(D.read_journal(spark, path, "trade_id string, setup string, status string, r_multiple double, ts timestamp").where("ts >= '1995-06-01'"), "journal-read")
    removed(spark, path)
    return shown(back)


def q_csv(spark, d):
    """Bars exported as tab-separated files of a broker's form and read again."""
    path = fresh_path(spark, "export")
    b = market.candles(spark, d).where("symbol = 'view'")
    out = b.select(F.date_format("ts", "yyyy.MM.dd").alias("<DATE>"), F.date_format("ts", "HH:mm:ss").alias("<TIME>"), *(F.col(c).alias(f"<{c.upper()}>") for c in ("open", "high", "low", "close")), F.col("volume").alias("<TICKVOL>"))
    out.write.csv(path, header=True, sep="\t")
    back, _ = saved(C.read_csv(spark, path, "VIEW"), "export-read")
    removed(spark, path)
    return shown(back)


def q_notes(spark, d):
    """The first three documents, by id, that hold one of two words, whatever its case."""
    notes = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.col("text").alias("body"))
    got = D.relevant_notes(notes, ["DIE ", "Los "], 3, 200)
    return got.select("name", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), F.length("body").cast("long").alias("chars"))


def q_video_ids(spark, d):
    """Ids from addresses of several forms, built from pages, each once."""
    k = F.col("page_id")
    code = F.substring(F.md5((k % 40).cast("string")), 1, 11)
    line = (
        F.when(k % 7 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), code, F.lit("&t=3"))).when(k % 7 == 1, F.concat(F.lit(" https://youtu.be/"), code)).when(k % 7 == 2, code)
        .when(k % 7 == 3, F.concat(F.lit("https://youtube.com/shorts/"), code)).when(k % 7 == 4, F.concat(F.lit("# "), code)).otherwise(F.col("url"))
    )
    return shown(T.first_ids(table(spark, d, "pages").select(k, line.alias("line")), "line", "page_id"))


def q_live_fallback(spark, d):
    """Live values while they are fresh and not 0, else the candles'."""
    e = ticks(spark, d).select("event_id", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("price")).alias("live"), F.col("size").alias("candle"), (F.col("event_id") * 37 % 9000).alias("age"))
    return shown(e.select("event_id", live.prefer_live("live", "candle", "age").alias("value")))


def q_unique(spark, d):
    """Ticks that come twice in a stream, once."""
    t = live.tick_stream(spark, d)
    got = live.drained(live.stream_unique(t.unionByName(live.tick_stream(spark, d))), shared_dir(spark))
    return shown(got.select("symbol", "event_id", "price"))


def q_hypothesis_signals(spark, d):
    """Signals of the strategy that a hypothesis names."""
    return shown(G.signals_of(market.candles(spark, d), {"strategy": "momentum"}).where("direction is not null").select(*market.SIGNAL))


def q_lens_pack(spark, d):
    """Hourly price, flow, structure, context and intent beside the same lenses of closed days."""
    reports = market.q_intent(spark, d).withColumn("ts", F.to_timestamp("day")).drop("day")
    pack = K.lens_pack(market.candles(spark, d), {"d1": ("1 day", 86400)}, reports)
    flags = {c: F.col(c).cast("double") for c in ("in_premium", "d1_in_premium")}
    return shown(pack.withColumns(flags))


def q_two_arms(spark, d):
    """Momentum with and without a filter whose answers follow the hour, cached for five bars. (Total returns over ticks that jump tenfold have too many digits to be shown.)"""
    s = market._signals(spark, d, "momentum")
    hour = F.hour("ts")
    answers = s.where("direction is not null").select(
        F.concat_ws("|", "symbol", F.unix_seconds("ts").cast("string")).alias("id"), F.when(hour % 3 == 0, "SKIP").otherwise("TAKE").alias("decision"),
        F.when(hour % 11 == 5, "timeout").alias("error"), F.when(hour % 7 == 6, "rr").alias("rejection"),
    )
    return shown(K.two_arms(s, answers, 5).drop(*(f"{p}_total_return" for p in ("base", "other", "delta"))))


def q_regime_runs(spark, d):
    """Momentum as the base and the toy strategy as the changed setting, over each type of event as a regime's archive."""
    keep = [*market.SIGNAL, "open", "high", "low", "close"]
    base, shadow = (market._signals(spark, d, n).select(*keep) for n in ("momentum", "two_lower_closes_short"))
    return shown(V.regime_runs(base, shadow))


def _lenses(unit: str) -> str:
    of = lambda name: market.ORACLE[name].replace("date_trunc('hour'", f"date_trunc('{unit}'")
    return f"""(select c.*, {r('b.close', 'close')}, cvd_full, aggressor_bias, swing_high, swing_low, last_bos, in_premium from ({of('feat_context')}) c
  join ({of('feat_flow')}) f on c.symbol = f.symbol and c.ts = f.ts join ({of('feat_structure')}) s on c.symbol = s.symbol and c.ts = s.ts
  join (with {bars_sql(unit)} select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, close from bars) b on c.symbol = b.symbol and c.ts = b.ts)"""


_COLUMNS = ("close", "cvd_full", "aggressor_bias", "swing_high", "swing_low", "last_bos", "in_premium", "atr", "atr_percentile")

QUERIES = {
    "store_dataset": q_store, "journal_lines": q_journal_lines, "source_csv": q_csv, "notes_relevant": q_notes, "text_video_ids": q_video_ids, "feat_live_fallback": q_live_fallback,
    "stream_unique": q_unique, "signal_hypothesis": q_hypothesis_signals, "feat_lens_pack": q_lens_pack, "experiments_two_arms": q_two_arms, "verdict_regimes": q_regime_runs,
}

def _accumulated(seconds: int) -> str:
    """Accumulation features with closes of bars of so many seconds."""
    first = f"to_timestamp(floor(epoch(t) / {seconds}) * {seconds})::timestamp"
    of = lambda sql: sql.replace("date_trunc('hour', t)", first)
    return f"""(select a.*, strptime(a.ts, '%Y-%m-%d %H:%M:%S') as at_ts, close from ({of(market.ORACLE['feat_accumulation'])}) a
  join (with {of(bars_sql())} select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, close from bars) b on a.symbol = b.symbol and a.ts = b.ts)"""


_ARM = "sharpe, n_trades, win_rate, mean_r"

ORACLE = {
    "verdict_regimes": f"""with recursive {folds._MOM_ORDERS}, {folds._TOY_ORDERS},
sa as (select 'base|' || symbol as k, ts, open, high, low, close, direction, stop, target, false as news from om
 union all select 'shadow|' || symbol, ts, open, high, low, close, direction, stop, target, false from ot),
{folds.fold_sql('sa')}, {folds.curve_sql('z', 'k')},
x as (select split_part(k, '|', 1) as arm, split_part(k, '|', 2) as symbol, sharpe from cm)
select a.symbol, {r('a.sharpe', 'base_sharpe')}, {r('b.sharpe', 'shadow_sharpe')}, {r('a.sharpe - b.sharpe', 'drop')}, (a.sharpe - b.sharpe > {V.SHARPE_GAIN_MIN})::bigint as failed
from x a join x b on a.symbol = b.symbol where a.arm = 'base' and b.arm = 'shadow'""",
    "signal_timeframes": f"""with b as (select *, at_ts as t0 from {_accumulated(3600)}),
m as (select symbol, at_ts + interval 2 hours as known, close, ma, ad, ad_improving from {_accumulated(7200)}),
h as (select symbol, at_ts + interval 4 hours as known, close, lag(close) over (partition by symbol order by at_ts) as prev, ma, ma_rising from {_accumulated(14400)}),
j as (select b.symbol, b.ts, b.volume_spike, b.ad_improving, b.ma_rising, m.close as mc, m.ma as mm, m.ad as ma_ad, m.ad_improving as mi, h.close as hc, h.prev as hp, h.ma as hm, h.ma_rising as hr
  from b asof left join m on b.symbol = m.symbol and b.t0 >= m.known asof left join h on b.symbol = h.symbol and b.t0 >= h.known)
select symbol, ts, (coalesce(mm is not null and ma_ad is not null and (ma_ad >= 0 or mi::int = 1) and mc >= mm * 0.995, false)
   and not coalesce(hc < hm and hp < hm and hr::double = 0, false))::bigint as confirmed,
 {r("least(0.95, 0.6 + case when volume_spike::int = 1 then 0.1 else 0 end + case when ad_improving::int = 1 then 0.1 else 0 end + case when ma_rising::double = 1 then 0.05 else 0 end)::double", 'confidence')} from j""",
    "experiments_two_arms": f"""with recursive {folds._MOM_ORDERS}, pb as (select *, row_number() over (partition by symbol order by ts) as m from om),
pp as (select symbol || '|' || direction as setup, symbol, ts, m, hour(ts) as h from pb where direction is not null),
{_CHAIN.format(key="setup", reach=6, of="pp")},
en as (select pp.*, c.m as entry from pp asof join ch c on pp.setup = c.setup and pp.m >= c.m),
de as (select en.symbol, en.ts, a.h % 11 <> 5 and a.h % 3 <> 0 and a.h % 7 <> 6 as passed from en join pp a on a.setup = en.setup and a.m = en.entry),
sa as (select 'base|' || symbol as k, ts, open, high, low, close, direction, stop, target, false as news from om
 union all select 'filtered|' || om.symbol, om.ts, open, high, low, close, case when passed then direction end, stop, target, false from om left join de on om.symbol = de.symbol and om.ts = de.ts),
{folds.fold_sql('sa')}, {folds.curve_sql('z', 'k')},
x as (select split_part(k, '|', 1) as arm, split_part(k, '|', 2) as symbol, {_ARM} from cm)
select a.symbol, {", ".join(f"{r(f'{t}.{c}', f'{n}_{c}') if c != 'n_trades' else f'{t}.{c} as {n}_{c}'}" for t, n in (("a", "base"), ("b", "other")) for c in _ARM.split(", "))},
 {", ".join(r(f'b.{c} - a.{c}', f'delta_{c}') if c != 'n_trades' else f'b.{c} - a.{c} as delta_{c}' for c in _ARM.split(", "))}
from x a join x b on a.symbol = b.symbol where a.arm = 'base' and b.arm = 'filtered'""",
    "store_dataset": f"""with {bars_sql()} select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('volume + case when day(ts) > 15 then 0.5 else 0 end', 'volume')}
from bars where ts >= '2024-01-10' and ts <= '2024-01-25 12:00:00'""",
    "journal_lines": f"""select l_orderkey || '-' || l_linenumber as trade_id, l_returnflag || l_linestatus as setup, case when l_linenumber <= 6 then 'CLOSED' else 'OPEN' end as status,
 {r('round((l_discount - l_tax) * 20, 4)', 'r_multiple')}, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as ts from lineitem where l_shipdate >= '1995-06-01'""",
    "source_csv": f"""with {bars_sql()} select 'VIEW' as symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('volume')}, '5m' as timeframe from bars where symbol = 'view'""",
    "notes_relevant": """select lpad(doc_id::varchar, 12, '0') as name, sha256(substr(text, 1, 200)) as sha, length(substr(text, 1, 200))::bigint as chars from documents
where contains(lower(text), 'die ') or contains(lower(text), 'los ') order by name limit 3""",
    "text_video_ids": """select substr(md5((page_id % 40)::varchar), 1, 11) as video_id, min(page_id) as first_at, count(*) as n from pages where page_id % 7 < 4 group by 1""",
    "feat_live_fallback": f"""select event_id, {r("case when event_id * 37 % 9000 <= 5000 and event_id % 4 <> 0 and value <> 0 then value else cast(json_extract_string(props, '$.k') as double) end", 'value')} from events""",
    "stream_unique": f"select event_type as symbol, event_id, {r('value', 'price')} from events",
    "signal_hypothesis": market.ORACLE["signal_momentum"],
    "feat_lens_pack": f"""with h as (select * from {_lenses('hour')}), dd as (select *, strptime(ts, '%Y-%m-%d %H:%M:%S') + interval 1 day as known from {_lenses('day')}),
i as ({market.ORACLE['feat_intent']})
select h.symbol, h.ts, h.session, {", ".join(f"h.{c}" for c in _COLUMNS)}, {", ".join(f"dd.{c} as d1_{c}" for c in _COLUMNS)}, i.commercial_bias, i.managed_bias, i.alignment, i.skew
from h asof left join dd on h.symbol = dd.symbol and strptime(h.ts, '%Y-%m-%d %H:%M:%S') >= dd.known asof left join i on strptime(h.ts, '%Y-%m-%d %H:%M:%S') >= i.day::timestamp""",
}
