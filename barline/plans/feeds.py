"""Queries over live feeds: caches and throttles, tape and book, silent symbols, paged and replayed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import features as X
from ..operators import joins, similar, spacing
from ..sources import candles
from ..sources import reports as P
from ..sources.scan import table, ticks
from ..sources.scratch import shared_dir
from ..streaming import live, tape
from .shape import bars_sql, r, shown


def cache_proposals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A proposal for each event, keyed by type and a fifth of the users, in hourly bars; a model's answers by the value."""
    e = table(spark, d, "events")
    p = e.select(F.col("event_id").alias("id"), F.concat_ws("-", "event_type", F.col("user_id") % 5).alias("setup"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("bar"))
    n = F.col("event_id")
    a = e.where(n % 31 != 0).select(
        n.alias("id"), F.when(n % 3 == 0, "TAKE").when(n % 3 == 1, "SKIP").otherwise("NO_TRADE").alias("decision"),
        F.when(n % 17 == 0, "timeout").alias("error"), F.when(n % 2 == 0, "no party").alias("rejection"),
    )
    return p, a


def q_cache(spark, d):
    """Decisions behind a cache whose entries live for 20 bars."""
    p, a = cache_proposals(spark, d)
    return shown(spacing.cached_decisions(p, a, 20, ["setup"], bucket=240))


def q_throttle(spark, d):
    """Large ticks of a symbol as alerts, at least two hours apart."""
    t = ticks(spark, d).where("size > 60").withColumn("at", F.unix_micros("ts"))
    got = spacing.spaced(t, ["symbol"], "at", 7_200_000_000, ["event_id"], bucket=5 * 86_400_000_000)
    return shown(got.where("kept").select("symbol", "event_id", "ts"))


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table as a stream of files."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


SYMBOLS = ["click", "error", "purchase", "signup", "view"]


def book_times(orders: DataFrame) -> DataFrame:
    """Orders as book messages: a symbol, and a second of January 2024 that no other of them has."""
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("key"), F.get(F.array(*map(F.lit, SYMBOLS)), (F.col("o_custkey") % 5).cast("int")).alias("symbol"),
        F.timestamp_seconds(F.lit(1704067200) + k * 7919 % 2592000).alias("ts"),
    )


def frames(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Exchange frames (symbol, ts, seq, value): a trade from each event; snapshots, deltas and acknowledgements from orders."""
    ts = F.col("ts").cast("timestamp")
    trade = F.struct(F.unix_millis(ts).alias("T"), F.col("value").cast("string").alias("p"), F.get_json_object("props", "$.k").alias("v"), F.when(F.col("event_id") % 2 == 0, "Buy").otherwise("Sell").alias("S"))
    traded = events.select(
        F.col("event_type").alias("symbol"), ts.alias("ts"), F.col("event_id").alias("seq"),
        F.to_json(F.struct(F.concat(F.lit("publicTrade."), "event_type").alias("topic"), F.array(trade).alias("data"))).alias("value"),
    )
    k = F.col("key")
    level = lambda price: F.array(F.array(price.cast("string"), (k % 6).cast("string")))
    book = F.to_json(F.struct(
        F.concat(F.lit("orderbook.50."), "symbol").alias("topic"), F.when(k % 97 == 0, "snapshot").otherwise("delta").alias("type"),
        F.struct(level(k % 25 + 5).alias("b"), level(k % 40 + 30).alias("a")).alias("data"),
    ))
    booked = book_times(orders).select("symbol", "ts", (k + 1_000_000_000).alias("seq"), F.when(k % 11 == 0, F.lit('{"op": "pong"}')).otherwise(book).alias("value"))
    return traded.unionByName(booked)


def q_tape_stream(spark, d):
    """Frames as a stream through the tape's state: signed volume of 500 trades, prints of 1.5 medians, book levels reached."""
    raw = frames(stream_of(spark, d, "events"), stream_of(spark, d, "orders"))
    got = live.drained(tape.stream_tape(live.parse_frames(raw), trades=500, factor=1.5), shared_dir(spark))
    return shown(got.select("symbol", "seq", "side", "cvd", "print_ratio", "levels"))


def q_silence(spark, d):
    """Types of a twentieth of the users that are silent for more than six hours."""
    e = stream_of(spark, d, "events").select(F.concat_ws("-", "event_type", F.col("user_id") % 20).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    got = live.drained(tape.stream_silence(e, 6 * 3600), shared_dir(spark))
    return got.select("symbol", F.unix_millis("last_ts").alias("last_ms"), F.unix_millis("alert_ts").alias("alert_ms"))


def books(orders: DataFrame) -> DataFrame:
    k = F.col("key")
    level = lambda base, step: F.struct((base + step).cast("double").alias("price"), (k % 7 + 1).cast("double").alias("size"))
    return book_times(orders).select(
        "symbol", "ts", F.array(*(level(k % 60 + 10, -5 * i) for i in range(5))).alias("bids"), F.array(*(level(k % 60 + 12, 5 * i) for i in range(5))).alias("asks"),
    )


def book_trades(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("value").alias("price"),
    )


def q_levels(spark, d):
    """Trades with the levels that they reach in books of at most half an hour."""
    got = joins.levels_eaten(book_trades(table(spark, d, "events")), books(table(spark, d, "orders")), 1800, bucket_seconds=86400)
    return shown(got.select("symbol", "id", "side", "price", "levels"))


def q_levels_stream(spark, d):
    """The same by a join of two streams, as far as the watermark has closed it."""
    got = live.drained(tape.stream_levels(book_trades(stream_of(spark, d, "events")), books(stream_of(spark, d, "orders")), "30 minutes"), shared_dir(spark))
    return shown(got.select("symbol", "id", "side", "price", "levels"))


def paged_options(spark: SparkSession, d: str) -> dict:
    """A feed of hourly bars of the events: pages of 100 bars, partitions of ten days."""
    low, high = table(spark, d, "events").agg(F.unix_millis(F.min("ts").cast("timestamp")), F.unix_millis(F.max("ts").cast("timestamp"))).first()
    hour = 3_600_000
    names = sorted(x[0] for x in table(spark, d, "events").select("event_type").distinct().collect())  # the feed's symbols
    return {
        "table": f"{d}/events.parquet", "symbol": ",".join(names), "start": str((low or 0) // hour * hour), "end": str((high or 0) + 1), "step": str(hour),
        "limit": "100", "span": str(10 * 24 * hour),
    }


def q_paged(spark, d):
    spark.dataSource.register(candles.PagedCandles)
    return shown(spark.read.format("paged_candles").options(**paged_options(spark, d)).load())


def q_paged_stream(spark, d):
    spark.dataSource.register(candles.PagedCandles)
    return shown(live.drained(spark.readStream.format("paged_candles").options(**paged_options(spark, d)).load(), shared_dir(spark)))


def q_live_correlation(spark, d):
    """Purchases against the other types, at each hourly bar, over 14 days with the day so far."""
    c = B.bars_from_ticks(ticks(spark, d)).select("symbol", "ts", "close")
    return shown(X.live_correlation(c.where("symbol = 'purchase'"), c.where("symbol <> 'purchase'"), 14))


def q_report_cache(spark, d):
    """Requests for the newest report (an order's total, by its second) from views, behind a cache of a day."""
    e = table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    o = table(spark, d, "orders")
    source = o.where("o_orderkey % 20 = 0").select((F.lit(1704067200) + F.col("o_orderkey") * 7919 % 2592000).alias("at"), F.col("o_totalprice").alias("total")).withColumn("at", F.col("at") * 1_000_000)
    return shown(spacing.cached_latest(e, source, 86_400_000_000, ["total"], bucket=5 * 86_400_000_000))


def q_report_text(spark, d):
    """Report texts written from orders, two blocks each, and read again."""
    k = F.col("o_orderkey")
    number = lambda i: F.format_number(k * i, 0)
    interest = F.when(k % 2 == 0, F.concat(F.format_number(k * 100, 0), F.lit(" "))).otherwise("")
    row = F.concat(F.lit("ALL  : "), interest, F.concat_ws(" : ", *(number(i) for i in range(1, 13))), F.when(k % 3 == 0, F.concat(*(x for i in range(13, 16) for x in (F.lit(" "), number(i))))).otherwise(""))
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    short = F.when(k % 5 == 0, F.date_format("o_orderdate", "MMM d yyyy")).otherwise(day)
    name = F.when(k % 7 == 0, "Silver - Commodity Exchange Inc.").otherwise("Gold - Commodity Exchange Inc.")
    other = F.concat(F.lit("COPPER - X\nALL : "), F.array_join(F.array_repeat(F.lit("9"), 15), " "), F.lit("\n\n"))
    text = F.concat(other, name, F.lit("\nCode-088691   12 3\n\n"), F.when(k % 11 == 0, "no date").otherwise(F.concat(F.lit("(As of   "), short, F.lit(")"))), F.lit("\r\n   \n"), row, F.lit("\n"))
    return shown(P.parse_report_texts(table(spark, d, "orders").select(k.alias("id"), text.alias("text")), "id", "text"))


def q_similar_pairs(spark, d):
    """Hypotheses of every second part against those of all: pairs at least 0.9 alike, ids shown by brand and size."""
    p = table(spark, d, "part")
    made = p.select("p_partkey", F.format_string('{"brand": "%s", "size": %d}', "p_brand", F.col("p_size")).alias("hypothesis_text")).withColumn(
        "hypothesis_id", F.concat_ws("-", F.get_json_object("hypothesis_text", "$.brand"), F.get_json_object("hypothesis_text", "$.size")))
    return shown(similar.similar_pairs(made.where("p_partkey % 2 = 0"), made, 0.9))


_CHAIN = """nx as (select {key}, m, min(m) over (partition by {key} order by m range between {reach} following and unbounded following) as nxt from (select distinct {key}, m from {of})),
ch as (select {key}, min(m) as m from nx group by {key} union all select ch.{key}, nx.nxt from ch join nx on ch.{key} = nx.{key} and ch.m = nx.m where nx.nxt is not null)"""

_BOOKS = """bk as (select o_orderkey as key, ['click', 'error', 'purchase', 'signup', 'view'][o_custkey % 5 + 1] as symbol, 1704067200000 + (o_orderkey * 7919 % 2592000) * 1000 as ms from orders)"""

_LEVELS = f"""{_BOOKS}, tr as (select event_type as symbol, event_id as id, case when event_id % 2 = 0 then 'buy' else 'sell' end as side, value as price, ts, epoch_us(ts) as us from events),
jn as (select tr.*, bk.key, us - bk.ms * 1000 <= 1800000000 as fresh from tr asof left join bk on tr.symbol = bk.symbol and tr.us >= bk.ms * 1000),
lv as (select symbol, id, side, {r('price')}, us, case when fresh then (case when side = 'buy' then len(list_filter(range(5), lambda i: key % 60 + 12 + 5 * i <= price))
  else len(list_filter(range(5), lambda i: key % 60 + 10 - 5 * i >= price)) end) else 0 end::bigint as levels from jn)"""

_BARS = f"with {bars_sql()} select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('volume')} from bars"

QUERIES = {
    "cache_decisions": q_cache, "throttle_alerts": q_throttle, "tape_stream": q_tape_stream, "silent_symbols": q_silence, "levels_eaten": q_levels,
    "levels_eaten_stream": q_levels_stream, "feat_live_correlation": q_live_correlation, "report_cache": q_report_cache, "registry_similar_pairs": q_similar_pairs, "source_report_text": q_report_text,
    "source_paged": q_paged, "source_paged_stream": q_paged_stream,
}

ORACLE = {
    "cache_decisions": f"""with recursive p as (select event_id as id, event_type || '-' || (user_id % 5) as setup, floor(epoch(ts) / 3600)::bigint as m from events),
{_CHAIN.format(key="setup", reach=21, of="p")},
en as (select p.*, c.m as entry from p asof join ch c on p.setup = c.setup and p.m >= c.m),
le as (select setup, m, min(id) as lead from p group by setup, m),
q as (select en.id, en.setup, en.m, not (en.entry = en.m and en.id = le.lead) as cached, le.lead as n from en join le on en.setup = le.setup and en.entry = le.m),
ac as (select *, case when n % 31 = 0 then 'model error: no answer' when n % 17 = 0 then 'model error: timeout' when n % 3 = 0 and n % 2 = 0 then 'rejected: no party'
  when n % 3 = 0 then 'approved' else 'model decided ' || (case when n % 3 = 1 then 'SKIP' else 'NO_TRADE' end) end as reason from q)
select id, setup, m as bar, cached::bigint as cached, case when reason = 'approved' then 'TAKE' when reason = 'model decided NO_TRADE' then 'NO_TRADE' else 'SKIP' end as action, reason,
  (reason = 'approved')::bigint as approved from ac""",
    "tape_stream": f"""with {_BOOKS}, tr as (select event_type as symbol, event_id * 1000 as seq, case when event_id % 2 = 0 then 'buy' else 'sell' end as side, value as price,
  cast(json_extract_string(props, '$.k') as double) as size, epoch_us(ts) // 1000 as ms from events),
w as (select *, sum(case when side = 'buy' then size else -size end) over (partition by symbol order by ms, seq rows between 499 preceding and current row) as cvd,
  median(size) over v as mid, count(*) over v as n from tr window v as (partition by symbol order by ms, seq rows between 200 preceding and 1 preceding)),
fr as (select *, (ms - 1704067200000) * 10000000 + key + 1 as t from bk where key % 11 <> 0),
up as (select symbol, side, price, key % 6 as size, t, lead(t) over (partition by symbol, side, price order by t) as nxt
  from (select symbol, 'sell' as side, key % 25 + 5 as price, key, t from fr union all select symbol, 'buy', key % 40 + 30, key, t from fr)),
sn as (select symbol, t from fr where key % 97 = 0),
li as (select up.*, least(coalesce(nxt, 9223372036854775807), coalesce(sn.t, 9223372036854775807)) as until from up asof left join sn on up.symbol = sn.symbol and up.t < sn.t),
lv as (select tr.symbol, tr.seq, count(*) as n from tr join li on tr.symbol = li.symbol and tr.side = li.side and li.size > 0 and (tr.ms - 1704067200000) * 10000000 > li.t and (tr.ms - 1704067200000) * 10000000 < li.until
  and case when tr.side = 'buy' then tr.price >= li.price else tr.price <= li.price end group by tr.symbol, tr.seq)
select w.symbol, w.seq, side, {r('cvd')}, {r("case when w.n >= 50 and mid > 0 and size > 1.5 * mid then size / mid end", 'print_ratio')}, least(coalesce(lv.n, 0), 5)::bigint as levels
from w left join lv on w.symbol = lv.symbol and w.seq = lv.seq""",
    "silent_symbols": """with e as (select event_type || '-' || (user_id % 20) as symbol, epoch_us(ts) // 1000 as ms from events), g as (select *, lead(ms) over (partition by symbol order by ms) as nxt from e)
select symbol, ms as last_ms, ms + 21600000 as alert_ms from g where nxt - ms > 21600000 or (nxt is null and ms + 21600000 <= (select max(ms) from e) - 600000)""",
    "levels_eaten": f"with {_LEVELS} select symbol, id, side, price, levels from lv",
    "levels_eaten_stream": f"""with {_LEVELS} select symbol, id, side, price, levels from lv
where us // 60000000 * 60000000 + 60000000 <= (select least((select max(us) from tr), (select max(ms) * 1000 from bk)) // 1000 * 1000 - 2400000000)""",
    "feat_live_correlation": f"""with {bars_sql()}, dl as (select symbol, ts::date as day, last(close order by ts) as c from bars group by all),
rt as (select symbol, day, c / lag(c) over (partition by symbol order by day) - 1 as ret from dl),
pr as (select a.symbol, m.symbol as series, a.day, a.ret as x, m.ret as y, row_number() over (partition by a.symbol, m.symbol order by a.day) as k
  from rt a join rt m on a.day = m.day where a.symbol = 'purchase' and m.symbol <> 'purchase' and a.ret is not null and m.ret is not null),
b as (select bars.symbol, series, ts, ts::date as day, close from bars join (select distinct symbol, series from pr) p on bars.symbol = p.symbol),
t1 as (select b.*, dl.c as a0 from b asof left join dl on b.symbol = dl.symbol and b.day > dl.day),
t2 as (select t1.*, dl.c as m0 from t1 asof left join dl on t1.series = dl.symbol and t1.day > dl.day),
t3 as (select t2.*, t2.close / a0 - 1 as x, case when m.ts::date = t2.day then m.close / m0 - 1 end as y from t2 asof left join bars m on t2.series = m.symbol and t2.ts >= m.ts),
t4 as (select t3.*, coalesce((select max(k) from pr where pr.series = t3.series and pr.day < t3.day), 0) as k from t3),
al as (select t4.symbol, t4.series, t4.ts, pr.x, pr.y from t4 join pr on pr.series = t4.series and pr.k <= t4.k and pr.k > t4.k - case when t4.x is not null and t4.y is not null then 13 else 14 end
  union all select symbol, series, ts, x, y from t4 where x is not null and y is not null),
mo as (select symbol, series, ts, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(y * y) as syy, sum(x * y) as sxy from al group by all)
select b.symbol, b.series, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as ts, {r('case when n >= 7 then (n * sxy - sx * sy) / nullif(sqrt(greatest((n * sxx - sx * sx) * (n * syy - sy * sy), 0)), 0) end', 'corr')}
from b left join mo on b.symbol = mo.symbol and b.series = mo.series and b.ts = mo.ts""",
    "registry_similar_pairs": f"""with h as (select distinct p_brand as b, p_size as s, p_partkey % 2 = 0 as fresh from part),
x as (select a.b || '-' || a.s as new_id, k.b || '-' || k.s as known_id, a.b as ab, k.b as kb, a.s as sa, k.s as sk from h a join (select distinct b, s from h) k on a.s = k.s where a.fresh and a.b <> k.b),
m as (select new_id, known_id, 2 * (6 + list_has_any(string_split(substr(ab, 7), ''), string_split(substr(kb, 7), ''))::int) / (length(ab) + length(kb)) as same from x)
select new_id, known_id, {r('(same + 1) / 2', 'score')} from m where (same + 1) / 2 >= 0.9""",
    "report_cache": f"""with recursive q as (select event_id as id, epoch_us(ts) as m, 1 as one from events where event_type = 'view'),
{_CHAIN.format(key="one", reach=86400000000, of="q")},
so as (select (1704067200 + o_orderkey * 7919 % 2592000) * 1000000 as m, o_totalprice as total from orders where o_orderkey % 20 = 0),
fe as (select ch.m, so.total from ch asof left join so on ch.m >= so.m),
en as (select q.*, fe.m as entry, fe.total from q asof join fe on q.m >= fe.m)
select id, m as "at", (m = entry and id = min(id) over (partition by m))::bigint as fetched, entry as fetched_at, {r('total')} from en""",
    "source_report_text": f"""with o as (select o_orderkey as k, o_orderdate as day from orders where o_orderkey % 7 <> 0),
c as (select k, case when k % 11 = 0 then '' else strftime(day, '%Y-%m-%d') end as report_date, k % 2 = 0 and k % 3 = 0 as cut, k % 2 = 0 as interest, k % 3 = 0 as long from o),
v as (select k, report_date, case when interest and not long then 0 else 1 end as shift, long from c),
p as (select k as id, report_date, list_transform(range(1, 16), lambda i: case when shift = 1 then (k * i)::double when i = 1 then (k * 100)::double else (k * (i - 1))::double end) as x, long from v)
select id, report_date, x[1] + x[3] + 0.0 as commercial_long, x[2] + x[4] + 0.0 as commercial_short, x[1] + x[3] - x[2] - x[4] + 0.0 as commercial_net, x[6] + 0.0 as managed_money_long, x[7] + 0.0 as managed_money_short,
  x[6] - x[7] + 0.0 as managed_money_net, case when long then x[14] else 0.0 end as small_spec_long, case when long then x[15] else 0.0 end as small_spec_short, case when long then x[14] - x[15] else 0.0 end as small_spec_net from p""",
    "source_paged": _BARS, "source_paged_stream": _BARS,
    "throttle_alerts": f"""with recursive t as (select event_type as symbol, event_id, ts, epoch_us(ts) as m from events where cast(json_extract_string(props, '$.k') as double) > 60),
{_CHAIN.format(key="symbol", reach=7200000000, of="t")}
select symbol, min(event_id) as event_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as ts from (select t.* from t join ch on t.symbol = ch.symbol and t.m = ch.m) group by symbol, m""",
}
