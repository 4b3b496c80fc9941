"""Queries over trade records, experiments, costs, text rules and storage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import journal as L
from ..operators import signals as G
from ..sources import candles as C
from ..sources import reports as P
from ..sources import stores as D
from ..sources.scan import table
from ..sources.scratch import shared_dir
from ..streaming import live, tape
from .shape import bars_sql, r, shown


def trades(spark: SparkSession, d: str) -> DataFrame:
    """Journal rows from line items: a trade for each, its setup the return flag and status, its R from the discount."""
    li = table(spark, d, "lineitem")
    r_mult = F.round((F.col("l_discount") - F.col("l_tax")) * 20, 4)
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id"), F.concat("l_returnflag", "l_linestatus").alias("setup"),
        F.when(F.col("l_linenumber") <= 6, "CLOSED").otherwise("OPEN").alias("status"), r_mult.alias("r_multiple"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_quantity", "l_extendedprice", "l_partkey", "l_orderkey", "l_linenumber", "l_discount", "l_tax",
    )


_TRADES = """tr as (select l_orderkey || '-' || l_linenumber as trade_id, l_returnflag || l_linestatus as setup, case when l_linenumber <= 6 then 'CLOSED' else 'OPEN' end as status,
 round((l_discount - l_tax) * 20, 4) as r_multiple, l_shipdate as ts, l_quantity, l_extendedprice, l_partkey, l_orderkey, l_linenumber from lineitem)"""


def q_setup_stats(spark, d):
    return shown(L.setup_stats(trades(spark, d)))


_STATS = f"""{_TRADES}, st as (select setup, count(*) as n, sum((r_multiple > 1e-9)::bigint)::bigint as wins, sum((r_multiple < -1e-9)::bigint)::bigint as losses, sum(r_multiple) as sum_r,
  coalesce(sum(case when r_multiple > 1e-9 then r_multiple end), 0) as sum_win_r, coalesce(sum(case when r_multiple < -1e-9 then r_multiple end), 0) as sum_loss_r from tr where status = 'CLOSED' and r_multiple is not null group by setup),
stats as (select *, n - wins - losses as breakeven, coalesce(wins / nullif(wins + losses, 0), 0) as win_rate, sum_r / n as expectancy_r, coalesce(sum_win_r / nullif(wins, 0), 0) as avg_win_r, coalesce(sum_loss_r / nullif(losses, 0), 0) as avg_loss_r from st)"""


def q_profile(spark, d):
    return shown(L.setup_stats(trades(spark, d)).select("setup", "n", "expectancy_r").orderBy(F.desc("expectancy_r"), "setup"))


def q_kelly(spark, d):
    s = L.setup_stats(trades(spark, d)).withColumn("conviction", F.explode(F.sequence(F.lit(1), F.lit(5))))
    k = L.kelly(s, F.col("conviction"))
    return shown(k.select("setup", "conviction", "full_kelly", "risk_pct", L.units(F.col("risk_pct"), F.lit(10000.0), F.lit(2.5)).alias("size")))


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """A trade idea from each part, with texts from its name."""
    p = table(spark, d, "part")
    e, up = F.col("p_retailprice"), F.col("p_size") % 2 == 0
    kill = F.when(F.col("p_size") % 5 == 0, F.lit("Gut feel says it is over")).when(F.col("p_size") % 7 == 0, "close").otherwise(F.concat(F.lit("A close above the level of "), "p_name", F.lit(" voids it")))
    return p.select(
        F.col("p_partkey").alias("id"), F.when(up, "long").otherwise("short").alias("direction"), e.alias("entry"),
        F.when(F.col("p_size") % 11 == 0, e * 1.01).when(up, e * 0.99).otherwise(e * 1.01).alias("stop"),
        F.when(up, e * (1 + F.col("p_size") / 1000)).otherwise(e * (1 - F.col("p_size") / 1000)).alias("target"),
        F.col("p_type").alias("thesis"), kill.alias("kill_thesis"), F.when(F.col("p_size") == 1, 1).otherwise(0).alias("open_positions"),
        (F.col("p_size") / -10.0).alias("day_pnl_pct"), (F.col("p_size") / 2.4).alias("account_dd_pct"), (F.col("p_size") == 3).alias("in_news"),
        F.when(F.col("p_size") > 30, 12).otherwise(0).alias("n"), F.when(F.col("p_size") > 40, -0.5).otherwise(0.2).alias("expectancy_r"),
    )


_PROPOSALS = """pr as (select p_partkey as id, case when p_size % 2 = 0 then 'long' else 'short' end as direction, p_retailprice as entry,
 case when p_size % 11 = 0 then p_retailprice * 1.01 when p_size % 2 = 0 then p_retailprice * 0.99 else p_retailprice * 1.01 end as stop,
 case when p_size % 2 = 0 then p_retailprice * (1 + p_size / 1000) else p_retailprice * (1 - p_size / 1000) end as target, p_type as thesis,
 case when p_size % 5 = 0 then 'Gut feel says it is over' when p_size % 7 = 0 then 'close' else 'A close above the level of ' || p_name || ' voids it' end as kill_thesis,
 case when p_size = 1 then 1 else 0 end as open_positions, p_size / -10.0 as day_pnl_pct, p_size / 2.4 as account_dd_pct, p_size = 3 as in_news,
 case when p_size > 30 then 12 else 0 end as n, case when p_size > 40 then -0.5 else 0.2 end as expectancy_r from part)"""


def q_discipline(spark, d):
    got = L.discipline(proposals(spark, d))
    failed = F.filter("checks", lambda c: ~c["passed"])
    return got.select("id", "decision", F.array_join(F.transform(failed, lambda c: c["name"]), ",").alias("failed"))


def q_take_rules(spark, d):
    """Rejections of proposed trades, built from customers."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    kill = F.when(k % 6 == 0, "short").when(k % 10 == 1, F.lit("We leave if the trade goes against me, whatever happens")).otherwise("A close above the prior session high on rising volume voids the idea")
    sr = c.select(
        k, F.when(k % 9 == 0, "SKIP").otherwise("TAKE").alias("decision"), F.when(k % 13 == 0, "STALE").otherwise("FRESH").alias("data_quality"),
        F.when(k % 7 != 0, F.col("c_name")).alias("trapped_party"), kill.alias("kill_thesis"), F.when(k % 8 == 0, 2.0).otherwise(3.5).alias("rr_minimum"),
        F.when(k % 17 == 0, 0.95).otherwise(0.8).alias("confidence"), F.when(k % 5 == 0, 0.8).otherwise(0.4).alias("flow"), F.when(k % 5 == 0, 0.0).otherwise(0.4).alias("structure"),
        F.when(k % 19 == 0, 0.2).otherwise(0.0).alias("context"), F.lit(0.0).alias("intent"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("zone_low"), F.lit(1.0).alias("first_target"),
    )
    return sr.select("c_custkey", F.coalesce(G.take_rejection(F.col("c_custkey") % 23 == 0), F.lit("accepted")).alias("outcome"))


def q_posts(spark, d):
    p = proposals(spark, d)
    sr = p.select(
        "id", F.when(F.col("id") % 5 == 0, "SKIP").when(F.col("id") % 7 == 0, "NO_TRADE").otherwise("TAKE").alias("decision"), "direction", F.lit("range").alias("regime"), "thesis", "kill_thesis",
        F.col("entry").alias("zone_low"), (F.col("entry") + 4).alias("zone_high"), F.lit(3.0).alias("rr_minimum"), F.lit(0.75).alias("confidence"), F.lit(0.4).alias("flow"),
        F.lit(0.35).alias("structure"), F.lit(0.0).alias("context"), F.lit(0.0).alias("intent"),
    )
    return sr.select("id", T.kill_class(F.col("kill_thesis")).alias("kill_class"), F.posexplode(T.posts()).alias("nth", "post")).select("id", "kill_class", F.col("nth").cast("long").alias("nth"), "post")


def closed_positions(spark: SparkSession, d: str) -> DataFrame:
    pos = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("position_id"), F.col("o_totalprice").alias("entry"), (F.col("o_totalprice") * F.when(F.col("o_custkey") % 50 == 0, 1.0).otherwise(0.99)).alias("sl"),
        F.lit(2.0).alias("size"), F.when(F.col("o_orderstatus") == "O", "long").otherwise("short").alias("direction"),
    )
    ev = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("position_id"), (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"), F.when(F.col("l_returnflag") == "R", "SL").otherwise("TP1").alias("rule_matched"),
    )
    return L.autopsies(pos, ev)


_CLOSED = """ps as (select o_orderkey as position_id, o_totalprice as entry, o_totalprice * case when o_custkey % 50 = 0 then 1.0 else 0.99 end as sl, 2.0 as size, case when o_orderstatus = 'O' then 'long' else 'short' end as direction from orders),
ev as (select l_orderkey as position_id, sum(l_extendedprice * (l_discount - l_tax)) as pnl, bool_or(l_returnflag = 'R') as kill from lineitem group by 1),
au as (select ps.*, coalesce(kill, false) as kill_triggered, case when entry = sl or coalesce(pnl, 0) = 0 then 'breakeven' when pnl > 0 then 'won' else 'lost' end as result,
  case when entry = sl or coalesce(pnl, 0) = 0 then 0.0 else pnl / 2.0 / abs(entry - sl) end as r_multiple from ps left join ev using (position_id))"""


def q_autopsies(spark, d):
    a = closed_positions(spark, d)
    return shown(a.select("position_id", "result", "r_multiple", "kill_triggered", F.array_join("tags", ",").alias("tags")))


def q_digest(spark, d):
    return shown(L.digest_counts(closed_positions(spark, d)))


def q_recurring(spark, d):
    a = closed_positions(spark, d)
    both = L.recurring_tags(a, True).withColumn("kind", F.lit("losing")).union(L.recurring_tags(a, False).withColumn("kind", F.lit("winning")))
    return shown(both)


def q_drift(spark, d):
    t = trades(spark, d).where("status = 'CLOSED'")
    got = L.drift(t.where("l_orderkey % 7 = 0").select("setup", F.col("ts").alias("at"), "r_multiple"), t.where("l_orderkey % 7 <> 0").select("setup", "r_multiple"), "setup")
    return shown(got.select("setup", "live_n", "live_sharpe", "bt_sharpe", "sharpe_delta_pct", "live_win_rate", "bt_win_rate", "ci_low", "ci_high", "ci_overlap", "d"))


def q_drift_verdict(spark, d):
    t = trades(spark, d).where("status = 'CLOSED'")
    live = t.where("l_orderkey % 7 = 0").select("setup", F.struct("ts", "trade_id").alias("at"), "r_multiple")
    return shown(L.drift(live, t.where("l_orderkey % 7 <> 0").select("setup", "r_multiple"), "setup", window=30).select("setup", "live_n", "ks_pvalue", "verdict"))


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """One for each line item and part brand: JSON with keys in another order for half of them."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.format_string('{"brand": "%s", "size": %d}', "p_brand", F.col("p_size"))).otherwise(
        F.format_string('{"size": %d, "brand": "%s"}', F.col("p_size"), "p_brand")).alias("hypothesis"))


def q_registry(spark, d):
    h = hypotheses(spark, d)
    known = h.where("p_partkey <= 50").select(L.hypothesis_id(F.col("hypothesis")).alias("hypothesis_id")).distinct()
    return L.register(known, h.select("hypothesis"))


def q_rollup(spark, d):
    li = table(spark, d, "lineitem")
    t = li.select(F.concat(F.lit("h"), F.col("l_suppkey")).alias("hypothesis_id"), (F.col("l_discount") * 10).alias("sharpe"), F.col("l_tax").alias("pbo"))
    return shown(L.trial_rollup(t))


def q_similar(spark, d):
    h = hypotheses(spark, d).select("p_partkey", "hypothesis")
    e = h.select(F.col("p_partkey").alias("hypothesis_id"), F.col("hypothesis").alias("hypothesis_text"))
    target = json.dumps({"brand": "Brand#11", "size": 10})
    return shown(L.similar(e, target, 0.9))


PRICES = [("default", 15.0, 75.0, 1.5, 18.75), ("A", 3.0, 15.0, 0.3, 3.75), ("R", 1.0, 5.0, 0.1, 1.25)]


def q_usage(spark, d):
    li = table(spark, d, "lineitem")
    u = li.select(F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.col("l_orderkey").alias("cache_read_tokens"), F.col("l_linenumber").cast("long").alias("cache_write_tokens"))
    prices = spark.createDataFrame(PRICES, "model string, input double, output double, cache_read double, cache_write double")
    return shown(L.usage_costs(u, prices))


def q_experiments(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "start").when(F.col("o_orderkey") % 5 == 4, "finish").otherwise("log")
    ev = o.select(F.concat(F.lit("exp"), F.floor(F.col("o_orderkey") / 5)).alias("experiment_id"), kind.alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"),
                  F.col("o_orderpriority").alias("hypothesis_id"), F.when(F.col("o_totalprice") > 200000, "PASS").otherwise("FAIL").alias("verdict"))
    return shown(D.experiment_index(ev))


def q_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"))).alias("result"), F.to_json(F.struct(F.col("p_type").alias("kind"))).alias("config_snapshot"))
    return L.filter_experiments(p, {"brand": "Brand#11"}).select("p_partkey")


def q_paired(spark, d):
    o = table(spark, d, "orders")
    arms = o.groupBy(F.col("o_orderpriority").alias("regime"), F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("filtered").alias("arm")).agg(
        F.sum("o_totalprice").alias("total"), F.count("*").alias("trades"))
    return shown(L.paired(arms, "arm", "base", "filtered", ["regime"], ["total", "trades"]))


def mined(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    return t.select((F.col("r_multiple") > 0).cast("int").alias("win"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / 1000).alias("price"), F.hour("ts").alias("hour"), F.month("ts").alias("month"))


def q_win_rates(spark, d):
    q, p = F.col("qty"), F.col("price")
    labels = {"small": q < 10, "large": q > 40, "cheap": p < 5, "large and dear": (q > 40) & (p > 60), "winter": F.col("month").isin(12, 1, 2)}
    return shown(L.conditional_win_rates(mined(spark, d), labels, 20))


def q_medians(spark, d):
    return shown(L.winner_loser_medians(mined(spark, d), ["qty", "price"]))


def q_close_trades(spark, d):
    o = table(spark, d, "orders")
    j = o.select(F.col("o_orderkey").cast("string").alias("trade_id"), F.when(F.col("o_custkey") % 2 == 0, "long").otherwise("short").alias("direction"), F.col("o_totalprice").alias("entry"),
                 (F.col("o_totalprice") * F.when(F.col("o_custkey") % 2 == 0, 0.98).otherwise(1.02)).alias("stop"), F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status"), F.lit(0.5).alias("risk_pct"), F.lit("n").alias("notes"),
                 F.lit(None).cast("double").alias("exit_price"), F.lit(None).cast("long").alias("closed_at"), F.lit(None).cast("string").alias("exit_reason"), F.lit(None).cast("double").alias("r_multiple"), F.lit(None).cast("double").alias("pnl_account"))
    c = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("trade_id"), (F.col("l_extendedprice") * 3).alias("exit_price"), F.col("l_partkey").alias("closed_at"), F.lit("manual").alias("exit_reason"), F.lit("late").alias("notes"))
    return shown(L.close_trades(j, c).where("status = 'CLOSED' and r_multiple is not null").select("trade_id", "r_multiple", "pnl_account", "notes"))


def q_latest(spark, d):
    """Current state of versioned rows: each customer's last order of each column that was given."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") > 1e5, F.col("o_totalprice")).alias("price"))
    return shown(D.latest(o, "o_custkey", "version"))


def q_reports(spark, d):
    """Positioning reports cleaned from text: built from orders by day, with thousands commas."""
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Report_Date_as_YYYY-MM-DD")).agg(F.sum("o_custkey").alias("a"), F.sum("o_orderkey").alias("b"), F.count("*").alias("c"))
    text = lambda c: F.format_number(c, 0)
    raw = o.select("`Report_Date_as_YYYY-MM-DD`", F.when(F.col("c") % 5 == 0, "SILVER - X").otherwise("GOLD - COMMODITY EXCHANGE INC.").alias("Market_and_Exchange_Names"),
                   *(text(F.col(s) + k).alias(n) for k, (n, s) in enumerate((("Prod_Merc_Positions_Long_All", "a"), ("Prod_Merc_Positions_Short_All", "b"), ("Swap_Positions_Long_All", "c"), ("Swap__Positions_Short_All", "a"),
                     ("M_Money_Positions_Long_All", "b"), ("M_Money_Positions_Short_All", "c"), ("NonRept_Positions_Long_All", "a"), ("NonRept_Positions_Short_All", "b")))))
    return shown(P.report_bias(P.clean_reports(raw)).withColumn("date", F.col("date").cast("string")))


def q_calendar(spark, d):
    """Computed releases for the months of the orders."""
    return shown(P.recurring_events(spark, "1992-01-01", 84))


def q_macro(spark, d):
    raw = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 3 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"), "o_orderkey")
    s = P.clean_series(raw, "X")
    return shown(s.groupBy("series", "ts").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def q_transcripts(spark, d):
    pages = table(spark, d, "pages")
    clean = T.clean_transcript(F.col("html"))
    return pages.select("page_id", F.sha2(clean.cast("binary"), 256).alias("text_sha256"), F.length(clean).cast("long").alias("n_chars"))


def q_regimes(spark, d):
    g = C.regime_archives(spark)
    return shown(g.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "ts").alias("last")))


def q_stream_bars(spark, d):
    """Streamed bars, each emitted once, when the watermark has closed it: those of the last minutes are still open."""
    return shown(live.drained(live.stream_bars(live.tick_stream(spark, d)), shared_dir(spark)).withColumnRenamed("bar", "ts"))


def q_stream_cvd(spark, d):
    t = live.tick_stream(spark, d).withColumn("side", F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell"))
    got = live.drained(live.stream_cvd(t, "6 hours", "3 hours"), shared_dir(spark))
    return shown(got.select("symbol", F.col("window.start").alias("ts"), "cvd", "n"))


def q_stream_activity(spark, d):
    got = live.drained(live.stream_activity(live.tick_stream(spark, d)), shared_dir(spark))
    return shown(got.select("symbol", F.col("session_window.start").alias("ts"), "n", "volume"))


def q_tape(spark, d):
    """Ticks as trades: signed volume of the buffer and large prints; without a book no levels are reached."""
    from ..sources.scan import ticks

    t = ticks(spark, d).select("symbol", "ts", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), "price", "size")
    return shown(tape.batch_tape(t).select("symbol", "seq", "side", "cvd", "print_ratio", F.lit(0).alias("levels")))


QUERIES = {
    "journal_setup_stats": q_setup_stats, "journal_profile": q_profile, "journal_kelly": q_kelly, "journal_discipline": q_discipline, "journal_close": q_close_trades, "signal_take_rules": q_take_rules,
    "text_posts": q_posts, "text_transcripts": q_transcripts, "memory_autopsies": q_autopsies, "memory_digest": q_digest, "memory_recurring_tags": q_recurring, "drift_statistics": q_drift,
    "drift_verdict": q_drift_verdict, "registry_register": q_registry, "registry_rollup": q_rollup, "registry_similar": q_similar, "usage_costs": q_usage, "experiments_index": q_experiments,
    "experiments_filter": q_filter, "experiments_paired": q_paired, "mining_win_rates": q_win_rates, "mining_medians": q_medians, "store_latest": q_latest, "source_reports": q_reports,
    "source_calendar": q_calendar, "source_macro": q_macro, "source_regimes": q_regimes, "stream_bars": q_stream_bars, "stream_cvd": q_stream_cvd, "stream_activity": q_stream_activity, "tape_features": q_tape,
}

ORACLE = {
    "journal_setup_stats": f"with {_STATS} select setup, n, wins, losses, {r('sum_r')}, {r('sum_win_r')}, {r('sum_loss_r')}, breakeven, {r('win_rate')}, {r('expectancy_r')}, {r('avg_win_r')}, {r('avg_loss_r')} from stats",
    "journal_profile": f"with {_STATS} select setup, n, {r('expectancy_r')} from stats",
    "journal_kelly": f"""with {_STATS}, k as (select *, unnest(range(1, 6)) as conviction, case when abs(avg_loss_r) > 0 and avg_win_r > 0 and win_rate > 0 then greatest(0.0, win_rate - (1 - win_rate) / (avg_win_r / abs(avg_loss_r))) else 0.0 end as full_kelly from stats),
  b as (select *, case when n < 20 then 0.5 when full_kelly <= 0 then 0.25 else greatest(0.25, least(2.0, full_kelly * 25)) end as base from k),
  c as (select *, round(greatest(0.25, least(2.0, base * (0.7 + (conviction - 1) * (0.45 / 4)))), 3) as risk_pct from b)
  select setup, conviction::bigint as conviction, {r('full_kelly')}, {r('risk_pct')}, {r('10000.0 * risk_pct / 100 / 2.5', 'size')} from c""",
    "journal_discipline": f"""with {_PROPOSALS}, f as (select *, case when abs(entry - stop) > 0 then abs(target - entry) / abs(entry - stop) else 0 end as rr from pr),
  g as (select id, open_positions >= 1 as a, account_dd_pct >= 20 as b, day_pnl_pct <= -4 as c, in_news as d, rr < 2 as e,
    length(trim(kill_thesis)) < 25 or regexp_matches(kill_thesis, '\\b(if\\s+it\\s+goes?\\s+against\\s+me|if\\s+i''?m\\s+wrong|gut\\s+feel|vibes?|if\\s+the\\s+trend\\s+reverses)\\b', 'i') as k,
    length(trim(thesis)) < 20 as t, not ((direction = 'long' and stop < entry) or (direction = 'short' and stop > entry)) as s, n >= 8 and expectancy_r < 0 as h from f)
  select id, case when a or b or c or d or e or k or s then 'BLOCK' when t or h then 'APPROVE_WITH_WARNINGS' else 'APPROVE' end as decision,
  concat_ws(',', case when a then 'one_position' end, case when b then 'drawdown_halt' end, case when c then 'daily_loss_cap' end, case when d then 'news_window' end, case when e then 'risk_reward' end, case when k then 'kill_thesis' end,
   case when t then 'thesis_present' end, case when s then 'stop_side' end, case when h then 'setup_track_record' end) as failed from g""",
    "journal_close": f"""with x as (select o_orderkey::varchar as trade_id, o_custkey % 2 = 0 as up, o_totalprice as e, o_totalprice * case when o_custkey % 2 = 0 then 0.98 else 1.02 end as s, l.p
    from orders join (select l_orderkey, first(l_extendedprice * 3 order by l_partkey, l_extendedprice) as p from lineitem where l_linenumber = 1 group by 1) l on o_orderkey = l_orderkey where o_orderstatus <> 'F'), y as (select *, case when up then p - e else e - p end / abs(e - s) as rm from x)
  select trade_id, {r('rm', 'r_multiple')}, {r('0.5 / 100 * rm', 'pnl_account')}, 'n | late' as notes from y""",
    "signal_take_rules": """select c_custkey, case when c_custkey % 9 = 0 then 'accepted' when c_custkey % 23 = 0 then 'position already open' when c_custkey % 13 = 0 then 'data not fresh' when c_custkey % 7 = 0 then 'no trapped party'
  when c_custkey % 6 = 0 then 'kill thesis too short' when c_custkey % 10 = 1 then 'kill thesis vague' when c_custkey % 8 = 0 then 'reward below 3R' when c_custkey % 17 = 0 then 'confidence above 0.9'
  when c_custkey % 19 = 0 then 'breakdown disagrees' when c_custkey % 5 = 0 then 'fewer than two lenses' when c_custkey % 4 = 0 then 'no entry zone or target' else 'accepted' end as outcome from customer""",
    "memory_autopsies": f"with {_CLOSED} select position_id, result, {r('r_multiple')}, kill_triggered::int as kill_triggered, concat_ws(',', result, case when kill_triggered then 'kill-thesis-clean' end, 'direction:' || direction) as tags from au",
    "memory_digest": f"""with {_CLOSED}, c as (select count(*) as n, count(*) filter (where result = 'won') as wins, count(*) filter (where result = 'lost') as losses, count(*) filter (where result = 'breakeven') as breakeven, avg(r_multiple) as avg_r from au)
  select n, wins, losses, breakeven, {r('avg_r')}, {r('wins / (wins + losses)', 'win_rate')} from c""",
    "memory_recurring_tags": f"""with {_CLOSED}, t as (select unnest(list_filter([result, case when kill_triggered then 'kill-thesis-clean' end, 'direction:' || direction], lambda x: x is not null)) as tag, r_multiple as rm from au),
  b as (select tag, count(*) as n, sum(rm) as total from t group by tag having count(*) >= 2)
  (select tag, n, {r('total', 'total_r')}, 'losing' as kind from b where total < 0 order by total, tag limit 5) union all (select tag, n, {r('total', 'total_r')}, 'winning' from b where total > 0 order by total desc, tag limit 5)""",
    "drift_statistics": f"""with {_TRADES}, t as (select * from tr where status = 'CLOSED'), lv as (select setup, count(*) as n, coalesce(avg(r_multiple) / nullif(stddev_samp(r_multiple), 0), 0) as sh, count(*) filter (where r_multiple > 0) as w from t where l_orderkey % 7 = 0 group by setup),
  bt as (select setup, coalesce(avg(r_multiple) / nullif(stddev_samp(r_multiple), 0), 0) as sh, avg((r_multiple > 0)::int) as wr from t where l_orderkey % 7 <> 0 group by setup),
  st as (select setup, r_multiple, count(*) filter (where l_orderkey % 7 = 0) as a, count(*) filter (where l_orderkey % 7 <> 0) as b from t group by 1, 2),
  cu as (select setup, sum(a) over v / sum(a) over (partition by setup) - sum(b) over v / sum(b) over (partition by setup) as gap from st window v as (partition by setup order by r_multiple)),
  ks as (select setup, max(abs(gap)) as d from cu group by setup),
  x as (select bt.setup, lv.n, lv.sh as ls, bt.sh as bs, w / n as lw, bt.wr as bw, 1.959963984540054 as z, d from bt join lv on bt.setup = lv.setup join ks on ks.setup = bt.setup),
  y as (select *, 1 + z * z / n as sc from x), q as (select *, greatest(0.0, (lw + z * z / (2 * n)) / sc - z * sqrt((lw * (1 - lw) + z * z / (4 * n)) / n) / sc) as lo, least(1.0, (lw + z * z / (2 * n)) / sc + z * sqrt((lw * (1 - lw) + z * z / (4 * n)) / n) / sc) as hi from y)
  select setup, n as live_n, {r('ls', 'live_sharpe')}, {r('bs', 'bt_sharpe')}, {r('case when bs = 0 then ls else (ls - bs) / bs end', 'sharpe_delta_pct')}, {r('lw', 'live_win_rate')}, {r('bw', 'bt_win_rate')}, {r('lo', 'ci_low')}, {r('hi', 'ci_high')}, (lo <= bw and bw <= hi)::int as ci_overlap, {r('d')} from q""",
    "registry_register": """with h as (select p_partkey, '{"brand": "' || p_brand || '", "size": ' || p_size || '}' as t from part), i as (select *, 'hyp_' || sha256(t)[1:12] as id from h)
  select distinct id as hypothesis_id, t as hypothesis_text from i where id not in (select id from i where p_partkey <= 50)""",
    "registry_rollup": f"select 'h' || l_suppkey as hypothesis_id, count(*) as trial_count, {r('max(l_discount * 10)', 'best_sharpe')}, {r('min(l_tax)', 'best_pbo')} from lineitem group by 1",
    "usage_costs": f"""with p(model, i, o, c, w) as (values ('default', 15.0, 75.0, 1.5, 18.75), ('A', 3.0, 15.0, 0.3, 3.75), ('R', 1.0, 5.0, 0.1, 1.25)),
  u as (select l_returnflag as model, count(*) as calls, sum(l_partkey)::bigint as input_tokens, sum(l_suppkey)::bigint as output_tokens, sum(l_orderkey)::bigint as cache_read_tokens, sum(l_linenumber)::bigint as cache_write_tokens from lineitem group by 1)
  select u.model, calls, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, {r('(input_tokens * i::double + output_tokens * o::double + cache_read_tokens * c::double + cache_write_tokens * w::double) / 1e6', 'usd')},
  {r('cache_read_tokens / (input_tokens + cache_read_tokens)', 'cache_hit_ratio')} from u join p on p.model = case when u.model in ('A', 'R') then u.model else 'default' end""",
    "experiments_index": """select 'exp' || floor(o_orderkey / 5)::bigint as experiment_id, max(case when o_orderkey % 5 = 0 then o_orderpriority end) as hypothesis_id, strftime(max(case when o_orderkey % 5 = 0 then o_orderdate end), '%Y-%m-%d %H:%M:%S') as started_at,
  strftime(max(case when o_orderkey % 5 = 4 then o_orderdate end), '%Y-%m-%d %H:%M:%S') as finished_at, max(case when o_orderkey % 5 = 4 then case when o_totalprice > 200000 then 'PASS' else 'FAIL' end end) as verdict,
  sum((o_orderkey % 5 in (1, 2, 3))::bigint)::bigint as n_events from orders group by 1""",
    "experiments_filter": "select p_partkey from part where p_brand = 'Brand#11'",
    "experiments_paired": f"""with a as (select o_orderpriority as regime, o_orderkey % 2 = 0 as base, sum(o_totalprice) as total, count(*) as trades from orders group by 1, 2)
  select b.regime, {r('b.total', 'base_total')}, b.trades as base_trades, {r('f.total', 'other_total')}, f.trades as other_trades, {r('f.total - b.total', 'delta_total')}, f.trades - b.trades as delta_trades from a b join a f on b.regime = f.regime and b.base and not f.base""",
    "mining_win_rates": f"""with {_TRADES}, m as (select (r_multiple > 0)::int as win, l_quantity as q, l_extendedprice / 1000 as p, month(ts) as mo from tr),
  l as (select win, unnest(list_filter([case when q < 10 then 'small' end, case when q > 40 then 'large' end, case when p < 5 then 'cheap' end, case when q > 40 and p > 60 then 'large and dear' end, case when mo in (12, 1, 2) then 'winter' end], lambda x: x is not null)) as label from m)
  select label, count(*) as n, {r('avg(win)', 'win_rate')}, {r('2 * avg(win) - (1 - avg(win))', 'expectancy')} from l group by label having count(*) >= 20""",
    "mining_medians": f"""with {_TRADES}, m as (select r_multiple > 0 as win, l_quantity as qty, l_extendedprice / 1000 as price from tr), u as (select 'qty' as feature, win, qty as x from m union all select 'price', win, price from m),
  a as (select feature, median(x) filter (where win) as winners, median(x) filter (where not win) as losers, stddev_samp(x) filter (where win) + stddev_samp(x) filter (where not win) as sd from u group by feature)
  select feature, {r('winners')}, {r('losers')}, {r('case when sd > 0 then (winners - losers) / sd else 0.0 end', 'separation')} from a""",
    "store_latest": f"select o_custkey, arg_max(case when o_orderstatus <> 'P' then o_orderstatus end, case when o_orderstatus <> 'P' then o_orderkey end) as status, {r('arg_max(case when o_totalprice > 1e5 then o_totalprice end, case when o_totalprice > 1e5 then o_orderkey end)', 'price')}, max(o_orderkey) as version from orders group by 1",
    "source_reports": f"""with o as (select strftime(o_orderdate, '%Y-%m-%d') as date, sum(o_custkey)::double as a, sum(o_orderkey)::double as b, count(*)::double as c from orders group by 1),
  p as (select date, a + c + 2 as commercial_long, b + 1 + a + 3 as commercial_short, b + 4 as managed_money_long, c + 5 as managed_money_short, a + 6 as small_spec_long, b + 7 as small_spec_short from o where c::bigint % 5 <> 0),
  n as (select *, commercial_long - commercial_short as commercial_net, managed_money_long - managed_money_short as managed_money_net, small_spec_long - small_spec_short as small_spec_net from p),
  s as (select *, case when commercial_net > 0 then 'long' when commercial_net < 0 then 'short' else 'neutral' end as commercial_bias, case when managed_money_net > 0 then 'long' when managed_money_net < 0 then 'short' else 'neutral' end as managed_money_bias from n)
  select *, case when commercial_bias = 'neutral' or managed_money_bias = 'neutral' then null when commercial_bias = managed_money_bias then 'aligned' else 'commercials_vs_specs' end as cot_alignment from s""",
    "source_calendar": """with m as (select date '1992-01-01' + to_months(i::int) as m from range(84) t(i)), e as (select 'NFP ' as label, m + to_days(((5 - isodow(m) + 7) % 7)::int) as d from m union all select 'US CPI ', m + to_days(((3 - isodow(m) + 7) % 7 + 7)::int) from m)
  select label || strftime(d, '%b %Y') as name, strftime(d + interval '750 minutes', '%Y-%m-%d %H:%M:%S') as event_ts, 'high' as impact, 'computed' as source from e""",
    "source_macro": f"select 'X' as series, strftime(o_orderdate::date, '%Y-%m-%d 00:00:00') as ts, count(*) as n, {r('sum(o_totalprice)', 'total')} from orders where o_orderkey % 3 <> 0 group by 1, 2",
    "text_transcripts": r"""with c as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&(nbsp|#160);', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as t from pages)
  select page_id, sha256(t) as text_sha256, length(t) as n_chars from c""",
    "text_posts": f"""with {_PROPOSALS}, k as (select *, lower(kill_thesis) as low from pr),
c as (select id, upper(direction) as side, trim(thesis) as why, case when contains(low, 'close') and (contains(low, 'above') or contains(low, 'below')) then 'structural reclaim'
  when contains(low, 'minute') or contains(low, 'time') then 'time decay' when contains(low, 'cvd') or contains(low, 'delta') then 'flow reversal' else 'structural invalidation' end as kill_class,
  (round_even((entry + entry + 4) / 2 / 5, 0) * 5)::bigint::varchar as around from k)
select id, kill_class, 0::bigint as nth, 'MARKET [PAPER] | ' || case when id % 5 = 0 then 'SKIP' || chr(10) || 'Regime: range' || chr(10) || 'Why: ' || why
  when id % 7 = 0 then 'NO TRADE' || chr(10) || 'Regime: range | Lenses active: 2/4' || chr(10) || 'Default is NO. Sitting on hands.'
  else side || chr(10) || 'Regime: range' || chr(10) || 'Setup: around ' || around || chr(10) || 'Target: 3R minimum' || chr(10) || 'Conf: 0.75' || chr(10) || chr(10) || 'Why: ' || why || chr(10) || 'Kill: ' || kill_class end as post
from c""",
    "tape_features": f"""with {bars_sql()}, x as (select *, case when event_id % 2 = 0 then 'buy' else 'sell' end as side from ticks),
  w as (select *, sum(case when side = 'buy' then size else -size end) over (partition by symbol order by t, event_id rows between 4999 preceding and current row) as cvd,
    median(size) over v as mid, count(size) over v as n from x window v as (partition by symbol order by t, event_id rows between 200 preceding and 1 preceding))
  select symbol, event_id as seq, side, {r('cvd')}, {r('case when n >= 50 and mid > 0 and size > 5 * mid then size / mid end', 'print_ratio')}, 0::bigint as levels from w""",
    "stream_bars": f"with {bars_sql()} select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('volume')} from bars where ts + interval '1 hour' <= (select max(t) - interval '10 minutes' from ticks)",
    "stream_cvd": f"""with {bars_sql()}, w as (select symbol, event_id, size, unnest([time_bucket(interval '3 hours', t, timestamp '1970-01-01'), time_bucket(interval '3 hours', t, timestamp '1970-01-01') - interval '3 hours']) as s from ticks)
  select symbol, strftime(s, '%Y-%m-%d %H:%M:%S') as ts, {r('sum(case when event_id % 2 = 0 then size else -size end)', 'cvd')}, count(*) as n from w where s + interval '6 hours' <= (select max(t) - interval '10 seconds' from ticks) group by symbol, s""",
    "stream_activity": f"""with {bars_sql()}, g as (select symbol, t, size, (lag(t) over (partition by symbol order by t) is null or t >= lag(t) over (partition by symbol order by t) + interval '30 minutes')::int as new from ticks),
  s as (select *, sum(new) over (partition by symbol order by t, size rows unbounded preceding) as k from g)
  select symbol, strftime(min(t), '%Y-%m-%d %H:%M:%S') as ts, count(*) as n, {r('sum(size)', 'volume')} from s group by symbol, k
  having max(t) + interval '30 minutes' <= (select max(t) - interval '10 minutes' from ticks)""",
}
