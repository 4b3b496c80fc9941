"""Spacing against a fold, live state at several triggers and over restarts, stream joins and the paged source."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from barline.operators import joins, spacing
from barline.plans import feeds
from barline.sources import candles
from barline.streaming import live, tape

START = dt.datetime(2024, 1, 1)


def folded(rows, span, strict):
    """{id: (entry, lead id, kept)} of rows (key, at, id), one key after another."""
    out, last = {}, {}
    for key, at, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        held = last.get(key)
        if held is None or at - held[0] > span or (at - held[0] == span and not strict):
            last[key] = held = (at, i)
            out[i] = (*held, True)
        else:
            out[i] = (*held, False)
    return out


@pytest.mark.parametrize("span, strict, bucket", [(5, False, None), (5, True, None), (7, False, 20), (1, False, None), (0, True, 50), (1000, False, None)])
def test_spacing_against_a_fold(spark, span, strict, bucket):
    rng = random.Random(span)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randint(-50, 150), i) for i in range(300)] + [("c", None, 300), ("d", 4, 301)]
    got = spacing.spaced(spark.createDataFrame(rows, "key string, at long, id long"), ["key"], "at", span, ["id"], strict, bucket).collect()
    assert len(got) == len(rows)
    want = folded(rows, span, strict)
    assert {r.id: (r.entry, r.lead.id, r.kept) for r in got if r.at is not None} == want
    assert [(r.entry, r.kept) for r in got if r.at is None] == [(None, False)]


def test_rounds_grow_with_the_logarithm(spark):
    n = 700
    moments = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("at"))
    found, rounds = spacing.chain(moments, ["key"], "at", 2, False, None)
    assert found.count() == n // 2 and rounds <= math.ceil(math.log2(n / 2)) + 1


def test_cache_keeps_refusals_and_errors_and_hits_extend_nothing(spark):
    p = spark.createDataFrame([(1, "k", 0), (2, "k", 3), (3, "k", 10), (4, "k", 11), (5, "k", 12), (6, "x", 0), (7, "y", 0), (8, "y", 1)], "id long, setup string, bar long")
    a = spark.createDataFrame([(1, "SKIP", None, None), (2, "TAKE", None, None), (4, "TAKE", None, None), (5, "SKIP", None, None), (6, "TAKE", None, "rr"), (7, None, "boom", None), (8, "TAKE", None, None)], "id long, decision string, error string, rejection string")
    got = {r.id: (r.cached, r.action, r.reason) for r in spacing.cached_decisions(p, a, 10, ["setup"]).collect()}
    assert got == {
        1: (False, "SKIP", "model decided SKIP"), 2: (True, "SKIP", "model decided SKIP"), 3: (True, "SKIP", "model decided SKIP"), 4: (False, "TAKE", "approved"),
        5: (True, "TAKE", "approved"), 6: (False, "SKIP", "rejected: rr"), 7: (False, "SKIP", "model error: boom"), 8: (True, "SKIP", "model error: boom"),
    }
    off = {r.id: (r.cached, r.action) for r in spacing.cached_decisions(p, a, 0, ["setup"]).collect()}
    assert not any(c for c, _ in off.values()) and off[3] == (False, "SKIP") and off[2] == (False, "TAKE")


def drain(stream, path, progress=None):
    """What is there now, into the table of a checkpointed query that earlier calls may have begun."""
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"file://{path}/checkpoint").format("parquet").start(f"file://{path}/out")
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    return stream.sparkSession.read.schema(stream.schema).parquet(f"file://{path}/out")


def naive_tape(messages, buffer):
    out, state = {}, {}
    for m in sorted(messages, key=lambda m: (m["ts"], m["seq"])):
        signed, sizes, book = state.setdefault(m["symbol"], ([], [], {"bids": {}, "asks": {}}))
        if m["kind"] == "trade":
            side = book["asks" if m["side"] == "buy" else "bids"]
            reached = sum(p <= m["price"] if m["side"] == "buy" else p >= m["price"] for p in side)
            last = sorted(sizes[-200:])
            mid = (last[(len(last) - 1) // 2] + last[len(last) // 2]) / 2 if len(last) >= 50 else None
            signed.append(m["size"] if m["side"] == "buy" else -m["size"])
            sizes.append(m["size"])
            out[m["symbol"], m["seq"]] = (round(sum(signed[-buffer:]), 6), round(m["size"] / mid, 6) if mid and m["size"] > 5 * mid else None, min(reached, 5))
            continue
        for name in ("bids", "asks"):
            if m["kind"] == "snapshot":
                book[name].clear()
            for price, size in tape.levels_in(m[name]):
                if size > 0:
                    book[name][price] = size
                elif m["kind"] == "delta":
                    book[name].pop(price, None)
    return out


def test_tape_at_several_triggers_and_after_a_restart(spark, tmp_path):
    rng = random.Random(9)
    names = [c.split()[0] for c in live.MESSAGE.split(", ")]
    rows = []
    for i in range(900):
        base = {"symbol": rng.choice("AB"), "ts": START + dt.timedelta(milliseconds=i * 40), "seq": i, "price": None, "size": None, "side": None, "bids": None, "asks": None}
        if rng.random() < 0.6:
            base |= {"kind": "trade", "price": float(rng.randint(1, 30)), "size": rng.choice([1.0, 2.0, 30.0]), "side": rng.choice(["buy", "sell"])}
        else:
            level = lambda: json.dumps([[str(rng.randint(1, 30)), str(rng.choice([0, 1, 5]))] for _ in range(3)] + [["x", "1"]])
            base |= {"kind": "snapshot" if rng.random() < 0.05 else "delta", "bids": level(), "asks": rng.choice([level(), None, "{", "5"])}
        rows.append(base)
    folder = tmp_path / "in"
    want = naive_tape(rows, 70)
    for part in range(5):
        some = [tuple(r[n] for n in names) for r in rows[part * 180 : part * 180 + 180]]
        spark.createDataFrame(some, live.MESSAGE).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        if part in (1, 4):  # the second call goes on from the first one's checkpoint
            stream = tape.stream_tape(spark.readStream.schema(live.MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}"), trades=70)
            got = drain(stream, tmp_path / "q").collect()
    assert {(r.symbol, r.seq): (round(r.cvd, 6), None if r.print_ratio is None or math.isnan(r.print_ratio) else round(r.print_ratio, 6), r.levels) for r in got} == want and len(got) == len(want)


def test_batch_tape_is_the_stream_without_a_book(spark, tmp_path):
    rng = random.Random(4)
    rows = [("A", START + dt.timedelta(seconds=i), i, "trade", 1.0, rng.choice([1.0, 9.0]), rng.choice(["buy", "sell"]), None, None) for i in range(300)]
    m = spark.createDataFrame(rows, live.MESSAGE)
    m.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    got = drain(tape.stream_tape(spark.readStream.schema(live.MESSAGE).parquet(f"file://{tmp_path}/in"), trades=90), tmp_path / "q")
    shape = lambda df: sorted((r.seq, round(r.cvd, 6), round(r.print_ratio, 6) if r.print_ratio and not math.isnan(r.print_ratio) else None) for r in df.collect())
    assert shape(got) == shape(tape.batch_tape(m, 90))


def test_silence_is_told_once(spark, tmp_path):
    """A gap inside a trigger, one between triggers that the timer tells first, and an open one."""
    def put(rows):
        spark.createDataFrame([(s, START + dt.timedelta(minutes=m)) for s, m in rows], "symbol string, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        s = spark.readStream.schema("symbol string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        got = drain(tape.stream_silence(s, 3600, "1 minute"), tmp_path / "q").collect()
        return sorted((r.symbol, (r.last_ts - START).total_seconds() / 60, (r.alert_ts - START).total_seconds() / 60) for r in got)

    put([("A", 0), ("A", 100), ("B", 90), ("B", 150)])
    assert run() == [("A", 0.0, 60.0)]
    put([("B", 200)])
    assert run() == [("A", 0.0, 60.0), ("A", 100.0, 160.0)]  # by its timer, without a row of its own
    put([("A", 300), ("B", 230)])
    put([("B", 330)])
    assert run() == [("A", 0.0, 60.0), ("A", 100.0, 160.0), ("B", 230.0, 290.0)]
    put([("B", 400)])
    assert run()[2:] == [("A", 300.0, 360.0), ("B", 230.0, 290.0), ("B", 330.0, 390.0)]


def test_stream_join_equals_batch_and_its_state_ends(spark, data, tmp_path):
    e, o = spark.read.parquet(f"{data}/events.parquet"), spark.read.parquet(f"{data}/orders.parquet")
    trades, books = feeds.book_trades(e), feeds.books(o)
    days = 10
    for name, df in (("t", trades), ("b", books)):
        for day in range(0, 30, 30 // days):  # files in order of time
            low = START + dt.timedelta(days=day)
            df.where((F.col("ts") >= low) & (F.col("ts") < low + dt.timedelta(days=30 // days))).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
    opened = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")
    seen = []
    got = drain(tape.stream_levels(opened("t", trades), opened("b", books), "30 minutes"), tmp_path / "q", seen)
    want = {r.id: r.levels for r in joins.levels_eaten(trades, books, 1800).collect()}
    found = {r.id: r.levels for r in got.collect()}
    assert len(found) == got.count() >= 0.95 * len(want) and all(want[i] == n for i, n in found.items())
    rows = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in seen if p["stateOperators"]]
    assert len(rows) >= days and max(rows[2:]) < 4 * (e.count() + o.count()) / days and rows[-1] < max(rows)


def test_stream_levels_meet_by_spans_of_time(spark, tmp_path):
    """One symbol's rows are dealt out by spans, and each trade has its row, also where ids repeat in a minute."""
    at = lambda s: START + dt.timedelta(seconds=s)
    t = spark.createDataFrame([("A", i // 2, at(i * 20), "buy" if i % 3 else "sell", float(i % 40)) for i in range(900)] + [(None, 1, at(50), "buy", 99.0)], "symbol string, id long, ts timestamp, side string, price double")
    level = lambda p: [(float(p + j), 1.0) for j in range(5)]
    b = spark.createDataFrame([("A", at(i * 70 + 1), level(i % 30), level(i % 25)) for i in range(260)] + [(None, at(40), level(1), level(1))], "symbol string, ts timestamp, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>")
    t.coalesce(1).write.parquet(f"file://{tmp_path}/t")
    b.where("minute(ts) % 20 < 12").coalesce(1).write.parquet(f"file://{tmp_path}/b")
    opened = lambda name, df: spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/{name}")
    stream = tape.stream_levels(opened("t", t), opened("b", b), "5 minutes")
    assert "StreamingSymmetricHashJoin" not in stream._jdf.queryExecution().toString()
    got = sorted((r.symbol or "", r.ts, r.id, r.levels) for r in drain(stream, tmp_path / "q").collect())
    kept = spark.read.schema(b.schema).parquet(f"file://{tmp_path}/b")
    want = sorted((r.symbol or "", r.ts, r.id, r.levels) for r in joins.levels_eaten(t.where("symbol is not null"), kept, 300).collect())
    shut = max(r[1] for r in got)
    assert [g for g in got if g[0]] == [w for w in want if w[1] <= shut] and len(got) > 700 and len({(g[0], g[2]) for g in got}) < len(got)
    assert [g[3] for g in got if not g[0]] == [0] and shut >= min(at(899 * 20), kept.agg(F.max("ts")).first()[0]) - dt.timedelta(minutes=17)


def test_paged_source_goes_on_without_loss_or_repeats(spark, data, tmp_path):
    spark.dataSource.register(candles.PagedCandles)
    options = feeds.paged_options(spark, data) | {"limit": "7"}
    whole = spark.read.format("paged_candles").options(**options).load()
    want = sorted(map(tuple, whole.collect()))
    assert want and len({r[:2] for r in want}) == len(want) and whole.rdd.getNumPartitions() == 15
    start, end, hour = int(options["start"]), int(options["end"]), 3_600_000
    middle = start + (end - start) // 2 // hour * hour
    for until in (middle, middle, end):
        stream = spark.readStream.format("paged_candles").options(**(options | {"end": str(until)})).load()
        got = sorted(map(tuple, drain(stream, tmp_path / "q").collect()))
        assert got == [r for r in want if r[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1000 < until]


def test_live_correlation_with_and_without_today(spark):
    """On each bar numpy's correlation of the closed days and the day so far; a day on which the macro is silent counts closed days only."""
    import numpy as np

    from barline.operators import features as X

    rng = np.random.default_rng(3)
    rows = {"A": [], "M": []}
    for day in range(25):
        for hour in (1, 9, 17):
            for s in rows:
                if not (s == "M" and (day in (7, 20) or (day == 15 and hour == 1))):
                    rows[s].append((s, START + dt.timedelta(days=day, hours=hour), 100 + float(rng.standard_normal())))
    table = lambda s: spark.createDataFrame(rows[s], "symbol string, ts timestamp, close double")
    got = {r.ts: r["corr"] for r in X.live_correlation(table("A"), table("M"), 10).collect()}

    def returns(s, until):
        last = {}
        for _, ts, c in rows[s]:
            if ts <= until:
                last[ts.date()] = c
        days = sorted(last)
        return {b: last[b] / last[a] - 1 for a, b in zip(days, days[1:])}

    assert len(got) == 75
    for ts, value in got.items():
        a, m = returns("A", ts), returns("M", ts)
        both = sorted(a.keys() & m.keys())[-10:]
        if len(both) < 5:
            assert value is None
        else:
            assert abs(value - np.corrcoef([a[d] for d in both], [m[d] for d in both])[0, 1]) < 1e-9


def test_cached_latest_keeps_what_a_fetch_brought(spark):
    requests = spark.createDataFrame([(1, 0), (2, 5), (3, 9), (4, 10), (5, 10), (6, 30)], "id long, at long")
    source = spark.createDataFrame([(1, "x"), (9, "y"), (25, None), (31, "z")], "at long, report string")
    got = sorted((r.id, r.fetched, r.fetched_at, r.report) for r in spacing.cached_latest(requests, source, 10, ["report"]).collect())
    assert got == [(1, True, 0, None), (2, False, 0, None), (3, False, 0, None), (4, True, 10, "y"), (5, False, 10, "y"), (6, True, 30, None)]


def test_cached_latest_of_reports_of_one_moment(spark):
    """Of reports of the same moment the greatest counts, in whichever order they come."""
    requests = spark.createDataFrame([(1, 3), (2, 4), (3, 25)], "id long, at long")
    reports = [(2, "b"), (2, "c"), (2, "a"), (20, "x"), (20, "z"), (20, "y")]
    for given in (reports, reports[::-1], sorted(reports)):
        source = spark.createDataFrame(given, "at long, report string").coalesce(1)
        for bucket in (None, 7):
            got = sorted((r.id, r.report) for r in spacing.cached_latest(requests, source, 10, ["report"], bucket=bucket).collect())
            assert got == [(1, "c"), (2, "c"), (3, "z")]


def test_batch_tape_deals_a_symbol_out(spark):
    """Runs of a symbol's trades give what one fold over all of them gives, with sizes missing, moments shared and a pause of days."""
    rng = random.Random(8)
    rows = [("A", START + dt.timedelta(seconds=i // 3 + (i > 2000) * 400_000), i, rng.choice(["buy", "sell"]), 1.0, None if 700 < i < 1000 or rng.random() < 0.05 else rng.choice([0.1, 1.0, 9.5])) for i in range(4000)]
    rows += [(None, START, 1, "sell", 1.0, 2.5)]
    trades = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, side string, price double, size double").repartition(3)
    dealt = tape.in_runs(trades, ["symbol"], ["ts", "seq"], "ts", 800, 200)
    assert max(r["count"] for r in dealt.groupBy("symbol", "_run").count().collect()) == 1000 and dealt.where("_own").count() == len(rows)
    got = {(r.symbol, r.seq): (r.cvd, r.print_ratio) for r in tape.batch_tape(trades, 90).collect()}
    assert len(got) == len(rows) and got[None, 1] == (-2.5, None)
    for i in range(4000):
        size = rows[i][5]
        held = [r[5] if r[3] == "buy" else -r[5] for r in rows[max(0, i - 89) : i + 1] if r[5] is not None]
        last = sorted(r[5] for r in rows[max(0, i - 200) : i] if r[5] is not None)
        mid = (last[(len(last) - 1) // 2] + last[len(last) // 2]) / 2 if len(last) >= 50 else None
        cvd, ratio = got["A", i]
        assert (cvd is None) == (not held) and (not held or abs(cvd - sum(held)) < 1e-9)
        assert ratio == (size / mid if mid and size is not None and size > 5 * mid else None)


def test_table_feed_holds_bars_not_ticks(spark, tmp_path):
    """Pages of a table of shuffled ticks, read in small batches: bars as over all ticks, and memory that doesn't grow with the ticks of a page."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, n = np.random.default_rng(2), 400_000
    ms = rng.permutation(n) * (20 * 3_600_000 // n)
    value, size = rng.integers(1, 10**6, n) / 100, rng.integers(1, 9, n)
    t = pa.table({
        "event_id": np.arange(n), "ts": pa.array(1704067200_000_000 + ms * 1000, pa.timestamp("us")), "event_type": ["A"] * n, "value": value, "props": [f'{{"k": {k}}}' for k in size],
    })
    pq.write_table(t, f"{tmp_path}/e.parquet", row_group_size=50_000)
    start, hour = 1704067200_000, 3_600_000
    want = []
    for h in range(20):
        i = np.flatnonzero(ms // hour == h)
        i = i[np.argsort(ms[i])]
        want.append([start + h * hour, value[i[0]], value[i].max(), value[i].min(), value[i[-1]], float(size[i].sum())])
    del t
    for end in (None, start + 20 * hour):
        feed = candles.TableFeed(f"{tmp_path}/e.parquet", hour, end)
        pool = pa.system_memory_pool()
        before = pa.default_memory_pool()
        pa.set_memory_pool(pool)
        try:
            assert feed("A", start, 7) == want[:7] and feed("A", start + 7 * hour - 5, 30) == want[7:]
            assert feed("B", start, 7) == []
            assert pool.max_memory() < 16e6, pool.max_memory()
        finally:
            pa.set_memory_pool(before)


def test_tape_asks_its_state_once_a_trigger():
    """However many trades a trigger holds, they don't ask the state one by one; a second trigger goes on from the first."""
    import pandas as pd

    calls = []

    class State(dict):
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("put", "update"):
                    self["all"] = args[0]
                elif name == "updateValue":
                    self[args[0]] = args[1]
                elif name == "removeKey":
                    del self[args[0]]
                elif name == "clear":
                    dict.clear(self)
                else:
                    return {"exists": lambda: bool(len(self)), "get": lambda: iter(self["all"]) if isinstance(self["all"], list) else self["all"], "iterator": lambda: iter([(k, v) for k, v in self.items()]),
                            "getValue": lambda k: self.get(k), "containsKey": lambda k: k in self}[name](*args)
            return call

        clear = property(lambda self: self.__getattr__("clear"))
        get = property(lambda self: self.__getattr__("get"))

    class Handle:
        def __getattr__(self, name):
            return lambda *args: State()

    p = tape.TapeProcessor(trades=100)
    p.init(Handle())
    names = [c.split()[0] for c in live.MESSAGE.split(", ")]
    rows = [("A", pd.Timestamp(START) + pd.Timedelta(seconds=i), i, "trade", 5.0, 1.0 + i % 3, "buy", None, None) for i in range(3000)]
    rows.insert(10, ("A", pd.Timestamp(START) + pd.Timedelta(seconds=9), 10_000, "delta", None, None, None, '[["4", "1"]]', '[["5", "1"], ["6", "1"]]'))
    made = []
    for some in (rows[:2000], rows[2000:]):
        frames = [pd.DataFrame(some[i : i + 700], columns=names) for i in range(0, len(some), 700)]
        made += [r for f in p.handleInputRows(("A",), iter(frames), None) for r in f.itertuples()]
    assert len(calls) < 50 and len(made) == 3000
    assert [r.cvd for r in made] == [sum(1.0 + k % 3 for k in range(max(0, i - 99), i + 1)) for i in range(3000)]
    assert [r.levels for r in made] == [0] * 10 + [1] * 2990
