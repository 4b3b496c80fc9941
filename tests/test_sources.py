"""Sources, stores, text functions and streams on small inputs."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from barline.functions import text as T
from barline.sources import candles as C
from barline.sources import reports as P
from barline.sources import settings as Z
from barline.sources import stores as D
from barline.sources.scan import ticks
from barline.streaming import live


def test_broker_csv(spark, tmp_path):
    (tmp_path / "GOLD_M15.csv").write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\n2024.01.02\t10:00:00\t1\t2\t0.5\t1.5\t7\n2024.01.02\t10:00:00\t1\t2\t0.5\t1.6\t8\nbad\tx\t1\t1\t1\t1\t1\n")
    rows = C.read_csv(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.timeframe, r.close, r.volume) for r in rows] == [("GOLD", "15m", 1.6, 8.0)]


def test_pages_end_and_retry():
    bars = [[i * 1000, 1, 2, 0, 1, 5] for i in range(2250)]
    calls = []

    def fetch(symbol, start, limit):
        calls.append(start)
        if len(calls) == 2:
            raise OSError
        return [b for b in bars if b[0] >= start][:limit]

    rows = list(C.read_pages(fetch, "X", 0, 10**9, 1000, wait=lambda s: None))
    assert len(rows) == 2250 and len(calls) == 4
    assert list(C.read_pages(lambda *a: [[0, 1, 1, 1, 1, 1]] * 1000, "X", 0, 10**9, 1000)) == [("X", dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), 1.0, 1.0, 1.0, 1.0, 1.0)]


HEAD = ",".join(o[0] for o in P.COLUMNS.values())


def test_report_zip(spark, tmp_path):
    for year, lines in ((2022, ['2022-12-06,GOLD - COMMODITY EXCHANGE INC.,"1,000",2,3,4,5,6,.,8', "2022-12-13,SILVER,1,2,3,4,5,6,7,8"]), (2023, ["2023-01-03,GOLD - COMMODITY EXCHANGE INC.,1,2,3,4,5,6,7,8"])):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("f_year.txt", "\n".join([HEAD, *lines]))
        (tmp_path / f"{year}.zip").write_bytes(data.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    rows = P.read_report_zips(spark, str(tmp_path)).orderBy("date").collect()
    assert [(str(r.date), r.commercial_net, r.small_spec_long) for r in rows] == [("2022-12-06", 1003.0 - 6, 0.0), ("2023-01-03", -2.0, 7.0)]
    assert [str(r.date) for r in P.read_report_zips(spark, str(tmp_path), end="2022-12-31").collect()] == ["2022-12-06"]
    assert [str(r.date) for r in P.read_report_zips(spark, str(tmp_path), "2022-12-07", "2023-01-03").collect()] == ["2023-01-03"]


def test_report_texts(spark, tmp_path):
    """The first block of the market that has a row of numbers; dates before and after the name; rows with and without interest."""
    row = "All : 900 10 20 30 45 1 60 20 2 0 0 0 0 0 5 6"
    texts = {
        "a": f"Futures (as of December 31, 2024)\nGOLD - COMMODITY EXCHANGE INC.\n{row}\n", "b": "nothing", "c": "",
        "d": f"SILVER - X\n{row}\nGC - Commodity Exchange Inc.\nno row\n" + "x\n" * 20 + f"Gold - Commodity Exchange, Inc.\n\n AS  OF Jan 3 2023 \r\n1,000 2 3 4 5 6 7 8 9 10 11 -12\n",
        "e": f"GOLD - COMMODITY EXCHANGE INC.\nas of Smarch 3, 2024\n{row}", "f": "GOLD - COMMODITY EXCHANGE INC.\n1 2 3",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {(r.report_date, r.commercial_long, r.commercial_short, r.managed_money_long, r.managed_money_short, r.small_spec_long, r.small_spec_net) for r in P.read_report_texts(spark, str(tmp_path)).collect()}
    assert got == {("2024-12-31", 40.0, 65.0, 60.0, 20.0, 5.0, -1.0), ("2023-01-03", 1003.0, 6.0, 6.0, 7.0, 0.0, 0.0), ("", 40.0, 65.0, 60.0, 20.0, 5.0, -1.0)}
    nulls = spark.createDataFrame([(1, None), (2, texts["a"])], "id long, text string")
    assert [r.id for r in P.parse_report_texts(nulls, "id", "text").collect()] == [2]


def test_calendar(spark, tmp_path):
    p = tmp_path / "events.json"
    p.write_text(json.dumps([{"name": "CPI", "timestamp": 1704153600000, "impact": "high"}, {"name": "x"}]))
    own = P.read_calendar(spark, str(p))
    assert [r.name for r in own.collect()] == ["CPI"]
    new = P.recurring_events(spark, "2024-01-15", 2)
    assert sorted(str(r.event_ts) for r in new.collect()) == ["2024-01-05 12:30:00", "2024-01-10 12:30:00", "2024-02-02 12:30:00", "2024-02-14 12:30:00"]
    assert P.merge_calendar(own.unionByName(new), new).count() == 5


def test_store(spark, tmp_path):
    s = D.DatasetStore(spark, str(tmp_path))
    row = lambda i, v: (dt.datetime(2024, 1, 1 + i), float(v))
    make = lambda rows: spark.createDataFrame(rows, "ts timestamp, v double")
    s.write("a/b", make([row(i, i) for i in range(3)]))
    s.write("a/b", make([row(i, 10 + i) for i in range(2, 5)]), "append")
    got = s.read("a/b").orderBy("ts").collect()
    assert [r.v for r in got] == [0.0, 1.0, 12.0, 13.0, 14.0] and s.names() == ["a/b"]
    assert s.read("a/b", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)).count() == 2
    assert s.path("../../x").endswith("/x")
    with pytest.raises(FileNotFoundError):
        s.read("none")


def test_notes(spark, tmp_path):
    (tmp_path / "n.md").write_text(D.with_front_matter({"id": "a", "r": 1.5}, "Body"))
    (tmp_path / "plain.md").write_text("Only text")
    r = {x.name: x for x in D.read_notes(spark, str(tmp_path)).collect()}
    assert r["n.md"].fields == {"id": '"a"', "r": "1.5"} and r["n.md"].body.strip() == "Body" and r["plain.md"].body == "Only text"
    assert D.front_matter((tmp_path / "n.md").read_text())[0] == {"id": "a", "r": 1.5}


def test_sections(spark):
    note = "## Outcome\n\nx\n\n## What actually happened\nold\nold\n\n## One-line lesson\nz\n"
    df = spark.createDataFrame([(note,)], "n string")
    got = df.select(T.replace_section(F.col("n"), "## What actually happened", F.lit("new")).alias("n")).first().n
    assert got == "## Outcome\n\nx\n\n## What actually happened\nnew\n\n## One-line lesson\nz\n"


def test_settings():
    base = {k: {} for k in Z.REQUIRED} | {"TRADING": {"account_risk_pct": 2}, "EXIT_RULES": {"tp_distances": [1, 2, 3]}}
    assert Z.checked(base)["CALENDAR"]["lead_minutes"] == 15
    with pytest.raises(Z.ConfigError):
        Z.checked({})
    out = Z.shadow(base, {"change_id": "c", "target": "config_threshold", "diff": {"path": ["NEW", "x"], "after": 3}})
    assert out["NEW"]["x"] == 3 and "NEW" not in base and out["_PENDING"][0]["change_id"] == "c"
    assert Z.loosened({"constant": "MIN_RR_MULTIPLE", "after": 2.0}) == ["MIN_RR_MULTIPLE"] and Z.loosened({"constant": "MIN_RR_MULTIPLE", "after": 4.0}) == []


@pytest.mark.parametrize("target, diff, path, want", [
    ("validate_take_rule", {"text": " no longs "}, ("_RULES",), ["no longs"]),
    ("lens_weight", {"weights": {"flow": 2}}, ("LENS_WEIGHTS",), {"flow": 2}),
    ("setup_file", {"filename": "a.md", "body": "x"}, ("_SETUPS", "a.md"), "x"),
    ("addendum_section", {"after": "more"}, ("_ADDENDA",), ["more"]),
    ("confidence_calibration", {"table": {"a": 1}}, ("CONFIDENCE_CALIBRATION_TABLE",), {"a": 1}),
    ("config_threshold", {"path": ["A", "b"], "after": 0}, ("A", "b"), 0),
])
def test_changes(target, diff, path, want):
    base = {"A": {"c": 1}}
    out = Z.shadow(base, {"change_id": "1", "target": target, "diff": diff})
    for key in path:
        out = out[key]
    assert out == want and base == {"A": {"c": 1}}


@pytest.mark.parametrize("target, diff", [
    ("nothing", {}), ("config_threshold", {"after": 1}), ("config_threshold", {"path": ["a"]}), ("lens_weight", {"weights": {"mood": 1}}), ("lens_weight", {"weights": {"flow": True}}),
    ("setup_file", {"body": "x"}), ("addendum_section", {"text": " "}), ("confidence_calibration", {"table": 3}),
])
def test_unfit_changes(target, diff):
    with pytest.raises(ValueError):
        Z.shadow({}, {"target": target, "diff": diff})


def test_frames(spark):
    rows = [("T", dt.datetime(2024, 1, 1), 1, json.dumps({"topic": "publicTrade.T", "data": [{"T": 1000, "p": "5", "v": "2", "S": "Buy"}, {"T": 1, "p": "x", "v": "1", "S": "Buy"}]})),
            ("T", dt.datetime(2024, 1, 1), 2, json.dumps({"topic": "orderbook.50.T", "type": "delta", "data": {"b": [["1", "2"]], "a": []}})), ("T", dt.datetime(2024, 1, 1), 3, '{"op": "pong"}')]
    got = live.parse_frames(spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, value string")).orderBy("seq").collect()
    assert [(r.kind, r.side, r.bids) for r in got] == [("trade", "buy", None), ("delta", None, '[["1","2"]]')]
