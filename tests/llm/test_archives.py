"""The ARC converter: formats, round trips, repeats, damage."""

import gzip
import hashlib
import random
import uuid

import pytest

from barline.llm import archives as A

PAGES = "page_id long, url string, html string, key string, payload_digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def brute(rows, least=100):
    first, out = {}, []
    for k, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            first[body] = min(first.get(body, float("inf")), float("inf") if k is None else k)
    seen = set()
    for k, _, html in sorted(rows, key=lambda r: float("inf") if r[0] is None else r[0]):
        body = (html or "").encode()
        again = body in first and body in seen
        seen.add(body)
        out.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["<p>" + "".join(rng.choice("ab é漢\r\n ") for _ in range(rng.choice([5, 60, 400]))) for _ in range(12)] + ["", "\r\n\r\n" * 40, "WARC/1.1\r\n" * 30, "x" * 3_000_000]
    out = [(i, f"http://h/{i} a\tb\n", rng.choice(texts)) for i in range(90)] + [(90, None, None), (91, "", "")]
    return out + [(None, "http://n", texts[2]), (7, "http://again", texts[3]), (-5, "http://neg", texts[4]), (1 << 62, "http://big", "y" * 99)]


def test_report_against_brute_force(spark, rows):
    got = A.report(pages_of(spark, rows).repartition(5))
    assert rows_of(got) == brute(rows)
    assert got.where("not verified").count() == 0


def test_a_third_of_all_rows_alike_and_a_join_instead_of_a_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(A, "maybe_broadcast", lambda table, width: table.hint("merge"))
    some = rows + [(1000 + i, "http://x", "<html>" * 40) for i in range(60)]
    got = A.report(pages_of(spark, some))
    assert rows_of(got) == brute(some) and got.where("refers_to = 1000").count() == 59


def test_empty_table(spark):
    assert A.report(pages_of(spark, [])).collect() == []


def test_converted_files(spark, rows, tmp_path):
    """Both versions: one warcinfo a file, dates and addresses carried over, revisits that name a record there is, unique ids, payloads whole."""
    for version in (1, 2):
        arc, warc = (f"file://{tmp_path}/{k}{version}" for k in ("arc", "warc"))
        A.write_arc(pages_of(spark, rows).coalesce(3), arc, version=version, date="20010203040506")
        index = A.convert(spark, arc, warc)
        assert {r.version for r in index.collect()} == {version} and index.where("fault is not null").count() == 0
        every = A.read_warc(spark, warc, payloads=True).collect()
        files = {r.file for r in every}
        assert len(every) == len(rows) + len(files) and sum(r.type == "warcinfo" for r in every) == len(files)
        assert len({r.record_id for r in every}) == len(every) and all(uuid.UUID(r.record_id.removeprefix("urn:uuid:")) for r in every)
        assert {r.date for r in every} == {"2001-02-03T04:05:06Z"} and all(r.verified for r in every)
        named = {r.record_id: r for r in every if r.type == "response"}
        for r in every:
            if r.type == "revisit":
                assert r.payload == b"" and named[r.refers_to_id].payload_digest == r.payload_digest
            elif r.type == "response":
                assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
        assert {r.url for r in every if r.key == 3} == {"http://h/3%20a%09b%0A"} and {r.url for r in every if r.key == 90} == {"-"}


V1 = (
    b"filedesc://IA-001102.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://www.dryswamp.edu:80/index.html 127.10.100.2 19961104142103 text/html 40\nHTTP/1.0 200 Ok\nServer: x\n\n<p>hi</p>\r\n\r\n\n"
    b"dns:old host.org 127.1.1.1 200001021530 text/dns 9\n20000102\n\n\nhttp://raw 1.2.3.4 x text/plain 3\nraw\n"
)
V2 = (
    b"filedesc://IA-2.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 IA-2.arc 121\n2 0 Alexa Internet\n"
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
    b"http://a/ 127.10.100.2 19961104142103 text/html 200 fac069150613fe55599cc7fa88aa089d - 209 IA-2.arc 22\nHTTP/1.0 200 Ok\n\npay\nx\n\n"
)


@pytest.mark.parametrize("packed", [lambda b: b, gzip.compress, lambda b: b"".join(gzip.compress(b[i : i + 50]) for i in range(0, len(b), 50))])
def test_old_files(spark, tmp_path, packed):
    """Lengths rule, not lines; addresses with spaces; 12 digits; the whole file or members compressed; bytes that are no UTF-8."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.arc").write_bytes(packed(V1.replace(b"raw\n", b"r\xffw\n")))
    (tmp_path / "in" / "2.arc").write_bytes(packed(V2))
    (tmp_path / "in" / "3.arc").write_bytes(b"")
    A.convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = {r.url: r for r in A.read_warc(spark, f"file://{tmp_path}/out", payloads=True).collect() if r.type != "warcinfo"}
    assert {u: (r.type, r.date, r.payload) for u, r in got.items()} == {
        "http://www.dryswamp.edu:80/index.html": ("response", "1996-11-04T14:21:03Z", b"<p>hi</p>\r\n\r\n"),
        "dns:old host.org": ("resource", "2000-01-02T15:30:00Z", b"20000102\n"), "http://raw": ("resource", "1970-01-01T00:00:00Z", b"r\xffw"),
        "http://a/": ("response", "1996-11-04T14:21:03Z", b"pay\nx"),
    }
    assert all(r.verified for r in got.values())


@pytest.mark.parametrize("bad, kept", [(V1[:-60], 2), (V1[:150], 1), (V1.replace(b"dns 9", b"dns x"), 2), (b"no archive", 0), (gzip.compress(V1)[:-30], 0), (V1.replace(b"dns 9", b"dns 99999"), 2)])
def test_damage_is_told(spark, tmp_path, bad, kept):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.arc").write_bytes(bad)
    index = A.convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert [r.type == "fault" for r in index] == [False] * (len(index) - 1) + [True] and index[-1].fault
    if bad[:2] != b"\x1f\x8b":
        assert len(index) - 1 == kept
    assert A.read_warc(spark, f"file://{tmp_path}/out").count() == len(index) - 1


def test_dates():
    assert A.iso_date(b"1999") == "1999-01-01T00:00:00Z" and A.iso_date(b"19990203") == "1999-02-03T00:00:00Z"
    assert {A.iso_date(b) for b in (b"", b"x", b"123", b"123456789012345")} == {"1970-01-01T00:00:00Z"}
