"""Web archives: writes legacy ARC files, converts ARC to WARC, and reads both.

Converter: a file's version block names its version and the fields of its header lines; each record's header line is cut by those
fields and its block read by the declared length. A WARC record is synthesised from each: the type from the block (an HTTP response, or
a resource), the date from the 14 (or fewer) digits, an identifier named by place and content, SHA-256 digests of
block and payload. Of responses with equal payloads of at least `least` bytes the first (smallest key, then date, file and place)
stays a response; the others become revisits that refer to it and keep their HTTP headers, but not the payload.

Scale: a task writes one file of what it reads, and files are read whole by one task each, so a file is as large as a scan's
partition; blocks are streamed out of it. Text writers put the bytes on any file system that Spark knows, so files are
compressed as a whole. Payloads are never shuffled while the table of repeated digests is small enough to be broadcast (its bytes are
summed first); beyond that they are joined with it, and a hot digest's rows are split by the adaptive skew join. First records
come from a pre-aggregated minimum.

Defined results: a null payload is empty, a null key writes no key and comes last. In addresses, white space and control
bytes are percent-encoded; a null or empty one is "-". Unreadable dates are the epoch's start. Rows that repeat a key are records
of their own. A damaged or truncated file gives its records up to the damage and then one row whose `fault` says what is wrong.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import maybe_broadcast
from .shared import fresh_path, removed, saved

#: Fixed values of the formats: the fields of header lines by version, and WARC's names.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: HTTP header that carries a row's key through the archives.
KEY = "X-Archive-Key"
#: Bytes of records in a batch.
BATCH = 4 << 20
#: How the text writers compress: gzip at its fastest level, which takes less than half of the usual one's time for a fifth more bytes.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def as_strings(values: list[bytes]) -> pa.Array:
    """Bytes as an Arrow string column whose text is never decoded; the text writer puts them out as they are."""
    plain = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(plain), plain.buffers())


def field(value, default: bytes = b"-") -> bytes:
    """One field of a header line."""
    raw = b"" if value is None else value if isinstance(value, bytes) else str(value).encode()
    return UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], raw) or default


def http_block(payload: bytes, key, kind: bytes = b"text/html; charset=utf-8") -> bytes:
    named = b"" if key is None else f"{KEY}: {key}\r\n".encode()
    return b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\n%sContent-Length: %d\r\n\r\n%s" % (kind, named, len(payload), payload)


def arc_header(version: int, given: dict[str, bytes]) -> bytes:
    return b" ".join(given.get(name, b"-") for name in ARC_FIELDS[version])


def version_block(version: int, name: bytes, date: bytes) -> bytes:
    body = b"%d 0 barline\n%s\n" % (version, " ".join(ARC_FIELDS[version]).encode())
    line = arc_header(version, {
        "URL": b"filedesc://" + name, "IP-address": b"0.0.0.0", "Archive-date": date, "Content-type": b"text/plain", "Result-code": b"200",
        "Offset": b"0", "Filename": name, "Archive-length": b"%d" % len(body),
    })
    return line + b"\n" + body


def write_arc(
    df: DataFrame, path: str, version: int = 1, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "19960101000000",
) -> None:
    """An ARC file for each partition of df: its version block, then each row as an HTTP response."""

    def run(batches):
        name = b"part-%05d.arc" % TaskContext.get().partitionId()
        out, size, at, started = [], 0, 0, False
        for batch in batches:
            for key, url, payload in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload"))):
                if not started:
                    started = True
                    out.append(version_block(version, name, date.encode()))
                    at = size = len(out[0]) + 1
                block = http_block(payload or b"", key)
                line = arc_header(version, {
                    "URL": field(url), "IP-address": b"0.0.0.0", "Archive-date": field(date), "Content-type": b"text/html", "Result-code": b"200",
                    "Checksum": hashlib.md5(block).hexdigest().encode(), "Offset": b"%d" % at, "Filename": name, "Archive-length": b"%d" % len(block),
                })
                out.append(line + b"\n" + block)
                at += len(out[-1]) + 1
                size += len(out[-1])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([as_strings(out)], ["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([as_strings(out)], ["value"])

    rows = df.select(F.col(key_col).cast("string").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    rows.mapInArrow(run, "value string").write.options(lineSep="\n", **PACKED).text(path)


class Damaged(Exception):
    """What is wrong with a file from here on."""


def opened(content: bytes):
    """A file's bytes as a stream, decompressed where it is compressed (as a whole or record by record)."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def exactly(stream, n: int) -> bytes:
    if n < 0:
        raise Damaged(f"negative length {n}")
    got = stream.read(n)
    if len(got) < n:
        raise Damaged(f"{n} bytes declared, {len(got)} there")
    return got


def number(text: bytes) -> int:
    if not text.strip().isdigit():
        raise Damaged(f"not a length: {text[:40]!r}")
    return int(text)


def arc_records_of(stream):
    """(offset, version, fields by name, block) of a file's records, the version block's first."""
    names, version = None, 1
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():  # records are parted by empty lines
            continue
        line = line.rstrip(b"\r\n")
        if names is None:
            if not line.startswith(b"filedesc:"):
                raise Damaged("no version block")
            length = number(line.rsplit(b" ", 1)[-1])
            body = exactly(stream, length)
            said = body.split(b"\n")
            version = int(said[0].split(b" ")[0]) if said[0].split(b" ")[0].isdigit() else 1
            own = said[1].split() if len(said) > 1 else []
            names = [n.decode("latin-1") for n in own] if len(own) > 1 else list(ARC_FIELDS.get(version, ARC_FIELDS[1]))
            layout = names if len(line.split(b" ")) == len(names) else ARC_FIELDS[1]
            yield at, version, dict(zip(layout, line.rsplit(b" ", len(layout) - 1))), body
            continue
        parts = line.rsplit(b" ", len(names) - 1)  # addresses of old files may hold spaces
        if len(parts) != len(names):
            raise Damaged(f"{len(parts)} fields in a header line of {len(names)}")
        given = dict(zip(names, parts))
        yield at, version, given, exactly(stream, number(given.get("Archive-length", parts[-1])))


def iso_date(digits: bytes) -> str:
    """2001-02-03T04:05:06Z of 14 digits; missing last ones are the least possible."""
    d = digits.decode("latin-1")
    if not d.isdigit() or not 4 <= len(d) <= 14 or len(d) % 2:
        return "1970-01-01T00:00:00Z"
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[int, dict[bytes, bytes]]:
    """Where an HTTP response's payload starts, and its headers by lower-case name; (0, {}) of anything else."""
    if not block.startswith(b"HTTP/"):
        return 0, {}
    m = re.search(rb"\r?\n\r?\n", block)
    end = m.end() if m else len(block)
    pairs = (line.split(b":", 1) for line in block[:end].splitlines()[1:] if b":" in line)
    return end, {k.strip().lower(): v.strip() for k, v in pairs}


def key_of(headers: dict[bytes, bytes]) -> int | None:
    said = headers.get(KEY.lower().encode(), b"")
    return int(said) if re.fullmatch(rb"-?\d{1,19}", said) and -(1 << 63) <= int(said) < 1 << 63 else None


def record_id(*named: bytes) -> str:
    """An identifier that is the same whenever the same record is converted."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b' '.join(named)).digest()[:16], version=5)}"


#: Columns of a converted record but its block.
RECORD = (
    "file string, offset long, version int, type string, record_id string, date string, url string, ip string, content_type string, "
    "key long, head int, payload_bytes long, payload_digest string, block_digest string, fault string"
)


def each_file(batches, parse, names: list[str], kinds: dict):
    """Record batches of about BATCH bytes from parse(file, content) of each file. What a file's damage cuts short ends with a row
    that has its fault."""

    def packed(rows):
        return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, pa.schema([(n, kinds[n]) for n in names]))

    for batch in batches:
        for i in range(batch.num_rows):
            file, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py() or b""
            rows, size = [], 0
            try:
                for row in parse(file, content):
                    rows.append(row)
                    size += 300 + len(row.get("block") or b"")
                    if size >= BATCH:
                        yield packed(rows)
                        rows, size = [], 0
            except (Damaged, EOFError, OSError, zlib.error) as e:
                rows.append({"file": file, "type": "fault", "fault": str(e) or type(e).__name__})
            if rows:
                yield packed(rows)


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def parsed_files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    kinds = {n: ARROW[t] for n, t in (c.split(" ") for c in schema.split(", "))}
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: each_file(batches, parse, list(kinds), kinds), schema)


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of ARC files with what WARC wants of each: RECORD, and `block` if wanted."""

    def parse(file, content):
        for at, version, given, block in arc_records_of(opened(content)):
            first = given["URL"].startswith(b"filedesc:")
            head, headers = (0, {}) if first else http_parts(block)
            digest = hashlib.sha256(memoryview(block)[head:]).hexdigest()
            stamp = given.get("Archive-date", b"")
            yield {
                "file": file, "offset": at, "version": version, "type": "warcinfo" if first else "response" if head else "resource",
                "record_id": record_id(file.encode(), b"%d" % at, given["URL"], stamp, digest.encode()), "date": iso_date(stamp),
                "url": given["URL"].decode("utf-8", "replace"), "ip": given.get("IP-address", b"-").decode("latin-1"),
                "content_type": given.get("Content-type", b"-").decode("latin-1"), "key": key_of(headers), "head": head,
                "payload_bytes": len(block) - head, "payload_digest": digest,
                "block_digest": hashlib.sha256(block).hexdigest(), "block": block if blocks else None,
            }

    return parsed_files(spark, path, parse, RECORD + (", block binary" if blocks else ""))


def warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n%sContent-Length: %d\r\n\r\n%s" % (lines.encode(), len(block), block)


def synthesised(row: dict) -> bytes:
    """A WARC record, but for the empty lines after it, of a row of RECORD, `block` and (for revisits) `first_*`."""
    revisit = row["first_id"] is not None
    block = row["block"][: row["head"]] if revisit else row["block"]
    kind = "application/warc-fields" if row["type"] == "warcinfo" else "application/http;msgtype=response" if row["type"] == "response" else row["content_type"]
    if row["type"] == "warcinfo":
        block = b"software: barline\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version %d\r\n" % row["version"]
    digest = hashlib.sha256(block).hexdigest() if revisit or row["type"] == "warcinfo" else row["block_digest"]
    return warc_record([
        ("WARC-Type", "revisit" if revisit else row["type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", None if row["type"] == "warcinfo" else row["url"]),
        ("WARC-IP-Address", row["ip"] if row["ip"] not in ("-", "0", "0.0.0.0") else None),
        ("WARC-Payload-Digest", None if row["type"] == "warcinfo" else f"sha256:{row['payload_digest']}"), ("WARC-Block-Digest", f"sha256:{digest}"),
        ("WARC-Profile", REVISIT if revisit else None), ("WARC-Refers-To", f"<{row['first_id']}>" if revisit else None),
        ("WARC-Refers-To-Target-URI", row["first_url"]), ("WARC-Refers-To-Date", row["first_date"]),
        ("WARC-Truncated", "length" if revisit else None), ("Content-Type", kind),
    ], block)


def first_payloads(records: DataFrame, least: int) -> DataFrame:
    """(payload_digest, first_*) of every payload that several responses have: the one that stays."""
    able = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= least))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "date", "file", "offset", "record_id", "url")
    firsts = able.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    return firsts.select("payload_digest", *(F.col(f"first.{c}").alias(f"first_{n}") for c, n in (
        ("file", "file"), ("offset", "offset"), ("record_id", "id"), ("url", "url"), ("date", "date"))))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 100) -> DataFrame:
    """WARC files of the ARC files' records; returns RECORD of each record, faults included, as a shared table."""
    index, _ = saved(read_arc(spark, arc_path, blocks=False), "arc-index")
    firsts, path = saved(first_payloads(index, least), "first-payloads")
    firsts = maybe_broadcast(firsts, 160 + F.octet_length("first_url") + F.octet_length("first_file"))
    records = read_arc(spark, arc_path).where("fault is null")
    joined = records.join(firsts, "payload_digest", "left")
    repeats = (F.col("type") == "response") & (F.col("payload_bytes") >= least) & ((F.col("file") != F.col("first_file")) | (F.col("offset") != F.col("first_offset")))
    wanted = [c.split(" ")[0] for c in RECORD.split(", ")] + ["block"]
    planned = joined.select(*wanted, *(F.when(repeats, F.col(f"first_{n}")).alias(f"first_{n}") for n in ("id", "url", "date")))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                out.append(synthesised({n: batch.column(n)[i].as_py() for n in batch.schema.names}))
                size += len(out[-1])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([as_strings(out)], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([as_strings(out)], ["value"])

    planned.mapInArrow(run, "value string").write.options(lineSep="\r\n\r\n", **PACKED).text(warc_path)
    removed(spark, path)
    return index


def warc_records_of(stream):
    """(offset, headers by lower-case name, block) of a file's records."""
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise Damaged("no WARC version line")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.partition(b":")
            headers[k.strip().lower().decode("latin-1")] = v.strip()
        yield at, headers, exactly(stream, number(headers.get("content-length", b"")))


WARC = (
    "file string, offset long, type string, record_id string, date string, url string, refers_to_id string, key long, "
    "payload_bytes long, payload_digest string, verified boolean, fault string"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of WARC files: WARC, and `payload` if wanted. `verified`: the digests are those of the bytes there. A
    revisit's payload length is what its HTTP headers declare."""

    def parse(file, content):
        for at, headers, block in warc_records_of(opened(content)):
            head, http = http_parts(block)
            kind = headers.get("warc-type", b"").decode("latin-1")
            said = headers.get("warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:") or None
            whole = headers.get("warc-block-digest", b"").decode("latin-1").removeprefix("sha256:")
            good = hashlib.sha256(block).hexdigest() == whole
            if kind == "revisit":
                declared = http.get(b"content-length", b"")
                length = int(declared) if declared.isdigit() else None
            else:
                length = len(block) - head
                good = good and (said is None or hashlib.sha256(memoryview(block)[head:]).hexdigest() == said)
            name = lambda h: headers.get(h, b"").decode("latin-1").strip("<>") or None
            yield {
                "file": file, "offset": at, "type": kind, "record_id": name("warc-record-id"), "date": name("warc-date"),
                "url": headers.get("warc-target-uri", b"").decode("utf-8", "replace") or None, "refers_to_id": name("warc-refers-to"),
                "key": key_of(http), "payload_bytes": length, "payload_digest": said, "verified": good,
                "block": block[head:] if payloads else None, "payload": block[head:] if payloads else None,
            }

    return parsed_files(spark, path, parse, WARC + (", payload binary" if payloads else ""))


def report(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified) of every page, read back from WARC files that are
    converted from ARC files of the pages."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    removed(spark, arc)
    found, _ = saved(read_warc(spark, warc).where("type <> 'warcinfo'"), "warc-index")
    removed(spark, warc)
    columns = ["key", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    responses = found.where("type <> 'revisit'")
    named = responses.select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    revisits = found.where("type = 'revisit'").join(named, "refers_to_id", "left")
    both = responses.select(*columns, F.lit(None).cast("long").alias("refers_to"), "verified").unionByName(revisits.select(*columns, "refers_to", "verified"))
    return both.withColumnRenamed("key", "page_id")
