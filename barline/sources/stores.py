"""Tables on a file system: a dataset store, versioned rows, JSON lines, notes with front matter."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import keep_last


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


class DatasetStore:
    """Named Parquet datasets under a root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        parts = [x for x in name.split("/") if x not in ("", ".", "..")]
        if not parts:
            raise ValueError(f"no dataset name: {name!r}")
        return "/".join([self.root, *parts])

    def has(self, name: str) -> bool:
        fs, p, _ = _fs(self.spark, self.path(name))
        return fs.exists(p)

    def read(self, name: str, start=None, end=None, ts: str = "ts") -> DataFrame:
        """Rows from start to end, both included; the range reaches the scan."""
        if not self.has(name):
            raise FileNotFoundError(self.path(name))
        df = self.spark.read.parquet(self.path(name))
        if start is not None:
            df = df.where(F.col(ts) >= F.lit(start))
        return df if end is None else df.where(F.col(ts) <= F.lit(end))

    def write(self, name: str, df: DataFrame, mode: str = "overwrite", keys: list[str] | None = None) -> None:
        """Replace a dataset, or append with the newest row of each key kept. Written aside, then swapped, since
        the old files may be what `df` reads."""
        if mode == "append" and self.has(name):
            old = self.read(name).withColumn("_age", F.lit(0))
            both = old.unionByName(df.withColumn("_age", F.lit(1)), allowMissingColumns=True)
            df = keep_last(both, keys or ["ts"], "_age").drop("_age")
        elif mode not in ("append", "overwrite"):
            raise ValueError(mode)
        target, aside = self.path(name), f"{self.root}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(aside)
        fs, goal, jvm = _fs(self.spark, target)
        fs.mkdirs(goal.getParent())
        before = jvm.org.apache.hadoop.fs.Path(f"{aside}-before")  # what was there stays on disk until the new one is in its place
        had = fs.exists(goal) and fs.rename(goal, before)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), goal):
            if had:
                fs.rename(before, goal)
            raise OSError(f"{target} was not written")
        if had:
            fs.delete(before, True)

    def names(self) -> list[str]:
        """All dataset names; a directory with Parquet files is one."""
        fs, root, _ = _fs(self.spark, self.root)
        found, todo = [], [root] if fs.exists(root) else []
        while todo:
            at = todo.pop()
            status = fs.listStatus(at)
            if any(s.isFile() and s.getPath().getName().endswith(".parquet") for s in status):
                found.append(at.toString().split(root.toString(), 1)[-1].strip("/"))
            todo += [s.getPath() for s in status if s.isDirectory() and not s.getPath().getName().startswith("_")]
        return sorted(found)

    def cached(self, build, **key) -> DataFrame:
        """`build()` materialised once for each set of arguments."""
        digest = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()
        name = f"cache/{digest}"
        if not self.has(name):
            self.write(name, build())
        return self.read(name)


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """Current rows of an append-only table: the newest version of each key. Its columns may be null where a
    version leaves them alone: the last value given counts."""
    others = [c for c in versions.columns if c not in (key, version)]
    return versions.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in others), F.max(version).alias(version))


def open_positions(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("status").isin("OPEN", "PARTIALLY_CLOSED")).orderBy("entry_ts", "position_id")


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that aren't JSON are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def front_matter(text: str) -> tuple[dict, str]:
    """The `key: json` block at a note's start and the rest; a note without one has an empty block."""
    m = re.match(r"---\n(.*?)\n---\n", text, re.DOTALL)
    if m is None:
        return {}, text
    out: dict = {}
    for line in m[1].splitlines():
        key, colon, value = line.partition(":")
        if not colon:
            continue
        try:
            out[key.strip()] = json.loads(value) if value.strip() else None
        except ValueError:
            out[key.strip()] = value.strip()
    return out, text[m.end() :]


def with_front_matter(fields: dict, body: str) -> str:
    head = "\n".join(f"{k}: {json.dumps(v, default=str)}" for k, v in fields.items())
    return f"---\n{head}\n---\n\n{body.strip()}\n"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(name, fields map<string,string> of JSON values, body) of notes, by expressions alone."""
    raw = spark.read.text(path, wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    whole = r"(?s)^---\n(.*?)\n---\n(.*)$"
    has = F.col("value").rlike(whole)
    lines = F.filter(F.split(F.regexp_extract("value", whole, 1), "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    return raw.select(
        "name", F.when(has, F.map_from_entries(pairs)).otherwise(F.expr("map_from_arrays(array(), array())").cast("map<string,string>")).alias("fields"),
        F.when(has, F.regexp_extract("value", whole, 2)).otherwise(F.col("value")).alias("body"),
    )


def relevant_notes(notes: DataFrame, tags: list[str] | None, limit: int = 3, chars: int = 1500, text: str = "body", name: str = "name") -> DataFrame:
    """Notes with any of the tags, whatever their case (all notes, without tags) in order of name, cut to `chars`; the limit is the feature."""
    if tags:
        hit = F.lit(False)
        for t in tags:
            hit = hit | F.lower(F.col(text)).contains(t.lower())
        notes = notes.where(hit)
    return notes.select(name, F.substring(text, 1, chars).alias(text)).orderBy(name).limit(limit)


def experiment_index(events: DataFrame) -> DataFrame:
    """(experiment_id, hypothesis_id, started_at, finished_at, verdict, n_events) from appended events
    (experiment_id, kind start|log|finish, at, hypothesis_id, verdict)."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return events.groupBy("experiment_id").agg(
        of("start", "hypothesis_id").alias("hypothesis_id"), of("start", "at").alias("started_at"), of("finish", "at").alias("finished_at"),
        of("finish", "verdict").alias("verdict"), F.sum((F.col("kind") == "log").cast("long")).alias("n_events"),
    )
