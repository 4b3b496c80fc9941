"""Structured Streaming versions of the live computations.

Event time carries a watermark; what arrives later than it is dropped, which is the policy for late data. Each function takes and
returns a streaming frame; `drained` runs one over what is there now, as tests and catch-up runs do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream of ticks; the time is given a zone, which a watermark needs."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def stream_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candles of closed windows; a refreshed open bar is what update mode emits."""
    at = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"),
    ).select("symbol", F.col("window.start").alias("bar"), "open", "high", "low", "close", "volume")


def stream_cvd(trades: DataFrame, length: str = "60 seconds", every: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Signed volume over a sliding window of event time. trades: with side."""
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    return trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", length, every)).agg(F.sum(signed).alias("cvd"), F.count("*").alias("n"))


def stream_unique(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Ticks without repeated ids; ids are remembered as long as the watermark allows."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "event_id"])


def stream_activity(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))


#: One message of the tape: a trade, or a side of the book (snapshot or delta) as JSON pairs [price, size].
MESSAGE = "symbol string, ts timestamp, seq long, kind string, price double, size double, side string, bids string, asks string"


def parse_frames(raw: DataFrame) -> DataFrame:
    """MESSAGE rows from exchange frames (symbol, ts, seq, value JSON); other topics and malformed frames are left out."""
    topic, kind = F.get_json_object("value", "$.topic"), F.get_json_object("value", "$.type")
    trades = F.from_json(F.get_json_object("value", "$.data"), "array<struct<T:long,p:string,v:string,S:string>>")
    t = raw.where(topic.startswith("publicTrade")).select("symbol", "seq", F.posexplode(trades).alias("n", "m")).select(
        "symbol", F.timestamp_millis("m.T").alias("ts"), (F.col("seq") * 1000 + F.col("n")).alias("seq"), F.lit("trade").alias("kind"),
        F.col("m.p").try_cast("double").alias("price"), F.col("m.v").try_cast("double").alias("size"), F.lower("m.S").alias("side"),
        F.lit(None).cast("string").alias("bids"), F.lit(None).cast("string").alias("asks"),
    ).where("ts is not null and price is not null and size is not null and side in ('buy', 'sell')")
    none = F.lit(None)
    b = raw.where(topic.startswith("orderbook") & kind.isin("snapshot", "delta")).select(
        "symbol", "ts", (F.col("seq") * 1000).alias("seq"), kind.alias("kind"), none.cast("double").alias("price"), none.cast("double").alias("size"),
        none.cast("string").alias("side"), F.get_json_object("value", "$.data.b").alias("bids"), F.get_json_object("value", "$.data.a").alias("asks"),
    )
    return t.unionByName(b)


def stream_cooldown(signals: DataFrame, seconds: int) -> DataFrame:
    """signals (symbol, ts, reason) that come at least so long after the last one that passed: signal intervals, alert
    throttles and message limits."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        keep = []
        for m in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
            at = int(m.ts.value // 1000)
            if last is None or at - last >= seconds * 1_000_000:
                last = at
                keep.append((key[0], m.ts, m.reason))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(keep, columns=["symbol", "ts", "reason"])

    return signals.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, reason string", "last long", "append", GroupStateTimeout.NoTimeout)


def prefer_live(live: str, candle: str, age_ms: str, stale_ms: int = 5000):
    """The live value while it is fresh and not 0, else the candles'."""
    return F.coalesce(F.when(F.col(age_ms) <= stale_ms, F.nullif(F.col(live), F.lit(0.0))), F.col(candle))


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available, into a table under `folder`, and read it. In append mode windows that the
    watermark hasn't closed aren't in it; complete results are written anew on each trigger."""
    spark = stream.sparkSession
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint").outputMode(mode)
    if mode == "append":
        writer.format("parquet").start(f"{at}/out").awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
