"""As-of, interval and window joins of time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], ts: str = "ts", lag_seconds: int = 0, bucket_seconds: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before it.

    Both sides are united and the newest right row is carried forward: one shuffle by key, no pair is
    built. lag_seconds: how long after its time a right row becomes known. bucket_seconds: one key's rows are dealt out by
    spans of time, and a span starts with what the spans before it left (a small table, a row for each key and span), so that
    neither a hot key nor a join without keys meets in one task. Of right rows of one moment the greatest by `values` counts, whatever their order.
    """
    known = F.col(ts).cast("double") + lag_seconds
    l_rows = left.withColumns({"_at": F.col(ts).cast("double"), "_side": F.lit(1), "_right": F.lit(None).cast(_struct(right, values))})
    r_rows = right.select(*keys, known.alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    spans = []
    if bucket_seconds is not None:
        spans = ["_span"]
        both = both.withColumn("_span", F.floor(F.col("_at") / bucket_seconds))
    w = Window.partitionBy(*keys, *spans).orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_right", ignorenulls=True).over(w))
    if bucket_seconds is not None:
        last = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_at", "_right"))).alias("_left")
        ends = both.groupBy(*keys, "_span").agg(last)
        before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "_span", F.last("_left", ignorenulls=True).over(before).alias("_carried"))
        same = [found[k].eqNullSafe(carried[k]) for k in [*keys, "_span"]]
        joined = found.join(carried, same)
        found = joined.select(*(found[c] for c in found.columns if c != "_last"), F.coalesce(found["_last"], carried["_carried"]).alias("_last"))
    return found.where("_side = 1").select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def _struct(df: DataFrame, values: list[str]) -> str:
    return "struct<" + ",".join(f"`{v}`:{df.schema[v].dataType.simpleString()}" for v in values) + ">"


def first_event_in_window(left: DataFrame, events: DataFrame, key: str, lead_minutes: int = 15, lag_minutes: int = 15, impact: str = "high", bucket_minutes: int = 60) -> DataFrame:
    """left with in_news and the name of the earliest event of that impact in [ts - lag, ts + lead].

    A range join by time buckets: an event is posted in each bucket that its window touches, so the join
    is an equi-join and neither side is broadcast or crossed. `key` names the left row.
    """
    width = bucket_minutes * 60
    at = F.col("event_ts").cast("double")
    low, high = at - lead_minutes * 60, at + lag_minutes * 60
    posted = events.where(F.col("impact") == impact).select(
        "name", "event_ts", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("_bucket")
    )
    now = F.col("ts").cast("double")
    hits = left.select(key, "ts", F.floor(now / width).alias("_bucket")).join(posted, "_bucket").where(
        (now >= low) & (now <= high)
    ).groupBy(key).agg(F.min(F.struct("event_ts", "name")).alias("_event"))
    return left.join(hits, key, "left").select(
        *left.columns, F.col("_event").isNotNull().alias("in_news"), F.col("_event.name").alias("event_name")
    )


def upcoming(events: DataFrame, now, hours: float) -> DataFrame:
    """Events from now to the horizon, in order."""
    at, start = F.col("event_ts").cast("double"), F.lit(now).cast("timestamp").cast("double")
    return events.where((at >= start) & (at <= start + hours * 3600)).orderBy("event_ts", "name")


def trailing_window(df: DataFrame, value: str, days: int, out: str, keys=("symbol",)) -> DataFrame:
    """Number and mean of the values of the last `days` days, by a range frame."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-days * 86400, 0)
    return df.withColumns({f"{out}_n": F.count(value).over(w), f"{out}_mean": F.avg(value).over(w)})


def levels_eaten(trades: DataFrame, book: DataFrame, max_age_seconds: float | None = None, bucket_seconds: int | None = None) -> DataFrame:
    """Trades with the number of book levels their price crosses, by the newest book at or before them.

    book: (symbol, ts, bids, asks) with arrays of (price, size), the best first. Books older than max_age_seconds don't count.
    """
    found = asof_backward(trades, book.withColumn("_book_ts", F.col("ts")), ["symbol"], ["bids", "asks", "_book_ts"], bucket_seconds=bucket_seconds)
    if max_age_seconds is not None:
        fresh = F.col("ts").cast("double") - F.col("_book_ts").cast("double") <= max_age_seconds
        found = found.withColumns({c: F.when(fresh, F.col(c)) for c in ("bids", "asks")})
    found = found.drop("_book_ts")
    eaten = F.when(F.col("side") == "buy", F.size(F.filter("asks", lambda x: x["price"] <= F.col("price")))).otherwise(
        F.size(F.filter("bids", lambda x: x["price"] >= F.col("price")))
    )
    return found.withColumn("levels", F.coalesce(F.greatest(eaten, F.lit(0)), F.lit(0))).drop("bids", "asks")


def book_features(book: DataFrame, levels: int = 5) -> DataFrame:
    """Sizes, imbalance and spread of the best `levels`."""
    total = lambda side: F.aggregate(F.slice(side, 1, levels), F.lit(0.0), lambda acc, x: acc + x["size"])
    b, a = F.col("bid_size"), F.col("ask_size")
    return book.withColumns({"bid_size": total("bids"), "ask_size": total("asks")}).withColumns({
        "imbalance": F.when(b + a > 0, (b - a) / (b + a)).otherwise(0.0),
        "spread": F.get("asks", F.lit(0))["price"] - F.get("bids", F.lit(0))["price"],
    })
