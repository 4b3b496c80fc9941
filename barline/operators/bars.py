"""Candles: building, resampling, refreshing, validating.

A candle table has (symbol, ts, open, high, low, close, volume); order is always a window's, never physical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CANDLE = ("open", "high", "low", "close", "volume")


def over(keys=("symbol",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts")


def rows(back: int, ahead: int = 0, keys=("symbol",)) -> WindowSpec:
    """The last `back` + 1 rows (and `ahead` following ones)."""
    return over(keys).rowsBetween(-back, ahead)


def history(keys=("symbol",)) -> WindowSpec:
    return over(keys).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, n: int, window: WindowSpec) -> Column:
    """value where the window holds n rows, else null."""
    return F.when(F.count(F.lit(1)).over(window) >= n, value)


def bars_from_ticks(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """OHLCV by symbol and time unit; one shuffle, partially aggregated."""
    first = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", F.date_trunc(unit, "ts").alias("bar")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", first).alias("close"), F.sum("size").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def resample(bars: DataFrame, every: str) -> DataFrame:
    """Wider candles from narrower ones."""
    return bars.groupBy("symbol", F.window("ts", every).getField("start").alias("start")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("start", "ts")


def keep_last(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row for each key, the last to arrive: upserts, refreshed bars, deduplicated downloads.

    The row is carried by a partial aggregate, so a key with many versions is combined before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.col(arrival)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*others), F.col(arrival)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def time_slice(bars: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start))
    return bars if end is None else bars.where(F.col("ts") <= F.lit(end))


def bad_candles(bars: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rule's name."""
    missing = [F.col(c).isNull() for c in CANDLE]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    rule = (
        F.when(any_missing, "missing value")
        .when(F.col("high") < F.col("low"), "high below low")
        .when(F.col("volume") < 0, "negative volume")
    )
    return bars.withColumn("rule", rule).where("rule is not null")


def is_fresh(bars: DataFrame, now, seconds: int = 300) -> DataFrame:
    """(symbol, fresh): whether the newest bar is at most `seconds` old."""
    age = F.lit(now).cast("timestamp").cast("double") - F.max("ts").cast("double")
    return bars.groupBy("symbol").agg((age <= seconds).alias("fresh"))


def timeframe_minutes(bars: DataFrame) -> DataFrame:
    """The most common distance of bars in minutes (the smallest, if several), 1 at least."""
    step = (F.col("ts").cast("double") - F.lag("ts").over(over()).cast("double")) / 60
    counted = bars.withColumn("step", step).where("step is not null").groupBy("symbol", "step").count()
    return counted.groupBy("symbol").agg(
        F.greatest(F.lit(1), F.max_by("step", F.struct("count", -F.col("step"))).cast("int")).alias("minutes")
    )


def by_time_chunks(bars: DataFrame, build, days: int, lookback: int, sums: dict[str, Column] | None = None) -> DataFrame:
    """Apply `build(bars, keys)`, whose frames reach back at most `lookback` rows, to chunks of time.

    One symbol with a long history is then many window partitions instead of one task. Each chunk also
    gets the days before it that hold its `lookback` preceding rows (counted by day, so gaps don't matter), and
    they are dropped afterwards. `sums` are for running sums over the whole history: each row gets, under the
    given name, the sum of its expression over all days before the rows that its chunk sees (`running` adds the rest).
    The plan of days and chunks is small, a row for each symbol and day, and so are the sums' first steps.
    Bars without a symbol or a time belong to no history and are left out.
    """
    sums = sums or {}
    day = F.floor(F.col("ts").cast("double") / 86400)
    totals = [F.sum(e).alias(f"_sum_{name}") for name, e in sums.items()]
    counts = bars.groupBy("symbol", day.alias("_day")).agg(F.count("*").alias("n"), *totals)
    through = Window.partitionBy("symbol").orderBy("_day")
    earlier = through.rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumns({
        "upto": F.sum("n").over(through), "_own": F.floor(F.col("_day") / days),
        **{f"_before_{name}": F.sum(f"_sum_{name}").over(earlier) for name in sums},
    })
    # a chunk sees a day before it if fewer than `lookback` rows lie between them: both meet in buckets of so many rows
    width = max(1, lookback)
    starts = own.groupBy("symbol", F.col("_own").alias("_chunk")).agg(F.min(F.col("upto") - F.col("n")).alias("before"))
    starts = starts.withColumn("_bucket", F.floor(F.col("before") / width))
    bucket = F.floor(F.col("upto") / width)
    near = own.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).join(starts, ["symbol", "_bucket"])
    extra = near.where((F.col("_chunk") > F.col("_own")) & (F.col("before") - F.col("upto") < lookback))
    carried = [f"_before_{name}" for name in sums]
    plan = own.withColumn("_chunk", F.col("_own")).select("symbol", "_day", "_own", "_chunk", *carried)
    plan = plan.union(extra.select("symbol", "_day", "_own", "_chunk", *carried))
    first = Window.partitionBy("symbol", "_chunk").orderBy("_day")
    plan = plan.select("symbol", "_day", "_own", "_chunk", *(F.first(f"_before_{name}").over(first).alias(name) for name in sums))
    copies = bars.withColumn("_day", day).join(plan, ["symbol", "_day"]).drop("_day")
    return build(copies, ("symbol", "_chunk")).where("_own = _chunk").drop("_own", "_chunk")


def running(name: str, value: Column, keys=("symbol",)) -> Column:
    """A sum over the whole history, in a chunk that holds under `name` what came before its rows."""
    here = F.sum(value).over(history(keys))
    return F.coalesce(F.col(name) + here, here, F.col(name))
