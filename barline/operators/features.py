"""Features of each bar from the bars up to it. All of a function's windows share one partitioning and
order, so they cost one shuffle and one sort.

`together` computes features by chunks of time: a symbol's history, however long, is never in one task. Its
warm-up counts are taken within what a chunk sees, which holds more rows than any of them asks for; they
assume that bars have their prices (`bars.bad_candles` finds those without).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .joins import asof_backward
from .bars import by_time_chunks, full, history, over, rows, running

TINY = 1e-12


class Feature(NamedTuple):
    """How columns are made of bars: `build(bars, keys)` with frames of at most `lookback` rows back, sums over all
    days before a chunk, and what follows on the united chunks."""

    build: Callable[[DataFrame, tuple], DataFrame]
    lookback: int
    sums: dict[str, Callable[[], Column]] = {}
    finish: Callable[[DataFrame], DataFrame] | None = None


def together(bars: DataFrame, features: list[Feature], days: int = 30) -> DataFrame:
    """The columns of all the features, by one pass over chunks of `days` days."""

    def build(chunk: DataFrame, keys) -> DataFrame:
        for f in features:
            chunk = f.build(chunk, keys)
        return chunk

    sums = {name: make() for f in features for name, make in f.sums.items()}
    out = by_time_chunks(bars, build, days, max(f.lookback for f in features), sums)
    for f in features:
        out = f.finish(out) if f.finish else out
    return out


def signed_volume() -> Column:
    return F.signum(F.col("close") - F.col("open")) * F.col("volume")


def correlation(a: str, b: str, window) -> Column:
    """Correlation over a window within -1 and 1, null where a side is constant."""
    spread = F.stddev_pop(a).over(window) * F.stddev_pop(b).over(window)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(a, b).over(window), spread)))


def sma(column: str, n: int, keys=("symbol",)) -> Column:
    w = rows(n - 1, keys=keys)
    return full(F.avg(column).over(w), n, w)


def true_range(keys=("symbol",), first_bar: bool = False) -> Column:
    """first_bar: whether a symbol's first bar has one (its high less its low)."""
    before = F.lag("close").over(over(keys))
    whole = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return whole if first_bar else F.when(before.isNotNull(), whole)


def with_tr(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    return bars.withColumn("tr", true_range(keys)).withColumn("n_tr", F.count("tr").over(history(keys)))


def atr(n: int, keys=("symbol",)) -> Column:
    """Mean of the last n true ranges, 0 before there are n. Needs with_tr."""
    return F.when(F.col("n_tr") >= n, F.avg("tr").over(rows(n - 1, keys=keys))).otherwise(0.0)


def session(hour: Column) -> Column:
    return (
        F.when((hour >= 13) & (hour < 16), "ny-overlap").when((hour >= 7) & (hour < 16), "london")
        .when(hour < 9, "asia").when((hour >= 13) & (hour < 22), "ny").otherwise("off-hours")
    )


def line_value() -> Column:
    """Where the close stands between low and high, from -1 to 1."""
    span = F.col("high") - F.col("low")
    return F.when(span == 0, 0.0).otherwise((2 * F.col("close") - F.col("high") - F.col("low")) / span)


def accumulation_of(extreme: float = -50.0) -> Feature:
    def build(bars, keys):
        w = over(keys)
        last3, last4, last20 = rows(2, keys=keys), rows(3, keys=keys), rows(19, keys=keys)
        n = lambda frame: F.count(F.lit(1)).over(frame)
        mean = F.avg("volume").over(last20)
        df = bars.withColumn("clv", line_value())
        # a running sum's last digits depend on the order of its terms; they must not make a turn
        df = df.withColumn("ad", F.round(running("ad", F.col("clv") * F.col("volume"), keys), 6)).withColumn("ma", sma("close", 20, keys))
        one, two = F.lag("ad", 1).over(w), F.lag("ad", 2).over(w)
        return df.withColumns({
            "ad_extreme": F.coalesce((n(last3) >= 3) & (F.max("ad").over(last3) < extreme), F.lit(False)),
            "ad_turning_up": F.coalesce((one < two) & (F.col("ad") > one), F.lit(False)),
            "ad_improving": F.coalesce((n(last4) >= 4) & (two < one) & (one < F.col("ad")), F.lit(False)),
            "ma_rising": F.col("ma") > F.lag("ma").over(w),
            "volume_average": full(mean, 20, last20),
            "volume_spike": (n(last20) >= 20) & (F.col("volume") > 2 * mean),
            "volume_ratio": F.when(mean > 0, F.col("volume") / mean).otherwise(1.0),
        })

    return Feature(build, 21, {"ad": lambda: line_value() * F.col("volume")})


def accumulation(bars: DataFrame, extreme: float = -50.0) -> DataFrame:
    """clv, ad and its states, moving averages and volume ratios."""
    return together(bars, [accumulation_of(extreme)])


def _flow(bars: DataFrame, keys) -> DataFrame:
    mean = F.avg("volume").over(rows(19, keys=keys))
    return bars.withColumn("signed", signed_volume()).withColumns({
        "cvd_full": running("cvd_full", F.col("signed"), keys),
        "cvd_recent": F.sum("signed").over(rows(9, keys=keys)),
        "volume_total": running("volume_total", F.col("volume"), keys),
        "volume_avg": mean,
        "flow_spike": F.col("volume") > 2 * mean,
        "flow_ratio": F.when(mean > 0, F.col("volume") / mean).otherwise(1.0),
        "close_vs_open_bp": (F.col("close") - F.col("open")) / F.when(F.col("open") == 0, 1.0).otherwise(F.col("open")) * 10000,
    }).withColumn(
        "aggressor_bias", F.when(F.col("cvd_recent") > 0, "buy").when(F.col("cvd_recent") < 0, "sell").otherwise("neutral")
    ).drop("signed")


FLOW = Feature(_flow, 19, {"cvd_full": signed_volume, "volume_total": lambda: F.col("volume")})


def flow(bars: DataFrame) -> DataFrame:
    """Signed-volume sums, volume spike without a warm-up, close against open in bp."""
    return together(bars, [FLOW])


def live_flow(snapshots: DataFrame) -> DataFrame:
    """Flow of symbols without candles, from the newest live snapshot alone.

    snapshots: symbol, ts, cvd_full, cvd_recent, ob_imbalance, ob_spread, sweeps and prints (arrays); missing values count as none.
    """
    values = [c for c in snapshots.columns if c not in ("symbol", "ts")]
    newest = snapshots.groupBy("symbol").agg(F.max_by(F.struct(*values), "ts").alias("s"))
    recent = F.coalesce("s.cvd_recent", F.lit(0.0))
    return newest.select(
        "symbol", F.coalesce("s.cvd_full", F.lit(0.0)).alias("cvd_full"), recent.alias("cvd_recent"),
        F.when(recent > 0, "buy").when(recent < 0, "sell").otherwise("neutral").alias("aggressor_bias"), "s.ob_imbalance", "s.ob_spread",
        F.coalesce(F.size("s.sweeps"), F.lit(0)).alias("n_sweeps"), F.coalesce(F.size("s.prints"), F.lit(0)).alias("n_prints"), F.lit("live").alias("source"),
    )


def order_flow(bars: DataFrame, lookback: int = 20, print_factor: float = 2.5) -> DataFrame:
    """Approximate CVD, its correlation with price, share of buying and large prints, over `lookback` bars.

    The correlation of sums restarted in each window equals that of sums that run through a chunk (it doesn't depend on a shift).
    """

    def build(bars, keys):
        w = rows(lookback - 1, keys=keys)
        df = bars.withColumn("signed", signed_volume())
        df = df.withColumns({"cum": F.sum("signed").over(history(keys)), "path": F.sum(F.col("close") - F.col("open")).over(history(keys))})
        buy = F.sum(F.when(F.col("signed") > 0, F.col("signed")).otherwise(0.0)).over(w)
        both = F.sum(F.abs("signed")).over(w)
        flat = (F.stddev_pop("cum").over(w) < TINY) | (F.stddev_pop("path").over(w) < TINY)
        volumes, mid = F.collect_list("volume").over(w), F.percentile("volume", F.lit(0.5)).over(w)
        return (
            df.withColumns({"volumes": volumes, "mid": mid, "cvd_approx": F.sum("signed").over(w)})
            .withColumns({
                "cvd_divergence": F.when(flat | (F.count(F.lit(1)).over(w) < 2), 0.0).otherwise(correlation("cum", "path", w)),
                "buy_share": F.when(both > 0, buy / both).otherwise(0.5),
                "large_prints": F.size(F.filter("volumes", lambda v: (v > print_factor * F.col("mid")) & (F.col("mid") > 0))),
            })
            .drop("signed", "cum", "path", "volumes", "mid")
        )

    return together(bars, [Feature(build, lookback)])


def context(bars: DataFrame, history_bars: int = 500) -> DataFrame:
    """Session, weekday, hour, ATR(14) and its share of the last `history_bars` ATRs that are not larger."""

    def build(bars, keys):
        df = with_tr(bars, keys).withColumn("atr", atr(14, keys))
        df = df.withColumn("warm", F.when(F.col("n_tr") >= 14, F.col("atr")))
        df = moving_share(df, "warm", history_bars, "share", keys)
        hour = F.hour("ts")
        return df.withColumns({
            "session": session(hour), "day_of_week": F.date_format("ts", "EEEE"), "hour_utc": hour,
            "atr_percentile": F.when(F.col("n_tr") >= 15, F.col("share")),
        }).drop("warm", "share", "tr", "n_tr")

    return together(bars, [Feature(build, history_bars + 16)], days=180)


def moving_share(bars: DataFrame, column: str, n: int, out: str, keys=("symbol",)) -> DataFrame:
    """Share of the last n non-null values that are not larger than the newest one.

    For long frames: a list of each frame would cost n for every row, so a sorted list is kept by one pass
    over each group of keys (log n searches). Long histories come in chunks of time.
    """
    schema = StructType([*bars.schema, StructField(out, DoubleType())])
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_right, insort

        pdf = pdf.sort_values("ts", kind="stable")
        window: list[float] = []
        order: list[float] = []
        share: list[float | None] = []
        for v in pdf[column].tolist():
            if v is None or v != v:
                share.append(None)
                continue
            order.append(v)
            insort(window, v)
            if len(order) > n:
                window.pop(bisect_right(window, order[len(order) - n - 1]) - 1)
            share.append(bisect_right(window, v + TINY) / len(window))
        pdf[out] = pd.array(share, dtype="Float64").astype("float64") if share else pd.Series([], dtype="float64")
        return pdf

    return bars.groupBy(*keys).applyInPandas(run, schema)


def vol_regime(bars: DataFrame, minutes: int = 60) -> DataFrame:
    """ATR(14), its 90-day percentile, expansion score, slope of 20 closes in bp, regime."""
    span = max(1, 1440 // minutes) * 90

    def build(bars, keys):
        df = with_tr(bars, keys).withColumn("rn", F.row_number().over(over(keys)))
        df = df.withColumns({"atr_14": atr(14, keys), "atr_50": atr(50, keys)})
        df = df.withColumn("atr_or_null", F.when(F.col("n_tr") >= 14, F.col("atr_14")))
        df = moving_share(df, "atr_or_null", span, "share", keys)
        w = rows(19, keys=keys)
        long = F.when(F.col("n_tr") >= 50, F.col("atr_50")).otherwise(F.col("atr_14"))
        mean = F.avg("close").over(w)
        slope = F.regr_slope("close", F.col("rn").cast("double")).over(w)
        warm = F.col("n_tr") >= 14
        df = df.withColumn("raw", F.when(long > 0, F.col("atr_14") / long).otherwise(1.0)).withColumn(
            "slope_bp", F.when(mean == 0, 0.0).otherwise(slope / mean * 10000)
        )
        regime = (
            F.when(~warm, "ranging").when(F.col("raw") > 1.65, "expansion").when(F.abs("slope_bp") < 5, "ranging")
            .when(F.col("slope_bp") > 0, "trending_up").otherwise("trending_down")
        )
        return df.withColumns({
            "atr_percentile_90d": F.coalesce("share", F.lit(0.0)), "regime": regime,
            "expansion_score": F.when(warm, F.least(F.col("raw"), F.lit(3.0)) / 3).otherwise(0.0),
            "slope_bp": F.when(warm, F.col("slope_bp")).otherwise(0.0),
        }).drop("share", "raw", "tr", "n_tr", "rn", "atr_or_null", "atr_50")

    return together(bars, [Feature(build, span + 50)], days=360)


def structure_of(lookback: int = 5) -> Feature:
    """Pivots come from chunks. The last three of each kind are carried on by days: a small table holds those before each day."""

    def build(bars, keys):
        w, around = over(keys), rows(lookback, lookback, keys)
        # the pivot that becomes visible at this bar stands `lookback` bars before it
        whole = F.count(F.lit(1)).over(around) == 2 * lookback + 1
        df = bars.withColumns({
            "ph": F.when(whole & (F.col("high") >= F.max("high").over(around)), F.col("high")),
            "pl": F.when(whole & (F.col("low") <= F.min("low").over(around)), F.col("low")),
        })
        return df.withColumns({c: F.lag(c, lookback).over(w) for c in ("ph", "pl")})

    def newest(values, n=3):
        return F.slice(values, F.greatest(F.lit(1), F.size(values) - (n - 1)), n)

    def finish(df):
        df = df.withColumn("_day", F.to_date("ts"))

        def of_day(c):
            pair = F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c).alias("v")))
            return F.transform(newest(F.array_sort(F.collect_list(pair))), lambda x: x["v"])

        def upto(c):
            # days with pivots alone: each adds one value at least, so three of them hold the last three
            some = F.size(c) > 0
            days = Window.partitionBy("symbol", some).orderBy("_day").rowsBetween(-2, 0)
            return F.when(some, newest(F.flatten(F.collect_list(c).over(days))))

        earlier_days = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        table = df.groupBy("symbol", "_day").agg(of_day("ph").alias("ph"), of_day("pl").alias("pl"))
        table = table.withColumns({c: upto(c) for c in ("ph", "pl")})
        before = [F.last(c, ignorenulls=True).over(earlier_days).alias(f"before_{c}") for c in ("ph", "pl")]
        df = df.join(table.select("symbol", "_day", *before), ["symbol", "_day"])
        keys = ("symbol", "_day")
        for c, best in (("ph", F.array_max), ("pl", F.array_min)):
            # a frame over the pivots alone, carried forward to the bars between them
            pivots = Window.partitionBy(*keys, F.col(c).isNull()).orderBy("ts").rowsBetween(-2, 0)
            earlier = F.coalesce(F.col(f"before_{c}"), F.array().cast("array<double>"))
            df = df.withColumn(f"three_{c}", F.when(F.col(c).isNotNull(), newest(F.concat(earlier, F.collect_list(c).over(pivots)))))
            three = F.coalesce(F.last(f"three_{c}", ignorenulls=True).over(history(keys)), F.col(f"before_{c}"))
            df = df.withColumn(f"three_{c}", three).withColumn(f"best_{c}", best(f"three_{c}"))
        both = F.col("three_ph").isNotNull() & F.col("three_pl").isNotNull()
        df = df.withColumns({
            "swing_high": F.element_at("three_ph", -1), "swing_low": F.element_at("three_pl", -1),
            "range_high": F.when(both, F.col("best_ph")), "range_low": F.when(both, F.col("best_pl")),
        }).withColumn("midpoint", (F.col("range_high") + F.col("range_low")) / 2)
        return df.withColumns({
            "last_bos": F.when(F.col("close") > F.col("swing_high"), "bull").when(F.col("close") < F.col("swing_low"), "bear"),
            "in_premium": F.col("close") > F.col("midpoint"),
        }).drop("_day", *(f"{p}{c}" for p in ("", "before_", "three_", "best_") for c in ("ph", "pl")))

    return Feature(build, 2 * lookback, {}, finish)


STRUCTURE = structure_of()


def structure(bars: DataFrame, lookback: int = 5) -> DataFrame:
    """Last swing points, break of structure, dealing range. A pivot needs `lookback` bars on each side, so it
    is seen only `lookback` bars later."""
    return together(bars, [structure_of(lookback)])


def fair_value_gaps(bars: DataFrame, max_age: int = 50, keep: int = 5) -> DataFrame:
    """bullish_fvgs, bearish_fvgs: arrays of the newest `keep` gaps (low, high, ts, index) of the last bars."""

    def build(bars, keys):
        w, age = over(keys), rows(max_age - 1, keys=keys)
        df = bars.withColumns({"rn": running("rn", F.lit(1), keys) - 1, "h2": F.lag("high", 2).over(w), "l2": F.lag("low", 2).over(w)})

        def gap(test, low, high):
            return F.when(test, F.struct(low.alias("low"), high.alias("high"), F.col("ts"), F.col("rn").alias("index")))

        df = df.withColumns({
            "bull": gap(F.col("h2") < F.col("low"), F.col("h2"), F.col("low")),
            "bear": gap(F.col("l2") > F.col("high"), F.col("high"), F.col("l2")),
        })
        newest = lambda c: F.collect_list(c).over(age)
        df = df.withColumns({"bullish_fvgs": newest("bull"), "bearish_fvgs": newest("bear")})
        tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - (keep - 1)), keep)
        return df.withColumns({c: tail(c) for c in ("bullish_fvgs", "bearish_fvgs")}).drop("rn", "h2", "l2", "bull", "bear")

    return together(bars, [Feature(build, max_age + 2, {"rn": lambda: F.lit(1)})])


def confluence(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """The trade-mining frame. Its true range exists on the first bar too."""
    w, last14 = over(keys), rows(13, keys=keys)
    df = bars.withColumns({"ma50": sma("close", 50, keys), "ma200": sma("close", 200, keys), "tr": true_range(keys, True)})
    ago = F.lag("close", 20).over(w)
    hour = F.hour("ts")
    inside = lambda a, b: ((hour >= a) & (hour < b)).cast("int")
    df = df.withColumn("atr14", full(F.avg("tr").over(last14), 14, last14))
    return df.withColumns({
        "ma50_slope_bp": (F.col("ma50") - F.lag("ma50", 20).over(w)) / F.col("ma50") * 10000,
        "dist_ma50_bp": (F.col("close") - F.col("ma50")) / F.col("ma50") * 10000,
        "below_ma200": F.coalesce(F.col("close") < F.col("ma200"), F.lit(False)).cast("int"),
        "atr_pct": F.col("atr14") / F.col("close") * 10000,
        "ret20_bp": (F.col("close") / ago - 1) * 10000,
        "hour": hour, "london": inside(7, 16), "ny": inside(13, 22), "ny_overlap": inside(13, 16),
    }).drop("tr")


CONFLUENCE = Feature(confluence, 220)


def _indicators(bars: DataFrame, keys) -> DataFrame:
    df = with_tr(bars, keys)
    return df.withColumns({
        "sma50": sma("close", 50, keys), "atr14": atr(14, keys), "cvd": running("cvd", signed_volume(), keys), "session": session(F.hour("ts")),
    }).drop("tr", "n_tr")


INDICATORS = Feature(_indicators, 50, {"cvd": signed_volume})


def daily_returns(series: DataFrame, value: str = "close") -> DataFrame:
    """(symbol, day, ret): change of each day's last value."""
    days = series.where(F.col(value).isNotNull()).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by(value, "ts").alias("last"))
    w = Window.partitionBy("symbol").orderBy("day")
    return days.withColumn("ret", F.col("last") / F.lag("last").over(w) - 1).where("ret is not null").select("symbol", "day", "ret")


def rolling_correlation(asset: DataFrame, macro: DataFrame, days: int = 30) -> DataFrame:
    """(symbol, series, day, corr): over the last `days` aligned returns (all, while fewer), null below max(5, days // 2).

    asset: (symbol, day, ret). macro: the same, its symbol becomes `series`.
    """
    pairs = asset.join(macro.select(F.col("symbol").alias("series"), "day", F.col("ret").alias("macro_ret")), "day")
    w = Window.partitionBy("symbol", "series").orderBy("day").rowsBetween(-(days - 1), 0)
    corr = correlation("ret", "macro_ret", w)
    enough = F.count(F.lit(1)).over(w) >= max(5, days // 2)
    return pairs.withColumn("corr", F.when(enough, corr)).select("symbol", "series", "day", "corr")


def live_correlation(asset: DataFrame, macro: DataFrame, days: int = 30) -> DataFrame:
    """(symbol, series, ts, corr) of each bar: over the returns of the last closed days and of the day so far.

    asset, macro: (symbol, ts, close), bars; a macro symbol becomes `series`. A day counts where both sides have a return. Closed days come as
    co-moments (n, sums, squares, products), which the day so far is added to: days - 1 of them with a return of today, which needs
    a macro bar of today at or before the bar, else the last `days`. Series that share no day's return with the asset give no row. Null below max(5, days // 2) returns. Bars meet a row of their day,
    never other days' bars.
    """
    def closes(df, value):
        day = F.to_date("ts").alias("day")
        last = df.where("close is not null").groupBy("symbol", day).agg(F.max_by("close", "ts").alias(value))
        return last.withColumn(f"prev_{value}", F.lag(value).over(Window.partitionBy("symbol").orderBy("day")))

    a, m = closes(asset, "a"), closes(macro, "m").withColumnRenamed("symbol", "series")
    x, y = F.col("a") / F.col("prev_a") - 1, F.col("m") / F.col("prev_m") - 1
    pairs = a.join(m, "day").select("symbol", "series", "day", x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    sums = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"), "sxy": F.col("x") * F.col("y")}
    w = Window.partitionBy("symbol", "series").orderBy("day")
    moments = pairs.select("symbol", "series", F.col("day").cast("timestamp").alias("ts"), *(
        F.struct(*(F.sum(c).over(w.rowsBetween(1 - k, 0)).alias(n) for n, c in sums.items())).alias(f"last_{k}") for k in (days - 1, days)
    ))
    # what a day starts from: a moment before it, and the newest closes of days before it
    starts = a.select("symbol", "day").join(pairs.select("symbol", "series").distinct(), "symbol")
    before = starts.select("symbol", "series", "day", (F.col("day").cast("timestamp") - F.expr("interval 1 day")).alias("ts"))
    before = asof_backward(before, moments, ["symbol", "series"], [f"last_{days - 1}", f"last_{days}"])
    before = asof_backward(before, a.select("symbol", F.col("day").cast("timestamp").alias("ts"), F.col("a").alias("a0")), ["symbol"], ["a0"])
    before = asof_backward(before, m.select("series", F.col("day").cast("timestamp").alias("ts"), F.col("m").alias("m0")), ["series"], ["m0"]).drop("ts")
    bars = asset.where("close is not null").select("symbol", "ts", "close", F.to_date("ts").alias("day")).join(before, ["symbol", "day"])
    live = macro.where("close is not null").select(F.col("symbol").alias("series"), F.to_date("ts").alias("day"), "ts", F.col("close").alias("now"))
    met = asof_backward(bars, live, ["series", "day"], ["now"])
    today = (F.col("close") / F.col("a0") - 1, F.col("now") / F.col("m0") - 1)
    both = F.coalesce(today[0].isNotNull() & today[1].isNotNull(), F.lit(False))
    tx, ty = (F.when(both, t).otherwise(0.0) for t in today)
    extra = {"n": both.cast("double"), "sx": tx, "sy": ty, "sxx": tx * tx, "syy": ty * ty, "sxy": tx * ty}
    total = met.select("symbol", "series", "ts", *(
        (F.coalesce(F.when(both, F.col(f"last_{days - 1}.{k}")).otherwise(F.col(f"last_{days}.{k}")), F.lit(0.0)) + extra[k]).alias(k) for k in sums
    ))
    across = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    corr = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(across > 0, across))
    return total.select("symbol", "series", "ts", F.when(F.col("n") >= max(5, days // 2), corr).alias("corr"))


def macro_regime(dxy: Column, us10y: Column, spx: Column) -> Column:
    known = F.size(F.array_compact(F.array(dxy, us10y, spx)))
    weak = F.size(F.filter(F.array(dxy, us10y, spx), lambda c: F.abs(c) >= 0.2))
    return (
        F.when(known == 0, "unknown").when(weak == 0, "decoupled")
        .when((dxy < -0.3) & (spx < -0.3), "haven_bid").when((dxy < -0.2) & (spx > 0.2), "risk_on")
        .when((dxy > 0.2) & (spx < -0.2), "risk_off").otherwise("decoupled")
    )


def funding_skew(rate: Column) -> Column:
    return F.when(rate.isNull(), None).when(rate > 1e-4, "long-crowded").when(rate < -1e-4, "short-crowded").otherwise("neutral")


def side_bias(net: Column) -> Column:
    return F.when(net > 0, "long").when(net < 0, "short").otherwise("neutral")


def cot_alignment(commercial: Column, managed: Column) -> Column:
    """Whether both groups stand on the same side; null where one of them stands on none."""
    both = commercial.isin("long", "short") & managed.isin("long", "short")
    return F.when(both, F.when(commercial == managed, "aligned").otherwise("commercials_vs_specs"))
