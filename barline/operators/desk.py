"""The trading desk as tables: reports checked and turned into signals, proposals reviewed and opened, feature packs of several timeframes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import journal, signals, simulate
from .bars import resample
from .features import context, flow, structure
from .joins import asof_backward
from .journal import paired
from .metrics import curve_metrics, trade_aggregates
from .simulate import folded
from .spacing import cached_decisions

#: What a report's fields may hold.
ALLOWED = {
    "data_quality": ("FRESH", "DEGRADED", "STALE"), "decision": ("TAKE", "SKIP", "NO_TRADE"), "direction": ("long", "short", "n/a"),
    "regime": ("accumulation", "markup", "distribution", "markdown", "reaccumulation", "redistribution", "indeterminate"),
}
MAX_CONFIDENCE = 0.9


def report_faults() -> Column:
    """Names of a report's faults, in order: fields with a value that isn't allowed, and the entry zone's prices.

    Columns: those of ALLOWED, zone_low and zone_high (both null: no zone), confidence.
    """
    low, high = F.col("zone_low"), F.col("zone_high")
    tests = [(name, ~F.coalesce(F.col(name).isin(*values), F.lit(False))) for name, values in ALLOWED.items()]
    tests += [
        ("zone_incomplete", low.isNull() != high.isNull()), ("zone_not_positive", (low <= 0) | (high <= 0)), ("zone_order", low > high),
        ("confidence", F.col("confidence").isNull()),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests)))


def report_signal(reports: DataFrame, balance: Column, has_open: Column) -> DataFrame:
    """A signal for each report without faults that proposes a trade and breaks no rule: entry in the middle of its zone, its own first
    target, the plan's stop, further targets and size, and a capped confidence."""
    entry = (F.col("zone_low") + F.col("zone_high")) / 2
    side = F.when(F.col("direction").isin("long", "short"), F.col("direction")).otherwise("long")
    plan = simulate.risk_plan(entry, balance, F.lit("long"))
    taken = reports.where((F.size(report_faults()) == 0) & (F.col("decision") == "TAKE") & signals.take_rejection(has_open).isNull())
    named = {"entry_price": entry, **plan, "tp1": F.col("first_target"), "side": side, "signal_confidence": F.least("confidence", F.lit(MAX_CONFIDENCE))}
    return taken.withColumns(named)


def review(proposals: DataFrame, stats: DataFrame, equity: float) -> DataFrame:
    """Proposals with their setup's history, the discipline checks and decision, the risk by Kelly, a size (0 where blocked) and coaching.

    proposals: what `journal.discipline` needs but for the history, and setup, conviction. stats: `journal.setup_stats`.
    """
    known = ["n", "win_rate", "expectancy_r", "avg_win_r", "avg_loss_r"]
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in known}
    joined = proposals.join(stats.select("setup", *known), "setup", "left").withColumns(zero)
    sized = journal.kelly(journal.discipline(joined), F.col("conviction"))
    per_unit = F.abs(F.col("entry") - F.col("stop"))
    size = F.when(F.col("decision") == "BLOCK", 0.0).otherwise(F.round(journal.units(F.col("risk_pct"), F.lit(equity), per_unit), 6))
    failed = lambda level: F.transform(F.filter("checks", lambda c: (c["severity"] == level) & ~c["passed"]), lambda c: F.concat(F.lit(f"{level}:"), c["name"]))
    praise = F.array_compact(F.array(
        F.when(journal.reward_risk(F.col("entry"), F.col("stop"), F.col("target")) >= 3, F.lit("asymmetry")),
        F.when((F.col("n") >= 20) & (F.col("expectancy_r") > 0), F.lit("proven edge")),
    ))
    coaching = F.when(F.col("decision") == "BLOCK", failed("block")).otherwise(F.concat(failed("warn"), praise))
    return sized.withColumns({"size": size, "coaching": coaching})


def committed(reviewed: DataFrame, opened_at) -> DataFrame:
    """Journal rows of the reviewed proposals that aren't blocked, open from now on."""
    return reviewed.where("decision <> 'BLOCK'").select(
        F.col("id").cast("string").alias("trade_id"), "setup", "direction", "entry", "stop", "target", "risk_pct", "size",
        F.lit(opened_at).cast("timestamp").alias("opened_at"), F.lit("OPEN").alias("status"),
    )


def opened(orders: DataFrame) -> DataFrame:
    """The entry event of each order (id, direction, entry, size) with a known direction."""
    return orders.where(F.col("direction").isin("long", "short")).select(
        F.concat(F.lit("p-"), F.col("id").cast("string")).alias("position_id"), F.lit("ENTRY").alias("event"), "direction", F.col("entry").alias("price"), "size", F.lit("OPEN").alias("status")
    )


def analysis_outcome(reviewed: DataFrame, confidence: Column, has_setup: Column) -> DataFrame:
    """Conviction from 1 to 5 by confidence (halves go to the even number), and what becomes of the analysis: SENT, BLOCKED or NO_SETUP."""
    conviction = F.greatest(F.lit(1), F.least(F.lit(5), F.bround(confidence * 5).cast("int")))
    outcome = F.when(~has_setup, "NO_SETUP").when(F.col("decision") == "BLOCK", "BLOCKED").otherwise("SENT")
    return reviewed.withColumns({"conviction": conviction, "outcome": outcome})


def change_since(df: DataFrame, value: str, seconds: int = 3600, keys=("symbol",)) -> Column:
    """Change of `value` against the newest one that is `seconds` to twice as old (null without one)."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-2 * seconds, -seconds)
    return F.col(value) - F.last(value).over(w)


def lens_pack(bars: DataFrame, wider: dict[str, tuple[str, int]], reports: DataFrame | None = None, report_span: int = 30 * 86400) -> DataFrame:
    """Price, flow, structure and context of each bar and, prefixed, of the newest closed bar of each wider timeframe: name -> (interval, its seconds);
    with reports (ts, commercial_bias, managed_bias, alignment, skew) also the intent of the newest one."""

    def lenses(b: DataFrame) -> DataFrame:
        parts = (
            flow(b).select("symbol", "ts", "close", "cvd_full", "aggressor_bias"), structure(b).select("symbol", "ts", "swing_high", "swing_low", "last_bos", "in_premium"),
            context(b).select("symbol", "ts", "session", "atr", "atr_percentile"),
        )
        return functools.reduce(lambda x, y: x.join(y, ["symbol", "ts"]), parts)

    out = lenses(bars)
    for name, (every, seconds) in wider.items():
        wide = lenses(resample(bars, every))
        wide = wide.select("symbol", "ts", *(F.col(c).alias(f"{name}_{c}") for c in wide.columns if c not in ("symbol", "ts", "session")))
        out = asof_backward(out, wide, ["symbol"], wide.columns[2:], lag_seconds=seconds, bucket_seconds=report_span)
    if reports is not None:
        out = asof_backward(out, reports, [], ["commercial_bias", "managed_bias", "alignment", "skew"], bucket_seconds=report_span)
    return out


def feature_pack(bars: DataFrame, wider: dict[str, tuple[str, int]]) -> DataFrame:
    """Flow features of each bar, and of the newest closed bar of each wider timeframe: name -> (interval, its seconds)."""
    names = ["close", "cvd_full", "aggressor_bias"]
    out = flow(bars).select("symbol", "ts", *names)
    for name, (every, seconds) in wider.items():
        wide = flow(resample(bars, every)).select("symbol", "ts", *(F.col(c).alias(f"{name}_{c}") for c in names))
        out = asof_backward(out, wide, ["symbol"], [f"{name}_{c}" for c in names], lag_seconds=seconds)
    return out


def filter_statistics(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions (action TAKE or SKIP, cached) by key: numbers of each, cache hits and their rate."""
    n = F.count("*")
    count = lambda test: F.sum(test.cast("long"))
    return decisions.groupBy(*keys).agg(
        n.alias("n_decisions"), count(F.col("action") == "TAKE").alias("approved"), count(F.col("action") == "SKIP").alias("filtered_out"),
        count(F.col("cached")).alias("cache_hits"), count(~F.col("cached")).alias("cache_misses"), F.avg(F.col("cached").cast("double")).alias("cache_hit_rate"),
    )


def two_arms(signals: DataFrame, answers: DataFrame, ttl: int, keys=("symbol",), bar_seconds: int = 3600, costs=None) -> DataFrame:
    """A strategy and the same behind a model's filter, run over the same bars: (keys, base_*, other_*, delta_*) of their statistics.

    signals: bars with direction, stop and target. answers: (id, decision, error, rejection) for the bars with a direction, the id being
    keys and the bar's second, joined by "|". A setup is the keys and the direction: `spacing.cached_decisions` says what the
    filter lets through, with a cache of `ttl` bars. What it doesn't leaves the bar without an order.
    """
    keys = list(keys)
    ident = F.concat_ws("|", *keys, F.unix_seconds("ts").cast("string"))
    rows = signals.withColumns({"bar": F.row_number().over(Window.partitionBy(*keys).orderBy("ts")).cast("long"), "id": ident})
    decided = cached_decisions(rows.where("direction is not null").select("id", *keys, "direction", "bar"), answers, ttl, [*keys, "direction"])
    passed = decided.where("approved").select("id", F.lit(True).alias("_passed"))
    filtered = rows.join(passed, "id", "left").withColumn("direction", F.when(F.col("_passed"), F.col("direction")))
    arms = rows.drop("bar", "id").withColumn("arm", F.lit("base")).unionByName(filtered.drop("bar", "id", "_passed").withColumn("arm", F.lit("filtered")))
    curves = folded(arms, ["arm", *keys], costs, bar_seconds)
    results = curve_metrics(curves, ["arm", *keys], bar_seconds, *trade_aggregates())
    return paired(results, "arm", "base", "filtered", keys, ["total_return", "sharpe", "n_trades", "win_rate", "mean_r"])


def filter_alpha(arms: DataFrame, key: str, equity: float) -> DataFrame:
    """What a filter adds to the total return of the arm without it, and its worth after the filter's costs.

    arms: key, arm (baseline or filtered), total_return, cost.
    """
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    alpha = pick("filtered", "total_return") - pick("baseline", "total_return")
    return arms.groupBy(key).agg(alpha.alias("filter_alpha"), (alpha * equity - pick("filtered", "cost")).alias("net_alpha"))


def stale(newest: DataFrame, now, seconds: int = 300) -> DataFrame:
    """(symbol, age) of the symbols without data for more than `seconds`; newest: symbol, ts."""
    age = F.lit(now).cast("timestamp").cast("long") - F.max("ts").cast("timestamp").cast("long")
    return newest.groupBy("symbol").agg(age.alias("age")).where(F.col("age") > seconds)
