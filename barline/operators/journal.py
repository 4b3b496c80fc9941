"""Trade journal, sizing, discipline checks, digests, drift, experiments and costs."""

from __future__ import annotations

import difflib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from ..sources.scratch import removed, saved
from .signals import VAGUE

EVEN = 1e-9
Z95 = 1.959963984540054


def closed_r(direction: Column, entry: Column, stop: Column, exit_price: Column) -> Column:
    risk = F.abs(entry - stop)
    move = F.when(direction == "long", exit_price - entry).otherwise(entry - exit_price)
    return F.when(risk > 0, move / risk).otherwise(0.0)


def reward_risk(entry: Column, stop: Column, target: Column) -> Column:
    risk = F.abs(entry - stop)
    return F.when(risk > 0, F.abs(target - entry) / risk).otherwise(0.0)


def close_trades(trades: DataFrame, closes: DataFrame) -> DataFrame:
    """Journal after closing events (trade_id, exit_price, closed_at, exit_reason, notes); an id that isn't open is left alone."""
    first = closes.groupBy("trade_id").agg(F.min(F.struct("closed_at", "exit_price", "exit_reason", "notes")).alias("_c"))
    hit = F.col("_c").isNotNull() & (F.col("status") == "OPEN")
    r = closed_r(F.col("direction"), F.col("entry"), F.col("stop"), F.col("_c.exit_price"))
    note = F.when(F.coalesce(F.col("_c.notes"), F.lit("")) == "", F.col("notes")).otherwise(
        F.expr("trim(BOTH ' |' FROM concat(coalesce(notes, ''), ' | ', _c.notes))")
    )
    new = {
        "exit_price": F.col("_c.exit_price"), "closed_at": F.col("_c.closed_at"), "exit_reason": F.col("_c.exit_reason"), "r_multiple": r,
        "pnl_account": F.col("risk_pct") / 100 * r, "status": F.lit("CLOSED"), "notes": note,
    }
    return trades.join(first, "trade_id", "left").withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).drop("_c")


def setup_stats(trades: DataFrame) -> DataFrame:
    """(setup, n, wins, losses, breakeven, sum_r, win_rate, expectancy_r, avg_win_r, avg_loss_r) of closed trades."""
    r = F.col("r_multiple")
    win, loss = r > EVEN, r < -EVEN
    count = lambda test: F.sum(test.cast("long"))
    out = trades.where((F.col("status") == "CLOSED") & r.isNotNull()).groupBy("setup").agg(
        F.count("*").alias("n"), count(win).alias("wins"), count(loss).alias("losses"), F.sum(r).alias("sum_r"),
        F.coalesce(F.sum(F.when(win, r)), F.lit(0.0)).alias("sum_win_r"), F.coalesce(F.sum(F.when(loss, r)), F.lit(0.0)).alias("sum_loss_r"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({
        "breakeven": F.col("n") - F.col("wins") - F.col("losses"),
        "win_rate": ratio(F.col("wins").cast("double"), F.col("wins") + F.col("losses")), "expectancy_r": ratio(F.col("sum_r"), F.col("n")),
        "avg_win_r": ratio(F.col("sum_win_r"), F.col("wins")), "avg_loss_r": ratio(F.col("sum_loss_r"), F.col("losses")),
    })


def kelly(stats: DataFrame, conviction: Column, fraction: float = 0.25, low: float = 0.25, high: float = 2.0, default: float = 0.5, min_trades: int = 20) -> DataFrame:
    """Adds full_kelly and risk_pct: fractional Kelly within bounds, scaled by conviction (1 to 5)."""
    w, up, down = F.col("win_rate"), F.col("avg_win_r"), F.abs("avg_loss_r")
    full = F.when((down > 0) & (up > 0) & (w > 0), F.greatest(F.lit(0.0), w - (1 - w) / (up / down))).otherwise(0.0)
    bounded = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    base = F.when(F.col("n") < min_trades, default).when(F.col("full_kelly") <= 0, low).otherwise(bounded(F.col("full_kelly") * fraction * 100))
    scale = 0.7 + (F.greatest(F.lit(1), F.least(F.lit(5), conviction)) - 1) * (0.45 / 4)
    return stats.withColumn("full_kelly", full).withColumn("risk_pct", F.round(bounded(base * scale), 3))


def units(risk_pct: Column, equity: Column, per_unit: Column) -> Column:
    return F.when(per_unit > 0, equity * risk_pct / 100 / per_unit).otherwise(0.0)


def discipline(proposals: DataFrame, min_rr: float = 2.0, min_kill: int = 25, max_open: int = 1, day_cap: float = 4.0, halt: float = 20.0, losing_n: int = 8, news_block: bool = True) -> DataFrame:
    """Adds checks (array of name, passed, severity) and decision.

    Columns: direction, entry, stop, target, thesis, kill_thesis, open_positions, day_pnl_pct, account_dd_pct, in_news,
    and the setup's n and expectancy_r (null: no history).
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    kill = text("kill_thesis")
    n, exp = F.coalesce("n", F.lit(0)), F.coalesce("expectancy_r", F.lit(0.0))
    side_ok = ((F.col("direction") == "long") & (F.col("stop") < F.col("entry"))) | ((F.col("direction") == "short") & (F.col("stop") > F.col("entry")))
    losing = (n >= losing_n) & (exp < 0)
    rules = [
        ("one_position", F.col("open_positions") < max_open, "block"), ("drawdown_halt", F.col("account_dd_pct") < halt, "block"),
        ("daily_loss_cap", F.col("day_pnl_pct") > -day_cap, "block"),
        *([("news_window", ~F.col("in_news"), "block")] if news_block else []),
        ("risk_reward", reward_risk(F.col("entry"), F.col("stop"), F.col("target")) >= min_rr, "block"),
        ("kill_thesis", (F.length(kill) >= min_kill) & ~kill.rlike("(?i)" + VAGUE), "block"),
        ("thesis_present", F.length(text("thesis")) >= 20, "warn"), ("stop_side", side_ok, "block"),
    ]
    check = lambda name, ok, level: F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed"), level.alias("severity"))
    record = F.when(n > 0, check("setup_track_record", ~losing, F.when(losing, "warn").otherwise("info")))
    checks = F.array_compact(F.array(*(check(a, b, F.lit(c)) for a, b, c in rules), record))
    failed = lambda level: F.exists("checks", lambda c: (c["severity"] == level) & ~c["passed"])
    return proposals.withColumn("checks", checks).withColumn(
        "decision", F.when(failed("block"), "BLOCK").when(failed("warn"), "APPROVE_WITH_WARNINGS").otherwise("APPROVE")
    )


def autopsies(positions: DataFrame, events: DataFrame) -> DataFrame:
    """(position_id, result, r_multiple, kill_triggered, tags) of closed positions from their events.

    positions: (position_id, entry, sl, size, direction). events: (position_id, pnl, rule_matched).
    """
    sums = events.groupBy("position_id").agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"), F.bool_or(F.col("rule_matched") == "SL").alias("kill"))
    risk = F.abs(F.col("entry") - F.col("sl"))
    pnl = F.coalesce("pnl", F.lit(0.0))
    result = F.when((risk == 0) | (pnl == 0), "breakeven").when(pnl > 0, "won").otherwise("lost")
    r = F.when((risk == 0) | (pnl == 0), 0.0).otherwise(pnl / F.coalesce(F.nullif("size", F.lit(0.0)), F.lit(1.0)) / risk)
    tags = F.array_compact(F.array(F.col("result"), F.when(F.col("kill_triggered"), "kill-thesis-clean"), F.concat(F.lit("direction:"), "direction")))
    return positions.join(sums, "position_id", "left").withColumns({
        "result": result, "r_multiple": r, "kill_triggered": F.coalesce("kill", F.lit(False))
    }).withColumn("tags", tags).drop("pnl", "kill")


def digest_counts(closed: DataFrame) -> DataFrame:
    """One row: n, wins, losses, breakeven, win_rate, avg_r (nulls left out)."""
    is_ = lambda x: F.sum((F.col("result") == x).cast("long"))
    out = closed.agg(F.count("*").alias("n"), is_("won").alias("wins"), is_("lost").alias("losses"), is_("breakeven").alias("breakeven"), F.avg("r_multiple").alias("avg_r"))
    return out.withColumn("win_rate", F.coalesce(F.try_divide(F.col("wins").cast("double"), F.col("wins") + F.col("losses")), F.lit(0.0)))


def recurring_tags(closed: DataFrame, losing: bool, top: int = 5) -> DataFrame:
    """The tags of at least two trades with the largest total loss (or gain)."""
    tags = closed.select(F.explode("tags").alias("tag"), F.coalesce("r_multiple", F.lit(0.0)).alias("r"))
    by = tags.groupBy("tag").agg(F.count("*").alias("n"), F.sum("r").alias("total_r")).where("n >= 2")
    if losing:
        return by.where("total_r < 0").orderBy("total_r", "tag").limit(top)
    return by.where("total_r > 0").orderBy(F.desc("total_r"), "tag").limit(top)


def wilson(wins: Column, n: Column) -> tuple[Column, Column]:
    n, p, z2 = F.nullif(n, F.lit(0)), F.try_divide(wins, n), Z95 * Z95
    scale = 1 + z2 / n
    mid = (p + z2 / (2 * n)) / scale
    off = Z95 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / scale
    return F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), mid - off)), F.when(n.isNull(), 1.0).otherwise(F.least(F.lit(1.0), mid + off))


def ks_distance(sample: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(key, d, n1, n2): largest distance of the two groups' distribution functions (group is 0 or 1).

    Running counts over the united values; equal values are one step.
    """
    steps = sample.groupBy(key, value).agg(F.sum((F.col(group) == 0).cast("long")).alias("a"), F.sum((F.col(group) == 1).cast("long")).alias("b"))
    w = Window.partitionBy(key).orderBy(value)
    run = steps.withColumns({"ca": F.sum("a").over(w), "cb": F.sum("b").over(w)})
    total = run.groupBy(key).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    return run.join(total, key).where("n1 > 0 and n2 > 0").groupBy(key, "n1", "n2").agg(
        F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))).alias("d")
    )


def ks_pvalue(d: float, n1: int, n2: int) -> float:
    """Two-sided p-value of the two-sample statistic: exact by counting lattice paths while n1 * n2 is at most a
    million, else the asymptotic series with its small-sample correction. 1 below two values."""
    if n1 < 2 or n2 < 2:
        return 1.0
    if n1 * n2 <= 1_000_000:
        n, m = (n1, n2) if n1 >= n2 else (n2, n1)
        # share of paths from (0, 0) to (n, m) on which |i/n - j/m| stays below d
        bound = d - 1e-12
        row = np.zeros(m + 1)
        j = np.arange(m + 1)
        for i in range(n + 1):
            ok = np.abs(i / n - j / m) < bound
            if i == 0:
                row = np.where(np.cumprod(ok), 1.0, 0.0)
                continue
            new = np.zeros(m + 1)
            for k in range(m + 1):
                if ok[k]:
                    up = row[k] * (i / (i + k))
                    new[k] = up + (new[k - 1] * (k / (i + k)) if k else 0.0)
            row = new
        return float(min(1.0, max(0.0, 1 - row[m])))
    en = math.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


@pandas_udf(DoubleType())
def ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([1.0 if a is None or a != a else ks_pvalue(a, int(b), int(c)) for a, b, c in zip(d, n1, n2)])


def drift(live: DataFrame, backtest: DataFrame, key: str, window: int | None = None) -> DataFrame:
    """Compare live trades with the backtest of each key: Sharpe change, Wilson interval, KS test, verdict.

    live: (key, at, r_multiple); window: the newest trades alone. backtest: (key, r_multiple).
    """
    if window is not None:
        newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at")))
        live = live.withColumn("_nth", newest).where(F.col("_nth") <= window)
    sd = F.stddev_samp("r_multiple")
    stats = lambda df, p: df.groupBy(key).agg(
        F.count("*").alias(f"{p}_n"), F.coalesce(F.when(sd > 0, F.avg("r_multiple") / sd), F.lit(0.0)).alias(f"{p}_sharpe"),
        F.sum((F.col("r_multiple") > 0).cast("long")).alias(f"{p}_wins"),
    ).withColumn(f"{p}_win_rate", F.col(f"{p}_wins") / F.col(f"{p}_n"))
    both = live.select(key, "r_multiple", F.lit(0).alias("g")).union(backtest.select(key, "r_multiple", F.lit(1).alias("g")))
    d = ks_distance(both, key, "g", "r_multiple")
    out = stats(backtest, "bt").join(stats(live, "live"), key, "left").join(d, key, "left").na.fill(0, ["live_n", "live_wins", "live_win_rate", "live_sharpe"])
    low, high = wilson(F.col("live_wins"), F.col("live_n"))
    out = out.withColumns({
        "sharpe_delta_pct": F.when(F.col("bt_sharpe") == 0, F.col("live_sharpe")).otherwise((F.col("live_sharpe") - F.col("bt_sharpe")) / F.col("bt_sharpe")),
        "ci_low": low, "ci_high": high, "ks_pvalue": F.when(F.col("d").isNull(), 1.0).otherwise(ks_p("d", "n1", "n2")),
    })
    out = out.withColumn("ci_overlap", (F.col("ci_low") <= F.col("bt_win_rate")) & (F.col("bt_win_rate") <= F.col("ci_high")))
    delta, p = F.abs("sharpe_delta_pct"), F.col("ks_pvalue")
    return out.withColumn("verdict", drift_verdict(F.col("live_n"), delta, p, F.col("ci_overlap"))).drop("n1", "n2")


def drift_verdict(n: Column, delta: Column, p: Column, overlap: Column) -> Column:
    return F.when(n == 0, "healthy").when((delta > 0.6) | (p <= 0.01) | ~overlap, "broken").when((delta >= 0.3) | (p <= 0.05), "drifting").otherwise("healthy")


def _canonical(text: str) -> str:
    try:
        value = json.loads(text)
    except ValueError:
        value = None
    return json.dumps(value if isinstance(value, dict) else {"text": text}, sort_keys=True)


@pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """JSON with sorted keys; other text as {"text": ...}."""
    return text.map(lambda t: None if t is None else _canonical(t))


def hypothesis_id(text: Column) -> Column:
    return F.concat(F.lit("hyp_"), F.substring(F.sha2(canonical(text).cast("binary"), 256), 1, 12))


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` (hypothesis) that aren't known yet, one for each id, as (hypothesis_id, hypothesis_text)."""
    made = new.select(hypothesis_id(F.col("hypothesis")).alias("hypothesis_id"), canonical("hypothesis").alias("hypothesis_text")).dropDuplicates(["hypothesis_id"])
    return made.join(known.select("hypothesis_id"), "hypothesis_id", "left_anti")


def trial_rollup(trials: DataFrame) -> DataFrame:
    return trials.groupBy("hypothesis_id").agg(F.count("*").alias("trial_count"), F.max("sharpe").alias("best_sharpe"), F.min("pbo").alias("best_pbo"))


def alike(a, b) -> float:
    """Mean over the united keys: 1 for equal values, the matching ratio of strings, recursion into objects."""
    if isinstance(a, str) and isinstance(b, str):
        return difflib.SequenceMatcher(None, a, b).ratio()
    keys = {*a, *b}
    if not keys:
        return 1.0
    total = 0.0
    for k in keys:
        x, y = a.get(k), b.get(k)
        if x is None or y is None:
            continue
        if x == y:
            total += 1
        elif isinstance(x, str) and isinstance(y, str) or isinstance(x, dict) and isinstance(y, dict):
            total += alike(x, y)
    return total / len(keys)


def similar(entries: DataFrame, target: str, threshold: float = 0.9) -> DataFrame:
    """Entries (hypothesis_id, hypothesis_text) at least so similar to one target, best first."""
    wanted = json.loads(_canonical(target))

    @pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: alike(wanted, json.loads(_canonical(t))))

    return entries.withColumn("score", score("hypothesis_text")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "hypothesis_id")


def usage_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and dollars of each model; a model without a price takes the row named `default`.

    usage: (model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens). prices: (model, input, output,
    cache_read, cache_write) in dollars for a million tokens; a short list.
    """
    names = ("input", "output", "cache_read", "cache_write")
    by = usage.groupBy("model").agg(F.count("*").alias("calls"), *(F.sum(f"{n}_tokens").alias(f"{n}_tokens") for n in names))
    known = by.join(prices, "model", "left_semi").withColumn("_price", F.col("model"))
    other = by.join(prices, "model", "left_anti").withColumn("_price", F.lit("default"))
    priced = known.unionByName(other).join(prices.withColumnRenamed("model", "_price"), "_price")
    usd = sum((F.col(f"{n}_tokens") * F.col(n) / 1e6 for n in names), F.lit(0.0))
    served = F.col("input_tokens") + F.col("cache_read_tokens")
    return priced.select("model", "calls", *(f"{n}_tokens" for n in names), usd.alias("usd"), F.when(served > 0, F.col("cache_read_tokens") / served).otherwise(0.0).alias("cache_hit_ratio"))


def filter_experiments(index: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Experiments whose column, else result field, else configuration field equals each value; an unknown name matches none."""
    for name, value in conditions.items():
        own = [F.col(name).cast("string")] if name in index.columns else []
        found = F.coalesce(*own, F.get_json_object("result", f"$.{name}"), F.get_json_object("config_snapshot", f"$.{name}"))
        index = index.where(found == value)
    return index


def paired(results: DataFrame, arm: str, base: str, other: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Both arms of an experiment side by side: base_*, other_* and delta_*."""
    side = lambda name, p: results.where(F.col(arm) == name).select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in columns))
    both = side(base, "base").join(side(other, "other"), keys)
    return both.withColumns({f"delta_{c}": F.col(f"other_{c}") - F.col(f"base_{c}") for c in columns})


def conditional_win_rates(trades: DataFrame, labels: dict[str, Column], least: int) -> DataFrame:
    """(label, n, win_rate, expectancy) of the trades under each condition; conditions on fewer than `least` are left out."""
    flags = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in labels.items())))
    by = trades.select("win", F.explode(flags).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"))
    return by.where(F.col("n") >= least).withColumn("expectancy", 2 * F.col("win_rate") - (1 - F.col("win_rate")))


def medians(values: DataFrame, keys: list[str], x: str = "x", accuracy: int = 10_000) -> DataFrame:
    """(keys, n, median) of a double column without nulls, exact, of few groups: no task holds a group's values.

    A sketch bounds the middle of each group, the rows below it are counted, and the distinct values within it (with their counts) are ranked.
    The bounds are checked by the counts and widened, at last to the whole range, until they hold the median.
    """
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    for reach in (min(3 / accuracy, 0.5), 0.05, 0.5):
        ends = F.array(F.lit(0.5 - reach), F.lit(0.5 + reach))
        bounds, path = saved(values.groupBy(*keys).agg(F.percentile_approx(x, ends, accuracy).alias("_ends")), "middles")
        near = values.join(F.broadcast(bounds), same(values, bounds)).select(*(values[k] for k in keys), values[x], F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"))
        below, upto = F.col(x) < F.col("_low"), F.col(x) <= F.col("_high")
        counts, counted = saved(near.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(below).alias("_below"), F.count_if(upto).alias("_upto")), "ranks")
        first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        if counts.where((F.col("_below") > first) | (F.col("_upto") <= second)).isEmpty():
            break
        removed(values.sparkSession, path, counted)
    within = near.where(~below & upto).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    last = F.sum("_c").over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranked = within.withColumn("_last", last).join(F.broadcast(counts), same(within, counts)).select(*(within[k] for k in keys), x, "_c", "_last", "n", "_below")
    end = F.col("_below") + F.col("_last")
    at = lambda rank: F.max(F.when((end > rank) & (end - F.col("_c") <= rank), F.col(x)))
    return ranked.groupBy(*keys, "n").agg(((at(first) + at(second)) / 2).alias("median"))


def winner_loser_medians(trades: DataFrame, features: list[str]) -> DataFrame:
    """(feature, winners, losers, separation): medians, and their distance over the summed standard deviations."""
    long = trades.select("win", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))))
    sd = lambda w: F.stddev_samp(F.when(F.col("win") == w, F.col("x")))
    spread = long.groupBy("feature").agg((sd(1) + sd(0)).alias("_sd"))
    half = lambda w: F.max(F.when(F.col("win") == w, F.col("median")))
    middles = medians(long.where("x is not null and win in (0, 1)"), ["feature", "win"]).groupBy("feature").agg(half(1).alias("winners"), half(0).alias("losers"))
    out = spread.join(middles, "feature", "left").select("feature", "winners", "losers", "_sd")
    return out.withColumn("separation", F.when(F.col("_sd") > 0, (F.col("winners") - F.col("losers")) / F.col("_sd")).otherwise(0.0)).drop("_sd")
