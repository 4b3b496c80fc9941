"""Bar-by-bar simulation of one position at a time under execution costs.

Whether an order is taken depends on whether an earlier trade is still open, so this is the one kernel that
folds over bars. It runs for each (run, segment, symbol) independently; everything it needs is in columns: prices,
news flag and the order that the strategy gives on each bar.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved


@dataclass(frozen=True)
class Costs:
    """Basis points. A side costs half the spread, slippage and a fee; longs pay funding, shorts receive it."""

    spread: float = 4.0
    spread_news: float = 25.0
    slippage: float = 2.0
    slippage_news: float = 8.0
    fee_taker: float = 5.5
    fee_maker: float = 2.0
    funding_8h: float = 1.5
    latency_seconds: float = 1.5

    def side_bp(self, news: bool, maker: bool = False) -> float:
        spread, slip = (self.spread_news, self.slippage_news) if news else (self.spread, self.slippage)
        return 0.5 * spread + slip + (self.fee_maker if maker else self.fee_taker)

    def funding_bp(self, hours: float, direction: str) -> float:
        paid = self.funding_8h * max(hours, 0.0) / 8
        return paid if direction == "long" else -paid

    def side_column(self, news: Column, maker: Column) -> Column:
        fee = F.when(maker, self.fee_maker).otherwise(self.fee_taker)
        return F.when(news, 0.5 * self.spread_news + self.slippage_news).otherwise(0.5 * self.spread + self.slippage) + fee

    def round_trip_column(self, direction: Column, news: Column, hours: Column, maker: Column) -> Column:
        funding = self.funding_8h * F.greatest(hours, F.lit(0.0)) / 8
        return 2 * self.side_column(news, maker) + F.when(direction == "long", funding).otherwise(-funding)


TRADE = (
    "entry_time timestamp, exit_time timestamp, direction string, entry_price double, exit_price double, size double, "
    "pnl double, r_multiple double, hold_hours double, exit_reason string"
)


def fold(pdf: pd.DataFrame, costs: Costs, bar_seconds: int, gap_fill: bool, start_equity: float = 1.0) -> tuple[list[tuple], np.ndarray]:
    """Trades, each with its bar's number, and equity at the start and after each bar (one point more than bars)."""
    ts = pdf["ts"].tolist()
    o, h, low, c = (pdf[x].to_numpy(float) for x in ("open", "high", "low", "close"))
    side, stop = pdf["direction"].tolist(), pdf["stop"].to_numpy(float)
    target = [list(t) if isinstance(t, (list, np.ndarray)) else [t] if t == t and t is not None else [] for t in pdf["target"].tolist()]
    news = pdf["news"].to_numpy(bool) if "news" in pdf else np.zeros(len(pdf), bool)
    late = min(1.0, costs.latency_seconds / bar_seconds)
    trades: list[tuple] = []
    equity, points = start_equity, [start_equity]
    held = waiting = None

    def close(exit_price: float, i: int, reason: str) -> float:
        direction, entry, entered, _, _, risk = held
        sign = 1.0 if direction == "long" else -1.0
        hours = (ts[i] - entered).total_seconds() / 3600
        net = exit_price * (1 - sign * costs.side_bp(news[i]) / 1e4)
        pnl = sign * (net - entry) / entry - costs.funding_bp(hours, direction) / 1e4
        r = sign * (exit_price - entry) / risk if risk > 0 else 0.0
        trades.append((i, entered, ts[i], direction, entry, exit_price, 1.0, pnl, r, hours, reason))
        return equity * (1 + pnl)

    for i in range(len(ts)):
        if waiting is not None:
            direction, s, t = waiting
            sign = 1.0 if direction == "long" else -1.0
            drift = (h[i] - o[i]) if direction == "long" else (o[i] - low[i])
            entry = (o[i] + sign * drift * late) * (1 + sign * costs.side_bp(news[i]) / 1e4)
            held = (direction, entry, ts[i], s, t, max(sign * (entry - s), entry * 5e-4))
            waiting = None
        if held is not None:
            direction, _, entered, s, t, _ = held
            hit_stop = low[i] <= s if direction == "long" else h[i] >= s
            hit_target = next((x for x in t if (h[i] >= x if direction == "long" else low[i] <= x)), None)
            if hit_stop:
                price = s
                if gap_fill and ts[i] != entered:
                    price = min(s, o[i]) if direction == "long" else max(s, o[i])
                equity, held = close(price, i, "SL"), None
            elif hit_target is not None:
                equity, held = close(hit_target, i, "TP"), None
        if held is None and isinstance(side[i], str):
            waiting = (side[i], stop[i], target[i])
        points.append(equity)
    if held is not None:
        points[-1] = close(c[-1], len(ts) - 1, "EOD")
    return trades, np.array(points)


def folded(signals: DataFrame, keys: list[str], costs: Costs | None = None, bar_seconds: int = 3600, gap_fill: bool = False) -> DataFrame:
    """(keys, seq, ts, equity, and the trade that the bar closed, else null): a point at the start, numbered 0, and one for
    each bar. At most one trade ends on a bar, so both results come from one pass.

    signals: keys, ts, OHLC, direction, stop, target (a price or an array of prices, of which the first that a bar reaches
    counts) and perhaps news. gap_fill: whether a stop that a bar opens beyond is filled at the open instead of at its level.
    """
    costs = costs or Costs()
    own = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)
    kept = [*keys, "ts", "open", "high", "low", "close", "direction", "stop", "target", *(["news"] if "news" in signals.columns else [])]
    names = [x.split()[0] for x in TRADE.split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        trades, points = fold(pdf, costs, bar_seconds, gap_fill)
        ts = pdf["ts"].tolist()
        out = pd.DataFrame({"seq": np.arange(len(points)), "ts": [ts[0], *ts], "equity": points})
        closed = pd.DataFrame(trades, columns=["seq", *names])
        out = out.merge(closed.assign(seq=closed["seq"].astype("int64") + 1), "left", "seq")
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    return signals.select(*kept).groupBy(*keys).applyInPandas(run, f"{own}, seq long, ts timestamp, equity double, {TRADE}")


def simulate(signals: DataFrame, keys: list[str], costs: Costs | None = None, bar_seconds: int = 3600, gap_fill: bool = False) -> DataFrame:
    """Trades of each key."""
    closed = folded(signals, keys, costs, bar_seconds, gap_fill).where("exit_reason is not null")
    return closed.select(*keys, *(x.split()[0] for x in TRADE.split(", ")))


def equity_curve(signals: DataFrame, keys: list[str], costs: Costs | None = None, bar_seconds: int = 3600, gap_fill: bool = False) -> DataFrame:
    """(keys, seq, ts, equity)."""
    return folded(signals, keys, costs, bar_seconds, gap_fill).select(*keys, "seq", "ts", "equity")


def cost_record(costs: Costs) -> dict:
    return asdict(costs)


SCALE_OUT = ("TP1", "TP2", "TP3")


def pyramid(prices: DataFrame) -> dict[str, DataFrame]:
    """Lowest and highest price of each symbol's days, months and years, each made from the finer one."""
    low, high = F.min("low").alias("low"), F.max("high").alias("high")
    days = prices.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min("price").alias("low"), F.max("price").alias("high"))
    days, _ = saved(days.withColumns({"month": F.trunc("day", "month"), "year": F.trunc("day", "year")}), "days")
    months = days.groupBy("symbol", "year", "month").agg(low, high)
    return {"day": days, "month": months, "year": months.groupBy("symbol", "year").agg(low, high)}


def first_touches(positions: DataFrame, prices: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(position_id, level, day): the first day after a position's entry day on which the price reaches a level, where there is one.

    Level columns named sl are reached from the losing side, others from the winning one. Searched down a pyramid by equi-joins: the days
    left of the entry's month, then the months left of its year, then later years, and in what was found the months and days. So a level meets at most the
    days of two months, the months of two years and the years, however many days follow.
    """
    reach = pyramid(prices)
    long = F.col("direction") == "long"
    entry = F.to_date("entry_ts")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).cast("double").alias("price"), (~long if c == "sl" else long).alias("above")) for c in levels))).alias("l")
    asks = positions.select("position_id", "symbol", entry.alias("entry"), F.trunc(entry, "month").alias("month"), F.trunc(entry, "year").alias("year"), each).select(
        "position_id", "symbol", "entry", "month", "year", "l.*"
    )
    asks, _ = saved(asks, "asks")
    key = ["position_id", "level"]
    own = [*key, "symbol", "price", "above"]
    hit = F.when(F.col("above"), F.col("high") >= F.col("price")).otherwise(F.col("low") <= F.col("price"))

    def first(rows: DataFrame, unit: str, on: list[str], later: str | None = None) -> DataFrame:
        """The first unit of each ask among those that share `on` with it, with `later` only those after it."""
        found = reach[unit].select(*on, F.col(unit).alias("_unit"), "low", "high")
        met = rows.join(found, on).where(hit)
        if later:
            met = met.where(F.col("_unit") > F.col(later))
        return met.groupBy(*own).agg(F.min("_unit").alias(unit))

    in_month = first(asks, "day", ["symbol", "month"], "entry")
    in_month, _ = saved(in_month, "in-month")
    rest = asks.join(in_month.select(*key), key, "left_anti")
    in_year, _ = saved(first(rest.withColumnRenamed("month", "_from"), "month", ["symbol", "year"], "_from"), "in-year")
    rest = rest.join(in_year.select(*key), key, "left_anti")
    years = first(rest.withColumnRenamed("year", "_from"), "year", ["symbol"], "_from")
    months = in_year.unionByName(first(years, "month", ["symbol", "year"]))
    days = in_month.unionByName(first(months, "day", ["symbol", "month"]))
    return days.select(*key, "day")


def manage_positions(positions: DataFrame, prices: DataFrame, scale_pct=(25.0, 25.0, 25.0), track_remaining: bool = False) -> DataFrame:
    """Exit events of positions over a price stream: the stop first, then targets that scale out.

    positions: (position_id, symbol, entry_ts, direction, entry, size, sl, tp1, tp2, tp3). prices: (symbol, ts, price).
    A stop after partial exits closes the whole entry size, and the third target closes the position, unless
    track_remaining: then only what is left is closed, and only when nothing is left.

    A position meets only the ticks of its first day and of the days that first reach one of its four levels
    (`first_touches`): nothing happens to it on the others.
    """
    day = F.to_date("ts").alias("day")
    reached = first_touches(positions, prices, ("sl", *(t.lower() for t in SCALE_OUT)))
    days = positions.select(*positions.columns, F.to_date("entry_ts").alias("day")).unionByName(
        positions.join(reached.select("position_id", "day").distinct(), "position_id").select(*positions.columns, "day")
    )
    ticks = prices.withColumn("day", day).join(days, ["symbol", "day"]).where(F.col("ts") >= F.col("entry_ts"))
    schema = "position_id string, ts timestamp, event string, price double, size double, pnl double, status string"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        p = pdf.iloc[0]
        sign = 1.0 if p.direction == "long" else -1.0
        todo, left, out = list(SCALE_OUT), float(p["size"]), []
        for ts, price in zip(pdf["ts"], pdf["price"]):
            if sign * (p.sl - price) >= 0:
                size = left if track_remaining else float(p["size"])
                out.append((key[0], ts, "SL", price, size, sign * (price - p.entry) * size, "CLOSED"))
                break
            if not track_remaining:
                left = float(p["size"])
            for name, pct in zip(SCALE_OUT, scale_pct):
                level = p[name.lower()]
                if name in todo and sign * (price - level) >= 0:
                    size = min(float(p["size"]) * pct / 100, left)
                    if size <= 0:
                        continue
                    left -= size
                    todo.remove(name)
                    done = left <= 1e-9 or (not todo and not track_remaining)
                    out.append((key[0], ts, name, level, size, sign * (level - p.entry) * size, "CLOSED" if done else "PARTIALLY_CLOSED"))
            if out and out[-1][-1] == "CLOSED":
                break
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return ticks.groupBy("position_id").applyInPandas(run, schema)


def risk_plan(entry: Column, balance: Column, direction: Column, risk_pct: float = 1.0, sl_bp: float = 50.0, tp_bp=(35.0, 70.0, 120.0), max_units: float | None = None) -> dict[str, Column]:
    """Stop, three targets, size and risk amount of an entry; mirrored for shorts."""
    sign = F.when(direction == "short", -1.0).otherwise(1.0)
    unit = entry * sl_bp / 10000
    amount = balance * risk_pct / 100
    size = amount / unit if max_units is None else F.least(amount / unit, F.lit(float(max_units)))
    return {
        "stop_loss": entry - sign * unit, **{f"tp{i}": entry + sign * entry * bp / 10000 for i, bp in enumerate(tp_bp, 1)},
        "position_size": size, "risk_amount": amount,
    }
