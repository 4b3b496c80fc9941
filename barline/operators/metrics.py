"""Performance statistics as aggregates, and the overfitting statistics built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def periods_per_year(bar_seconds: int) -> int:
    return max(1, round(365 * 86400 / max(1, bar_seconds)))


def returns_of(equity: DataFrame, keys: list[str]) -> DataFrame:
    """equity with `ret`, the change from the point before it in order of seq (null on the first)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    return equity.withColumns({
        "ret": F.col("equity") / F.lag("equity").over(w) - 1,
        "drawdown": F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1,
    })


def sharpe(ret: str, per_year: float) -> Column:
    sd = F.stddev_samp(ret)
    return F.coalesce(F.when(sd > 0, F.avg(ret) / sd * math.sqrt(per_year)), F.lit(0.0))


def sortino(ret: str, per_year: float) -> Column:
    sd = F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret)))
    return F.coalesce(F.when(sd > 0, F.avg(ret) / sd * math.sqrt(per_year)), F.lit(0.0))


def skew_corrected(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2)).otherwise(0.0)


def kurtosis_corrected(x: str) -> Column:
    """Excess kurtosis."""
    n = F.count(x)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)).otherwise(0.0)


def curve_metrics(equity: DataFrame, keys: list[str], bar_seconds: int, *more: Column) -> DataFrame:
    """more: further aggregates of the same rows. sharpe, sortino, max_drawdown, calmar (252 periods whatever the bar), total_return, moments of returns."""
    per_year = periods_per_year(bar_seconds)
    out = returns_of(equity, keys).groupBy(*keys).agg(
        sharpe("ret", per_year).alias("sharpe"), sortino("ret", per_year).alias("sortino"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"), F.avg("ret").alias("mean_ret"),
        F.stddev_samp("ret").alias("sd_ret"), F.count("ret").alias("n_ret"),
        skew_corrected("ret").alias("skew"), (kurtosis_corrected("ret") + 3).alias("kurt"),
        (F.max_by("equity", "seq") / F.min_by("equity", "seq") - 1).alias("total_return"), *more,
    )
    return out.withColumn(
        "calmar", F.when(F.col("max_drawdown") == 0, 0.0).otherwise(F.col("mean_ret") * 252 / F.abs("max_drawdown"))
    )


def trade_aggregates() -> list[Column]:
    """n_trades, win_rate, profit_factor (infinite without losses), mean_r, std_r, mean_hold_hours; rows without a trade don't count."""
    wins = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")))
    losses = F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return [
        F.count("exit_reason").alias("n_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.when(losses < 0, F.coalesce(wins, F.lit(0.0)) / F.abs(losses)).when(wins > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
        F.avg("r_multiple").alias("mean_r"), F.coalesce(F.stddev_samp("r_multiple"), F.lit(0.0)).alias("std_r"),
        F.avg("hold_hours").alias("mean_hold_hours"),
    ]


def trade_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(*trade_aggregates())


@pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))) if v == v else None)


def deflated_sharpe(sr: Column, trials: Column, samples: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the Sharpe ratio beats the best of so many trials by chance (sqrt(2 ln n))."""
    best = F.when(trials > 1, F.sqrt(2 * F.log(trials))).otherwise(0.0)
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    z = (sr - best) * F.sqrt(F.greatest(samples - 1, F.lit(0))) / F.sqrt(spread)
    return F.when((samples <= 1) | (spread <= 0), 0.0).otherwise(normal_cdf(z))


def ranks(scores: DataFrame, split: str, strategy: str, score: str, out: str) -> DataFrame:
    """Rank of each strategy in its split from 0, ties in order of the strategy."""
    return scores.withColumn(out, F.row_number().over(Window.partitionBy(split).orderBy(score, strategy)) - 1)


def overfitting_probability(ranked: DataFrame, split: str, strategy: str) -> DataFrame:
    """(n_splits, pbo): how often the best strategy in sample is below the median out of sample (half for the median).

    ranked: split, strategy, is_rank, oos_rank.
    """
    best = ranked.groupBy(split).agg(
        F.max_by("oos_rank", "is_rank").alias("oos"), F.count("*").alias("n")
    )
    middle = (F.col("n") - 1) / 2
    flag = F.when(F.abs(F.col("oos") - middle) < 1e-9, 0.5).when(F.col("oos") < middle, 1.0).otherwise(0.0)
    return best.where("n >= 2").agg(F.count("*").alias("n_splits"), F.coalesce(F.avg(flag), F.lit(0.0)).alias("pbo"))


def ruin_probability(mean_r: float, std_r: float, threshold_pct: float, n_trades: int, risk_pct: float, n_paths: int = 5000, seed: int = 42) -> float:
    """Share of simulated paths that fall by the threshold from their peak; draws are numpy's, so a seed repeats."""
    if n_trades <= 0 or risk_pct <= 0 or threshold_pct <= 0:
        return 0.0
    draws = np.random.default_rng(seed).normal(mean_r, std_r, size=(int(n_paths), int(n_trades)))
    worth = np.cumprod(1 + draws * risk_pct / 100, axis=1)
    peak = np.maximum.accumulate(worth, axis=1)
    return float(((worth - peak) / peak).min(axis=1).__le__(-threshold_pct / 100).mean())


def ruin_of(summaries: DataFrame, keys: list[str], threshold_pct: float = 20.0, risk_pct: float = 1.0, n_paths: int = 500, seed: int = 17) -> DataFrame:
    """Ruin probability of each key from its win rate: trades of plus or minus one R; 1 without trades.

    summaries: keys, n_trades, win_rate.
    """
    own = ", ".join(f"`{k}` {summaries.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            pdf["ruin_prob"] = [
                ruin_probability(2 * w - 1, 1.0, threshold_pct, max(int(n), 100), risk_pct, n_paths, seed) if n else 1.0
                for n, w in zip(pdf["n_trades"], pdf["win_rate"])
            ]
            yield pdf[[*keys, "ruin_prob"]]

    return summaries.select(*keys, "n_trades", "win_rate").mapInPandas(run, f"{own}, ruin_prob double")
