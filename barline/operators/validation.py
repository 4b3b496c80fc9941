"""Walk-forward and combinatorial cross-validation over one simulation of each segment, and verdicts.

Signals are computed on the whole causal history and then cut into segments, so no strategy state leaks
between folds and results don't depend on the order of calls. A group is simulated once and reused in all combinations.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import metrics, simulate
from .bars import over

#: Fixed values of the promotion gate.
GATE = {"pbo_max": 0.20, "dsr_min": 0.95, "wfe_pass_ratio_min": 0.70, "wfe_per_step_min": 0.5, "min_oos_trades": 200}
SHARPE_GAIN_MIN = 0.10


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(over()) - 1)


def walk_forward_folds(counts: DataFrame, is_bars: int, oos_bars: int, step: int) -> DataFrame:
    """(symbol, step, part, lo, hi) of bar numbers, from (symbol, n); 70/30 where the history is too short."""
    short = F.col("n") < is_bars + oos_bars
    own_is = F.when(short, F.greatest(F.lit(1), F.floor(F.col("n") * 0.7))).otherwise(is_bars).cast("long")
    own_oos = F.when(short, F.greatest(F.lit(1), F.col("n") - own_is)).otherwise(oos_bars).cast("long")
    sized = counts.withColumns({"is_n": own_is, "oos_n": own_oos}).withColumn("by", F.when(short, F.col("oos_n")).otherwise(step).cast("long"))
    last = F.col("n") - F.col("is_n") - F.col("oos_n")
    starts = sized.where(last >= 0).select("symbol", "is_n", "oos_n", "by", F.explode(F.sequence(F.lit(0).cast("long"), last, F.col("by"))).alias("at"))
    part = lambda name, lo, n: F.struct(F.lit(name).alias("part"), lo.alias("lo"), (lo + n - 1).alias("hi"))
    both = F.array(part("is", F.col("at"), F.col("is_n")), part("oos", F.col("at") + F.col("is_n"), F.col("oos_n")))
    return starts.select("symbol", (F.col("at") / F.col("by")).cast("int").alias("step"), F.inline(both))


def in_folds(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Numbered bars in each fold that holds them. Folds are few for each symbol; the bars aren't crossed with them:
    each fold's range is posted by blocks of bars."""
    block = 4096
    posted = folds.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    return bars.withColumn("_block", F.floor(F.col("i") / block)).join(posted, ["symbol", "_block"]).where(
        (F.col("i") >= F.col("lo")) & (F.col("i") <= F.col("hi"))
    ).drop("_block", "lo", "hi")


def efficiency(is_return: Column, oos_return: Column) -> Column:
    return F.when((is_return > 0) & (oos_return > 0), oos_return / is_return).otherwise(0.0)


def walk_forward(signals: DataFrame, is_bars: int, oos_bars: int, step: int, bar_seconds: int = 3600, costs=None) -> DataFrame:
    """(symbol, step, is_return, oos_return, wfe, is_sharpe, oos_sharpe)."""
    rows = numbered(signals)
    counts = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    cut = in_folds(rows, walk_forward_folds(counts, is_bars, oos_bars, step))
    keys = ["symbol", "step", "part"]
    each = metrics.curve_metrics(simulate.equity_curve(cut, keys, costs, bar_seconds), keys, bar_seconds)
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    out = each.groupBy("symbol", "step").agg(*(pick(p, c).alias(f"{p}_{n}") for p in ("is", "oos") for c, n in (("total_return", "return"), ("sharpe", "sharpe"))))
    return out.withColumn("wfe", efficiency(F.col("is_return"), F.col("oos_return")))


def walk_forward_verdict(steps: DataFrame, threshold: float = 0.5) -> DataFrame:
    return steps.groupBy("symbol").agg(
        F.count("*").alias("n_steps"), F.avg((F.col("wfe") >= threshold).cast("double")).alias("wfe_pass_ratio"), F.min("wfe").alias("min_wfe")
    )


def groups(bars: DataFrame, n_groups: int) -> DataFrame:
    """Numbered bars with their group: bounds are the whole parts of evenly spaced points."""
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    rows = numbered(bars).withColumn("_n", size)
    guess = F.floor(F.col("i") * n_groups / F.col("_n"))
    # the bound of group g + 1 is floor((g + 1) n / groups): a bar at or beyond it is in the next one
    return rows.withColumn("grp", F.when(F.col("i") >= F.floor((guess + 1) * F.col("_n") / n_groups), guess + 1).otherwise(guess).cast("int")).drop("_n")


def combos(spark: SparkSession, n_groups: int, k_test: int) -> DataFrame:
    """(combo, grp, test): every choice of k test groups; the table's size depends on the parameters alone."""
    rows = [(c, g, g in chosen) for c, chosen in enumerate(combinations(range(n_groups), k_test)) for g in range(n_groups)]
    return spark.createDataFrame(rows, "combo int, grp int, test boolean")


def purged_training(bars: DataFrame, chosen: list[int], n_groups: int, horizon: int = 30, embargo_pct: float = 0.01) -> DataFrame:
    """Bars with `train`: not in a chosen test group, within `horizon` of one, nor in the embargo after it."""
    rows = groups(bars, n_groups)
    edges = rows.where(F.col("grp").isin(chosen)).groupBy("symbol", "grp").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    sizes = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    wide = edges.join(sizes, "symbol").withColumn("embargo", F.greatest(F.lit(1), F.round(F.col("n") * embargo_pct)).cast("long"))
    spans = wide.groupBy("symbol").agg(F.collect_list(F.struct((F.col("lo") - horizon).alias("a"), (F.col("hi") + horizon + F.col("embargo")).alias("b"))).alias("spans"))
    return rows.join(spans, "symbol", "left").withColumn(
        "train", ~F.coalesce(F.exists("spans", lambda s: (F.col("i") >= s["a"]) & (F.col("i") <= s["b"])), F.lit(False))
    ).drop("spans")


def stitched(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Segments' equity after one another: each is scaled to start where the one before it ended.

    segments: keys, order, seq, equity. The running product is a sum of logarithms with the sign kept apart.
    """
    ends = segments.groupBy(*keys, order).agg((F.max_by("equity", "seq") / F.min_by("equity", "seq")).alias("_growth"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    g = F.col("_growth")
    size = F.exp(F.coalesce(F.sum(F.when(g != 0, F.log(F.abs(g)))).over(w), F.lit(0.0)))
    turns = F.coalesce(F.sum(F.when(g < 0, 1).otherwise(0)).over(w), F.lit(0))  # a curve below zero turns the sign
    lost = F.coalesce(F.max(F.when(g == 0, 1).otherwise(0)).over(w), F.lit(0))
    ends = ends.withColumn("_before", F.when(lost == 1, 0.0).when(turns % 2 == 1, -size).otherwise(size)).drop("_growth")
    first = F.min_by("equity", "seq").over(Window.partitionBy(*keys, order))
    return segments.withColumn("_first", first).join(ends, [*keys, order]).withColumn(
        "equity", F.col("equity") / F.col("_first") * F.col("_before")
    ).drop("_first", "_before")


def cpcv(spark: SparkSession, signals: DataFrame, n_groups: int = 10, k_test: int = 2, bar_seconds: int = 3600, costs=None, keys=("strategy", "symbol")) -> DataFrame:
    """(keys, combo, is_sharpe, oos_sharpe, oos_trades) from one simulation of each group."""
    keys = list(keys)
    rows = groups(signals, n_groups) if keys == ["symbol"] else _groups_by(signals, keys, n_groups)
    seg_keys = [*keys, "grp"]
    curve = simulate.folded(rows, seg_keys, costs, bar_seconds).select(*seg_keys, "seq", "equity", "exit_reason")
    segments, _ = saved(segment_summaries(curve, seg_keys), "segments")
    picks = F.broadcast(combos(spark, n_groups, k_test))  # C(n, k) * n rows, by the parameters
    per = joined_segments(segments.join(picks, "grp"), [*keys, "combo", "test"], "grp", metrics.periods_per_year(bar_seconds))
    side = lambda test, c: F.max(F.when(F.col("test") == test, F.col(c)))
    return per.groupBy(*keys, "combo").agg(
        side(False, "sharpe").alias("is_sharpe"), side(True, "sharpe").alias("oos_sharpe"), F.coalesce(side(True, "trades"), F.lit(0)).alias("oos_trades")
    )


def segment_summaries(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, m2, growth, trades) of each segment's equity points: returns counted, their mean and squared deviations."""
    ret = metrics.returns_of(curve, keys)
    return ret.groupBy(*keys).agg(
        F.count("ret").alias("n"), F.coalesce(F.avg("ret"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("ret") * F.count("ret"), F.lit(0.0)).alias("m2"),
        (F.max_by("equity", "seq") / F.min_by("equity", "seq")).alias("growth"), F.count("exit_reason").alias("trades"),
    )


def joined_segments(segments: DataFrame, keys: list[str], order: str, per_year: float) -> DataFrame:
    """(keys, sharpe, trades) of segments put after one another as `stitched` does it, from their summaries.

    Returns don't change when a segment is scaled, and a joint adds a return of 0, so summaries add up whatever the choice: no point is copied for
    it. Behind a segment that lost everything there are no more returns.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    over = F.coalesce(F.max((F.col("growth") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rows = segments.withColumns({"_over": over, "_joint": (F.row_number().over(w) > 1).cast("int")})
    lived = lambda c: F.sum(F.when(~F.col("_over"), c).otherwise(0))
    n, total = lived(F.col("n") + F.col("_joint")), lived(F.col("n") * F.col("mean"))
    squares, within = lived(F.col("n") * F.col("mean") ** 2), lived(F.col("m2"))
    sums = rows.groupBy(*keys).agg(n.alias("n"), total.alias("total"), squares.alias("squares"), within.alias("within"), F.sum("trades").alias("trades"))
    mean = F.col("total") / F.nullif(F.col("n"), F.lit(0))
    m2 = F.col("within") + F.col("squares") - F.col("n") * mean**2
    spread = F.when((F.col("n") > 1) & (m2 > 1e-14 * F.col("squares")), F.sqrt(m2 / F.nullif(F.col("n") - 1, F.lit(0))))
    return sums.select(*keys, F.coalesce(mean / spread * per_year**0.5, F.lit(0.0)).alias("sharpe"), "trades")


def _groups_by(signals: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    rows = signals.withColumns({"i": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(w)})
    guess = F.floor(F.col("i") * n_groups / F.col("_n"))
    return rows.withColumn("grp", F.when(F.col("i") >= F.floor((guess + 1) * F.col("_n") / n_groups), guess + 1).otherwise(guess).cast("int")).drop("_n")


def pbo_of(paths: DataFrame) -> DataFrame:
    """(symbol, n_splits, pbo) from cpcv over several strategies: (strategy, symbol, combo, is_sharpe, oos_sharpe)."""
    split = paths.withColumn("split", F.struct("symbol", "combo"))
    ranked = metrics.ranks(metrics.ranks(split, "split", "strategy", "is_sharpe", "is_rank"), "split", "strategy", "oos_sharpe", "oos_rank")
    best = ranked.groupBy("symbol", "combo").agg(F.max_by("oos_rank", F.col("is_rank")).alias("oos"), F.count("*").alias("n"))
    middle = (F.col("n") - 1) / 2
    flag = F.when(F.col("oos") == middle, 0.5).when(F.col("oos") < middle, 1.0).otherwise(0.0)
    return best.where("n >= 2").groupBy("symbol").agg(F.count("*").alias("n_splits"), F.avg(flag).alias("pbo"))


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that fail, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks)))


def promotion(table: DataFrame) -> DataFrame:
    """Adds fail_reasons and verdict; needs pbo (null: not known), dsr, wfe_pass_ratio, min_wfe, oos_trades."""
    failed = reasons([
        ("pbo", F.col("pbo") < GATE["pbo_max"]), ("dsr", F.col("dsr") > GATE["dsr_min"]),
        ("wfe_pass_ratio", F.col("wfe_pass_ratio") >= GATE["wfe_pass_ratio_min"]),
        ("min_wfe", F.col("min_wfe") >= GATE["wfe_per_step_min"]), ("oos_trades", F.col("oos_trades") >= GATE["min_oos_trades"]),
    ])
    return table.withColumn("fail_reasons", failed).withColumn("verdict", F.when(F.size("fail_reasons") == 0, "PASS").otherwise("FAIL"))


def at_most(a: Column, b: Column) -> Column:
    """Whether a <= b. The last digits of means depend on the order of their terms; they must not decide where both are equal."""
    return F.round(a - b, 12) <= 0


def shadow_verdict(pairs: DataFrame) -> DataFrame:
    """Gates for a changed configuration against the base: columns base_* and shadow_* of sharpe, pbo, dsr, ruin,
    and worst_regime_drop (null: no regimes). A value on its gate passes."""
    gain = F.col("shadow_sharpe") - F.col("base_sharpe")
    failed = reasons([
        ("sharpe_delta", at_most(F.lit(SHARPE_GAIN_MIN), gain)),
        ("pbo", at_most(F.col("shadow_pbo"), F.lit(GATE["pbo_max"]))), ("dsr", at_most(F.lit(GATE["dsr_min"]), F.col("shadow_dsr"))),
        ("ruin_prob", at_most(F.col("shadow_ruin"), F.col("base_ruin"))), ("regime", at_most(F.col("worst_regime_drop"), F.lit(SHARPE_GAIN_MIN))),
    ])
    return pairs.withColumn("fail_reasons", failed).withColumn("passed", F.size("fail_reasons") == 0)


def regime_runs(base: DataFrame, shadow: DataFrame, regime: str = "symbol", bar_seconds: int = 3600, costs=None) -> DataFrame:
    """(regime, base_sharpe, shadow_sharpe, drop, failed): both settings run over each regime's bars; a regime in which the changed one falls
    by more than the least gain asked for is failed. A regime without bars of both gives no row. base, shadow: signals with the regime as a column."""
    arms = base.withColumn("arm", F.lit("base")).unionByName(shadow.withColumn("arm", F.lit("shadow")), allowMissingColumns=True)
    per_year = metrics.periods_per_year(bar_seconds)
    curve = metrics.returns_of(simulate.folded(arms, ["arm", regime], costs, bar_seconds), ["arm", regime])
    runs = curve.groupBy("arm", regime).agg(metrics.sharpe("ret", per_year).alias("sharpe"))
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("sharpe"))).alias(f"{arm}_sharpe")
    both = runs.groupBy(regime).agg(side("base"), side("shadow")).dropna(subset=["base_sharpe", "shadow_sharpe"])
    drop = F.col("base_sharpe") - F.col("shadow_sharpe")
    return both.withColumns({"drop": drop, "failed": drop > SHARPE_GAIN_MIN})


def evaluate(spark: SparkSession, signals: DataFrame, geometry=(8000, 1000, 1000), n_groups: int = 10, k_test: int = 2, n_trials: int = 1, bar_seconds: int = 3600, costs=None) -> DataFrame:
    """One verdict row for each symbol: in-sample run, walk-forward, CPCV, deflated Sharpe ratio and gate.

    signals: (strategy, symbol, ts, OHLC, direction, stop, target) of one or more strategies; PBO is known with two or
    more, and the first strategy by name is the one judged.
    """
    judged_name = signals.agg(F.min("strategy")).first()[0]
    main = signals.where(F.col("strategy") == judged_name)
    curve = metrics.curve_metrics(simulate.equity_curve(main, ["symbol"], costs, bar_seconds), ["symbol"], bar_seconds)
    wf = walk_forward_verdict(walk_forward(main, *geometry, bar_seconds, costs))
    paths = cpcv(spark, signals, n_groups, k_test, bar_seconds, costs)
    oos = paths.where(F.col("strategy") == judged_name).groupBy("symbol").agg(F.sum("oos_trades").alias("oos_trades"))
    sr = F.when(F.col("sd_ret") > 0, F.col("mean_ret") / F.col("sd_ret")).otherwise(0.0)
    judged = curve.withColumn("dsr", metrics.deflated_sharpe(
        sr, F.lit(max(1, n_trials)), F.greatest(F.col("n_ret"), F.lit(2)), F.col("skew"), F.col("kurt")
    ))
    table = judged.join(wf, "symbol", "left").join(oos, "symbol", "left").join(pbo_of(paths), "symbol", "left")
    return promotion(table)


def poisoned(bars: DataFrame, cut) -> DataFrame:
    """Bars whose prices after `cut` are absurd: causal features and entries up to it must not change."""
    factor = {"open": 10.0, "high": 12.0, "low": 0.1, "close": 8.0, "volume": 100.0}
    return bars.withColumns({c: F.when(F.col("ts") > F.lit(cut), F.col(c) * x).otherwise(F.col(c)) for c, x in factor.items()})


def lookahead_leaks(bars: DataFrame, cut, build, digits: int = 6) -> DataFrame:
    """Rows up to `cut` that `build` makes differently when later bars are poisoned; empty for a causal build.

    Doubles are compared to so many digits: the last ones of a sum depend on the order of its terms.
    """

    def seen(x: DataFrame) -> DataFrame:
        made = build(x).where(F.col("ts") <= F.lit(cut))
        return made.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes))

    return seen(bars).exceptAll(seen(poisoned(bars, cut)))
