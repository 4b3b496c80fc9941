"""Rows kept at a distance: cooldowns, alert throttles and caches whose entries live for a time.

Of each key's rows the first is kept, then the first one that comes a span after the last kept one, and so on. A fold over a key's
rows would say it, but a key's history would then be one task's. Here every moment of a key points to the first moment beyond
its span (an as-of join, forwards), and the chain from the key's first moment is found by pointer jumping: after round k
the first 2**k members are known, and each pointer leads 2**k members on. So there are log2(longest chain) rounds of equi-joins on
(key, moment), each round's results being shared tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import removed, saved
from .joins import asof_backward


def _on(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]):
    return [a[x].eqNullSafe(b[y]) for x, y in pairs]


def chain(moments: DataFrame, keys: list[str], at: str, span: int, strict: bool, bucket: int | None) -> tuple[DataFrame, int]:
    """The kept ones of distinct (keys, at), and the number of rounds."""
    spark = moments.sparkSession
    beyond = F.col(at) + span + int(strict)
    # backwards in time the first moment at or after `beyond` is the last one at or before it
    asked = moments.select(*keys, at, (-beyond).alias("_n"))
    known = moments.select(*keys, (-F.col(at)).alias("_n"), F.col(at).alias("_next"))
    jump, jump_path = saved(asof_backward(asked, known, keys, ["_next"], "_n", bucket_seconds=bucket).where("_next is not null").select(*keys, at, "_next"), "jumps")
    kept, kept_path = saved(moments.groupBy(*keys).agg(F.min(at).alias(at)), "kept")
    rounds, paths = 0, []
    while True:
        now = kept.alias("k")
        step = now.join(jump, _on(now, jump, [(k, k) for k in keys] + [(at, at)])).select(*(jump[k] for k in keys), jump["_next"].alias(at))
        step, path = saved(step, "reached")
        paths.append(path)
        if step.isEmpty():
            break
        rounds += 1
        kept = kept.unionByName(step)
        a, b = jump.alias("a"), jump.select(*keys, at, "_next").toDF(*(f"_{k}" for k in keys), "_from", "_to")
        longer = a.join(b, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys] + [a["_next"] == b["_from"]]).select(*keys, at, F.col("_to").alias("_next"))
        jump, new = saved(longer, "jumps")
        removed(spark, jump_path)
        jump_path = new
    done, _ = saved(kept, "chain")
    removed(spark, kept_path, jump_path, *paths)
    return done, rounds


def spaced(df: DataFrame, keys: list[str], at: str, span: int, order: list[str], strict: bool = False, bucket: int | None = None) -> DataFrame:
    """df with `entry` (the moment of the kept row in force), `lead` (its `order` columns) and `kept`.

    at: a whole number (bar numbers, milliseconds). The next kept row comes at least `span` after the last, with `strict` more than
    it. Of rows of one moment the first by `order` can be kept. bucket: width of the spans of `at` by which a
    hot key's as-of joins are dealt out. Rows without `at` are never kept and have no entry; null keys are a key. A span of
    0 without `strict` keeps the first row of every moment. Rows that agree in `at` and `order` are kept together.
    """
    if span < 0:
        raise ValueError("a span can't be negative")
    timed = df.where(F.col(at).isNotNull())
    lead = F.struct(*order)
    moments, path = saved(timed.groupBy(*keys, F.col(at).cast("long").alias(at)).agg(F.min(lead).alias("lead")), "moments")
    if span == 0 and not strict:
        chosen = moments
    else:
        found, _ = chain(moments.select(*keys, at), keys, at, span, strict, bucket)
        chosen = moments.join(found, _on(moments, found, [(k, k) for k in keys] + [(at, at)]), "left_semi")
    chosen, _ = saved(chosen.select(*keys, at, F.col(at).alias("entry"), "lead"), "chosen")
    removed(df.sparkSession, path)
    joined = asof_backward(df, chosen, keys, ["entry", "lead"], at, bucket_seconds=bucket)
    return joined.withColumn("kept", F.coalesce((F.col("entry") == F.col(at)) & (F.col("lead") == lead), F.lit(False)))


def cached_decisions(proposals: DataFrame, answers: DataFrame, ttl: int, keys: list[str], bar: str = "bar", id_col: str = "id", bucket: int | None = None) -> DataFrame:
    """(id, keys, bar, cached, action, reason, approved): each proposal's decision by a model's answers behind a cache.

    answers: (id, decision, error, rejection) of every proposal that a model was asked about. A proposal whose key has an entry of at
    most `ttl` bars ago takes over its decision, which doesn't extend the entry's life; otherwise its own answer
    counts and becomes the entry, refusals and errors too. Errors and missing answers skip; so does a TAKE that the rules reject. With ttl 0
    nothing is cached.
    """
    seen = spaced(proposals, keys, bar, ttl, [id_col], strict=True, bucket=bucket) if ttl > 0 else proposals.withColumns({"kept": F.lit(True), "lead": F.struct(id_col)})
    asked = F.when(F.col("kept"), F.col(id_col)).otherwise(F.col(f"lead.{id_col}"))
    said = answers.select(F.col(id_col).alias("_asked"), "decision", "error", "rejection")
    failed = F.col("error").isNotNull() | F.col("decision").isNull()
    took = F.col("decision") == "TAKE"
    action = F.when(failed, "SKIP").when(took & F.col("rejection").isNotNull(), "SKIP").otherwise(F.col("decision"))
    reason = (
        F.when(failed, F.concat(F.lit("model error: "), F.coalesce("error", F.lit("no answer"))))
        .when(took & F.col("rejection").isNotNull(), F.concat(F.lit("rejected: "), "rejection")).when(took, "approved").otherwise(F.concat(F.lit("model decided "), "decision"))
    )
    joined = seen.withColumn("_asked", asked).join(said, "_asked", "left")
    return joined.select(id_col, *keys, bar, (~F.col("kept")).alias("cached"), action.alias("action"), reason.alias("reason"), (action == "TAKE").alias("approved"))


def cached_latest(requests: DataFrame, source: DataFrame, ttl: int, values: list[str], at: str = "at", id_col: str = "id", bucket: int | None = None) -> DataFrame:
    """requests with `fetched` (whether this one asked the source), `fetched_at` and the source's newest `values` of that time.

    A request within `ttl` of the last fetch takes over what that brought, also where the source has moved on since. source: (at, values).
    """
    one = requests.withColumn("_all", F.lit(1))
    seen = spaced(one, ["_all"], at, ttl, [id_col], bucket=bucket)
    fetches = seen.where("kept").select("_all", F.col(at).alias("entry")).distinct()
    brought = asof_backward(fetches.withColumn("_n", F.col("entry")), source.select(F.lit(1).alias("_all"), F.col(at).alias("_n"), *values), ["_all"], values, "_n", bucket_seconds=bucket)
    joined = seen.join(brought.select("entry", *values), "entry", "left")
    return joined.select(*requests.columns, F.col("kept").alias("fetched"), F.col("entry").alias("fetched_at"), *values)
