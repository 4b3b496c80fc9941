"""Similarity join of hypotheses (JSON objects): every pair of a new and a known one whose likeness reaches a threshold.

Likeness is the mean over the united keys of 1 for equal values, the matching ratio of strings and the likeness of objects
(`journal.alike`). All pairs are never formed:

* A pair at threshold t loses at most (1 - t) of its united keys, of which there are at most n / t for a record of n keys. So
  among few enough of the new record's keys one has a value at least PER_KEY alike; those whose tokens are rarest are taken.
* Two strings that are so alike share so many letters (a letter's second occurrence is a token of its own) that their rarest tokens, a third of
  them, have one in common: the prefix. Numbers and objects have tokens of their own.
* What shares such a token is a candidate. An upper bound from letter counts, in expressions, leaves few; those are verified.

Copies are joined once: a hypothesis is its canonical text, whose hash is the id.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..sources.scratch import saved
from .journal import alike

#: Likeness that one of the taken keys' values has at least.
PER_KEY = 0.75


def letters(text: Column) -> Column:
    """Each letter with the number of its occurrence."""
    ordered = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(ordered, lambda c, i: F.concat(c, F.lit("#"), (i - F.array_position(ordered, c)).cast("string")))


def values_of(entries: DataFrame) -> DataFrame:
    """(id, key, n_keys, tokens, extra): the values of each hypothesis; `extra` is the token of numbers and objects."""
    each = entries.select("id", F.from_json("text", "map<string,string>").alias("m")).select("id", F.size("m").alias("n_keys"), F.explode("m").alias("key", "value"))
    value = F.coalesce("value", F.lit(""))
    number = F.coalesce(F.when(value.isin("true", "false"), (value == "true").cast("double")), value.try_cast("double"))
    extra = F.when(value.startswith("{"), "object").when(number.isNotNull(), F.concat(F.lit("number "), number.cast("string"))).when(value == "", "empty")
    return each.select("id", "key", "n_keys", letters(value).alias("tokens"), extra.alias("extra"))


def postings(values: DataFrame, known: DataFrame) -> DataFrame:
    """(id, key, n_keys, length, token, f): the prefix of each value, rarest first among the known ones, and its extra token."""
    listed = F.concat(F.col("tokens"), F.when(F.col("extra").isNotNull(), F.array("extra")).otherwise(F.array().cast("array<string>")))
    each = values.select("id", "key", "n_keys", F.size("tokens").alias("length"), F.col("extra"), F.explode(listed).alias("token"))
    joined = each.join(known, ["key", "token"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    least = F.ceil(F.col("length") * PER_KEY / (2 - PER_KEY) - 1e-9)
    plain = ~F.coalesce(F.col("token") == F.col("extra"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("id", "key", plain).orderBy("f", "token"))
    return joined.withColumns({"_plain": plain, "_place": place}).where(~F.col("_plain") | (F.col("_place") <= F.col("length") - least + 1)).select("id", "key", "n_keys", "length", "token", "f")


def candidates(new: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(new_id, known_id): a superset of the pairs, by rare tokens of few keys."""
    mine, theirs = values_of(new), values_of(known)
    listed = F.concat(F.col("tokens"), F.when(F.col("extra").isNotNull(), F.array("extra")).otherwise(F.array().cast("array<string>")))
    counts, _ = saved(theirs.select("key", F.explode(listed).alias("token")).groupBy("key", "token").agg(F.count("*").alias("f")), "tokens")
    asked, _ = saved(postings(mine, counts), "asked")
    # keys that may be less than PER_KEY alike, and one more
    spare = F.ceil((1 - threshold) * F.floor(F.col("n_keys") / threshold + 1e-9) / (1 - PER_KEY) - 1e-9)
    cost = asked.groupBy("id", "key", "n_keys").agg(F.sum("f").alias("cost"))
    taken = cost.withColumn("_place", F.row_number().over(Window.partitionBy("id").orderBy("cost", "key"))).where(F.col("_place") <= F.greatest(spare, F.lit(1))).select("id", "key")
    probe = asked.join(taken, ["id", "key"]).select(F.col("id").alias("new_id"), "key", "token", F.col("length").alias("_mine"))
    index, _ = saved(postings(theirs, counts).select(F.col("id").alias("known_id"), "key", "token", "length"), "index")
    fit = (F.col("length") * (2 - PER_KEY) + 1e-9 >= F.col("_mine") * PER_KEY) & (F.col("_mine") * (2 - PER_KEY) + 1e-9 >= F.col("length") * PER_KEY)
    return probe.join(index, ["key", "token"]).where(fit | ~F.col("token").contains("#")).select("new_id", "known_id").distinct()


def bounded(pairs: DataFrame, new: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose letter counts allow the threshold."""
    def packed(entries, name):
        by_key = F.map_from_entries(F.collect_list(F.struct("key", F.struct("tokens", "extra"))))
        return values_of(entries).groupBy(F.col("id").alias(f"{name}_id")).agg(by_key.alias(name))

    a, b = F.col("new"), F.col("known")

    def most(k):
        x, y = a[k], b[k]
        shared = 2 * F.size(F.array_intersect(x["tokens"], y["tokens"])) / F.greatest(F.size(x["tokens"]) + F.size(y["tokens"]), F.lit(1))
        return F.when(y.isNull(), 0.0).when(F.coalesce(x["extra"] == y["extra"], F.lit(False)), 1.0).otherwise(shared)

    total = F.aggregate(F.map_keys(a), F.lit(0.0), lambda acc, k: acc + most(k))
    united = F.size(F.array_union(F.map_keys(a), F.map_keys(b)))
    joined = pairs.join(packed(new, "new"), "new_id").join(packed(known, "known"), "known_id")
    return joined.where(total + 1e-9 >= threshold * united).select("new_id", "known_id")


def similar_pairs(new: DataFrame, known: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(new_id, known_id, score) of all pairs at or above the threshold, a hypothesis with itself left out.

    new, known: (hypothesis_id, hypothesis_text) with canonical texts, as `register` makes them. Repeated ids count once. Null texts and
    empty objects are like nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    one = lambda df: df.select(F.col("hypothesis_id").alias("id"), F.col("hypothesis_text").alias("text")).where("id is not null and text is not null").dropDuplicates(["id"])
    mine, _ = saved(one(new), "new")
    theirs, _ = saved(one(known), "known")
    found, _ = saved(candidates(mine, theirs, threshold).where("new_id <> known_id"), "candidates")
    left = bounded(found, mine, theirs, threshold)

    @pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(json.loads(x), json.loads(y)) for x, y in zip(a, b)], dtype="float64")

    texts = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.col("text").alias(name))
    scored = left.join(texts(mine, "new"), "new_id").join(texts(theirs, "known"), "known_id").withColumn("score", score("new", "known"))
    return scored.where(F.col("score") >= threshold).select("new_id", "known_id", "score")
