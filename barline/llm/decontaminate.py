"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Texts are lower-cased (A-Z only) and cut into words. A window is `span` consecutive words of an item; an item
with fewer words is one window. Of every window's k-grams of word hashes the smallest is kept as its
fingerprint, in documents as in items, so equal windows have equal fingerprints: every shared window is
guaranteed to be found. Fingerprints are joined, and each hit is extended to its whole window and compared word by word.

Scale: a document contributes its distinct fingerprints (two sevenths of its words for k = 5), never pairs. Its
words are hashed once for windows of every length that the items have. Tables are broadcast only where their
summed bytes allow; beyond it the join is a shuffle with adaptive skew splitting. Only documents with a
joined fingerprint are read for windows.

Defined results: null and wordless texts have no words and no hit; an item without words has no
window. Documents are keyed by (id, text), so rows with equal ids are judged separately and exactly repeated rows
alike. Items with equal ids count once in n_items. Null item ids are the text "". Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names, removed, row_key, saved

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of values up to which a table is broadcast.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased and no other letter changed."""
    plain = F.length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD, -1), "")


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, NOT_WORD_ANY_CASE, -1), ""))).cast("long")


def fingerprints(df: DataFrame, spans: list[int], k: int = 5) -> DataFrame:
    """Adds, for each n of spans, `mins_n` to a frame with `w`: the fingerprint of the window of n words that starts at
    each word; null where there are too few words. (A filter on the words would cut every text twice.)"""

    def grams(n):
        size = min(k, n)
        places = F.sequence(F.lit(0), F.size("h") - size)
        return F.when(F.size("h") >= n, F.transform(places, lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(size)))))

    def least(n):
        wide = n - min(k, n) + 1
        g = f"g_{n}"
        if wide == 1:
            return F.col(g)
        places = F.sequence(F.lit(0), F.size(g) - wide)
        return F.when(F.col(g).isNotNull(), F.transform(places, lambda i: F.least(*(F.get(g, i + j) for j in range(wide)))))

    return (
        df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
        .withColumns({f"g_{n}": grams(n) for n in spans})
        .withColumns({f"mins_{n}": least(n) for n in spans})
        .drop("h", *(f"g_{n}" for n in spans))
    )


def maybe_broadcast(table: DataFrame, width: Column) -> DataFrame:
    """A saved table with a broadcast hint where the widths of its rows add up to little enough."""
    total = table.agg(F.coalesce(F.sum(width + 16), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def hits(docs: DataFrame, items: DataFrame, spans: list[int]) -> tuple[DataFrame, list[str]]:
    """(_k1, _k2, item_id, pos, span): every occurrence of an item's window.

    docs: (_k1, _k2, text). items: (item_id, w, span), span being the length of an item's windows.
    """
    mins = [F.coalesce(F.col(f"mins_{n}"), F.array().cast("array<bigint>")) for n in spans]
    mine = F.coalesce(*(F.when(F.col("span") == n, F.col(f"mins_{n}")) for n in spans))
    # a table of its own: below an explode the optimizer would infer a filter on `mins` and work it out again for each word
    marked, p1 = saved(fingerprints(items, spans).select("item_id", "w", "span", mine.alias("mins")), "items")
    prints, p2 = saved(marked.select(F.explode("mins").alias("fp")).distinct(), "prints")
    windows, p3 = saved(marked.select("item_id", "span", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - F.col("span")), lambda i: F.array_join(F.slice("w", i + 1, F.col("span")), " ")
    )).alias("said")).distinct(), "windows")
    worded = docs.withColumn("w", words(F.col("text"))).drop("text")
    # a fingerprint of another length only proposes a place more: windows are compared word by word in the end
    found = (
        fingerprints(worded, spans)
        .select("_k1", "_k2", F.explode(F.array_distinct(F.concat(*mins))).alias("fp"))
        .join(maybe_broadcast(prints, F.lit(8)), "fp")
        .groupBy("_k1", "_k2").agg(F.collect_set("fp").alias("fps"))
    )
    found, p4 = saved(found, "candidates")
    again = docs.join(maybe_broadcast(found, 16 + 8 * F.size("fps")), ["_k1", "_k2"]).withColumn("w", words(F.col("text"))).drop("text")

    def places(n):
        starts = F.filter(
            F.sequence(F.lit(0), F.size(f"mins_{n}") - 1), lambda i: F.array_contains("fps", F.get(f"mins_{n}", i))
        )
        some = F.transform(starts, lambda i: F.struct(F.lit(n).alias("span"), i.alias("pos")))
        return F.when(F.size(f"mins_{n}") > 0, some).otherwise(F.array().cast("array<struct<span:int,pos:int>>"))

    said = fingerprints(again, spans).withColumn("at", F.explode(F.concat(*(places(n) for n in spans)))).select(
        "_k1", "_k2", "at.pos", F.array_join(F.slice("w", F.col("at.pos") + 1, F.col("at.span")), " ").alias("said")
    )
    width = F.octet_length("said") + F.octet_length("item_id")
    return said.join(maybe_broadcast(windows, width), "said").select("_k1", "_k2", "item_id", "pos", "span"), [p1, p2, p3, p4]


def contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id",
    item_id_col: str = "item_id", item_text_col: str = "text", span: int = 10,
) -> DataFrame:
    """(_k1, _k2, n_hit, n_items, items_sha256) of every row key with a hit, as a shared table."""
    k1, k2 = row_key(id_col, text_col)
    rows = docs.select(k1.alias("_k1"), k2.alias("_k2"), F.col(text_col).alias("text"))
    bench = items.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(item_text_col)).alias("w")
    ).where(F.size("w") > 0)
    bench = bench.withColumn("span", F.least(F.size("w"), F.lit(span)))
    spans = sorted(r[0] for r in bench.select("span").distinct().collect())  # at most `span` rows
    if not spans:
        return rows.limit(0).select("_k1", "_k2", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items_sha256"))
    every, paths = hits(rows, bench, spans)
    per_doc = every.groupBy("_k1", "_k2").agg(
        F.collect_set(F.struct("pos", "span")).alias("places"), F.sort_array(F.collect_set("item_id")).alias("ids")
    )
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["pos"], p["pos"] + p["span"] - 1))))
    table, _ = saved(per_doc.select(
        "_k1", "_k2", F.size(covered).cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
    ), "contaminated")
    removed(docs.sparkSession, *paths)
    return table


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that hold a window of an item; all columns stay."""
    k1, k2 = row_key(id_col, text_col)
    names = free_names(docs, "_k1", "_k2")
    bad = contamination(docs, items, text_col, id_col).select("_k1", "_k2").toDF(*names)
    return docs.withColumns(dict(zip(names, (k1, k2)))).join(maybe_broadcast(bad, F.lit(16)), names, "left_anti").drop(*names)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row."""
    k1, k2 = row_key("doc_id", "text")
    rows = docs.select("doc_id", k1.alias("_k1"), k2.alias("_k2"), word_count(F.col("text")).alias("n_words"))
    found = contamination(docs, items)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(maybe_broadcast(found, F.lit(96)), ["_k1", "_k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
