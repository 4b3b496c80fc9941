"""Line dedup: windows of three consecutive lines that occurred before are removed.

Every window of `window` lines is hashed (128 bits), its first occurrence in the corpus (smallest id, then
smallest line) is found, and lines covered by any later occurrence are removed; overlapping occurrences merge.
Occurrences are judged on the input, not on what is left.

Scale: one pre-aggregated shuffle of hashes finds repeated windows; a join marks later occurrences
(its hot windows are split by the adaptive skew join, for nothing above needs a window's rows together);
one list for each document goes back to the texts. No group of copies meets in a task.

Defined results: lines are split at "\\n" alone and compared exactly; windows of empty lines only aren't
compared; a text with fewer lines has no window. A null text stays null with 0 lines. Rows with null ids come first. Exactly repeated
rows (same id and text) are the same occurrence, so all of them stay as the first one does.
Other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, row_key, saved


def line_array(column):
    return F.split(column, "\n", -1)


def covered_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 3) -> DataFrame:
    """(_k1, _k2, _covered): for each row key with a later occurrence, the covered line numbers."""
    k1, k2 = row_key(id_col, text_col)
    rows = df.select(F.col(id_col).alias("id"), k1.alias("_k1"), k2.alias("_k2"), line_array(F.col(text_col)).alias("l"))
    rows = rows.where(F.size("l") >= window)
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("l") - window),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*(F.get("l", i + j) for j in range(window))).alias("h1"),
            F.xxhash64(F.lit(1), *(F.get("l", i + j) for j in range(window))).alias("h2"),
            F.greatest(*(F.length(F.get("l", i + j)) for j in range(window))).alias("longest"),
        ),
    )
    occ = (
        rows.select("id", "_k1", "_k2", F.inline(hashes))
        .where("longest > 0").drop("longest")
        .withColumn("at", F.struct("id", "_k1", "_k2", "pos"))
    )
    first = occ.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    # a table of its own: the join's other side, with its hot windows, is then a shuffle that can be split
    first, _ = saved(first, "first-windows")
    later = occ.join(first, ["h1", "h2"]).where(F.col("at") > F.col("first"))
    starts = later.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("starts"))
    return starts.select(
        "_k1", "_k2",
        F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1))))).alias("_covered"),
    )


def line_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 3, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """df with the remaining text, and the numbers of lines and of removed lines (both of the input) in the columns `counts`.

    Columns of df named like those are replaced.
    """
    a, b, covered_at, at = free_names(df, "_k1", "_k2", "_covered", "_l")
    k1, k2 = row_key(id_col, text_col)
    names = [c for c in df.columns if c not in counts]
    covered = covered_lines(df, text_col, id_col, window).toDF(a, b, covered_at)
    rows = df.select(*names).withColumns({a: k1, b: k2}).join(covered, [a, b], "left")
    rows = rows.withColumn(at, F.when(F.col(covered_at).isNotNull(), line_array(F.col(text_col))))
    left = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(at) - 1), F.col(covered_at)), lambda i: F.get(at, i)
    )
    return rows.select(
        *(F.when(F.col(covered_at).isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(c) for c in names),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(line_array(F.col(text_col)))).cast("long").alias(counts[0]),
        F.when(F.col(covered_at).isNull(), 0).otherwise(F.size(covered_at)).cast("long").alias(counts[1]),
    )
