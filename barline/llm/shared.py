"""What the corpus operators have in common: shared tables, row keys, batches, components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path, process_state, removed, saved, shared_dir, sweep

__all__ = ["fresh_path", "process_state", "removed", "saved", "shared_dir", "sweep"]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over tasks and batches."""
    return process_state().__dict__.setdefault("cache", {})


def row_key(*columns: str) -> tuple[Column, Column]:
    """128 bits that identify a row by the named columns, nulls included; never null."""
    tagged = [c for name in columns for c in (F.col(name).isNull(), F.col(name))]
    return F.xxhash64(*tagged), F.xxhash64(F.lit(0x5EED), *tagged)


def release() -> None:
    """Give freed memory back to the system; allocators would keep it for the worker's life."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_slices(batch, column: str, max_bytes: int = 4 << 20) -> Iterator:
    """Parts of an Arrow batch whose texts take about `max_bytes` each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(size) // max_bytes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)
    release()


def held_by(labels: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Every id with its label from `labels` (node, component), itself where it has none."""
    return ids.join(labels.withColumnRenamed("node", id_col), id_col, "left").withColumn(
        "component", F.coalesce("component", F.col(id_col))
    )


#: Edges up to which a graph is small.
SMALL_GRAPH = 1_000_000


def _united(batches):
    """(node, component) of all edges (a, b) of one task."""
    import pandas as pd

    parent: dict = {}

    def find(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    nodes: set = set()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            nodes.update((a, b))
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    each = sorted(nodes)
    yield pd.DataFrame({"node": each, "component": [find(x) for x in each]})


def components(edges: DataFrame, label: str = "components") -> tuple[DataFrame, str]:
    """Connected components of `edges` (a, b) as (node, component), the smallest node of each.

    Alternates large-star and small-star steps; each round is a shared table, so neither the
    lineage nor anything on the driver grows. Nodes without an edge to another are not returned. Both steps
    join on a node: a hub's rows are split by the adaptive skew join, and its minimum is
    pre-aggregated. At most SMALL_GRAPH distinct edges (16 MB) are united by one task instead, which gives the same
    components without rounds. Returns the table and its path.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now, path = saved(both, label)
    if now.count() <= SMALL_GRAPH:
        kind = now.schema["a"].dataType.simpleString()
        done, new = saved(now.coalesce(1).mapInPandas(_united, f"node {kind}, component {kind}"), label)
        removed(spark, path)
        return done, new
    before = None
    while True:
        mark = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if mark == before:
            break
        before = mark
        sym = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after, new = saved(small, label)
        removed(spark, path)
        now, path = after, new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), path
