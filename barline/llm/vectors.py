"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits recursively on random directions; a vector within `spill` of a split goes to both sides, so
close pairs are rarely parted, and several trees make a miss in all of them negligible. Vectors are compared
within leaves in double precision, every pair at or above the threshold is verified and counted once (in the
first leaf that its two vectors share), and links are united into components.

Bounds: the forest is fitted on a sample of about `sample` vectors, chosen by a hash of the id; every vector is
indexed. Leaves above LARGE times `leaf` get a tree of their own, grown by a task from about FURTHER of their vectors, and so on until no large leaf can be
parted: so leaves don't grow with the table. Equal vectors are one class with a multiplicity. A leaf that no tree parts (close
vectors, which are links) is not capped: it is cut into blocks, and pairs of blocks are compared by
separate tasks that return counts and a spanning link for each vector, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; so do rows with a null id, whose component is null. Vectors of other lengths are never linked. Rows that
repeat an id are further vectors. Only the named columns are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import maybe_broadcast
from .minhash import mixed
from .shared import components, removed, saved

BLOCK = 1024
#: A leaf of more than so many times the wanted size is parted further; vectors that a further tree is grown from; and how many
#: vectors one task takes through such a tree, about.
LARGE, FURTHER, AT_ONCE = 4, 4096, 100_000


class Tree:
    """One tree as flat arrays; a negative child -k - 1 is leaf k."""

    def __init__(self, x: np.ndarray, scale: float, rng, leaf: int, spill: float, tries: int = 8):
        self.directions: list[np.ndarray] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves = 0
        self.root = self._grow(x, np.arange(len(x)), scale, rng, leaf, spill, tries, 0)

    def _grow(self, x, rows, scale, rng, leaf, spill, tries, depth) -> int:
        best = None
        if len(rows) * scale > leaf and len(rows) >= 32 and depth < 24:
            some = rng.standard_normal((tries, x.shape[1]))
            some /= np.linalg.norm(some, axis=1, keepdims=True)
            for d in some:
                p = np.sort(x[rows] @ d)
                for q in np.quantile(p, (0.3, 0.4, 0.5, 0.6, 0.7)):
                    near = np.searchsorted(p, q + spill) - np.searchsorted(p, q - spill)
                    if best is None or near < best[0]:
                        best = (near, d, q)
        if best is None or best[0] > 0.4 * len(rows):  # a split that sends most to both sides parts nothing
            self.leaves += 1
            return -self.leaves
        _, d, q = best
        at = len(self.cut)
        self.directions.append(d)
        self.cut.append(q)
        self.left.append(0)
        self.right.append(0)
        p = x[rows] @ d
        self.left[at] = self._grow(x, rows[p <= q + spill], scale, rng, leaf, spill, tries, depth + 1)
        self.right[at] = self._grow(x, rows[p >= q - spill], scale, rng, leaf, spill, tries, depth + 1)
        return at

    def leaves_of(self, x: np.ndarray, spill: float) -> list[tuple[np.ndarray, int]]:
        """(rows, leaf) for every leaf that has rows of x."""
        out, todo = [], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, -node - 1))
                continue
            p = x[rows] @ self.directions[node]
            todo.append((self.left[node], rows[p <= self.cut[node] + spill]))
            todo.append((self.right[node], rows[p >= self.cut[node] - spill]))
        return out


def grow_forest(sample: dict[int, np.ndarray], counts: dict[int, int], trees: int, leaf: int, spill: float, seed: int):
    """Trees for each vector length, with the number of their first leaf."""
    forest, first = {}, 0
    for dim in sorted(counts):
        x = sample.get(dim, np.zeros((0, dim)))
        own = []
        for t in range(trees):
            tree = Tree(x, counts[dim] / max(len(x), 1), np.random.default_rng([seed, dim, t]), leaf, spill)
            own.append((tree, first))
            first += tree.leaves
        forest[dim] = own
    return forest


def part_large(placed: DataFrame, leaf: int, spill: float, seed: int) -> tuple[DataFrame, list[str]]:
    """placed (leaf, rep, copies, v) with its large leaves parted by trees of their own, as often as that helps; and the paths of its tables."""
    spark = placed.sparkSession
    kind = placed.schema["rep"].dataType.simpleString()
    paths, whole = [], None  # whole: leaves that a tree couldn't part
    for depth in range(24):
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > LARGE * leaf)
        if whole is not None:
            sizes = sizes.join(whole, "leaf", "left_anti")
        sizes, path = saved(sizes, "large-leaves")
        paths.append(path)
        if sizes.isEmpty():
            break
        draw = F.shiftrightunsigned(F.xxhash64("rep", F.lit(11 + depth)), 11) / F.lit(float(1 << 53))
        some = placed.join(sizes, "leaf").where(draw < FURTHER / F.col("size")).select("leaf", "size", "rep", "v")

        def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rep", kind="stable")
            rng = np.random.default_rng([seed, depth, key[0] & 0xFFFFFFFF])
            tree = Tree(unit(pdf["v"]), pdf["size"].iloc[0] / len(pdf), rng, leaf, spill)
            return pd.DataFrame({"leaf": [key[0]], "tree": [pickle.dumps(vars(tree))], "leaves": [tree.leaves]})

        trees, path = saved(some.groupBy("leaf").applyInPandas(grow, "leaf long, tree binary, leaves int"), "trees")
        paths.append(path)
        stuck = trees.where("leaves = 1").select("leaf")
        whole = stuck if whole is None else whole.union(stuck)
        parted = trees.where("leaves > 1").join(sizes, "leaf").withColumn("salts", F.ceil(F.col("size") / AT_ONCE).cast("int")).select("leaf", "salts", "tree")
        # a leaf's tree comes before its vectors, in every task that has some of them
        mine = placed.join(parted.select("leaf", "salts"), "leaf").select(
            "leaf", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("nth"), "rep", "copies", "v", F.lit(None).cast("binary").alias("tree")
        )
        guides = parted.select("leaf", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("nth"), "tree")
        dealt = mine.unionByName(guides, allowMissingColumns=True).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "nth")

        def descend(batches):
            tree = None
            for batch in batches:
                nth = np.asarray(batch.column("nth"))
                guide = np.flatnonzero(nth == 0)
                for a, b in zip([0, *(guide + 1).tolist()], [*guide.tolist(), len(nth)]):
                    if b > a:
                        own = batch.slice(a, b - a)
                        found = tree.leaves_of(unit(own.column("v").to_pylist()), spill)
                        take = np.concatenate([rows for rows, _ in found])
                        base = own.column("leaf")[0].as_py() * 1_000_003
                        child = np.concatenate([np.full(len(rows), (base + k + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64) for rows, k in found])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(mixed(child).view(np.int64)), *(own.column(c).take(pa.array(take)) for c in ("rep", "copies", "v"))], ["leaf", "rep", "copies", "v"]
                        )
                    if b < len(nth):
                        tree = Tree.__new__(Tree)
                        vars(tree).update(pickle.loads(batch.column("tree")[b].as_py()))

        further = dealt.mapInArrow(descend, f"leaf long, rep {kind}, copies long, v array<double>")
        placed, path = saved(placed.join(parted.select("leaf"), "leaf", "left_anti").unionByName(further), "leaves")
        paths.append(path)
    return placed, paths


def unit(rows) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare_cell(ids, copies, x, codes, leaf, one_block, side, threshold):
    """Link counts and a local root for the vectors of one leaf, or of two blocks of it."""
    n = len(ids)
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    if not one_block:
        hit &= side[:, None] != side[None, :]
    lower = sorted({c for own in codes for c in own if c < leaf})
    counted = hit
    if lower and hit.any():
        place = {c: i for i, c in enumerate(lower)}
        member = np.zeros((n, len(lower)), np.float32)
        for i, own in enumerate(codes):
            for c in own:
                if c < leaf:
                    member[i, place[c]] = 1
        counted = hit & (member @ member.T == 0)
    links = (counted * copies[None, :]).sum(1)
    root = np.arange(n)
    a, b = np.nonzero(hit)
    while len(a):
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return links, ids[root]


def near_duplicates(
    df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = 0.95,
    trees: int = 6, leaf: int = 800, spill: float = 0.02, sample: int = 8192, seed: int = 7,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = df.sparkSession
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    largest = F.array_max(F.transform(v, lambda x: F.abs(x)))  # NaN is the largest double
    usable = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()) & (largest > 0) & (largest < float("inf"))
    key = (F.xxhash64("v"), F.xxhash64(F.lit(1), v))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    keyed = rows.select("id", "ok", *(F.when(F.col("ok"), k).alias(f"_k{i}") for i, k in enumerate(key)), "v")
    classes = (
        keyed.where("ok").groupBy("_k0", "_k1")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    )
    classes, p1 = saved(classes, "vectors")
    counts = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}  # a row for each vector length
    total = sum(counts.values())
    draw = F.shiftrightunsigned(F.xxhash64("rep", F.lit(3)), 11) / F.lit(float(1 << 53))
    drawn: dict[int, list] = {}
    for r in classes.where(draw < sample / max(total, 1)).select("v").collect():
        drawn.setdefault(len(r.v), []).append(r.v)
    forest = grow_forest({d: unit(sorted(x)) for d, x in drawn.items()}, counts, trees, leaf, spill, seed)
    shared = spark.sparkContext.broadcast(forest)

    def index(batches):
        for batch in batches:
            lists = batch.column("v").to_pylist()
            if not lists:
                continue
            by_dim: dict[int, list[int]] = {}
            for i, x in enumerate(lists):
                by_dim.setdefault(len(x), []).append(i)
            at, where = [], []
            for dim, members in by_dim.items():
                x = unit([lists[i] for i in members])
                own = np.array(members)
                for tree, first in shared.value[dim]:
                    for found, k in tree.leaves_of(x, spill):
                        at.append(own[found])
                        where.append(np.full(len(found), first + k, np.int64))
            at, where = np.concatenate(at), np.concatenate(where)
            order = np.lexsort((where, at))
            at, where = at[order], where[order]
            edge = np.searchsorted(at, np.arange(len(lists) + 1)).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(edge), pa.array(where))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), batch.column("rep").take(take), batch.column("copies").take(take), batch.column("v").take(take), codes.take(take)],
                ["leaf", "rep", "copies", "v", "codes"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    placed = classes.select("rep", "copies", "v").mapInArrow(
        index, f"leaf long, rep {kind}, copies long, v array<double>, codes array<long>"
    )
    placed, p2 = saved(placed, "leaves")
    finer, paths = part_large(placed.drop("codes"), leaf, spill, seed)
    if len(paths) > 1:  # some leaves were parted: a vector's leaves are others now
        placed = finer.join(finer.groupBy("rep").agg(F.collect_list("leaf").alias("codes")), "rep")
    blocks = finer.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks, path = saved(blocks, "blocks")
    paths.append(path)
    cells = (
        placed.join(maybe_broadcast(blocks, F.lit(12)), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "rep", "copies", "v", "codes")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"id": [], "links": [], "root": []})
        pdf = pdf.sort_values("rep", kind="stable")
        links, root = compare_cell(
            pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), unit(pdf["v"]), pdf["codes"].tolist(), pdf["leaf"].iloc[0],
            pdf["bi"].iloc[0] == pdf["bj"].iloc[0], pdf["own"].to_numpy(), threshold,
        )
        out = pd.DataFrame({"id": pdf["rep"].to_numpy(), "links": links, "root": root})
        return out[(out["links"] > 0) | (out["id"] != out["root"])]

    found = cells.groupBy("leaf", "bi", "bj").applyInPandas(compare, f"id {kind}, links long, root {kind}")
    found, p3 = saved(found, "links")
    degree = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    labels, p4 = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        classes.select("_k0", "_k1", "rep", "copies")
        .join(degree, "rep", "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("_k0", "_k1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    known, _ = saved(known, "classes")
    removed(spark, p1, p2, p3, p4, *paths)
    return keyed.select("id", "_k0", "_k1").join(known, ["_k0", "_k1"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
