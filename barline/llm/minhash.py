"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set holds its distinct shingles of five words (64-bit hashes). Documents with equal sets form
one class; only classes are compared. A class has a signature of `COORDS` minima, and is posted under its
coordinate-value pairs, rarest first, as far as a pair of classes with `MATCHES` equal coordinates must share
one (the prefix: COORDS - MATCHES + 1 pairs, less those that no other class has, which are skipped).
Candidates from the lists have their equal coordinates counted, and those at or above the match threshold are confirmed on
their full sets: 100 * intersection >= 75 * union. At similarity 0.75 a pair has fewer than 30 of 64
matches with probability below 1e-6.

Scale: the pairs of a list are never all emitted. First each member is compared with the list's first
class; lists whose members are then all in one component are done. In the others (where they are so many that
the last step would be dear, after further members served as pivots) the members outside the list's largest component
are held against those of other components, in blocks: of a list's outsiders and members about BLOCK each meet in one group, sizes
that don't fit are left out by their order, and the bitmaps of the rest are compared on arrays. Only pairs pass whose bitmaps of shingles allow a similarity of
0.75, an upper bound that loses no link. So no pair of different components is left open, and what is emitted is near the number
of links. All joins on a list or a pivot are plain joins that the adaptive skew join splits.

Defined results: A-Z are lower-cased and words are cut at ASCII white space; with fewer than five words
the whole sequence is the one shingle; null, empty and wordless texts have no shingle and link with nothing. Rows that repeat an id
are one node; rows with a null id link with nothing and have a null component. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, removed, saved, text_slices

SHINGLE = 5
COORDS = 64
MATCHES = 30
PREFIX = COORDS - MATCHES + 1
#: Further pivot rounds while the last step would look at more than CROWD pairs for each posting.
ROUNDS, CROWD = 6, 500
#: 64-bit words of a set's bitmap.
BITS = 32
#: Members of a list that meet as many others in one group.
BLOCK = 512
#: Pairs whose bitmaps are compared at once.
AT_ONCE = 1 << 13

_draw = np.random.default_rng(20240229)
SALT = _draw.integers(0, 1 << 63, COORDS, dtype=np.uint64)
FACTOR = _draw.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _draw.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.cast(pa.large_binary())
    at = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1] if len(known) else np.zeros(1, np.int64)
    data = known.buffers()[2].to_pybytes() if at[-1] else b""
    hashed = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.uint64, len(known))
    empty = np.diff(at) == 0
    codes = np.asarray(coded.indices)
    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    keep = ~empty[codes] if len(codes) else np.zeros(0, bool)
    word, owner = hashed[codes][keep] if len(codes) else np.zeros(0, np.uint64), owner[keep]
    edge = np.searchsorted(owner, np.arange(len(lists) + 1))
    m = max(len(word) - SHINGLE + 1, 0)
    grams = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        grams += word[j : j + m] * PLACE[j]
    grams = mixed(grams)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a >= SHINGLE:
            own = np.sort(grams[a : b - SHINGLE + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = (word[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each coordinate's hashes, 31 bits of it."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[i : i + 4096, None] ^ SALT) * FACTOR).min(0))
    return (low >> np.uint64(33)).astype(np.int32)


def signatures(df: DataFrame) -> DataFrame:
    """(id, n, f1, f2, sig) for (id, text): the set's size, 128 bits that identify the set, its signature."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                sig = np.concatenate([signature(s) for s in sets])
                f1 = np.array([mixed(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
                f2 = np.array([mixed(s * np.uint64(3)).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDS), pa.array(sig))],
                    ["id", "n", "f1", "f2", "sig"],
                )

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, sig array<int>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit for each shingle's hash. A bit of one set that another lacks stands for a shingle it lacks."""
    on = np.zeros(BITS * 64, np.uint8)
    on[(shingles * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)).astype(np.int64) % len(on)] = 1
    return np.packbits(on)


def full_sets(df: DataFrame) -> DataFrame:
    """(id, shingles array<long>, bits binary) for (id, text)."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                bits = pa.array([bitmap(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(edge), pa.array(flat)), bits], ["id", "shingles", "bits"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, shingles array<long>, bits binary")


def postings(classes: DataFrame) -> tuple[DataFrame, str]:
    """(token, rep, n): each class under the rarest shared coordinate-value pairs of its prefix; a shared table and its path."""
    tokens = classes.select("rep", "n", F.posexplode("sig").alias("at", "value")).select(
        "rep", "n", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")).alias("token")
    )
    # a table of its own: the tokens' side of the join is then a shuffle whose hot lists can be split
    shared, path = saved(tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"), "shared-tokens")
    listed = tokens.join(shared, "token").groupBy("rep", "n").agg(F.collect_list(F.struct("f", "token")).alias("own"))
    # of its COORDS pairs a class has COORDS - size that nobody shares; they fill the prefix first
    posted = (
        listed.where(F.size("own") >= MATCHES)
        .select("rep", "n", F.slice(F.sort_array("own"), 1, F.size("own") - (COORDS - PREFIX)).alias("own"))
        .select("rep", "n", F.explode("own").alias("own"))
        .select(F.col("own.token").alias("token"), "rep", "n")
    )
    posted, kept = saved(posted, "postings")
    removed(classes.sparkSession, path)
    return posted, kept


def sizes_fit(a: str, b: str):
    """Whether two sets' sizes allow a similarity of 0.75."""
    return (F.col(a) * 100 >= F.col(b) * 75) & (F.col(b) * 100 >= F.col(a) * 75)


def block_pairs(group, far, rep, n, component, main, bits) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of members of one group: i is far (outside the list's main component), j of another component than i, and sizes
    and bitmaps leave room for a similarity of 0.75: each bit that one set alone has is a shingle outside the intersection.

    Of two far members the one of the smaller `rep` is i. All arrays have an entry for each member; `bits` has BITS words each.
    """
    group = np.unique(group, return_inverse=True)[1].astype(np.int64)
    near = np.flatnonzero(far == 0)
    near = near[np.lexsort((n[near], group[near]))]
    outside = np.flatnonzero(far == 1)
    # sizes are below 2 ** 40: a group's members by size lie between two places
    key, base = (group[near] << 40) + n[near], group[outside] << 40
    first = np.searchsorted(key, base + -(-n[outside] * 75 // 100))
    count = np.maximum(np.searchsorted(key, base + n[outside] * 100 // 75, "right") - first, 0)
    ends = np.cumsum(count)
    on = np.bitwise_count(bits).sum(1, dtype=np.int64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    # members are taken in turns of about AT_ONCE pairs
    turn = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1] + AT_ONCE, AT_ONCE)) + 1 if len(ends) else []
    for x, y in zip([0, *turn], turn):
        c = count[x:y]
        i = np.repeat(outside[x:y], c)
        j = near[np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[x:y], c)]
        fits = (component[i] != component[j]) & ((component[j] == main[j]) | (rep[i] < rep[j]))
        i, j = i[fits], j[fits]
        both = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        most = np.minimum(n[i] - on[i], n[j] - on[j]) + both
        hit = most * 100 >= (n[i] + n[j] - most) * 75
        found.append((i[hit], j[hit]))
    return tuple(np.concatenate(z) for z in zip(*found))


def crossed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs within a list, of different components, whose sizes and bitmaps allow a similarity of 0.75.

    members: (token, rep, n, component, main, out, size); sets: (rep, bits). A list's outsiders and all its members are dealt out
    in blocks, each block of the one meeting each of the other in a group of its own.
    """
    kind = members.schema["rep"].dataType.simpleString()
    rows = members.join(sets.select("rep", "bits"), "rep").withColumns({
        "fars": F.ceil(F.col("out") / BLOCK).cast("int"), "nears": F.ceil(F.col("size") / BLOCK).cast("int"), "h": F.xxhash64("rep"),
    })
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    each = F.struct("far", "rep", "n", "component", "main", "bits").alias("m")
    outside = rows.where("component <> main").withColumns({"far": F.lit(1).cast("tinyint"), "fb": F.pmod("h", "fars").cast("int"), "nb": every("nears")})
    inside = rows.withColumns({"far": F.lit(0).cast("tinyint"), "nb": F.pmod("h", "nears").cast("int"), "fb": every("fars")})
    dealt = outside.select("token", "fb", "nb", each).unionByName(inside.select("token", "fb", "nb", each))

    def run(batches):
        for batch in batches:
            lists = batch.column("ms")
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            # as many groups at a time as have about 4 MB of bitmaps
            part = np.cumsum(sizes) // (1 << 14)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:]):
                flat = lists.slice(x, y - x).flatten()
                if not len(flat):
                    continue
                far, n = (np.asarray(flat.field(c)) for c in ("far", "n"))
                # ids of any type as numbers in their order
                names = pa.concat_arrays([flat.field(c) for c in ("rep", "component", "main")])
                rank = pc.rank(names, tiebreaker="dense").to_numpy().astype(np.int64).reshape(3, -1)
                bits = np.frombuffer(b"".join(flat.field("bits").to_pylist()), np.uint64).reshape(-1, BITS)
                i, j = block_pairs(np.repeat(np.arange(y - x), sizes[x:y]), far, rank[0], n, rank[1], rank[2], bits)
                rep = flat.field("rep")
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(i)), rep.take(pa.array(j))], ["a", "b"])

    return dealt.groupBy("token", "fb", "nb").agg(F.collect_list("m").alias("ms")).select("ms").mapInArrow(run, f"a {kind}, b {kind}")


class Linker:
    """Confirms candidate pairs of classes and keeps those that were compared."""

    def __init__(self, classes: DataFrame, sets: DataFrame):
        self.sigs = classes.select("rep", "sig")
        self.sets = sets
        self.tried: DataFrame | None = None
        self.links: DataFrame | None = None
        self.paths: list[str] = []

    def __call__(self, pairs: DataFrame) -> None:
        """pairs: (a, b); orders and deduplicates them, drops those compared before."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs, path = saved(pairs, "pairs")
        self.paths.append(path)
        self.tried = pairs if self.tried is None else self.tried.union(pairs)

        def side(table, column, name):
            return table.select(F.col("rep").alias(name), F.col(column).alias(f"{column}_{name}"))

        matched = (
            pairs.join(side(self.sigs, "sig", "a"), "a").join(side(self.sigs, "sig", "b"), "b")
            .where(F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda hit: hit)) >= MATCHES)
            .select("a", "b")
        )
        both = F.size(F.array_intersect("shingles_a", "shingles_b"))
        confirmed = (
            matched.join(side(self.sets, "shingles", "a"), "a").join(side(self.sets, "shingles", "b"), "b")
            .where(both * 100 >= (F.size("shingles_a") + F.size("shingles_b") - both) * 75)
            .select("a", "b")
        )
        new, path = saved(confirmed, "confirmed")
        self.paths.append(path)
        self.links = new if self.links is None else self.links.union(new)


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: components of linked documents."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sigs, p0 = saved(signatures(rows), "signatures")
    classes = sigs.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    classes, p1 = saved(classes, "classes")
    posted, p2 = postings(classes)
    needed = posted.select(F.col("rep").alias("id")).distinct()
    sets, p3 = saved(full_sets(rows.join(needed, "id")).withColumnRenamed("id", "rep"), "sets")
    link = Linker(classes, sets)
    first, p5 = saved(posted.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("pivot")), "pivots")
    star = posted.join(first.select("token", F.col("pivot.rep").alias("p"), F.col("pivot.n").alias("pn")), "token")
    link(star.where((F.col("rep") != F.col("p")) & sizes_fit("n", "pn")).select(F.col("rep").alias("a"), F.col("p").alias("b")))
    labels, path = components(link.links)
    for turn in range(ROUNDS + 1):
        placed = posted.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
        parts = placed.groupBy("token", "component").agg(F.count("*").alias("m"))
        lists = parts.groupBy("token").agg(
            F.count("*").alias("parts"), F.sum("m").alias("size"), F.max(F.struct("m", "component")).alias("main")
        ).where("parts > 1").select("token", F.col("main.component").alias("main"), (F.col("size") - F.col("main.m")).alias("out"), "size")
        lists, p6 = saved(lists, "lists")
        link.paths.append(p6)
        open_lists, p4 = saved(placed.join(lists, "token"), "open")
        cost = open_lists.agg(F.sum("out").alias("c"), F.count("*").alias("n")).first()
        if not cost.n:
            removed(spark, p4)
            break
        outside = open_lists.where("component <> main")
        if cost.c <= CROWD * cost.n or turn == ROUNDS:
            pairs = crossed(open_lists, sets)
        else:
            pivot = outside.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "n", "component")).alias("pivot"))
            pairs = open_lists.join(pivot, "token").where(
                (F.col("component") != F.col("pivot.component")) & sizes_fit("n", "pivot.n")
            ).select(F.col("rep").alias("a"), F.col("pivot.rep").alias("b"))
        link(pairs)
        removed(spark, path, p4)
        labels, path = components(link.links)
        if cost.c <= CROWD * cost.n or turn == ROUNDS:
            break
    owners = classes.select("f1", "f2", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "n", F.coalesce("component", "rep").alias("component")
    )
    owners, _ = saved(owners, "owners")
    ids, _ = saved(sigs.select("id", "n", "f1", "f2"), "sets-of")
    removed(spark, p0, p1, p2, p3, p5, path, *link.paths)
    linked = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), linked)
    return ids.join(owners, ["f1", "f2", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
