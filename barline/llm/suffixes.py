"""Suffix-array dedup: every byte inside a 400-byte string that starts anywhere else is removed.

Shorter repeats, from 256 bytes and over 50 words, aren't removed but counted as passages.

Sorting: suffixes are ordered deep-shallow. A multikey quicksort runs to a shallow depth; what is still tied
there shares a long prefix and is ordered by a blind trie (Patricia), which compares each suffix with one other.

Which suffixes: of the 193 64-grams in each 256-byte string the one with the smallest hash (leftmost, if equal) is its
anchor, a choice that depends on the string's bytes alone. Two equal strings therefore meet at an anchor, at the same
offset (a 400-byte string at those of the 256-byte strings in it), and only suffixes at anchors that occur twice are
sorted: about one position in 97, and none in unique text.
In an anchor's group the suffixes to the right (400 bytes) and, reversed, the texts to the left (336 bytes) are both sorted.
Groups of suffixes are merged from the longest common prefix down; a merged suffix's neighbours in the left order
give the longest left match for that right match, hence every repeated string through the anchor.

Scale: copies of whole texts are resolved by counting. Equal contexts of an anchor are resolved by counting
too, without their bytes. The distinct ones are sorted by anchor, in groups of at most `GROUP`; a larger
group is split by window offsets into parts with longer common strings, whose equal contexts are counted
again, down to single windows, so a passage that many documents share never gathers in a task.

Defined results: a null text is an empty one; rows with equal texts are different documents, whatever their ids. The
bytes that remain are judged by the input, not by what is left. Words of a passage are cut at ASCII white space.
Only id and text are read.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, row_key, saved, text_slices

LENGTH = 400
#: Repeats from this length on are passages, if they have more than PASSAGE_WORDS words.
SHORT = 256
PASSAGE_WORDS = 50
GRAM = 64
BEFORE = LENGTH - GRAM  # an anchor's largest offset in a string
GROUP = 1000
SHALLOW = 16
SEGMENT = 1 << 21
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@functools.cache
def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _segment_anchors(raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of all SHORT-byte strings that lie in one owner's bytes."""
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE)[:n], out=total[1:])
    h = (total[GRAM:] - total[: n - GRAM + 1]) * _powers(BASE_INVERSE)[: n - GRAM + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    m, width = len(h), SHORT - GRAM + 1
    # the smallest of each window: high bits of the hash, then the position, so that equal grams go to the left
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
    pad = -m % width
    grid = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    low = np.minimum(ahead[: m - width + 1], behind[width - 1 : m])
    low = low[owner[: n - SHORT + 1] == owner[SHORT - 1 :]]
    # a window's anchor is mostly its neighbour's
    low = low[np.flatnonzero(np.diff(low, prepend=np.uint64(0)))] if len(low) else low
    at = np.unique(low & np.uint64((1 << 24) - 1)).astype(np.int64)
    return at, h[at]


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position in it and gram hash of every anchor of texts that lie one after another in raw."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    found = [
        (at + i, h)
        for i in range(0, len(raw) - SHORT + 1, SEGMENT - SHORT + 1)
        for at, h in [_segment_anchors(raw[i : i + SEGMENT], owner[i : i + SEGMENT])]
    ]
    at = np.concatenate([a for a, _ in found] or [np.empty(0, np.int64)])
    at, first = np.unique(at, return_index=True)
    h = np.concatenate([x for _, x in found] or [np.empty(0, np.uint64)])[first]
    return owner[at], at - offsets[owner[at]], h


def lcp(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least `start`."""
    end = min(len(a), len(b))
    lo, step = start, 16
    while lo < end:
        hi = min(lo + step, end)
        if a[lo:hi] != b[lo:hi]:
            break
        lo, step = hi, step * 2
    else:
        return end
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def multikey_quicksort(texts: list[bytes], shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Indices in order, as lists of those tied at the shallow depth. Keys are eight bytes at a time."""
    todo = [(list(range(len(texts))), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) == 1 or depth >= shallow:
            yield rows
            continue
        keys = [texts[i][depth : depth + 8] for i in rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, k in zip(rows, keys) if k < pivot]
        same = [i for i, k in zip(rows, keys) if k == pivot]
        more = [i for i, k in zip(rows, keys) if k > pivot]
        if more:
            todo.append((more, depth))
        todo.append((same, depth + 8 if len(pivot) == 8 else shallow))
        if less:
            todo.append((less, depth))


class BlindTrie:
    """Orders texts with a long common prefix. A node is a list [depth, first leaf, {byte: node}]; a leaf
    is a list of equal texts' indices. Descending looks at branching bytes alone; one comparison with the leaf reached
    then tells where the new text branches off."""

    def __init__(self, texts: list[bytes], shared: int):
        self.texts, self.shared, self.root = texts, shared, None

    def _byte(self, i: int, depth: int) -> int:
        t = self.texts[i]
        return t[depth] if depth < len(t) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = (None, [i])
            return
        path, node = [], self.root
        while node[0] is not None:
            path.append(node)
            child = node[2].get(self._byte(i, node[0]))
            node = child if child is not None else next(iter(node[2].values()))
        other = node[1][0]
        common = lcp(self.texts[i], self.texts[other], self.shared)
        if common == len(self.texts[i]) == len(self.texts[other]):
            node[1].append(i)
            return
        up = None
        for node in path:
            if node[0] > common:
                break
            up = node
        leaf = (None, [i])
        if up is not None and up[0] == common:
            up[2][self._byte(i, common)] = leaf
            return
        below = self.root if up is None else up[2][self._byte(i, up[0])]
        branch = (common, None, {self._byte(other, common): below, self._byte(i, common): leaf})
        if up is None:
            self.root = branch
        else:
            up[2][self._byte(i, up[0])] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in order, and the common prefix of each with the one before it (the first: 0)."""
        order: list[int] = []
        common: list[int] = []
        todo: list[tuple] = [(self.root, 0)]
        while todo:
            node, before = todo.pop()
            if node[0] is None:
                order += node[1]
                common += [before, *[len(self.texts[node[1][0]])] * (len(node[1]) - 1)]
                continue
            children = [node[2][k] for k in sorted(node[2])]
            for child in children[:0:-1]:
                todo.append((child, node[0]))
            todo.append((children[0], before))
        return order, common


def deep_shallow_sort(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """The texts' order and the common prefix of each with the one before it."""
    order: list[int] = []
    common: list[int] = []
    for tied in multikey_quicksort(texts):
        some, inner = tied, [0]
        if len(tied) > 1:
            trie = BlindTrie(texts, 0)
            for i in tied:
                trie.insert(i)
            some, inner = trie.ordered()
        if order:
            inner[0] = lcp(texts[order[-1]], texts[some[0]])
        order += some
        common += inner
    return order, common


def repeated_ranges(lefts: list[bytes], rights: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each context of one anchor, (bytes before, bytes after) of matches with another of SHORT or more bytes.

    lefts are reversed. Merges suffix groups from the longest common prefix down, the smaller into the larger; for
    each suffix that moves, the nearest in left order on either side have its longest left match.
    """
    n = len(rights)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def meet(x: int, y: int, right: int) -> None:
        left = lcp(lefts[x], lefts[y])
        if left + right >= SHORT:
            out[x].append((left, right))
            out[y].append((left, right))

    if n == 2:  # each is the other's neighbour in both orders
        meet(0, 1, lcp(rights[0], rights[1]))
        return out
    order, common = deep_shallow_sort(rights)
    rank = [0] * n
    by_rank = deep_shallow_sort(lefts)[0]
    for r, i in enumerate(by_rank):
        rank[i] = r
    sets: list[list[int] | None] = [[rank[i]] for i in order]
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in sorted(range(1, n), key=lambda i: -common[i]):
        right = common[at]
        a, b = find(at - 1), find(at)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for r in sets[b]:
            k = bisect_left(large, r)
            if k:
                meet(by_rank[r], by_rank[large[k - 1]], right)
            if k < len(large):
                meet(by_rank[r], by_rank[large[k]], right)
            large.insert(k, r)
        sets[b], parent[b] = None, a
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _anchor_rows(batches):
    for batch in batches:
        for part in text_slices(batch, "text"):
            text = part.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            owner, at, h = anchors(raw, offsets - offsets[0])
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [part.column("k1").take(take), part.column("k2").take(take), pa.array(at), pa.array(h.view(np.int64))], ["k1", "k2", "pos", "anchor"]
            )


def _bounds(pos: int, n: int) -> tuple[int, int]:
    return max(0, pos - BEFORE), min(n, pos + LENGTH)


def _placed(batch):
    """(k1, k2, text as bytes, places as pairs (pos, anchor)) of each row."""
    places = batch.column("places")
    inner = places.flatten()
    pos, anchor = (inner.field(c).to_pylist() for c in ("pos", "anchor"))
    edge = np.concatenate([[0], np.cumsum(np.asarray(places.value_lengths()))]).tolist()
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    for k1, k2, data, a, b in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), texts, edge, edge[1:]):
        yield k1, k2, data, zip(pos[a:b], anchor[a:b])


def _context_hashes(batches):
    """(k1, k2, places) -> a row for each anchor with 128 bits of its context."""
    import xxhash

    for batch in batches:
        for part in text_slices(batch, "text"):
            rows, digests = [], []
            for k1, k2, data, places in _placed(part):
                for pos, anchor in places:
                    a, b = _bounds(pos, len(data))
                    digests.append(xxhash.xxh3_128_digest(data[a:b] + (pos - a).to_bytes(2, "little")))
                    rows.append((k1, k2, pos, anchor, a, b))
            c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            k1, k2, pos, anchor, a, b = zip(*rows) if rows else [()] * 6
            columns = [k1, k2, pos, anchor, c[:, 0], c[:, 1], a, b]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["k1", "k2", "pos", "anchor", "c1", "c2", "a", "b"])


def _context_bytes(batches):
    for batch in batches:
        for part in text_slices(batch, "text", 1 << 20):
            rows = []
            for k1, k2, data, places in _placed(part):
                for pos, anchor in places:
                    a, b = _bounds(pos, len(data))
                    rows.append((k1, k2, pos, anchor, data[a:pos], data[pos:b]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["k1", "k2", "pos", "anchor", "before", "after"])


def _sorted_groups(batches):
    """Contexts sorted by group -> (k1, k2, a, b, long) of repeated bytes, long: by LENGTH-byte strings. A group may lie in two batches."""

    def done(group, out):
        ranges = repeated_ranges([g[5][::-1] for g in group], [g[6] for g in group])
        for (k1, k2, pos, *_), found in zip(group, ranges):
            found = [(pos - x, pos + y) for x, y in found]
            long = merged([r for r in found if r[1] - r[0] >= LENGTH])
            out += [(k1, k2, a, b, True) for a, b in long]
            out += [(k1, k2, a, b, False) for a, b in merged(found) if (a, b) not in long]

    def rows(out):
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["k1", "k2", "a", "b", "long"])

    group: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "pos", "g1", "g2", "before", "after"))):
            if group and row[3:5] != group[0][3:5]:
                if len(group) > 1:
                    done(group, out)
                group = []
            group.append(row)
        if out:
            yield rows(out)
    out = []
    if len(group) > 1:
        done(group, out)
    if out:
        yield rows(out)


def _cut(batches):
    """(k1, k2, text, ranges) -> what is left of each text, and how many passages it has."""
    import hashlib

    for batch in batches:
        for part in text_slices(batch, "text"):
            rows = []
            for k1, k2, text, ranges in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "ranges"))):
                data = text.encode()
                spans = merged([(r["a"], r["b"]) for r in ranges if r["long"]])
                passages = sum(len(data[a:b].split()) > PASSAGE_WORDS for a, b in merged([(r["a"], r["b"]) for r in ranges]))
                left, at = [], 0
                for a, b in spans:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                kept = b"".join(left)
                rows.append((k1, k2, len(data) - len(kept), len(spans), passages, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["k1", "k2", "n_removed", "n_spans", "n_passages", "kept_sha256", "kept"])


def _split(big: DataFrame, parts: int = 7) -> DataFrame:
    """Contexts of too large groups (with offsets lo to hi of windows of `wide` bytes) by narrower ranges of offsets.

    Windows at offsets lo..hi all hold the bytes from lo before the anchor to wide - hi after it; with the range they
    make the new group. A context keeps the bytes that its windows hold.
    """
    step = F.ceil((F.col("hi") - F.col("lo") + 1) / parts).cast("int")
    ranges = big.withColumn("from", F.explode(F.sequence(F.col("lo"), F.col("hi"), step))).withColumn(
        "to", F.least(F.col("from") + step - 1, F.col("hi"))
    ).where(F.octet_length("before") >= F.col("from"))
    have = F.octet_length("before")
    core = F.concat(
        F.expr("substring(before, octet_length(before) - `from` + 1, `from`)"), F.expr("substring(after, 1, wide - `to`)")
    )
    return (
        ranges.where(F.octet_length("after") >= F.col("wide") - F.col("to"))
        .withColumns({g: F.xxhash64(g, "wide", "from", "to", core) for g in ("g1", "g2")})
        .withColumns({
            "before": F.when(have > F.col("to"), F.expr("substring(before, octet_length(before) - `to` + 1, `to`)")).otherwise(F.col("before")),
            "after": F.expr("substring(after, 1, wide - `from`)"),
        })
        .select("k1", "k2", "pos", "g1", "g2", "before", "after", "wide", F.col("from").alias("lo"), F.col("to").alias("hi"))
    )


def _ranges(contexts: DataFrame, paths: list[str]) -> DataFrame:
    """(k1, k2, a, b, long) of repeated bytes among distinct contexts (k1, k2, pos, g1, g2, before, after).

    A group too large to be sorted in a task is split for windows of LENGTH and of SHORT bytes, again and again.
    """
    spark, found, used = contexts.sparkSession, None, []
    is_long = F.col("b") - F.col("a") >= LENGTH
    contexts = contexts.withColumns({"wide": F.lit(0), "lo": F.lit(0), "hi": F.lit(1)})

    def add(more):
        nonlocal found
        more, path = saved(more.select("k1", "k2", "a", "b", "long"), "ranges")
        paths.append(path)
        found = more if found is None else found.union(more)

    while True:
        sizes, path = saved(contexts.groupBy("g1", "g2").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        used.append(path)
        sized = contexts.join(sizes, ["g1", "g2"])
        small = sized.where(F.col("m") <= GROUP).select("k1", "k2", "pos", "g1", "g2", "before", "after")
        add(small.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_sorted_groups, "k1 long, k2 long, a long, b long, long boolean"))
        big = sized.where((F.col("m") > GROUP) & (F.col("lo") < F.col("hi"))).drop("m")
        if big.isEmpty():
            removed(spark, *used)
            return found
        windows = F.array(*(F.struct(F.lit(w).alias("wide"), F.lit(0).alias("lo"), F.lit(w - GRAM).alias("hi")) for w in (LENGTH, SHORT)))
        whole = big.where("wide = 0").drop("wide", "lo", "hi").select("*", F.inline(windows))
        finer, path = saved(_split(big.where("wide > 0").unionByName(whole)), "finer")
        same = ["g1", "g2", "before", "after"]
        counted = finer.groupBy(*same).agg(F.count("*").alias("m"), F.min(F.struct("k1", "k2", "pos", "wide", "lo", "hi")).alias("one"))
        counted, kinds = saved(counted, "counted")
        equal = finer.join(counted.where("m > 1").select(*same), same)
        add(equal.select("k1", "k2", (F.col("pos") - F.octet_length("before")).alias("a"), (F.col("pos") + F.octet_length("after")).alias("b")).withColumn("long", is_long))
        contexts, after = saved(counted.select("one.*", *same), "contexts")
        removed(spark, path, kinds, *used)
        used = [after]


def repeated_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All rows as (id, k1, k2, n_bytes, n_words, sha, copies), and (k1, k2, n_removed, n_spans, n_passages, kept_sha256, kept) of the
    rows with repeats (exactly repeated rows: as often). A row with copies is removed whole if it has LENGTH bytes."""
    spark = df.sparkSession
    k1, k2 = row_key("id", "text")
    t1, t2 = row_key("text")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({"k1": k1, "k2": k2})
    n_words = F.size(F.array_remove(F.split("text", "[ \t-\r]+", -1), ""))
    keys = docs.select(
        "id", "k1", "k2", t1.alias("t1"), t2.alias("t2"), F.octet_length("text").cast("long").alias("n_bytes"), n_words.alias("n_words"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
    )
    keys, _ = saved(keys, "texts")
    copied = keys.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2")).alias("one")).where("copies > 1")
    # the counted sides of joins are tables of their own: then the other side's hot keys can be split
    copied, _ = saved(copied, "copied")
    keys = keys.join(copied, ["t1", "t2"], "left")
    rows = keys.select("id", "k1", "k2", "n_bytes", "n_words", "sha", F.coalesce("copies", F.lit(1)).alias("copies"))
    others = keys.where("copies > 1").where((F.col("k1") != F.col("one.k1")) | (F.col("k2") != F.col("one.k2"))).select("k1", "k2").distinct()
    long = docs.where(F.octet_length("text") >= SHORT).select("k1", "k2", "text")
    places = long.mapInArrow(_anchor_rows, "k1 long, k2 long, pos long, anchor long").join(others, ["k1", "k2"], "left_anti")
    places, p1 = saved(places, "anchors")
    again, p2 = saved(places.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "repeated")
    own = places.join(again, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "anchor")).alias("places"))
    texts, p3 = saved(long.join(own, ["k1", "k2"]), "anchored")
    removed(spark, p1, p2)
    marks, p4 = saved(texts.mapInArrow(_context_hashes, "k1 long, k2 long, pos long, anchor long, c1 long, c2 long, a long, b long"), "contexts")
    counted = marks.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("m"), F.min(F.struct("k1", "k2", "pos")).alias("one"))
    counted, p5 = saved(counted, "counted")
    whole, p6 = saved(marks.join(counted.where("m > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"]).select("k1", "k2", "a", "b", (F.col("b") - F.col("a") >= LENGTH).alias("long")), "whole")
    removed(spark, p4)
    mixed, p7 = saved(counted.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"), "mixed")
    chosen = counted.join(mixed, "anchor").groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("one.pos", "anchor")).alias("places"))
    contexts = texts.drop("places").join(chosen, ["k1", "k2"]).mapInArrow(
        _context_bytes, "k1 long, k2 long, pos long, anchor long, before binary, after binary"
    ).select("k1", "k2", "pos", F.col("anchor").alias("g1"), F.lit(0).cast("long").alias("g2"), "before", "after")
    contexts, p8 = saved(contexts, "bytes")
    removed(spark, p5, p7)
    paths = [p3, p6, p8]
    found = whole.union(_ranges(contexts, paths)).distinct()
    per_doc = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "long")).alias("ranges"))
    cut, _ = saved(
        texts.drop("places").join(per_doc, ["k1", "k2"])
        .mapInArrow(_cut, "k1 long, k2 long, n_removed long, n_spans long, n_passages long, kept_sha256 string, kept binary"), "cut"
    )
    removed(spark, *paths)
    return rows, cut


def suffix_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passages) for every row. A passage is a run of repeated
    strings of SHORT or more bytes with more than PASSAGE_WORDS words."""
    rows, cut = repeated_spans(df, text_col, id_col)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= SHORT)
    zero = F.lit(0).cast("long")
    once = cut.drop("kept").dropDuplicates(["k1", "k2"])  # exactly repeated rows have the same key
    return rows.join(once, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copied, (F.col("n_words") > PASSAGE_WORDS).cast("long")).otherwise(F.coalesce("n_passages", zero)).alias("n_passages"),
    )
