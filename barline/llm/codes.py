"""Vector code compression: product quantisation in whole numbers, nearest entries found by annular norm pruning.

Components become floor(1024 * x); a vector is cut into `parts` equal consecutive parts, and each part position has a
codebook of `entries`, fitted by rounds of assigning every part to its nearest entry and replacing entries by the floored mean
of their parts. A vector's code is the indices of its parts' nearest entries.

Nearest entries: a codebook is sorted by norm. By the triangle inequality an entry at distance d of a part has a norm within d of
the part's, so the current best distance allows only an annulus of norms: an interval of the sorted codebook, which
binary search finds. The first best is the nearest of `PROBES` entries around the part's own norm; then all entries of
the annulus, its ends included, are evaluated exactly. Parts of neighbouring norms share one evaluation, over all their annuli. Sums of squares
stay below 2**53 in doubles, or are Python integers where components are so large that they might not; so distances are exact, and
ties go to the lower index.

Scale: whole numbers are made once and kept as a shared table, and each of the rounds reads it once. A task adds at most
parts * entries rows of sums to a round, and a codebook (broadcast) has parts * entries rows whatever the table's size. Errors are
summed by label before they are joined back; a hot label's rows are split by the adaptive skew join.

Defined results: rows whose vector is null or empty or holds null or non-finite components are dropped. So are vectors of
another length than most have (of equally frequent lengths, the longest; only lengths that the number of parts divides
count). Codebooks start with the smallest ids, repeated ids by their vectors, null ids last; fewer vectors make a smaller codebook.
Rows that repeat an id are coded each. An empty table gives an empty result. Components beyond
2**53 are taken as the long nearest to them; a row's error beyond a long fails the job.
"""

from __future__ import annotations

import bisect
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import maybe_broadcast
from .shared import saved

#: What a component is multiplied by.
SCALE = 1024
#: Entries around a part's own norm that give the first best distance.
PROBES = 8
#: Parts of neighbouring norms that are evaluated together.
TOGETHER = 512


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: list[list[int]]):
        squares = [sum(c * c for c in e) for e in entries]
        self.order = np.array(sorted(range(len(entries)), key=lambda i: squares[i]), np.int64)
        self.whole = [entries[i] for i in self.order]
        self.norm = np.sqrt(np.array([float(squares[i]) for i in self.order]))
        self.widest = max((abs(c) for e in entries for c in e), default=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry for each row of whole numbers."""
        top = max(self.widest, int(x.max(initial=0)), -int(x.min(initial=0)))
        if x.shape[1] * (2 * top) ** 2 * len(self.whole) < 1 << 52:
            return self._in_doubles(x.astype(np.float64))
        found = [self._in_integers(row) for row in x.tolist()]
        return np.array([i for i, _ in found], np.int64), np.array([d for _, d in found], object)

    def _in_doubles(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By blocks of parts with neighbouring norms, each over the annulus that its parts' annuli make up. All sums are exact, and
        so is squared distance * entries + index, whose least value is the nearest entry with the lowest index."""
        k = len(self.whole)
        entries = np.array(self.whole, np.float64)
        fixed = (entries * entries).sum(1) * k + self.order
        square = (x * x).sum(1)
        norm = np.sqrt(square)
        out = np.empty(len(x))
        sorted_rows = np.argsort(norm)
        for i in range(0, len(x), TOGETHER):
            rows = sorted_rows[i : i + TOGETHER]
            block, size = x[rows], norm[rows]

            def least(a, b):
                return (fixed[a:b] - (2 * k) * (block @ entries[a:b].T)).min(1, initial=np.inf) + square[rows] * k

            start = np.clip(np.searchsorted(self.norm, size) - PROBES // 2, 0, max(k - PROBES, 0))
            first, last = int(start.min()), min(int(start.max()) + PROBES, k)
            best = least(first, last)
            reach = np.sqrt(np.floor(best / k)) + 1e-3  # far above the rounding of norms
            low = int(np.searchsorted(self.norm, size - reach, "left").min())
            high = int(np.searchsorted(self.norm, size + reach, "right").max())
            out[rows] = np.minimum(best, np.minimum(least(low, max(first, low)), least(min(last, high), high)))
        far = np.floor(out / k)
        return (out - far * k).astype(np.int64), far

    def _in_integers(self, row: list[int]) -> tuple[int, int]:
        """The same for one part with components of any size."""
        norm = float(np.sqrt(float(sum(c * c for c in row))))
        start = min(max(bisect.bisect(self.norm, norm) - PROBES // 2, 0), max(len(self.whole) - PROBES, 0))

        def least(a, b):
            return min(((sum((c - e) ** 2 for c, e in zip(row, self.whole[i])), int(self.order[i])) for i in range(a, b)), default=(float("inf"), 0))

        best = least(start, min(start + PROBES, len(self.whole)))
        reach = float(np.sqrt(float(best[0]))) * (1 + 1e-9) + 1e-9 * (norm + float(self.norm[-1])) + 1
        far, index = min(best, least(bisect.bisect_left(self.norm, norm - reach), bisect.bisect(self.norm, norm + reach)))
        return index, far


def whole_numbers(column) -> F.Column:
    return F.transform(column, lambda x: F.floor(x * float(SCALE)))


def usable_rows(df: DataFrame, vec_col: str, id_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """(id, label, v) of whole numbers as a shared table, and the number of components."""
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    # NaN is larger than any number
    finite = (F.size("v") > 0) & F.forall(v, lambda x: x.isNotNull()) & (F.array_max(F.transform(v, F.abs)) < float("inf"))
    rows, _ = saved(rows.where(finite).select("id", "label", whole_numbers(v).alias("v")), "whole")
    sizes = rows.groupBy(F.size("v").alias("n")).count().where(F.col("n") % parts == 0).orderBy(F.desc("count"), F.desc("n")).first()
    size = sizes.n if sizes else 0
    return rows.where(F.size("v") == size), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def column_sums(codes: np.ndarray, own: np.ndarray, k: int) -> list[list[int]]:
    """For each entry, the sums of the rows assigned to it."""
    if max(abs(int(own.max(initial=0))), abs(int(own.min(initial=0)))) * max(len(own), 1) >= 1 << 53:
        out = [[0] * own.shape[1] for _ in range(k)]
        for c, row in zip(codes.tolist(), own.tolist()):
            out[c] = [a + b for a, b in zip(out[c], row)]
        return out
    return np.stack([np.bincount(codes, own[:, i], k) for i in range(own.shape[1])], 1).astype(np.int64).tolist()


def improved(rows: DataFrame, size: int, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """Codebooks after one round over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    width = size // len(books)

    def run(batches):
        found = [Codebook(b) for b in shared.value]
        counts = [np.zeros(len(b), np.int64) for b in shared.value]
        sums = [[[0] * width for _ in b] for b in shared.value]
        for batch in batches:
            x = matrix(batch.column("v"), size)
            for p, book in enumerate(found):
                own = x[:, p * width : (p + 1) * width]
                codes, _ = book.nearest(own)
                counts[p] += np.bincount(codes, minlength=len(counts[p]))
                sums[p] = [[a + b for a, b in zip(s, t)] for s, t in zip(sums[p], column_sums(codes, own, len(counts[p])))]
        rows = [(p, e, int(n), sums[p][e]) for p, c in enumerate(counts) for e, n in enumerate(c.tolist()) if n]
        part, entry, n, total = zip(*rows) if rows else ((), (), (), ())
        flat = [(p, e, c, i, s) for p, e, c, t in zip(part, entry, n, total) for i, s in enumerate(t)]
        yield pa.RecordBatch.from_pydict(
            {"part": [r[0] for r in flat], "entry": [r[1] for r in flat], "n": [r[2] for r in flat], "at": [r[3] for r in flat], "total": [r[4] for r in flat]},
            pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("total", pa.decimal128(38, 0))]),
        )

    partial = rows.select("v").mapInArrow(run, "part int, entry int, n long, at int, total decimal(38,0)")
    merged = partial.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [[list(e) for e in b] for b in books]
    for r in merged.collect():  # one number for each component of the codebooks
        out[r.part][r.entry][r.at] = int(r.total) // r.n
    return out


def compress(
    df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """((id, label, codes, error) of every usable row, codebooks). codes: indices in part order; error: squared distances."""
    rows, size = usable_rows(df, vec_col, id_col, label_col, parts)
    width = size // parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = [[list(r.v[p * width : (p + 1) * width]) for r in first] for p in range(parts)]
    if first:
        books = functools.reduce(lambda now, _: improved(rows, size, now), range(rounds), books)
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        found = [Codebook(b) for b in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), size)
            each = [book.nearest(x[:, p * width : (p + 1) * width]) for p, book in enumerate(found)]
            codes = np.stack([c for c, _ in each], 1).astype(np.int32)
            edge = np.arange(len(x) + 1, dtype=np.int32) * parts
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(edge), pa.array(codes.reshape(-1))), pa.array([sum(map(int, d)) for d in zip(*(d.tolist() for _, d in each))], pa.int64())],
                ["id", "label", "codes", "error"],
            )

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    return rows.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, codes array<int>, error long"), books


def decoded(books: list[list[list[int]]], codes: list[int]) -> list[float]:
    """The vector that a code stands for."""
    return [c / SCALE for book, code in zip(books, codes) for c in book[code]]


def report(df: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    coded, books = compress(df)
    said = ",".join(str(c) for book in books for entry in book for c in entry)
    coded, _ = saved(coded, "codes")
    by_label, _ = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    by_label = maybe_broadcast(by_label.withColumnRenamed("label", "of"), F.lit(16))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256")
    )
