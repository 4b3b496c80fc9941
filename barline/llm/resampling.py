"""Importance resampling towards a target distribution, by hashed word n-grams.

Features are all runs of one to `WIDEST` consecutive words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo
`buckets`. Both tables' bucket counts give each bucket a gain, floor(1000 * log of the smoothed ratio); a document's
weight is the sum over its features, taken from an array of gains. Gumbel noise from a hash of the id turns weights into
scores, of which the highest `percent` per cent are drawn: weighted sampling without replacement that repeats exactly.

Method: texts are cut and hashed in numpy (the CRC of a run follows from its words' by linearity, so no feature is ever
a string). The k-th key is found by radix selection on the digits of (score descending, id, row): each round counts the digits of
the candidates left and keeps those of one digit. Only drawn rows are sorted by ranges and ranked.

Scale: two passes over the texts and no shuffle of them; a task adds at most `buckets` rows to the counts. Rounds of the
selection read three numbers of a row, and give the driver at most 2**DIGIT counts. Neither ranks nor the selection put
rows into one task; a row number in the key parts equal scores and ids.

Defined results: A-Z are lower-cased, words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Null and wordless texts have no
feature, the weight 0 and are never drawn. A null id counts as the empty text in the hash and comes after all others among
equal scores. Rows that repeat an id are judged each by its own text. Ids are integers. An empty target leaves t = T = 0; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, text_slices, worker_cache

#: Words in the longest feature.
WIDEST = 3
#: Bits of a digit.
DIGIT = 16
#: Bytes of a text that are cut into words at once.
PIECE = 4 << 20
#: Word lengths up to which a CRC is shifted by a table.
SHORT = 64
ALL = 0xFFFFFFFF
TOP = 1 << 63

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes of words, after lower-casing.
WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)


def _through_zeros(crc: int, n: int) -> int:
    """A CRC register after n zero bytes more."""
    return zlib.crc32(bytes(n), crc ^ ALL) ^ ALL


def shift_tables() -> np.ndarray:
    """Entry (n, k, v): what byte k of a CRC, if it is v, becomes after n zero bytes. Kept by the worker."""
    cache = worker_cache()
    if "crc-shifts" not in cache:
        single = np.array([[_through_zeros(v << (8 * k), 1) for v in range(256)] for k in range(4)], np.uint32)
        tables = np.empty((SHORT + 1, 4, 256), np.uint32)
        tables[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
        for n in range(SHORT):
            t = tables[n]
            tables[n + 1] = single[0][t & 255] ^ single[1][(t >> 8) & 255] ^ single[2][(t >> 16) & 255] ^ single[3][t >> 24]
        cache["crc-shifts"] = tables
    return cache["crc-shifts"]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC moved before n bytes: shifted(crc(a), len(b)) ^ crc(b) is the CRC of a followed by b."""
    flat = shift_tables().reshape(-1)
    at = np.minimum(n, SHORT) * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + ((crc >> 8) & 255)] ^ flat[at + 512 + ((crc >> 16) & 255)] ^ flat[at + 768 + (crc >> 24)]
    for i in np.flatnonzero(n > SHORT).tolist():
        out[i] = _through_zeros(int(crc[i]), int(n[i]))
    return out


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc, length, edge) of the words in lower-cased bytes; text i has words edge[i] to edge[i + 1]."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(edges), np.int64)
    inside = WORD[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[edges] = True  # words don't cross from text to text
    first = inside & (opens[:-1] | ~np.concatenate([[False], inside[:-1]]))
    last = inside & (opens[1:] | ~np.concatenate([inside[1:], [False]]))
    starts = np.flatnonzero(first)
    length = np.flatnonzero(last) - starts + 1
    offsets = np.concatenate([[0], np.cumsum(length)])
    said = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    coded = said.dictionary_encode()
    each = np.fromiter(map(zlib.crc32, coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
    return each[np.asarray(coded.indices)] if len(length) else np.zeros(0, np.uint32), length, np.searchsorted(starts, edges)


def run_hashes(crc: np.ndarray, length: np.ndarray, edge: np.ndarray, skip: int = 0):
    """(hash, edge) of all features for each width: those of text i are edge[i] to edge[i + 1], each at its last word.
    Features that end in the first `skip` words are left out."""
    text = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    blank = np.uint32(zlib.crc32(b" "))
    spaced = shifted(crc, np.ones(len(crc), np.int64)) ^ blank  # each word with a space after it
    before = spaced
    for width in range(1, WIDEST + 1):
        if width == 1:
            found = crc
        else:
            tail = slice(width - 1, None)
            found = shifted(before[:-1], length[tail]) ^ crc[tail] if len(crc) >= width else crc[:0]
            before = shifted(found, np.ones(len(found), np.int64)) ^ blank
        ends = np.arange(width - 1, width - 1 + len(found))
        whole = (text[ends] == text[ends - width + 1]) & (ends >= skip) if len(found) else np.zeros(0, bool)
        yield found[whole], np.searchsorted(ends[whole], edge)


def feature_pieces(texts: pa.Array):
    """(first text, hashes and edges for each width, word edges) of pieces of an Arrow array of texts: many short texts, or a part of a long one."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1, i + 1)
        if j > i + 1 or offsets[j] - offsets[i] <= PIECE:
            crc, length, edge = words_of(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
            yield i, list(run_hashes(crc, length, edge)), edge
        else:
            at, end = int(offsets[i]), int(offsets[j])
            crc, length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            while at < end:
                to = min(at + PIECE, end)
                while to < end and WORD[LOWER[data[to]]]:  # a piece ends where a word does
                    ahead = np.flatnonzero(~WORD[LOWER[data[to : min(to + PIECE, end)]]])
                    to = to + int(ahead[0]) if len(ahead) else min(to + PIECE, end)
                more, size, _ = words_of(LOWER[data[at:to]], np.array([0, to - at]))
                held = len(crc)
                crc, length = np.concatenate([crc, more]), np.concatenate([length, size])
                edge = np.array([0, len(crc)])
                yield i, list(run_hashes(crc, length, edge, held)), edge - np.array([0, held])
                crc, length = crc[-(WIDEST - 1) :], length[-(WIDEST - 1) :]
                at = to
        i = j


def bucket_counts(df: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches):
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for _, runs, _ in feature_pieces(part.column("text")):
                    for hashes, _ in runs:
                        count += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["bucket", "n"])

    found = df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed ratio of shares."""
    n = float(len(raw))
    ratio = ((target + 1.0) * (float(raw.sum()) + n)) / ((raw + 1.0) * (float(target.sum()) + n))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(df: DataFrame, gains: np.ndarray, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches):
        gain = shared.value
        size = np.uint32(len(gain))
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, count, weight = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for i, runs, edge in feature_pieces(part.column("text")):
                    here = slice(i, i + len(edge) - 1)
                    words[here] += np.diff(edge)
                    for hashes, at in runs:
                        total = np.concatenate([[0], np.cumsum(gain[hashes % size])])
                        count[here] += np.diff(at)
                        weight[here] += np.diff(total[at])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words), pa.array(count), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def _unsigned(x: int) -> int:
    return x + TOP


def kth_key(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The k-th smallest combination (from 1) of long columns without nulls, no two rows of which are equal in all.

    Each round counts one digit of DIGIT bits over the candidates, the rows whose earlier digits are those of the k-th,
    and keeps the candidates with the digit that holds it. Leading bits in which the candidates agree are passed over.
    """
    fixed: list[int] = []
    left = k
    for key in keys:
        here = rows
        for name, value in zip(keys, fixed):
            here = here.where(F.col(name) == value)
        low, high = here.agg(F.min(key), F.max(key)).first()
        while low < high:
            a, b = _unsigned(low), _unsigned(high)
            shift = max((a ^ b).bit_length() - DIGIT, 0)
            digit = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-TOP).cast("long")), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            counts = sorted(here.where(F.col(key).between(low, high)).groupBy(digit.alias("digit")).count().collect())  # at most 2**DIGIT
            for d, n in counts:
                if left <= n:
                    break
                left -= n
            base = (a >> (shift + DIGIT) << (shift + DIGIT)) | (d << shift)
            low, high = max(low, base - TOP), min(high, base + (1 << shift) - 1 - TOP)
            if low < high:
                low, high = here.where(F.col(key).between(low, high)).agg(F.min(key), F.max(key)).first()
        fixed.append(low)
    return fixed


def resample(
    df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42,
    text_col: str = "text", id_col: str = "doc_id", target_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row; ranks are null where a row isn't drawn."""
    spark = df.sparkSession
    gains = gains_of(bucket_counts(df, text_col, buckets), bucket_counts(target, target_col, buckets))
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weigh(df, gains, text_col, id_col).withColumn("score", F.col("weight") + noise)
    scored = scored.withColumns({
        "down": -F.col("score"), "at": F.coalesce("id", F.lit(TOP - 1)), "row": F.monotonically_increasing_id()
    })
    scored, _ = saved(scored, "scored")
    able = F.col("n_words") >= least_words
    k = percent * scored.where(able).count() // 100
    out = ["id", "n_features", "weight", "score"]
    if not k:
        ranked = scored.select(*out, F.lit(None).cast("long").alias("rank"))
        return ranked.withColumnRenamed("id", id_col)
    keys = ["down", "at", "row"]
    d, a, r = kth_key(scored.where(able).select(*keys), keys, k)
    within = (F.col("down") < d) | ((F.col("down") == d) & ((F.col("at") < a) | ((F.col("at") == a) & (F.col("row") <= r))))
    # the ids made in sorted partitions hold the partition's number and the place in it
    drawn = scored.where(able & within).repartitionByRange(*keys).sortWithinPartitions(*keys).select(*out, F.monotonically_increasing_id().alias("place"))
    drawn, _ = saved(drawn, "drawn")
    part = F.shiftrightunsigned("place", 33)
    sizes = sorted(drawn.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, total = [], 0
    for number, n in sizes:
        before.append((number, total))
        total += n
    first = spark.createDataFrame(before, "part long, before long")
    ranked = drawn.withColumn("part", part).join(F.broadcast(first), "part").select(
        *out, (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank")
    )
    others = scored.where(~(able & within)).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others).withColumnRenamed("id", id_col)
