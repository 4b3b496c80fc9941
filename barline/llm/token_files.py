"""Token ids as Parquet list columns.

File format: a Parquet dataset in ascending document order. Columns: `part` int (the file's place), `row` long
(the document's place in it), `first` long (ids before it in the file), `doc_id`, `n_tokens` int, `ids` array<int>,
the end id included. Ids are dictionary-encoded or, with encoding="delta", delta-binary-packed (format version
2); row groups and pages have the given sizes, a page no more than `page_rows` rows, and page indexes (column and
offset index) are written, so that a reader can fetch the token counts or a range of documents without the other pages.

Encoding is the tokenizer's own, its special strings included; only the special tokens that it would add around a text
are left out.

Defined results: a null text is an empty one and has the end id alone; rows with equal ids are ordered
by a hash of their text and the text, null ids come first; exactly repeated rows are all written. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .shared import fresh_path, text_slices, worker_cache

LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Chunks of visible ASCII and Latin letters, with line ends or tabs inside alone.
QUICK = rf"[!-~{LATIN}](?:[!-~{LATIN}\n\t]*[!-~{LATIN}])?"
#: The byte-level pattern that cuts a text into words, for the characters of QUICK.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
MEMO = 100_000


def byte_marks() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for those from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


class ByteEncoder:
    def __init__(self, path: str, threads: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = str(threads > 1).lower()
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.tokenizer = t = Tokenizer.from_file(path)
        self.model, self.marks = t.model, byte_marks()
        opens = np.zeros(t.get_vocab_size(), bool)
        opens[[i for p, i in t.get_vocab().items() if p.startswith("Ġ")]] = True
        special = "|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values())
        marked = re.compile(special) if special else None
        quick = re.compile(rf"(?!.*(?:{special}))" * bool(special) + QUICK, re.DOTALL)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.encoder = ChunkEncoder(self._encode, opens, False, marked, quick=(quick, self._pieces))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of QUICK chunks, each after a space, by the tokenizer's model: each distinct word of them once."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = PIECE.findall(" " + " ".join(chunks))
        memo, one = self.memo, self.model.tokenize
        new = [w for w in dict.fromkeys(words) if w not in memo]
        marked = "\0".join(new).encode().decode("latin-1").translate(self.marks).split(self.marks[0]) if new else []
        memo.update((w, tuple([x.id for x in one(m)])) for w, m in zip(new, marked))
        ids = [memo[w] for w in words]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        opening = np.fromiter((w[0] == " " for w in words), bool, len(words))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum())), np.add.reduceat(length, np.flatnonzero(opening))


def encoder(path: str, threads: int) -> ChunkEncoder:
    cache = worker_cache()
    if ("bytes", path) not in cache:
        cache["bytes", path] = ByteEncoder(path, threads)
    return cache["bytes", path].encoder


def write_token_files(
    df: DataFrame, out: str, tokenizer_path: str, end_id: int, text_col: str = "text",
    id_col: str = "doc_id", encoding: str = "dictionary", row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10, page_rows: int = 1000, threads: int = 1,
) -> None:
    """Encode all rows and write them to `out`, one file for each range of ids.

    One shuffle, by ranges of (id, hash of the text), so a repeated id can't fill a single range
    unless its rows are all alike.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)

    def run(batches):
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId()
        row = first = 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, counts, _ = encoder(tokenizer_path, threads)(part.column("text"))
                n = part.num_rows
                ends = np.cumsum(counts + 1)
                ids = np.empty(int(ends[-1]), np.int32)
                keep = np.ones(len(ids), bool)
                keep[ends - 1] = False
                ids[keep], ids[ends - 1] = flat, end_id
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part_id, np.int32)), pa.array(row + np.arange(n)), pa.array(first + ends - counts - 1),
                     part.column("id"), pa.array((counts + 1).astype(np.int32)), lists],
                    ["part", "row", "first", "id", "n_tokens", "ids"],
                )
                row, first = row + n, first + len(ids)

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    tokens = (
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(*order, "text")
        .mapInArrow(run, f"part int, row long, first long, id {kind}, n_tokens int, ids array<int>")
        .withColumnRenamed("id", "doc_id")
    )
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(out)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, low=None, high=None) -> DataFrame:
    """The dataset, or only the named columns (`ids` isn't read unless it is named), or only documents with
    low <= doc_id <= high: row groups are skipped by their statistics and pages by the column index."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df.select(*columns) if columns else df


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone, without a shuffle of documents.

    `start` is exact at any size: the ids before the document in its file, after the sum of the files before
    it; only one number for each file passes through a single task.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values = np.asarray(lists.flatten()).astype("<u4", copy=False)
            edge = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            crc = [zlib.crc32(values[a:b]) for a, b in zip(edge.tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("first"), batch.column("doc_id"), pa.array(np.diff(edge).astype(np.int64)), pa.array(crc, pa.int64())],
                ["part", "first", "doc_id", "n_tokens", "ids_crc32"],
            )

    files = spark.read.parquet(path)
    kind = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("part", "first", "doc_id", "ids").mapInArrow(run, f"part int, first long, doc_id {kind}, n_tokens long, ids_crc32 long")
    sums = read_tokens(spark, path, ["part", "first", "n_tokens"]).groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select(  # a row for each file
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenize(spark: SparkSession, df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write `df` to token files in the shared folder and return their digests."""
    out = fresh_path(spark, "tokens")
    write_token_files(df, out, tokenizer_path, end_id)
    return digests(spark, out)
