"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, SentencePiece.

Each stage takes what its predecessor kept, in the columns of `documents`; the last returns token digests.

Defined results: further columns of `documents` stay as they are, whatever their names; `n_chars` is set anew where it is
there and a text was cut. Null and empty texts pass all stages. Rows with a null id are judged by their text in every stage but
near-dedup, which keeps them. Rows that repeat an id share the verdict of near-dedup, as one document; exactly repeated
rows fare alike in every stage. Of near copies the smallest id stays. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import decontaminate, lines, minhash, sentencepiece, toxicity
from barline.llm.queries import tokenizer_file
from barline.llm.shared import free_names, removed, saved

#: Documents at or above this score are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; a null or empty text scores 0 and stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.learn_toxicity(docs, labels, usable)
    (score,) = free_names(docs, "_score")
    return toxicity.score_toxicity(docs, model, keep=True, score_col=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of windows that occurred before; `n_chars` follows. A document of which no line is left goes."""
    n, gone = free_names(docs, "_lines", "_gone")
    left = lines.line_dedup(docs, counts=(n, gone)).where((F.col(gone) == 0) | (F.col(gone) < F.col(n)))
    if "n_chars" in docs.columns:
        now = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col(gone) == 0, F.col("n_chars")).otherwise(now))
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; null ids stay."""
    judged = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return docs.join(judged.where("not kept and doc_id is not null").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every remaining document's tokens and of its decoded text."""
    return sentencepiece.encode_and_decode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The stages train a model and hash signatures, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a shared Parquet table that the next stage reads."""

    def step(state, stage):
        docs, path = state
        name, function = stage
        after, new = saved(function(spark, docs, sf_dir), f"stage-{name}")
        if path:
            removed(spark, path)
        return after, new

    return functools.reduce(step, STAGES, (spark.read.parquet(f"{sf_dir}/documents.parquet"), None))[0]
