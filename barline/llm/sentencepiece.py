"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (no protobuf runtime), and from it are rebuilt: the normaliser
(precompiled map, extra white space, dummy prefix, escape to the metaspace mark), the metaspace
split, the pieces with their scores (a unigram model takes the scores themselves, a BPE model the
merges that they order) and byte fallback. Batches are encoded, and decoded again by the library's decoder,
multithreaded. Parity with the sentencepiece library is verified for every chunk that a worker encodes, and for whole
texts where a text isn't cut into chunks; where the two differ, the document is marked, and its ids stay as they are.

Control, unused and byte pieces, and the unknown piece, are never matched in a text; a unigram model's user-defined
pieces win over others as the format has it. A BPE model's user-defined pieces are merged like others, and where that differs
parity says so.

Defined results: a null text is an empty one; an empty text has no ids and decodes to "". Rows are
independent, so repeated rows and null ids pass through, and further columns are kept out. Texts of
any length are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .shared import release, text_slices, worker_cache

SPACE = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0], at + n
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def parse_model(data: bytes) -> PieceModel:
    m = PieceModel()
    for number, value in wire_fields(data):
        if number == 1:
            piece = dict(wire_fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(piece.get(2, 0.0))
            m.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(wire_fields(value))
            m.model_type, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(wire_fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.trim_spaces, m.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m


def merges_by_score(m: PieceModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two, the best-scored piece first."""
    rank = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k in (NORMAL, USER)}
    found = []
    for piece, i in rank.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in rank and right in rank:
                found.append((-m.scores[i], i, rank[left], rank[right], left, right))
    return [(x[4], x[5]) for x in sorted(found)]


#: Before the string of a piece that no text may match: a code point that is no character.
UNMATCHED = "\U0010fffe"


def unigram_pieces(m: PieceModel) -> list[tuple[str, float]]:
    """Pieces and scores for the library's unigram model; those that never match keep their places under other strings."""
    scores = [s for s, k in zip(m.scores, m.kinds) if k == NORMAL] or [0.0]
    low, high = min(scores), max(scores)
    return [
        (p, s) if k == NORMAL else (p, len(p) * high - 0.1) if k == USER else (UNMATCHED + p, low)
        for p, s, k in zip(m.pieces, m.scores, m.kinds)
    ]


def build_tokenizer(m: PieceModel):
    """The same model as a tokenizers.Tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else None
    if m.model_type == UNIGRAM:
        model = models.Unigram(unigram_pieces(m), unk_id=unknown, byte_fallback=False)  # bytes of unknowns: PieceCodec
    elif m.model_type == BPE:
        model = models.BPE(
            {p: i for i, p in enumerate(m.pieces)}, merges_by_score(m), fuse_unk=True, byte_fallback=m.byte_fallback,
            unk_token=m.pieces[unknown] if unknown is not None else None,
        )
    else:
        raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE))
    t = Tokenizer(model)
    t.normalizer = normalizers.Sequence(steps)
    if chunks_are_independent(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    hidden = [decoders.Replace(UNMATCHED, "")] if m.model_type == UNIGRAM else []
    ends = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    # every mark is a space, wherever it stands: the first one goes at the ends
    spaces = decoders.Metaspace(replacement=SPACE, prepend_scheme="never")
    t.decoder = decoders.Sequence([*hidden, spaces, decoders.ByteFallback(), decoders.Fuse(), *ends])
    return t


def chunks_are_independent(m: PieceModel) -> bool:
    """Whether no piece has the mark after another character, so none crosses into a next word."""
    return not any(SPACE in p.lstrip(SPACE) for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER))


class PieceCodec:
    """Encodes and decodes batches; one for each worker and model."""

    def __init__(self, model_path: str, threads: int = 2, verify: bool = True, chunk_limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(model_path, "rb") as f:
            data = f.read()
        self.model = m = parse_model(data)
        self.tokenizer = build_tokenizer(m)
        self.peer = None
        if verify:
            import sentencepiece

            self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        opens = np.array([p.startswith(SPACE) for p in m.pieces])
        by_chunk = chunks_are_independent(m) and m.dummy_prefix and m.escape_spaces and not m.charsmap
        self.encoder = ChunkEncoder(
            self._encode, opens, True, re.compile(SPACE), chunk_limit, audit=self._audit if verify else None
        ) if by_chunk else None
        self.unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else None
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self.model.model_type == UNIGRAM and self.model.byte_fallback:  # the fast form leaves unknown tokens' strings out
            got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [self._with_bytes(x) if self.unknown in x.ids else x.ids for x in got]
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _with_bytes(self, encoding) -> list[int]:
        """Ids with each unknown token as the pieces of its bytes."""
        return [
            j for i, token in zip(encoding.ids, encoding.tokens)
            for j in ([self.bytes[b] for b in token.encode()] if i == self.unknown else [i])
        ]

    def _audit(self, texts: list[str], flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether both libraries agree on each text."""
        lists = self.peer.encode(texts, num_threads=1)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        if np.array_equal(n, length) and np.array_equal(np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum())), flat):
            return np.ones(len(texts), bool)
        edge = np.concatenate([[0], np.cumsum(length)])
        return np.fromiter((flat[a:b].tolist() == x for a, b, x in zip(edge, edge[1:], lists)), bool, len(texts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number for each text, and whether each text passed the parity check."""
        if self.encoder is not None:
            return self.encoder(texts)
        shown = [t or "" for t in texts.to_pylist()]
        lists = [x if t else [] for x, t in zip(self._encode(shown), shown)]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(length.sum()))
        return flat, length, np.ones(len(lists), bool) if self.peer is None else self._audit(shown, flat, length)

    def forget(self) -> None:
        """Drop the chunk table: a worker that goes on to other stages doesn't keep it."""
        if self.encoder is not None:
            self.encoder.clear()
            release()

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each document, by the tokenizer's decoder."""
        ids, edge = flat.tolist(), np.concatenate([[0], np.cumsum(counts)]).tolist()
        return self.tokenizer.decode_batch([ids[a:b] for a, b in zip(edge, edge[1:])], skip_special_tokens=False)


def codec(model_path: str, threads: int, verify: bool) -> PieceCodec:
    key = ("pieces", model_path, threads, verify)
    cache = worker_cache()
    if key not in cache:
        cache[key] = PieceCodec(model_path, threads, verify)
    return cache[key]


def encode_documents(
    df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id",
    threads: int = 2, verify: bool = True,
) -> DataFrame:
    """(id, ids array<int>, parity boolean) for every row. No shuffle: encoding is by row."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, counts, good = codec(model_path, threads, verify).encode(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, pa.array(good)], ["id", "ids", "parity"])
        codec(model_path, threads, verify).forget()

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>, parity boolean"
    )
    return got.withColumnRenamed("id", id_col)


def decode_documents(
    df: DataFrame, model_path: str, ids_col: str = "ids", id_col: str = "doc_id"
) -> DataFrame:
    """(id, text) from (id, ids array<int>); null ids decode to null, bytes that aren't UTF-8 to
    the replacement character."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            found = codec(model_path, 2, False).decode(np.asarray(lists.flatten()), counts)
            texts = [None if null else t for t, null in zip(found, lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return got.withColumnRenamed("id", id_col)


def encode_and_decode(df: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """Per document (doc_id, n_tokens, ids_crc32, decoded_sha256, lossless, parity): the text encoded,
    its ids decoded again and the texts compared, in one pass without a shuffle."""

    def run(batches):
        import hashlib

        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                c = codec(model_path, threads, True)
                texts = [t or "" for t in part.column("text").to_pylist()]
                flat, counts, good = c.encode(part.column("text"))
                back = c.decode(flat, counts)
                edge = np.concatenate([[0], np.cumsum(counts)])
                little = flat.astype("<u4")
                cols = [
                    part.column("doc_id"),
                    pa.array(counts),
                    pa.array([zlib.crc32(little[a:b]) for a, b in zip(edge, edge[1:])], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([a == b for a, b in zip(back, texts)]),
                    pa.array(good),
                ]
                yield pa.RecordBatch.from_arrays(
                    cols, ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless", "parity"]
                )
        codec(model_path, threads, True).forget()

    return df.select("doc_id", "text").mapInArrow(
        run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, "
        "decoded_sha256 string, lossless boolean, parity boolean"
    )
