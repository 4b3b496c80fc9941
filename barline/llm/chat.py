"""Chat formatting by columnar byte assembly.

A conversation becomes one string: for each turn `<|role|>` role `<|text|>` text `<|end|>`. A control
string inside a role or text is escaped by a `!` after its first character, and one more for each
that stands there already, so the escape is reversible and no text can close or open a turn.

Formatting computes every segment's length, the cumulative offsets and scatter indices in numpy and
copies headers and contents into one preallocated Arrow buffer.

Defined results: a null role or text is an empty one; turns are ordered by (turn, role, text), nulls
first; repeated rows are all formatted; rows of a null conversation id form one conversation; an
empty table has no conversations. Only the named columns are read. The digest of a conversation needs its turns in
order, so one conversation is formatted by one task, in pieces: rows are streamed and no task holds
more than an Arrow batch and the conversation's own text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: What follows `<` or `[` in a control string of this template and of common tokenizers.
TAILS = r"\||/?s>|unk>|/?INST\]|<SYS>>|</SYS>>"
OPENS = re.compile(rf"([<\[])(!*)(?={TAILS})")
ESCAPED = re.compile(rf"([<\[])!(!*)(?={TAILS})")
#: A text without these is its own escape.
HINT = r"[<\[]!*(?:\||/?s>|unk>|/?INST\]|<SYS>>|</SYS>>)"
TURN = re.compile(r"<\|role\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return OPENS.sub(r"\1!\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def escaped(column: pa.Array) -> pa.Array:
    """The column with nulls as empty texts and control strings escaped, texts without any untouched."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    hit = pc.match_substring_regex(column, HINT)
    if not pc.any(hit).as_py():
        return column
    return pc.replace_with_mask(column, hit, pa.array([escape(t) for t in column.filter(hit).to_pylist()], pa.large_string()))


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a large_string array."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offs[:-1], np.diff(offs)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """Each row's formatted turn, all of them in one preallocated buffer, and the n + 1 offsets of the turns in it."""
    n = len(roles)
    columns = [escaped(roles), escaped(texts)]
    headers = [np.frombuffer(x.encode(), np.uint8) for x in (ROLE, TEXT, END)]
    contents = [_parts(c) for c in columns]
    sizes = np.column_stack(
        [np.full(n, len(headers[0])), contents[0][2], np.full(n, len(headers[1])), contents[1][2], np.full(n, len(headers[2]))]
    ).astype(np.int64)
    ends = np.cumsum(sizes.ravel())
    total = int(ends[-1]) if n else 0
    place = (ends - sizes.ravel()).reshape(n, 5)
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for k, head in enumerate(headers):
        out[place[:, 2 * k, None] + np.arange(len(head))] = head
    for k, (raw, start, length) in enumerate(contents):
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(place[:, 2 * k + 1], length) + step] = raw[np.repeat(start, length) + step]
    return buffer, np.concatenate([[0], ends[4::5]]).astype(np.int64)


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, formatted): one row for each conversation. One shuffle, by conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the conversation that may go on in the next batch
        key: pa.Array | None = None
        parts: list[bytes] = []

        def last() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, pa.array([b"".join(parts)], pa.binary()).cast(pa.string())], ["conv_id", "formatted"])

        for batch in batches:
            n, keys = batch.num_rows, batch.column("conv_id")
            if not n:
                continue
            buffer, offsets = assemble(batch.column("role"), batch.column("text"))
            codes = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [n]])
            # a conversation's turns lie next to each other: it is a slice of the buffer
            chats = pa.LargeStringArray.from_buffers(len(edge) - 1, pa.py_buffer(offsets[edge].tobytes()), buffer)
            if key is not None and not key.equals(keys.slice(0, 1)):
                yield last()
                parts = []
            if len(chats) > 1:
                firsts, done = keys.take(pa.array(edge[:-2])), chats.slice(0, len(chats) - 1)
                if parts:
                    key, parts = firsts.slice(0, 1), [*parts, memoryview(buffer)[: int(offsets[edge[1]])]]
                    yield last()
                    firsts, done = firsts.slice(1), done.slice(1)
                yield pa.RecordBatch.from_arrays([firsts, done.cast(pa.string())], ["conv_id", "formatted"])
                parts = []
            key = keys.slice(n - 1, 1)
            parts.append(bytes(memoryview(buffer)[int(offsets[edge[-2]]) :]))
        if key is not None:
            yield last()

    kind = df.schema[conv_col].dataType.simpleString()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    return (
        rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
        .mapInArrow(run, f"conv_id {kind}, formatted string")
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Code-point ranges of the formatted string that a model is trained on: that role's texts."""
    return [m.span(2) for m in TURN.finditer(formatted) if m[1] == role]


def read_back(chats: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Digests of formatted conversations, from the formatted strings alone: (conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def run(batches):
        for batch in batches:
            rows = []
            for s in batch.column("formatted").to_pylist():
                turns = parse(s)
                loss = "".join(unescape(s[a:b]) for a, b in loss_spans(s, learn_role))
                every = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            n, turns_hash, chars, loss_hash, size = zip(*rows) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns_hash, pa.string()), pa.array(chars, pa.int64()),
                 pa.array(loss_hash, pa.string()), pa.array(size, pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
