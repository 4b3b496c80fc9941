"""Encoding whole texts through a table of their space-separated chunks.

Byte-level and metaspace vocabularies never merge across a single space between two non-space
characters, so a text's ids are those of its chunks, one after another. A worker encodes each
distinct chunk once (with its tokenizer, in batches) and assembles documents with numpy. A text
with any other use of white space is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start+length] of every pair, one after another."""
    total = int(length.sum())
    return flat[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)]


class ChunkEncoder:
    """encode: list of texts -> list of id lists. opens: for each id, whether it opens a chunk
    (its string starts with the space mark). same_first: the first chunk is encoded as one after a
    space is (a dummy prefix). marked: texts that hold a match of this pattern in a chunk are encoded whole.
    limit: chunks kept at most; beyond it those seen in few batches go, so memory is bounded.
    quick: (pattern, function) that encodes chunks of this pattern, each after a space, at less cost: all ids, and
    how many each chunk has.
    audit: given (texts, flat ids, lengths), returns a flag for each."""

    def __init__(
        self,
        encode: Callable[[list[str]], list[list[int]]],
        opens: np.ndarray,
        same_first: bool,
        marked: re.Pattern | None = None,
        limit: int = 500_000,
        quick: tuple[re.Pattern, Callable[[list[str]], tuple[np.ndarray, np.ndarray]]] | None = None,
        audit: Callable | None = None,
    ):
        self.encode, self.opens, self.same_first = encode, opens, same_first
        self.marked, self.limit, self.quick, self.audit = marked, limit, quick, audit
        self.lead = "" if same_first else " "
        self.clear()

    def clear(self) -> None:
        self.later: dict[str, int] = {}
        self.first: dict[str, int] = self.later if self.same_first else {}
        self.flat = np.empty(1 << 16, np.int32)
        self.start = np.zeros(1 << 10, np.int64)
        self.length = np.zeros(1 << 10, np.int64)
        self.good = np.zeros(1 << 10, bool)
        self.odd = np.zeros(1 << 10, bool)
        self.uses = np.zeros(1 << 10, np.int32)
        self.used = self.n = 0

    def _shrink(self) -> None:
        """Keep the half of the table, at most, that was used by the most batches; older uses count half."""
        least = 2
        while (keep := self.uses[: self.n] >= least).sum() > self.limit // 2:
            least *= 2
        new = np.where(keep, np.cumsum(keep) - 1, -1)
        tables = [self.later] if self.same_first else [self.later, self.first]
        for table in tables:
            at = new[np.fromiter(table.values(), np.int64, len(table))].tolist()
            left = [(c, i) for c, i in zip(table, at) if i >= 0]
            table.clear()
            table.update(left)
        self.flat = gathered(self.flat, self.start[: self.n][keep], self.length[: self.n][keep])
        self.length, self.good, self.odd = self.length[: self.n][keep], self.good[: self.n][keep], self.odd[: self.n][keep]
        self.uses = self.uses[: self.n][keep] // 2
        self.start = np.cumsum(self.length) - self.length
        self.used, self.n = len(self.flat), len(self.length)

    def _room(self, name: str, need: int) -> np.ndarray:
        old = getattr(self, name)
        if need > len(old):
            grown = np.zeros(max(2 * len(old), need), old.dtype)
            grown[: len(old)] = old
            setattr(self, name, grown)
        return getattr(self, name)

    def _add(self, table: dict[str, int], chunks: list[str], shown: list[str], flat, length, odd) -> None:
        n, total = len(chunks), len(flat)
        good = np.ones(n, bool) if self.audit is None else self.audit(shown, flat, length)
        self._room("flat", self.used + total)[self.used : self.used + total] = flat
        for name, value in (("start", self.used + np.cumsum(length) - length), ("length", length), ("good", good), ("odd", odd), ("uses", 0)):
            self._room(name, self.n + n)[self.n : self.n + n] = value
        table.update(zip(chunks, range(self.n, self.n + n)))
        self.used, self.n = self.used + total, self.n + n

    @staticmethod
    def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(length.sum())), length

    def _is_odd(self, chunk: str) -> bool:
        return not chunk or chunk != chunk.strip() or (self.marked is not None and self.marked.search(chunk) is not None)

    def _learn_first(self, chunks: list[str]) -> None:
        odd = np.fromiter(map(self._is_odd, chunks), bool, len(chunks))
        shown = ["" if o else c for c, o in zip(chunks, odd)]
        self._add(self.first, chunks, shown, *self._joined(self.encode(shown)), odd)

    def _learn_later(self, chunks: list[str]) -> None:
        plain = np.zeros(len(chunks), bool)
        if self.quick is not None:
            pattern, encode_quick = self.quick
            plain = np.fromiter((m is not None for m in map(pattern.fullmatch, chunks)), bool, len(chunks))
        rest = [c for c, p in zip(chunks, plain.tolist()) if not p]
        odd = np.zeros(len(chunks), bool)
        odd[~plain] = np.fromiter(map(self._is_odd, rest), bool, len(rest))
        flat, length = self._after_space(["x" if o else c for c, o in zip(rest, odd[~plain].tolist())])
        if plain.any():
            one, n = encode_quick([c for c, p in zip(chunks, plain.tolist()) if p])
            every, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
            size[~plain], size[plain] = length, n
            every[~plain], every[plain] = np.cumsum(length) - length, len(flat) + np.cumsum(n) - n
            flat, length = gathered(np.concatenate([flat, one]), every, size), size
        shown = [self.lead + ("x" if o else c) for c, o in zip(chunks, odd.tolist())] if self.audit is not None else chunks
        self._add(self.later, chunks, shown, flat, length, odd)

    def _after_space(self, chunks: list[str], at_once: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that follow a space: many are encoded in one text, which is cut at the opening ids. Few
        texts at once, since the tokenizer's own results are large."""
        groups = [chunks[i : i + 1000] for i in range(0, len(chunks), 1000)]
        flats, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(groups), at_once):
            some = groups[i : i + at_once]
            for group, ids in zip(some, self.encode([self.lead + " ".join(g) for g in some])):
                ids = np.array(ids, np.int32)
                cuts = np.flatnonzero(self.opens[ids])
                if len(cuts) == len(group) and cuts[0] == 0:
                    flats.append(ids)
                    lengths.append(np.diff(cuts, append=len(ids)))
                else:
                    one, n = self._joined(self.encode([self.lead + c for c in group]))
                    flats.append(one)
                    lengths.append(n)
        return np.concatenate(flats), np.concatenate(lengths)

    def _known(self, table: dict[str, int], chunks: list[str], learn: Callable) -> np.ndarray:
        found = np.fromiter(map(table.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = self.n + np.arange(len(missing))
            learn([chunks[i] for i in missing.tolist()])
        self.uses[found] += 1
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, how many each has, and whether each passed the audit."""
        if self.n > self.limit:
            self._shrink()
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.empty(0, np.int32), np.zeros(0, np.int64), np.ones(0, bool)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes, names = np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False)
        edge = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        if self.same_first:
            idx = self._known(self.later, names.tolist(), self._learn_later)[codes]
        else:
            opening = codes[edge[:-1]]
            later = np.flatnonzero(np.bincount(codes, minlength=len(names)) > np.bincount(opening, minlength=len(names)))
            own = np.full(len(names), -1, np.int64)
            own[later] = self._known(self.later, names[later].tolist(), self._learn_later)
            idx = own[codes]
            some, back = np.unique(opening, return_inverse=True)
            idx[edge[:-1]] = self._known(self.first, names[some].tolist(), self._learn_first)[back]
        odd = np.logical_or.reduceat(self.odd[idx], edge[:-1])
        good = np.logical_and.reduceat(self.good[idx], edge[:-1])
        length = self.length[idx]
        counts = np.add.reduceat(length, edge[:-1])
        if not odd.any():
            return gathered(self.flat, self.start[idx], length), counts, good
        keep = np.repeat(~odd, np.diff(edge))
        plain = gathered(self.flat, self.start[idx[keep]], length[keep])
        whole = texts.filter(pa.array(odd)).to_pylist()
        other, other_n = self._joined(self.encode(whole))
        if self.audit is not None:
            good[odd] = self.audit(whole, other, other_n)
        counts[odd] = other_n
        both = np.concatenate([plain, other])
        start = np.zeros(n, np.int64)
        start[~odd] = np.cumsum(counts[~odd]) - counts[~odd]
        start[odd] = len(plain) + np.cumsum(other_n) - other_n
        return gathered(both, start, counts), counts, good
