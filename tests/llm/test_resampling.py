"""Importance resampling against a plain version in Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from barline.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, least):
    """(id, n_features, weight, score, rank) of (id, text) rows."""
    def count(texts):
        out = [0] * 10_000
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % 10_000] += 1
        return out

    s, t = count(x for _, x in rows), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        n, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], float("inf") if x[0] is None else x[0]))
    for r, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = r + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pool = ["The", "Œuvre", "x1", "a-b", "漢字", "w" * 70, "é" * 40, "it's", "2024", "ZÄ"] + [f"w{i}" for i in range(40)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(120)]


@pytest.mark.parametrize("piece", [4 << 20, 37])
@pytest.mark.parametrize("percent", [5, 40, 100])
def test_against_brute_force(spark, docs, texts, percent, piece, monkeypatch):
    """In whole texts and in pieces; words longer than the tables; equal texts."""
    monkeypatch.setattr(resampling, "PIECE", piece)
    every = texts + texts[:10]
    target = docs(texts[:7] + ["w1 w2 w3", None])
    got = resampling.resample(docs(every), target, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == brute(list(enumerate(every)), texts[:7] + ["w1 w2 w3"], percent, 20)


def test_odd_rows(spark, docs, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = rows_of(resampling.resample(odd_docs, docs(["a b c", None, ""]), percent=70, least_words=1))
    assert got == brute(rows, ["a b c"], 70, 1)
    assert {r[1:3] for r in got if r[0] in (0, 1, 2)} == {(0, 0)}


def test_empty_tables(spark, docs, no_docs):
    assert resampling.resample(no_docs, docs(["a b"])).count() == 0
    some = ["a b c " * 20, "d"]
    assert rows_of(resampling.resample(docs(some), no_docs, percent=100)) == brute(list(enumerate(some)), [], 100, 20)


def test_repeated_rows_are_drawn_exactly(spark, docs):
    """A third of all rows with one id and text: exactly k rows, ranks from 1 to k."""
    some = ["a b c d e f g h i j " * 2] * 300 + [f"w{i} b c d e f g h i j " * 2 for i in range(600)]
    got = resampling.resample(docs(some, [7] * 300 + list(range(1000, 1600))), docs(["a b c d"]), percent=20).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 181)) and len(got) == 900


@pytest.mark.parametrize("spread", [1, 50, 1 << 20, 1 << 62])
def test_radix_selection(spark, spread):
    rng = random.Random(spread)
    ends = [-(1 << 63), (1 << 63) - 1]
    rows = [(rng.randint(-spread, spread), rng.choice([rng.randint(-spread, spread), *ends]), i) for i in range(200)]
    table = spark.createDataFrame(rows, "a long, b long, c long")
    order = sorted(rows)
    for k in (1, 2, 77, 150, 200):
        assert tuple(resampling.kth_key(table, ["a", "b", "c"], k)) == order[k - 1]


def test_shifted_crcs():
    rng = np.random.default_rng(1)
    parts = [(rng.bytes(int(rng.integers(0, 80))), rng.bytes(int(n))) for n in rng.integers(0, 200, 300)]
    head = np.array([zlib.crc32(a) for a, _ in parts], np.uint32)
    tail = np.array([zlib.crc32(b) for _, b in parts], np.uint32)
    size = np.array([len(b) for _, b in parts])
    assert (resampling.shifted(head, size) ^ tail == [zlib.crc32(a + b) for a, b in parts]).all()
