"""Vector codes against a plain version in whole Python numbers."""

import hashlib
import math

import numpy as np
import pytest

from barline.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, of int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(v, p)[1], []).append(cut(v, p))
            for i, each in own.items():
                new[p][i] = [sum(c) // len(each) for c in zip(*each)]
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), l) for i, v, l in kept]
    total = {}
    for _, _, e, l in found:
        total[l] = total.get(l, 0) + e
    return sorted(((i, c, e, total[l], sha) for i, c, e, l in found), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("n, scale", [(3, 1.0), (300, 1.0), (300, 0.004), (40, 1e7)])
def test_against_brute_force(spark, n, scale):
    """Fewer and more vectors than entries; coarse values with many ties and equal parts; components too large for doubles."""
    rng = np.random.default_rng(n)
    rows = [(i * 3 % n, (rng.standard_normal(8) * scale).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(min(n, 30))]
    assert rows_of(codes.report(table(spark, rows).repartition(3))) == brute(rows)


def test_a_hot_label_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "maybe_broadcast", lambda t, width: t.hint("merge"))
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(4).tolist(), None if i % 2 else i % 5) for i in range(60)]
    assert rows_of(codes.report(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [], 1), (2, [nan, 1.0, 1.0, 1.0], 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [inf, 1.0, 1.0, 1.0], 1), (5, [1.0, -inf, 1.0, 1.0], 1), (6, [0.0] * 4, None),
            (7, [-0.0001, 0.5, -2.0, 1.0], 3), (7, [-0.0001, 0.5, -2.0, 1.0], 3), (7, [1.0, 0.5, -2.0, 1.0], 3), (None, [0.1] * 4, None)]
    assert rows_of(codes.report(table(spark, rows))) == brute(rows)
    odd = [(20, [1.0] * 5, 1), (21, [1.0] * 8, 1)]  # other lengths are dropped
    assert rows_of(codes.report(table(spark, rows + odd))) == brute(rows)
    assert codes.report(table(spark, [])).collect() == [] and codes.report(table(spark, rows[:6])).collect() == []


def test_annulus_leaves_entries_out(monkeypatch):
    """Entries whose norms are too far aren't evaluated, and results are those of all entries."""
    rng = np.random.default_rng(5)
    entries = (rng.standard_normal((256, 4)) * np.linspace(1, 4000, 256)[:, None]).astype(int)
    x = entries[rng.integers(0, 256, 3000)] + rng.integers(-3, 4, (3000, 4))
    book = codes.Codebook(entries.tolist())
    want = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    for size in (1, 512):
        monkeypatch.setattr(codes, "TOGETHER", size)
        index, far = book.nearest(x)
        assert (index == want.argmin(1)).all() and (far == want.min(1)).all()
    looked = []
    monkeypatch.setattr(codes, "PROBES", 4)
    plain = book.whole

    class Counting(list):
        def __getitem__(self, i):
            looked.append(i)
            return plain[i]

    book.whole = Counting(plain)
    assert [book._in_integers(r) for r in x[:200].tolist()] == list(zip(want.argmin(1)[:200].tolist(), want.min(1)[:200].tolist()))
    assert len(looked) < 200 * 256 / 4


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(200)]
    got, books = codes.compress(table(spark, rows))
    for r in got.collect():
        back = codes.decoded(books, r.codes)
        assert abs(sum((math.floor(1024 * a) - 1024 * b) ** 2 for a, b in zip(rows[r.id][1], back)) - r.error) < 1e-6
