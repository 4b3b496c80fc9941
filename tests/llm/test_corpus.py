"""Corpus operators against brute force, round trips and held-out rows, and their edge cases."""

import collections
import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barline.llm import chat, decontaminate, language, lines, minhash, sentencepiece, suffixes, token_files, toxicity, vectors
from barline.llm import queries as Q
from barline.llm import shared
from barline.llm.shared import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, score double, n_lines string"
WORDS = random.Random(0).sample([a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "")], 120)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, ids=None):
    """Texts with ids from 0, and columns whose names operators might use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", 1.0, "y") for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white space, a very long text, repeated rows and ids."""
    texts = [None, "", " \n\t ", "one", "two words", "a b c d e f", "word " * 60000, "same text again " * 50, "same text again " * 50, "é漢字🎉 \x00 <|end|> </s>", "x\n\n\ny", None, "a b c d e f"]
    return docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 7, 9, 10, None, None])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def oracle(name, data, spark):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    want = con.execute(Q.ORACLE[name]).df()
    got = Q.QUERIES[name](spark, data).toPandas()
    key = list(want.columns)[0]
    assert sorted(want.columns) == sorted(got.columns)

    def plain(v):
        """Whole numbers as such: columns with nulls are doubles in one frame and nullable integers in the other."""
        return None if pd.isna(v) else int(v) if isinstance(v, (int, float, np.integer, np.floating)) and v == int(v) else v

    a, b = (x[sorted(want.columns)].sort_values(key).reset_index(drop=True).map(plain).astype(str) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(name, spark, data):
    oracle(name, data, spark)


# --- lines


def brute_lines(texts):
    seen, out = set(), []
    for t in texts:
        ls = (t or "").split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if any(w) and w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append("\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, 3) for _ in range(6)] + [""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    got = lines.line_dedup(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in got] == brute_lines(texts)


def test_lines_odd(odd, none):
    r = lines.line_dedup(odd)
    assert r.count() == odd.count() and r.where("text is null and n_lines = 0").count() == 2
    assert r.where("doc_id = 7").select("text").distinct().count() == 1
    assert lines.line_dedup(none).count() == 0


# --- near copies


def brute_near(texts):
    sets = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split("[ \t-\r]+", low) if x]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    for base in list(texts[:12]):
        for _ in range(rng.randint(1, 8)):
            w = base.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    return texts + ["", None, " \n"]


def test_near_copies_against_brute_force(spark, near_texts):
    got = minhash.near_duplicates(docs(spark, near_texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_near(near_texts)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_near_copies_with_every_round(spark, near_texts, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", -1)
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    got = minhash.near_duplicates(docs(spark, near_texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [c for _, c in brute_near(near_texts)]


def test_near_copies_of_hot_lists_meet_in_blocks(spark, monkeypatch):
    """Members of a list that no link joins to its main part are compared in groups of bounded size, and none is left out."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randint(0, 9))
        texts.append(" ".join(w))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "AT_ONCE", 16)
    compared = minhash.block_pairs
    counted = spark.sparkContext.accumulator(0)

    def watched(group, *rest):
        counted.add(len(group))
        assert np.bincount(group).max() <= 60
        return compared(group, *rest)

    monkeypatch.setattr(minhash, "block_pairs", watched)
    got = minhash.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_near(texts)
    assert counted.value > 0 and len({r.component_id for r in got}) > 3


def test_block_pairs_lose_no_link():
    rng = np.random.default_rng(1)
    m, base = 150, rng.integers(0, 1 << 63, (3, 200)).astype(np.uint64)
    sets = [np.unique(np.concatenate([b[rng.random(200) < rng.choice([0.97, 0.85])], rng.integers(0, 1 << 63, 10).astype(np.uint64)])) for b in base[rng.integers(0, 3, m)]]
    group, far, rep, component, main = rng.integers(0, 4, m), rng.integers(0, 2, m), rng.permutation(m), rng.integers(0, 5, m), rng.integers(0, 2, m)
    n, bits = np.array([len(s) for s in sets]), np.stack([minhash.bitmap(s).view(np.uint64) for s in sets])
    i, j = minhash.block_pairs(group, far, rep, n, component, main, bits)
    got = set(zip(i.tolist(), j.tolist()))
    asked = {
        (x, y) for x in range(m) for y in range(m)
        if far[x] and not far[y] and group[x] == group[y] and component[x] != component[y] and (component[y] == main[y] or rep[x] < rep[y])
    }
    links = {(x, y) for x, y in asked if 100 * len(np.intersect1d(sets[x], sets[y])) >= 75 * len(np.union1d(sets[x], sets[y]))}
    assert len(got) == len(i) and links and links <= got <= asked and len(got) < len(asked) / 2


def test_near_copies_odd(odd, none):
    r = {x.doc_id: x for x in minhash.near_duplicates(odd).collect()}
    assert r[1].n_shingles == 0 and r[1].component_id == 1 and r[None].component_id is None and not r[None].kept
    assert r[7].component_id == 7 and minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(shared, "SMALL_GRAPH", small)
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"))[0].collect()}
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {n: find(n) for p in pairs for n in p if p[0] != p[1]}


# --- SentencePiece


@pytest.fixture(scope="module")
def model_path():
    return Q.tokenizer_file("piece_bpe_32k.model")


def test_pieces_have_parity(model_path):
    c = sentencepiece.PieceCodec(model_path)
    rng = random.Random(3)
    texts = ["", " ", "  a  b ", "é漢字🎉", "x\ty\n z", "▁▁a", "<0x41></s>", "don't stop. I've 3 of it"] + [prose(rng, 40) for _ in range(30)] + ["".join(chr(rng.randrange(32, 1200)) for _ in range(50)) for _ in range(30)]
    flat, n, good = c.encode(pa.array(texts))
    edge = np.concatenate([[0], np.cumsum(n)])
    assert [flat[a:b].tolist() for a, b in zip(edge, edge[1:])] == [c.peer.encode(t) for t in texts] and good.all()
    assert c.decode(flat, n) == [c.peer.decode(c.peer.encode(t)) for t in texts]


def test_whole_documents_have_parity(spark, data, model_path):
    """The query's digests against the sentencepiece library on whole texts."""
    import sentencepiece as library

    peer = library.SentencePieceProcessor(model_file=model_path)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = Q.op3_sentencepiece(spark, data).collect()
    assert len(got) == len(texts) and all(r.parity and r.lossless for r in got)
    for r in got:
        ids = peer.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(peer.decode(ids).encode()).hexdigest()


def test_disagreement_is_reported_not_replaced(model_path):
    c = sentencepiece.PieceCodec(model_path)
    want, _, _ = c.encode(pa.array(["one two three", "four"]))
    c.encoder.clear()
    encode = c.peer.encode
    c.peer = type("Peer", (), {"encode": staticmethod(lambda texts, **k: [x + [7] if "two" in t else x for t, x in zip(texts, encode(texts))])})
    flat, _, good = c.encode(pa.array(["one two three", "four"]))
    assert good.tolist() == [False, True] and flat.tolist() == want.tolist()


def test_chunk_table_is_bounded(model_path):
    """A table that overflows keeps what many batches use, and ids stay those of whole texts."""
    c = sentencepiece.PieceCodec(model_path, chunk_limit=40)
    rng = random.Random(9)
    for turn in range(6):
        texts = ["the same words again", " ".join(f"w{turn}x{i}" for i in range(50)), prose(rng, 30)]
        flat, n, good = c.encode(pa.array(texts))
        edge = np.concatenate([[0], np.cumsum(n)])
        assert [flat[a:b].tolist() for a, b in zip(edge, edge[1:])] == [c.peer.encode(t) for t in texts] and good.all()
    assert "again" in c.encoder.later and len(c.encoder.later) < 200


def test_unigram_model(tmp_path):
    """A hand-made unigram model with byte fallback."""
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + data

    def message(n, data):
        out, k = b"", len(data)
        while k > 127:
            out, k = out + bytes([k & 127 | 128]), k >> 7
        return field(n, 2, out + bytes([k]) + data)

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{i:02X}>", -9.0, 6) for i in range(256)]
    pieces += [(p, -float(i + 1) / 3, 1) for i, p in enumerate(["▁the", "▁t", "he", "h", "e", "▁", "t", "▁cat", "c", "at", "a", "s", "▁s", "sat", "▁sat"])]
    pieces += [("hec", -8.0, 4), ("tt", -0.1, 5)]
    data = b"".join(message(1, message(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += message(2, field(3, 0, b"\x01") + b"\x98\x02\x01".replace(b"\x98\x02", bytes([35 << 3 & 127 | 128, 35 << 3 >> 7])))
    data += message(3, message(1, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    c = sentencepiece.PieceCodec(str(path))
    assert c.model.model_type == sentencepiece.UNIGRAM and c.model.byte_fallback
    texts = ["the cat sat", "theat é", "", "that", "a <s> b", "</s>", "<0x41> a", "<unk>", "hechec the", "cattt", "漢字 sat🎉"]
    flat, n, good = c.encode(pa.array(texts))
    edge = np.concatenate([[0], np.cumsum(n)])
    assert [flat[a:b].tolist() for a, b in zip(edge, edge[1:])] == [c.peer.encode(t) for t in texts] and good.all()
    assert c.decode(flat, n) == texts


def test_piece_decoder_turns_every_mark_into_a_space(model_path):
    from tokenizers import decoders

    c = sentencepiece.PieceCodec(model_path, 1, False)
    plain = decoders.Sequence([decoders.Replace(sentencepiece.SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    size, rng = c.tokenizer.get_vocab_size(), random.Random(3)
    marks = [i for i, p in enumerate(c.model.pieces) if p.count(sentencepiece.SPACE) > 1 or p == sentencepiece.SPACE]
    lists = [[rng.choice([rng.randrange(size), rng.choice(marks), rng.randrange(300)]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    got = c.tokenizer.decode_batch(lists, skip_special_tokens=False)
    assert "Metaspace" in str(c.tokenizer.decoder)
    c.tokenizer.decoder = plain
    assert got == c.tokenizer.decode_batch(lists, skip_special_tokens=False)


def test_pieces_odd(odd, none, model_path):
    r = sentencepiece.encode_and_decode(odd, model_path).collect()
    assert len(r) == odd.count() and all(x.lossless and x.parity for x in r)
    assert sentencepiece.encode_and_decode(none, model_path).count() == 0
    ids = sentencepiece.encode_documents(odd, model_path)
    back = sentencepiece.decode_documents(ids, model_path)
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == texts


# --- chat


def test_escapes():
    for t in ["<|end|>", "<!|x", "<!!|", "</s>[INST] ok [/INST]", "<<SYS>>a<</SYS>>", "<<|", "[!INST]", "plain", "<unk>"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and "<|" not in e and "[INST]" not in e and "</s>" not in e


def test_chat_odd(spark):
    rows = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", None), (None, 0, "user", "x"), (2, 0, None, ""), (2, 0, None, ""), (3, None, "assistant", "y" * 300000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    r = {x.conv_id: x for x in chat.read_back(chat.format_chats(df)).collect()}
    assert r[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb<|end|>\n").hexdigest() and r[1].loss_chars == 8
    assert r[2].n_turns == 2 and r[3].loss_chars == 300000 and r[None].n_turns == 1
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
    f = {x.conv_id: x.formatted for x in chat.format_chats(df).collect()}
    a, b = chat.loss_spans(f[1])[0]
    assert chat.unescape(f[1][a:b]) == "b<|end|>"


# --- suffixes


def brute_suffix(texts):
    raw = [(t or "").encode() for t in texts]

    def covered(size):
        count = collections.Counter(d[i : i + size] for d in raw for i in range(len(d) - size + 1))
        for d in raw:
            gone = np.zeros(len(d) + 1, int)
            for i in range(len(d) - size + 1):
                if count[d[i : i + size]] > 1:
                    gone[i : i + size] = 1
            yield gone

    out = []
    for d, gone, short in zip(raw, covered(400), covered(256)):
        kept = bytes(np.frombuffer(d, np.uint8)[gone[:-1] == 0])
        edge = np.flatnonzero(np.diff(short, prepend=0))
        passages = sum(len(d[a:b].split()) > 50 for a, b in zip(edge[::2], edge[1::2]))
        out.append((len(d), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), passages))
    return out


@pytest.mark.parametrize("group", [1000, 3])
def test_suffixes_against_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(8)
    passages = [prose(rng, rng.randint(70, 200)) for _ in range(5)]
    texts = ["", None, "x" * 255, "x" * 256, "x" * 399, "x" * 400, "x" * 900, "ab" * 700, passages[0], passages[0], "a " * 140, "a " * 140]
    for _ in range(40):
        p = rng.choice(passages)
        a = rng.randint(0, 80)
        texts.append(" ".join([prose(rng, rng.randint(0, 30)), p[a : a + rng.randint(200, 1100)], "é" + prose(rng, rng.randint(0, 30))]))
    got = suffixes.suffix_dedup(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in got] == brute_suffix(texts)


def test_anchors_across_segments(monkeypatch):
    """A text longer than a segment has the anchors that it has in one segment."""
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    edge = np.array([0, 300, 300, 4700, 5000])
    whole = suffixes.anchors(raw, edge)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    suffixes._powers.cache_clear()
    parts = suffixes.anchors(raw, edge)
    suffixes._powers.cache_clear()
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) > 40


def test_deep_shallow_sort():
    rng = random.Random(5)
    for size in (2, 6, 60):
        base = bytes(rng.choice(b"ab") for _ in range(300))
        texts = [base[rng.randint(0, 40) : rng.randint(100, 300)] for _ in range(size)]
        order, common = suffixes.deep_shallow_sort(texts)
        assert [texts[i] for i in order] == sorted(texts)
        assert common == [0, *(suffixes.lcp(texts[a], texts[b]) for a, b in zip(order, order[1:]))]


def test_suffixes_odd(odd, none):
    r = suffixes.suffix_dedup(odd)
    assert r.count() == odd.count() and r.where("doc_id = 7 and n_removed = n_bytes").count() == 2
    assert suffixes.suffix_dedup(none).count() == 0


# --- language


def test_language_held_out(spark, data):
    r = Q.op6_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = r.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert r.where("score < 0 or score > 1").count() == 0


def test_language_against_plain_vectors(spark, data):
    """Predictions against TF-IDF vectors and cosines worked out text by text."""
    df = spark.read.parquet(f"{data}/documents.parquet")
    m = language.learn_languages(df, F.col("doc_id") % 4 != 2)
    some = df.where("doc_id % 8 = 2 and text is not null")
    got = {x.doc_id: x for x in language.predict_languages(some, m).collect()}
    for x in some.collect():
        raw = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in x.text.encode()) + b" "
        count = collections.Counter()
        for n in (1, 2, 3, 4):
            for i in range(len(raw) - n + 1):
                g = raw[i : i + n]
                if n > 1 and g[:2] == b"  ":
                    continue
                code = 0
                for c in g:
                    code = (code * 257 + c) & 0xFFFFFFFF
                count[(((code ^ n * 0x51ED27) * 2654435761) & 0xFFFFFFFF) >> 20] += 1
        v = np.zeros(language.DIMS)
        for k, c in count.items():
            v[k] = np.log1p(c) * m.idf[k]
        cosine = m.centroids @ (v / np.linalg.norm(v))
        assert got[x.doc_id].score == pytest.approx(float(cosine.max()), abs=1e-4)
        assert cosine[[o == got[x.doc_id].lang_pred for o in m.owner]].max() >= cosine.max() - 1e-4


def test_language_odd(odd, none):
    model = language.fit_centroids(["der die das und ist", "the and of to is"] * 3, ["de", "en"] * 3, 2)
    r = {(x.doc_id): x for x in language.predict_languages(odd, model).collect()}
    assert r[1].lang_pred == "und" and r[0].lang_pred == "und" and r[2].lang_pred == "und" and r[3].lang_pred in ("de", "en")
    empty = language.learn_languages(none, F.lit(True))
    assert {x.lang_pred for x in language.predict_languages(odd, empty).collect()} == {"und"}
    assert language.predict_languages(none, model).count() == 0
    far = language.CentroidModel(model.idf, model.centroids, model.owner, np.ones(len(model.owner)))
    assert far.predict(["zzz qqq"])[2].all()


# --- decontamination


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, ""), (4, None), (10, " ".join(WORDS[:12])), (11, " ".join(WORDS[:10]))], "item_id long, text string")
    texts = ["x ALPHA, beta y", "alpha gamma beta", " ".join(["pre", *WORDS[:12], "post"]), " ".join(WORDS[:9]), None, ""]
    r = {x.doc_id: x for x in decontaminate.report(docs(spark, texts), items).collect()}
    assert [(r[i].n_words, r[i].n_hit, r[i].n_items, r[i].contaminated) for i in range(6)] == [(4, 2, 1, True), (3, 1, 1, True), (14, 12, 2, True), (9, 0, 0, False), (0, 0, 0, False), (0, 0, 0, False)]
    assert r[2].items_sha256 == hashlib.sha256(b"10,11").hexdigest()


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "same text again same text again same text again same")], "item_id long, text string")
    r = decontaminate.report(odd, items)
    assert r.count() == odd.count() and r.where("contaminated").count() == 2
    assert decontaminate.report(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd, items).count() == odd.count() - 2 and decontaminate.report(none, items).count() == 0


# --- vectors


def brute_vectors(rows):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[hit[i]]]) for i in range(len(x))])
        if (new == label).all():
            return [(int(h.sum()), int(c)) for h, c in zip(hit, label)]
        label = new


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, *(base[i] + rng.standard_normal((k, 16)) * 0.15 for i, k in ((0, 150), (1, 60), (2, 30), (3, 5)))]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 20, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_vectors(rows)
    whole = vectors.near_duplicates(df).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in whole] == want
    split = vectors.near_duplicates(df, leaf=40, sample=200).orderBy("vec_id").collect()
    assert sum(r.n_links for r in split) >= 0.97 * sum(n for n, _ in want) and all(r.n_links <= n for r, (n, _) in zip(split, want))


def test_recall_over_many_leaves(spark):
    """Planted links among vectors of many leaves, with the query's parameters: recall by link, and no wrong link."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((5000, 32))
    near = base[:1500] + rng.standard_normal((1500, 32)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    want = brute_vectors(rows)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    assert all(r.n_links <= n for r, (n, _) in zip(got, want))
    found, planted = sum(r.n_links for r in got), sum(n for n, _ in want)
    print("recall", found, planted, found / planted)
    assert planted > 2000 and found >= 0.98 * planted


def test_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = 1 + rng.standard_normal((90, 8)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in got] == brute_vectors(rows)


@pytest.mark.parametrize("n", [1500, 6000])
def test_leaves_stay_bounded_as_the_table_grows(spark, n, monkeypatch):
    """With a sample of one size leaves don't grow with the table, every vector stays indexed, and recall holds."""
    seen = []
    part = vectors.part_large

    def watched(placed, leaf, spill, seed):
        before = placed.groupBy("leaf").count().agg(F.max("count")).first()[0]
        after, paths = part(placed, leaf, spill, seed)
        seen.append((before, after.groupBy("leaf").count().agg(F.max("count")).first()[0], after.select("rep").distinct().count(), len(paths)))
        return after, paths

    monkeypatch.setattr(vectors, "part_large", watched)
    monkeypatch.setattr(vectors, "AT_ONCE", 300)
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n, 32))
    near = base[: n // 4] + rng.standard_normal((n // 4, 32)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    want = brute_vectors(rows)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=80, sample=150).orderBy("vec_id").collect()
    before, after, reps, tables = seen[0]
    assert before > 320 and after <= 320 and reps == len(rows) and tables > 1
    assert all(r.n_links <= w for r, (w, _) in zip(got, want))
    found, planted = sum(r.n_links for r in got), sum(w for w, _ in want)
    print("recall", found, planted)
    assert planted > n // 4 and found >= 0.98 * planted


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "a") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")
    r = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.near_duplicates(df).collect()}
    assert all(r[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)) and r[None] == (0, None, False)
    assert r[7] == (2, 7, True) and r[8] == (2, 7, False) and r[10] == (2, 7, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# --- toxicity


def test_toxicity_learns_from_documents_and_locates():
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(400):
        sentences = [prose(rng, rng.randint(4, 12)) + "." for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k][:-1] + " " + rng.choice(["vilefool", "grotbag", "swinehead"]) + rng.choice(["", "s"]) + "."
        texts.append(" ".join(sentences))
        labels.append(int(i % 4 == 0))
    m = toxicity.fit_bags(texts[:300], labels[:300])
    score = np.array([m.score(t) for t in texts[300:]])
    y = np.array(labels[300:])
    assert (score[y == 1] >= 0.7).mean() > 0.95 and (score[y == 0] < 0.7).mean() > 0.95
    t = texts[300]
    a, b, p = max(m.sentences(t), key=lambda s: s[2])
    assert re.search("vilefool|grotbag|swinehead", t[a:b])
    assert m.score(t) == pytest.approx(1 - np.prod([1 - q for _, _, q in m.sentences(t)]), abs=1e-6)


def test_toxicity_scan_cuts_the_same_words_apart():
    """The scoring scan and the sentences that are located hold the same words, and a word's weight is that of its features."""
    rng = random.Random(4)
    weights = {"bad": 1.5, "fool": 2.0, "fool~": -0.25, "foolis~": 0.5, "né": 0.75, "str": -1.0, "ängst~": 0.3}
    m = toxicity.BagModel(weights, -3.0)
    for _ in range(400):
        text = "".join(rng.choice([*".!?;\n \t\x0b_0é", "\u2028", "\u00a0", "bad", "Fool", "foolish", "né", "STR", "ängstlich", "x"]) for _ in range(rng.randint(0, 40))).lower()
        cut = [[w for w in toxicity.WORD.findall(t)] for t in toxicity.SENTENCE_END.split(text)]
        assert [w for w in cut if w] == [w for w in map(toxicity.WORD.findall, toxicity.BETWEEN.split(text)) if w]
        assert all(m.weight(w) == sum(weights.get(f, 0.0) for f in toxicity.features(w)) for words in cut for w in words)


def test_toxicity_query(spark, data):
    r = Q.op9_toxicity(spark, data)
    assert r.where("score < 0 or score > 1 or score is null").count() == 0 and r.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_toxicity_held_out_and_scores(spark):
    """Quality on held-out rows, and each score as the noisy-or of the sentences, worked out anew."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    r = Q.op9_toxicity(spark, d).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (r[r.toxic == 1].predicted == 1).mean() >= 0.8 and (r[r.toxic == 0].predicted == 0).mean() >= 0.98
    m = toxicity.learn_toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    some = docs.where("doc_id % 50 = 1")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(some, m).collect()}
    for x in some.collect():
        clean = 1.0
        for s in re.split(r"(?<=[.!?;])\s+|\n+", (x.text or "").lower()):
            words = re.findall(r"\w+", s)
            total = m.bias + sum(m.weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + "~" for n in (4, 5, 6) if len(w) >= n)])
            clean *= 1 - 1 / (1 + np.exp(-np.clip(total, -40, 40))) if words else 1
        assert got[x.doc_id] == pytest.approx(1 - clean, abs=1e-6)


def test_toxicity_odd(spark, odd, none):
    m = toxicity.fit_bags(["a fine day", "a bad fool", "a good day", "a fool"] * 20, [0, 1, 0, 1] * 20)
    r = toxicity.score_toxicity(odd, m, keep=True)
    assert r.count() == odd.count() and set(r.columns) == set(odd.columns) and r.where("text is null and score <> 0").count() == 0
    nothing = toxicity.learn_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {x.score for x in toxicity.score_toxicity(odd, nothing).collect()} == {0.0}
    assert toxicity.locate(odd, m).count() == 0 and toxicity.score_toxicity(none, m).count() == 0


# --- token files


def brute_tokens(df):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_file("byte_bpe_50k.json"))
    rows, at = [], 0
    for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.col("text"))).collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        rows.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return rows


def test_tokens_against_plain_encoding(spark, data):
    got = [tuple(r) for r in Q.op10_token_files(spark, data).orderBy("start").collect()]
    assert got == brute_tokens(spark.read.parquet(f"{data}/documents.parquet"))


def test_tokens_odd(spark, odd, none):
    path = Q.tokenizer_file("byte_bpe_50k.json")
    got = token_files.tokenize(spark, odd, path, 2).orderBy("start").collect()
    want = brute_tokens(odd.where("doc_id is not null"))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((a, c, d) for a, _, c, d in want)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()] and got[0].doc_id is None
    assert token_files.tokenize(spark, none, path, 2).count() == 0


def test_tokens_of_special_strings_and_marks(spark):
    """The library's plain ids for texts that hold its special string, other marks, digits and white space."""
    rng = random.Random(12)
    bits = ["<|endoftext|>", "a", "Über", "don't", "I'LL", "3.14", "x\ny", "\n\n", "\t", "", "ª", "漢字", "🎉", "=%%", "ſ", "é́", "\u00a0", "o<|endoftext|>o", "_", "'s", "v2.0's", "ʰa", "İ"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = docs(spark, texts)
    got = token_files.tokenize(spark, df, Q.tokenizer_file("byte_bpe_50k.json"), 2).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute_tokens(df)


def test_order_of_repeated_ids(spark, tmp_path):
    """`start` is a document's place in the files where ids repeat, too."""
    out = f"file://{tmp_path}/t"
    df = docs(spark, [prose(random.Random(i), 5 + i) for i in range(40)], [i % 3 for i in range(40)])
    token_files.write_token_files(df, out, Q.tokenizer_file("byte_bpe_50k.json"), 2)
    rows = token_files.read_tokens(spark, out).orderBy("part", "row").collect()
    at = 0
    starts = {(r.doc_id, r.ids_crc32): r.start for r in token_files.digests(spark, out).collect()}
    for r in rows:
        assert starts[r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())] == at
        at += len(r.ids)
    assert [r.doc_id for r in rows] == sorted(i % 3 for i in range(40))


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(13)
    return docs(spark, [prose(rng, 30) for _ in range(6000)])


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_file_layout(spark, many, tmp_path, encoding):
    import glob

    import pyarrow.parquet as pq

    out = str(tmp_path / encoding)
    token_files.write_token_files(many, "file://" + out, Q.tokenizer_file("byte_bpe_50k.json"), 2, encoding=encoding, row_group_bytes=64 << 10, page_bytes=8 << 10)
    metas = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(f"{out}/*.parquet"))]
    group = metas[0].row_group(0)
    column = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("ids"))
    assert column.has_offset_index and (("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta"))
    assert any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary")
    groups = [m.row_group(i) for m in metas for i in range(m.num_row_groups)]
    assert len(groups) > len(metas)
    assert token_files.read_tokens(spark, out, ["doc_id", "n_tokens"]).columns == ["doc_id", "n_tokens"]


def test_range_reads_few_pages(spark, many, tmp_path):
    """A range of documents is read by the pages that hold it: the scan gives few rows to the filter, and no ids where none are named."""
    out = f"file://{tmp_path}/r"
    token_files.write_token_files(many, out, Q.tokenizer_file("byte_bpe_50k.json"), 2, page_rows=50)
    got = token_files.read_tokens(spark, out, ["doc_id", "ids"], 1000, 1020)
    assert sorted(r.doc_id for r in got.collect()) == list(range(1000, 1021))

    def scan(plan):
        while not plan.nodeName().startswith("Scan"):
            plan = plan.children().head()
        return plan

    rows = scan(got._jdf.queryExecution().executedPlan()).metrics().apply("numOutputRows").value()
    assert 21 <= rows <= 200
    named = token_files.read_tokens(spark, out, ["doc_id", "n_tokens"], 1000, 1020)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in named and "GreaterThanOrEqual(doc_id,1000)" in named


# --- pipeline


@pytest.mark.parametrize("some", ["odd", "none"])
def test_pipeline_on_odd_and_empty_tables(spark, some, request, tmp_path):
    """Columns of names that stages might use stay; nulls and empty texts pass; copies go once."""
    import corpus_pipeline as P

    names = {"k1": "_k1", "score": "_score", "n_lines": "_lines"}
    table = request.getfixturevalue(some)
    table.withColumnsRenamed(names).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", "one")], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == now.columns
        rows = after.collect()
        assert all((r._k1, r._score, r._lines) == ("x", 1.0, "y") for r in rows)
        now = after
    if some == "odd":
        ids = [r.doc_id for r in rows]
        assert {0, 1, 2, 4, 6, 9, 10} <= set(ids) and 3 not in ids and ids.count(5) == 1 and ids.count(None) == 2
    assert P.run(spark, str(tmp_path)).count() == len(rows)


def test_shared_folder(spark, monkeypatch):
    """Tables that no result needs any more can be swept; a cluster without a shared folder is an error."""
    import os

    _, path = shared.saved(spark.range(3), "kept")
    assert os.path.exists(path.removeprefix("file://"))
    shared.sweep(spark)
    assert not os.path.exists(path.removeprefix("file://"))
    far = type("Spark", (), {"sparkContext": type("Context", (), {"master": "yarn", "getConf": lambda self: {}})()})
    with pytest.raises(ValueError):
        shared.shared_dir(far)



def plain_toxicity(model, text):
    """Noisy-or over sentences, worked out word by word."""
    clean = 1.0
    for s in re.split(r"(?<=[.!?;])\s+|\n+", (text or "").lower()):
        words = re.findall(r"\w+", s)
        total = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + "~" for n in (4, 5, 6) if len(w) >= n)])
        clean *= 1 - 1 / (1 + np.exp(-np.clip(total, -40, 40))) if words else 1
    return 1 - clean


def plain_windows(text, span=10):
    """All windows of a text's words by length, as tuples."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, span + 1)}


def test_pipeline_filters_against_brute_force(spark):
    """The toxicity and decontamination stages keep just what plain versions keep, and drop some."""
    import corpus_pipeline as P

    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.learn_toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    kept = {r.doc_id for r in P.drop_toxic(spark, docs, d).collect()}
    assert kept == {i for i, t in texts.items() if plain_toxicity(model, t) < P.TOXIC} and 0 < len(kept) < len(texts)
    items = [plain_windows(r.text)[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    wanted = {tuple(w[i : i + min(len(w), 10)]) for w in items if w for i in range(len(w) - min(len(w), 10) + 1)}
    kept = {r.doc_id for r in P.drop_contaminated(spark, docs, d).collect()}
    assert kept == {i for i, t in texts.items() if not any(wanted & of for of in plain_windows(t)[1].values())} and 0 < len(kept) < len(texts)


def test_pipeline_stages(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, kept, data)
        assert after.columns == docs.columns
        rows = after.collect()
        ids = [r.doc_id for r in rows]
        assert len(set(ids)) == len(ids)
        before = {r.doc_id: r.text for r in kept.collect()}
        if name == "line_dedup":
            order = sorted(before)
            want = dict(zip(order, brute_lines([before[i] for i in order])))
            assert {r.doc_id: r.text for r in rows} == {i: t for i, t in want.items() if t or not before[i]}
        elif name == "minhash_dedup":
            order = sorted(before)
            assert set(ids) == {i for i, (_, c) in zip(order, brute_near([before[i] for i in order])) if order[c] == i}
        kept = spark.createDataFrame(rows, docs.schema)
    got = P.run(spark, data)
    assert got.count() == kept.count() and got.where("not lossless or not parity").count() == 0 and texts
