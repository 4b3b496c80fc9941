"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the words and word
beginnings that it has; a document's is the noisy-or of its sentences, 1 - prod(1 - p). Weights are
trained from document labels alone, and then point out the offending sentences.

Bounds: the model is fitted on about `per_class` labelled documents of each class, chosen by a hash of
the id, and has at most `MAX_FEATURES` features. Every document is scored from its whole text.

Defined results: a null or empty text has no sentence and score 0; without labelled rows of both
classes every score is 0. Features that say equally much about the label are taken in the order of their strings, so ties
don't depend on partitioning. Rows are independent: repeated rows and null ids pass through. Only the
named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import hashed_sample
from .shared import free_names

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?;])\s+|\n+")
#: Cuts the same words apart; each branch begins with a character, so the scan skips all others.
BETWEEN = re.compile(r"\.\s+|!\s+|\?\s+|;\s+|\n\n*")
BEGINNINGS = (4, 5, 6)
MAX_FEATURES = 3000
MEMO = 200_000


def features(word: str) -> list[str]:
    """The word, and its beginnings as marked strings."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) >= n)]


class WordWeights(dict):
    """The weight of each word asked for, kept for at most MEMO words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        #: Of all features; a word that begins otherwise has none.
        self.heads = {f[: min(BEGINNINGS)] for f in weights}

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO:
            self.clear()
        get = self.weights.get
        self[word] = found = sum(get(f, 0.0) for f in features(word)) if word[: min(BEGINNINGS)] in self.heads else 0.0
        return found


@dataclass
class BagModel:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.weight = WordWeights(self.weights).__getitem__

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every sentence, in code points."""
        out, at = [], 0
        for m in [*SENTENCE_END.finditer(text), None]:
            end = m.start() if m else len(text)
            words = WORD.findall(text[at:end].lower())
            if words:
                out.append((at, end, float(sigmoid(self.bias + sum(map(self.weight, words))))))
            at = m.end() if m else end
        return out

    def score(self, text: str) -> float:
        """Noisy-or over the sentences."""
        weight, log = self.weight, 0.0
        total, plain = 0, np.log1p(-sigmoid(self.bias))
        for words in map(WORD.findall, BETWEEN.split(text.lower())):
            if words:
                x = sum(map(weight, words))
                if x:
                    log += np.log1p(-min(float(sigmoid(self.bias + x)), 1 - 1e-12))
                else:
                    total += 1
        return float(-np.expm1(log + total * plain)) if self.weights else 0.0


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_bags(texts: list[str], labels: list[int], rounds: int = 400, rate: float = 0.15, shrink: float = 3e-5) -> BagModel:
    """Train by gradient steps (Adam) on the log likelihood of the noisy-or."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return BagModel({}, -10.0)
    docs = [[f for f in (WORD.findall(s) for s in SENTENCE_END.split(t.lower())) if f] for t in texts]
    seen: dict[str, list[int]] = {}
    for i, sents in enumerate(docs):
        for f in {f for w in {w for s in sents for w in s} for f in features(w)}:
            seen.setdefault(f, [0, 0])[labels[i]] += 1
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    ranked = []
    for f, (a, b) in seen.items():
        if a + b < 4:
            continue
        total = a + b
        # what the feature says about the label, in nats (the G statistic of its 2 x 2 table)
        gain = sum(
            o * np.log(o / e) for o, e in (
                (a, total * n0 / len(y)), (b, total * n1 / len(y)),
                (n0 - a, (len(y) - total) * n0 / len(y)), (n1 - b, (len(y) - total) * n1 / len(y)),
            ) if o > 0 and e > 0
        )
        if gain > 6:
            ranked.append((-gain, f))
    names = [f for _, f in sorted(ranked)[:MAX_FEATURES]]
    index = {f: i for i, f in enumerate(names)}
    bag, where, what = [], [], []
    for i, sents in enumerate(docs):
        for s in sents:
            for w in s:
                for f in features(w):
                    if f in index:
                        where.append(len(bag))
                        what.append(index[f])
            bag.append(i)
    if not names:
        return BagModel({}, -10.0)
    bag, where, what = np.array(bag), np.array(where, np.int64), np.array(what, np.int64)
    theta = np.zeros(len(names) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        p = sigmoid(theta[-1] + np.bincount(where, theta[what], len(bag)))
        log = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        doc = np.clip(-np.expm1(log), 1e-9, 1 - 1e-12)
        # d loss / d x of a sentence: p (1 - y / P)
        slope = p * (1 - y / doc)[bag]
        grad = np.concatenate([np.bincount(what, slope[where], len(names)), [slope.sum()]]) / len(y)
        grad[:-1] += shrink * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return BagModel({f: float(w) for f, w in zip(names, theta)}, float(theta[-1]))


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", id_col: str = "doc_id",
    label_col: str = "toxic", per_class: int = 1500,
) -> BagModel:
    """Fit on documents for which `usable` (a condition on the id column) holds and that have a label."""
    known = labels.where(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    ids = hashed_sample(known.distinct(), "id", "label", per_class)
    # the ids are bounded by the sample's size; the checked count allows the broadcast
    few = F.broadcast(ids) if ids.count() <= 8 * per_class else ids
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id").where("text is not null").collect()
    got.sort(key=lambda r: (str(r.id), r.label, r.text))
    return fit_bags([r.text for r in got], [int(r.label) for r in got])


def score_toxicity(
    df: DataFrame, model: BagModel, text_col: str = "text", id_col: str = "doc_id", keep: bool = False, score_col: str = "score",
) -> DataFrame:
    """(id, score) for every row, by row: no shuffle. keep: all columns of df, and the score in place of
    a column of its name."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    names = [c for c in df.columns if c != score_col] if keep else [id_col]
    (text_at,) = free_names(df, "_text")

    def run(batches):
        own = BagModel(*shared.value)
        for batch in batches:
            score = [own.score(t) if t else 0.0 for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(score, pa.float64())], [*names, score_col]
            )

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*names, F.col(text_col).alias(text_at)).mapInArrow(run, f"{fields}, `{score_col}` double")


def locate(df: DataFrame, model: BagModel, text_col: str = "text", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The offending sentences: (id, sentence_start, sentence_end, score, sentence), offsets in code points."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = BagModel(*shared.value)
        for batch in batches:
            rows = [
                (i, a, b, p, t[a:b])
                for i, t in enumerate(batch.column("text").to_pylist()) if t
                for a, b, p in own.sentences(t) if p >= least
            ]
            at, a, b, p, s = zip(*rows) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                 pa.array(p, pa.float64()), pa.array(s, pa.string())],
                ["id", "sentence_start", "sentence_end", "score", "sentence"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, sentence_start int, sentence_end int, score double, sentence string"
    ).withColumnRenamed("id", id_col)
