"""Language identification by nearest centroid.

A text becomes a vector of TF-IDF weighted n-grams of its letters (1 to 4 bytes, hashed), scaled
to length 1. Spherical k-means makes several centroids for each language from a bounded sample, and a text takes the
language of the centroid with the largest cosine. A text farther from its centroid than nearly all
training texts of that language is marked as rejected.

Bounds: the classifier is fitted on about `per_language` labelled rows of each language, chosen by a
hash of the id (so the same rows at every partitioning); all rows are predicted from whole texts.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; without any
labelled row every text is `und`. Of centroids with equal cosine the first wins, languages being in the order of their names. Rows are independent: repeated rows and null ids pass through. Only
the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_slices

DIMS = 4096
MANY_LABELS = 10_000
ORDERS = (1, 2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
#: A-Z to a-z; bytes of other letters stay; everything else is a space.
LETTERS_ONLY = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, one row for each text; long texts are counted whole."""
    raw = [b" " + t.encode("utf-8", "surrogatepass").translate(LETTERS_ONLY) + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw), dtype=np.int64) * DIMS, [len(r) for r in raw])
    out = np.zeros(len(raw) * DIMS, np.float32)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + data[n - 1 :]
        inside = owner[:m] == owner[n - 1 :]
        if n > 1:  # runs of spaces say nothing
            inside &= ~((data[:m] == 32) & (data[1 : m + 1] == 32))
        mixed = (code ^ np.uint32(n * 0x51ED27)) * np.uint32(2654435761)
        out += np.bincount((owner[:m] + (mixed >> np.uint32(20)).astype(np.int64))[inside], minlength=len(out)).astype(np.float32)
    return out.reshape(len(raw), DIMS)


def scaled(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


@dataclass
class CentroidModel:
    idf: np.ndarray
    centroids: np.ndarray
    owner: list[str]
    floor: np.ndarray  # cosine below which a centroid rejects

    def vectors(self, texts: list[str]) -> np.ndarray:
        return scaled(np.log1p(ngram_counts(texts)) * self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not len(self.centroids):
            n = len(texts)
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        cosine = self.vectors(texts) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        return [self.owner[b] for b in best], score, score < self.floor[best]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids; starts at the row nearest to the mean, then at the rows farthest from those taken."""
    first = int((x @ x.mean(0)).argmax())
    chosen = [first]
    near = x @ x[first]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        label = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        kept = np.bincount(label, minlength=len(c)) > 0
        c = scaled(sums[kept])
    return c


def fit_centroids(texts: list[str], langs: list[str], per_language: int = 4, reject_share: float = 0.005) -> CentroidModel:
    """Fit on a bounded sample; deterministic for a given order of rows."""
    if not texts:
        return CentroidModel(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    counts = np.concatenate([ngram_counts(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    idf = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = scaled(np.log1p(counts) * idf)
    names = np.array(langs)
    centroids, owner = [], []
    for lang in sorted(set(langs)):
        found = spherical_kmeans(x[names == lang], per_language)
        centroids.append(found)
        owner += [lang] * len(found)
    c = np.concatenate(centroids)
    cosine = x @ c.T
    best = cosine.argmax(1)
    floor = np.array([
        np.quantile(cosine[best == j, j], reject_share) if (best == j).any() else 0.0 for j in range(len(c))
    ])
    return CentroidModel(idf, c.astype(np.float32), owner, floor)


def hashed_sample(df: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label (all, where there are fewer), by a hash of the id.

    The expected number is the bound. The labels' counts have one row for each label; they are broadcast
    where there are at most `MANY_LABELS`, so that no text is shuffled by its label.
    """
    sized = df.groupBy(label_col).agg(F.count("*").alias("_n")).withColumnRenamed(label_col, "_label")
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), 11) / F.lit(float(1 << 53))
    sized = F.broadcast(sized) if sized.limit(MANY_LABELS + 1).count() <= MANY_LABELS else sized
    return df.join(sized, F.col(label_col) == F.col("_label")).where(draw < per_label / F.col("_n")).drop("_n", "_label")


def learn_languages(
    df: DataFrame, labelled: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    per_language: int = 600, centroids: int = 4,
) -> CentroidModel:
    """Fit on the rows where `labelled` holds and text and language aren't null. The sample that the
    driver reads has about `per_language` rows of each language."""
    rows = df.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    got = hashed_sample(rows, "id", "lang", per_language).collect()
    got.sort(key=lambda r: (r.lang, str(r.id), r.text))
    got = [r for r in got if LETTER.search(r.text)]
    return fit_centroids([r.text for r in got], [r.lang for r in got], centroids)


def predict_languages(df: DataFrame, model: CentroidModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row, by row: no shuffle. The model (its size is
    fixed by the number of languages) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.owner, model.floor))

    def run(batches):
        own = CentroidModel(*shared.value)
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                langs: list[str] = []
                score, rejected = [], []
                for i in range(0, len(texts), 256):
                    a, b, c = own.predict(texts[i : i + 256])
                    langs += a
                    score.append(b)
                    rejected.append(c)
                score, rejected = np.concatenate(score), np.concatenate(rejected)
                for i, t in enumerate(texts):
                    if not LETTER.search(t):
                        langs[i], score[i], rejected[i] = "und", 0.0, True
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                    ["id", "lang_pred", "score", "rejected"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
        .withColumnRenamed("id", id_col)
    )
