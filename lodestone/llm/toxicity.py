"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct hashed words (whole and cut to their first letters, so that compound and inflected
forms share a feature), word pairs, and pairs with one word between. The learner keeps
a gradient sum and a squared sum for each coordinate, which give it a rate of its own; an L1 term leaves most weights at zero,
so that the weights, of a fixed width, are broadcast.

Labels come from at most SAMPLE rows, those least by a hash of their id; all else covers all documents.

Defined cases: a null or empty text has the bias alone; null labels are no labels; repeated labels of a
document count once, toxic if one says so; of rows that share an id the least text is learned from, and each is scored; ties of the hash go by id; without any label the score is 0.5; texts of any
length are read whole; an empty table gives no rows; a kept column named score gives way to the result's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BITS = 20
#: Labelled rows that are learned from, at most.
SAMPLE = 16_384
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 1.0
EPOCHS, BATCH = 3, 64
#: Texts that are taken apart at a time.
TEXTS = 64
#: Odd multipliers, one for each place of a word in a feature.
PLACES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
WORDS = re.compile(r"[^\W_]+")
#: Words whose hashes a task remembers.
REMEMBERED = 1_000_000
#: Letters of the beginnings that stand for a word's inflected and compound forms.
STEMS = (4, 5, 6, 7)


class Hashes(dict):
    """Word to the row of table that holds 32-bit hashes of the word and of its beginnings; forgets all when full."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((REMEMBERED, 1 + len(STEMS)), np.uint32)

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            raise OverflowError
        self[word] = at = len(self)
        forms = (word, *(word[:n] if len(word) > n else word for n in STEMS))
        self.table[at] = [zlib.crc32(f"{k if len(x) < len(word) else 0}{x}".encode("utf-8", "surrogatepass")) for k, x in enumerate(forms)]
        return at

    def of(self, words: list[str]) -> np.ndarray:
        """A row of hashes for each word. The words of one text are looked up together, so that none is forgotten meanwhile."""
        if len(self) + len(words) >= REMEMBERED:
            self.clear()
        if len(words) >= REMEMBERED:
            return np.concatenate([self.of(words[i : i + REMEMBERED // 2]) for i in range(0, len(words), REMEMBERED // 2)])
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def features(texts: list[str | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all words, beginnings of words, pairs and skip pairs of the texts, with repeats, and whose each is. No pair reaches over two texts."""
    words = [WORDS.findall(t.lower()) if t else [] for t in texts]
    rows = hashes.of([w for x in words for w in x])
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in words])
    h = rows[:, 0]
    one, two = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    a, b, c, d, e = (np.uint32(x) for x in PLACES)
    pairs, skips = h[:-1] * b + (h[1:] ^ (h[1:] >> np.uint32(15))) * c, h[:-2] * d + (h[2:] ^ (h[2:] >> np.uint32(13))) * e
    found = np.concatenate([rows.ravel() * a, pairs[one], skips[two]])
    return (found * a) >> np.uint32(32 - BITS), np.concatenate([np.repeat(owner, rows.shape[1]), owner[:-1][one], owner[:-2][two]])


def distinct(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each coordinate of an owner once, by owner."""
    both = np.unique(owner.astype(np.int64) << BITS | flat.astype(np.int64))
    return both & ((1 << BITS) - 1), both >> BITS


def learn(docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias. Gradients of BATCH documents meet in one step of each coordinate."""
    z, n, w = (np.zeros(1 << BITS) for _ in range(3))
    bias = nb = 0.0
    if len(labels):
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        bias = float(np.log(rate / (1 - rate)))
    for _ in range(EPOCHS):
        for start in range(0, len(docs), BATCH):
            part = docs[start : start + BATCH]
            y = labels[start : start + BATCH]
            sizes = np.array([len(x) for x in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            flat = np.concatenate(part) if part else np.zeros(0, np.int64)
            margin = np.bincount(owner, w[flat], minlength=len(part)) + bias
            error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y
            met, place = np.unique(flat, return_inverse=True)
            g = np.bincount(place, error[owner], minlength=len(met))
            gg = np.bincount(place, error[owner] ** 2, minlength=len(met))
            root = np.sqrt(n[met])
            n[met] += gg
            z[met] += g - (np.sqrt(n[met]) - root) / ALPHA * w[met]
            zm = z[met]
            w[met] = np.where(np.abs(zm) <= L1, 0.0, -(zm - np.sign(zm) * L1) / ((BETA + np.sqrt(n[met])) / ALPHA + L2))
            nb += float((error**2).sum())
            bias -= ALPHA / (BETA + np.sqrt(nb)) * float(error.sum())
    return w, bias


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights (1 << BITS) and bias from labelled documents, sample of them at most."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    chosen = table(chosen, "labelled")  # sample rows at most
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("t")).join(F.broadcast(chosen), "_key")
    # one text for each id, however often it is repeated: sample rows at most go on
    rows = rows.groupBy("_key").agg(F.min("t").alias("t"), F.max("_y").alias("_y")).select(F.xxhash64("_key").alias("o"), "t", "_y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            texts, found = b.column("t").to_pylist(), []
            for i in range(0, len(texts), TEXTS):
                flat, owner = distinct(*features(texts[i : i + TEXTS], hashes))
                found += np.split(flat.astype(np.int32), np.searchsorted(owner, np.arange(1, len(texts[i : i + TEXTS]))))
            yield pa.RecordBatch.from_arrays([b.column("o"), pa.array(found, pa.list_(pa.int32())), b.column("_y")], ["o", "f", "y"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[int, np.ndarray, float]] = []
        for b in batches:
            f = b.column("f")
            at, flat = f.offsets.to_numpy(), f.values.to_numpy(zero_copy_only=False)
            seen += [(o, flat[i:j].copy(), y) for o, i, j, y in zip(b.column("o").to_pylist(), at[:-1], at[1:], b.column("y").to_pylist(), strict=True)]
        seen.sort(key=lambda x: x[0])
        w, bias = learn([x[1] for x in seen], np.array([x[2] for x in seen]))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["i", "w"])

    found = table(rows.mapInArrow(hashed, "o long, f array<int>, y double"), "features")
    sparse = found.coalesce(1).mapInArrow(learned, "i long, w double").toPandas()  # 1 << BITS rows at most
    w = np.zeros(1 << BITS)
    bias = float(sparse.w[sparse.i < 0].sum())
    sparse = sparse[sparse.i >= 0]
    w[sparse.i.to_numpy()] = sparse.w.to_numpy()
    return w, bias


def score(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep and score: the probability that the text is toxic."""
    keep = [c for c in keep if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    df = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = sent.value
        some, hashes = w != 0, Hashes()
        for b in batches:
            out = np.zeros(b.num_rows)
            texts = b.column("t").to_pylist()
            for i in range(0, len(texts), TEXTS):
                flat, owner = features(texts[i : i + TEXTS], hashes)
                weighed = some[flat]
                flat, owner = distinct(flat[weighed], owner[weighed])
                out[i : i + TEXTS] = np.bincount(owner, w[flat].astype(float), minlength=len(texts[i : i + TEXTS]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(1 / (1 + np.exp(-np.clip(out + b0, -35, 35))))], ["row", "score"])

    kind = dict(df.dtypes)["row"]
    return df.mapInArrow(run, f"row {kind}, score double").select(*(F.col(f"row.{c}") for c in keep), "score")
