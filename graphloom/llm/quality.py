"""Quality classifier: supervised subword embeddings.

A text's words (split at white space) each have hashed features: the word and its character n-grams; each two neighbours
have one more, the word pair, by a hash in which both words and their order count. Vectors learned for the features are averaged over the text and go through a softmax. Training is stochastic gradient descent in numpy on the driver, over a sample with a documented bound (MAX_PER_CLASS texts of each class, those with the lowest
hashes of their ids, and of each its MAX_FEATURES most frequent features); features are counted on the executors.

For scoring, each feature's vector times the output weights is one number, and a word's sum of these is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import crc_mod, slices

BITS, GRAMS, SIZE = 16, (3, 4), 8
MAX_PER_CLASS = 2000
EPOCHS, RATE, SEED = 4, 1.0, 8
MIN_STEPS = 12_000
#: Features of a training text that are learned from: the most frequent ones of a longer list. A bound of what the driver gathers.
MAX_FEATURES = 8192
REMEMBERED = 100_000
#: Multipliers of the feature hashes, and their number of powers (positions in very long words go round).
FACTOR, FIRST, POWERS = 0x9E3779B97F4A7C15, 0x632BE59BD9B4E019, 4096


@lru_cache(maxsize=1)
def powers_of_factor() -> np.ndarray:
    return np.cumprod(np.full(POWERS, FACTOR, np.uint64))


def features(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of all words, and the index of the word that each belongs to."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    powers = powers_of_factor()
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(c)) - begin[owner]
    wide = c.astype(np.uint64)
    found = [np.add.reduceat(wide * powers[place % POWERS], begin)]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        if len(c) >= n:
            inside = np.flatnonzero(place[: len(c) - n + 1] + n <= size[owner[: len(c) - n + 1]])
            h = np.full(len(inside), n, np.uint64)
            for k in range(n):
                h = (h + wide[inside + k]) * powers[k]
            found.append(h)
            owners.append(owner[inside])
    return bucket_of(np.concatenate(found), bits), np.concatenate(owners)


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(FACTOR)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Words:
    """Words that were seen: each one's place, hash, and the sum and number of its features' weights (without weights: none)."""

    def __init__(self, bits: int, weights: np.ndarray | None = None):
        self.bits, self.weights = bits, weights
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.hash, self.total, self.number = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.place) > REMEMBERED:
            self.clear()
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.place))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.hash = np.concatenate((self.hash, np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new], np.uint64)))
        if self.weights is not None:
            bucket, owner = features(new, self.bits)
            self.total = np.concatenate((self.total, np.bincount(owner, self.weights[bucket], len(new))))
            self.number = np.concatenate((self.number, np.bincount(owner, minlength=len(new))))

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Buckets of the neighbours in a text, given its words' places."""
        h = self.hash[at]
        return bucket_of(h[:-1] * np.uint64(FIRST) + h[1:], self.bits)

    def places(self, words: list[str]) -> np.ndarray:
        place = self.place
        return np.array([place[w] for w in words], np.int64)


def counted(text: str | None, bits: int = BITS) -> np.ndarray:
    """How often each bucket's features come in a text."""
    words, seen = (text or "").split(), Words(bits)
    seen.learn([words])
    at = seen.places(words)
    bucket, owner = features(list(seen.place), bits)
    each = np.bincount(at, minlength=len(seen.place)).astype(float)
    return np.bincount(bucket, each[owner], 1 << bits) + np.bincount(seen.pairs(at), minlength=1 << bits)


@dataclass
class Model:
    weights: np.ndarray  # of each feature, for class 1 against class 0
    bias: float


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, size: int = SIZE, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """rows: (features, their shares of the text, class). With one class only, or no rows, its share is the score."""
    ones = sum(y for *_, y in rows)
    if ones in (0, len(rows)):
        return Model(np.zeros(1 << bits), 0.0 if not rows else 20.0 if ones else -20.0)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / size, 1 / size, (1 << bits, size))
    out, bias = np.zeros((size, 2)), np.zeros(2)
    # the rarer class is repeated until it is about as frequent; few rows are gone through more often
    times = [max(1, ones // (len(rows) - ones)), max(1, (len(rows) - ones) // ones)]
    order = np.repeat(np.arange(len(rows)), [times[y] for *_, y in rows])
    epochs = max(epochs, -(-MIN_STEPS // len(order)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(order):
            at, share, y = rows[k]
            hidden = share @ vectors[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            vectors[at] -= (step * share)[:, None] * (out @ p)
            out -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_where: Column, max_per_class: int = MAX_PER_CLASS, bits: int = BITS) -> Model:
    """docs (doc_id, text), labels (doc_id, quality); train_where is over doc_id. Labels other than 0 and 1 are ignored."""
    usable = labels.where(train_where & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.where("quality = 0").orderBy(*order).limit(max_per_class).union(usable.where("quality = 1").orderBy(*order).limit(max_per_class))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, share = [], []
            for text in batch.column("text").to_pylist():
                total = counted(text, bits)
                i = np.flatnonzero(total)
                i = i if len(i) <= MAX_FEATURES else np.sort(i[np.argsort(-total[i], kind="stable")[:MAX_FEATURES]])
                at.append(i.astype(np.int32).tobytes())
                share.append((total[i] / max(total.sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["doc_id", "quality", "at", "share"])

    # at most 2 * max_per_class rows, so the broadcast is bounded
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    rows = sample.mapInArrow(count, "doc_id long, quality int, at binary, share binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.at), bytes(r.share)))
    return fit([(np.frombuffer(r.at, np.int32), np.frombuffer(r.share, np.float32), r.quality) for r in rows], bits)


def score_texts(texts: list[str | None], model: Model, known: Words) -> list[float]:
    """known remembers words; it gets those that it lacks."""
    split = [(t or "").split() for t in texts]
    known.learn(split)
    scores = []
    for words in split:
        at = known.places(words)
        total = known.total[at].sum() + model.weights[known.pairs(at)].sum()
        n = known.number[at].sum() + max(len(words) - 1, 0)
        scores.append(float(1 / (1 + np.exp(-np.clip(total / n + model.bias if n else model.bias, -500, 500)))))
    return scores


def classify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score (0 to 1, higher: class 1 likelier).

    Null and blank texts have no features; the bias alone scores them. Whole texts are read. Other columns stay;
    an earlier column named quality_score is replaced.
    """
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("quality_score")
    schema = docs.selectExpr("*", "0D AS quality_score").schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(len(shared.value.weights).bit_length() - 1, shared.value.weights)
        for batch in slices(batches, limit=1 << 19):
            found = score_texts(batch.column("text").to_pylist(), shared.value, known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(score, schema)


def in_training(doc_id: Column) -> Column:
    """The rows that the production model learns from: crc32 of the id modulo 3 isn't 1."""
    return crc_mod(doc_id, 3) != 1
