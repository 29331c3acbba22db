"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket come from all labelled texts: each task counts into one matrix and hands over its cells,
which are summed before and after the shuffle. The matrix of log probabilities (buckets x languages, both bounded) is
broadcast; texts are scored in numpy, by the cells that they touch. Languages beyond MAX_LANGUAGES have matrices of their own,
that many each, by which the texts go one after another; the best and the sum of probabilities go along from each to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut_lineage, slices

BITS, ORDERS = 15, (1, 2, 3)
SMOOTH = 0.5
#: Bound of a broadcast matrix: so many languages at most.
MAX_LANGUAGES = 512
UNKNOWN = "und"
CHUNK = 1 << 20
LETTER = regex.compile(r"\p{L}")
#: Odd multipliers of the n-gram hash.
FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str, bits: int = BITS) -> np.ndarray:
    """Bucket counts of the lower-cased text's n-grams; runs of other characters than letters count as one space."""
    total = np.zeros(1 << bits, np.int64)
    is_letter, before = letters(), np.empty(0, np.uint32)  # before: the end of the chunk before, whose n-grams reach into the next
    for at in range(0, max(len(text), 1), CHUNK):
        part = text[at : at + CHUNK].lower().replace("ς", "σ")  # the two forms depend on what follows
        part = f"{'' if at else ' '}{part}{' ' if at + CHUNK >= len(text) else ''}"
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate((before, np.where(is_letter[c], c, np.uint32(32))))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        for n in ORDERS:
            first = max(0, len(before) - n + 1)  # those that end in the part before are counted already
            if len(c) >= first + n:
                h = np.full(len(c) - first - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h ^ c[first + k : len(c) - n + 1 + k]) * FACTORS[k]
                    h ^= h >> np.uint32(15)
                total += np.bincount((h * FACTORS[3]) >> np.uint32(32 - bits), minlength=1 << bits)
        before = c[-(max(ORDERS) - 1) :]
    return total


@dataclass
class Model:
    """The languages of one matrix, in order; more() gives the next one's model, or None."""

    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray
    more: Callable[[], Model | None] = lambda: None


def train(docs: DataFrame, train_where: Column, bits: int = BITS) -> Model:
    """Counts n-grams of all rows with train_where, a text with a letter, and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if LETTER.search(text):
                    by[lang] = by.get(lang, 0) + ngrams(text, bits)
                    texts[lang] = texts.get(lang, 0) + 1
        for lang, total in by.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts[lang]))], ["lang", "bucket", "n"])

    labelled = docs.where(train_where & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    cells = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = cut_lineage(docs.sparkSession, cells, "language-counts")
    return matrix(cells, cells.where("bucket < 0").agg(F.sum("n")).first()[0] or 0, None, bits) or Model([], np.zeros((1 << bits, 0)), np.zeros(0))


def matrix(cells: DataFrame, texts_of_all: int, after: str | None, bits: int) -> Model | None:
    """The model of the first languages, at most MAX_LANGUAGES, after one."""
    texts_by = cells.where("bucket < 0").select("lang", "n")
    named = (texts_by if after is None else texts_by.where(F.col("lang") > after)).orderBy("lang").limit(MAX_LANGUAGES).collect()
    if not named:
        return None
    languages = [r.lang for r in named]
    place = {x: i for i, x in enumerate(languages)}
    table = cells.where((F.col("bucket") >= 0) & F.col("lang").between(languages[0], languages[-1])).toArrow()
    counts = np.full((1 << bits, len(languages)), SMOOTH)
    counts[table["bucket"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] += table["n"].to_numpy()
    more = (lambda: matrix(cells, texts_of_all, languages[-1], bits)) if len(languages) == MAX_LANGUAGES else (lambda: None)
    return Model(languages, np.log(counts / counts.sum(axis=0, keepdims=True)), np.log(np.array([r.n for r in named]) / texts_of_all), more)


#: The best language so far, its log probability, and the sum of all languages' probabilities as shares of its own.
Found = tuple[str, float, float]
NOTHING: Found = (UNKNOWN, float("-inf"), 0.0)


def scored(text: str | None, languages: list[str], log_prob: np.ndarray, log_prior: np.ndarray, before: Found = NOTHING) -> Found:
    if not text or not languages or not LETTER.search(text):
        return before
    counts = ngrams(text, int(np.log2(len(log_prob))))
    at = np.flatnonzero(counts)
    score = log_prior + counts[at] @ log_prob[at]
    best = int(np.argmax(score))
    own = (languages[best], float(score[best]), float(np.exp(score - score[best]).sum()))
    first, second = (own, before) if own[1] > before[1] else (before, own)  # ties: the alphabetically first, which came before
    return first[0], first[1], first[2] + second[2] * float(np.exp(second[1] - first[1]))


def predict(text: str | None, model: Model) -> tuple[str, float]:
    """The language of a text and its posterior probability."""
    found, part = NOTHING, model
    while part is not None:
        found, part = scored(text, part.languages, part.log_prob, part.log_prior, found), part.more()
    return found[0], 1 / found[2] if found[2] else 0.0


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score (the predicted language's posterior probability).

    Null texts, texts without a letter, and all texts if nothing was learned: 'und', score 0. Ties go to the
    alphabetically first language. Very long texts are counted in chunks, with the same result. Other columns stay; earlier columns named
    lang_pred or lang_score are replaced.
    """
    docs, plain = docs.drop("lang_pred", "lang_score"), docs.drop("lang_pred", "lang_score").columns
    part, begun, total = model, False, "lang_sum"
    while total in plain:
        total += "_"
    while part is not None:
        further = part.more()
        docs = _pass(spark, docs, part, begun, further is None, total)
        part, begun = further, True
        if part is not None:
            docs = cut_lineage(spark, docs, "languages")
    return docs.select(*plain, "lang_pred", "lang_score")


def _pass(spark: SparkSession, docs: DataFrame, part: Model, begun: bool, ends: bool, total: str) -> DataFrame:
    """docs with lang_pred, lang_score and the sum (total) as found by now; at the end, lang_score is the probability."""
    shared = spark.sparkContext.broadcast((part.languages, part.log_prob, part.log_prior))
    names = docs.columns[:-3] if begun else docs.columns
    more = ["lang_pred", "lang_score"] + ([] if ends else [total])
    schema = docs.select(*names).selectExpr("*", "'' AS lang_pred", "0D AS lang_score", *([] if ends else [f"0D AS {total}"])).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            before = zip(*(batch.column(c).to_pylist() for c in ("lang_pred", "lang_score", total))) if begun else [NOTHING] * batch.num_rows
            found = [scored(t, *shared.value, b) for t, b in zip(batch.column("text").to_pylist(), before)]
            number = [x[1] if not ends else 1 / x[2] if x[2] else 0.0 for x in found]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array(number, pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns[: len(more)]], [*names, *more])

    return docs.mapInArrow(score, schema)


def in_training(doc_id: Column) -> Column:
    """The rows that the production model learns from: crc32 of the id modulo 4 isn't 2."""
    return crc_mod(doc_id, 4) != 2
