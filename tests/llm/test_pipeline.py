"""The pipeline's stages on the smallest tables: columns, decisions, agreement with the operators."""

import hashlib
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom import lineage
from graphloom.llm import jaccard, langid, mixing, quality
from graphloom.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows.append(docs.count())
    assert rows[1] < rows[0] and rows[2] <= rows[1] and rows[3] < rows[2]
    packed = docs.groupBy("sequence_id").sum("length").collect()
    assert all(n == 4096 or n & (n - 1) == 0 for _, n in packed)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def poisson_copies(rate, source, key):
    pieces = max(1, math.ceil(rate / mixing.MAX_PIECE_RATE))
    copies = 0
    for j in range(pieces):
        u = int(hashlib.md5(f"{mixing.SEED}|{source}|{key}|{j}".encode()).hexdigest()[:13], 16) / 2**52
        k, term, total = 0, math.exp(-rate / pieces), 0.0
        while (total := total + term) <= u:
            k += 1
            term *= rate / pieces / k
        copies += k
    return copies


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_against_plain_python(spark):
    """All stages in plain Python, with the learned models' weights: the same documents, as often, with all their ids."""
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    q = quality.train(spark, docs, labels, quality.in_training(F.col("doc_id")))
    lang = langid.train(docs, langid.in_training(F.col("doc_id")))
    rows = sorted((r.doc_id, r.text or "", r.source or "") for r in docs.collect())

    def quality_of(text):
        n = quality.counted(text)
        return 1 / (1 + math.exp(-((n @ q.weights / n.sum() if n.sum() else 0) + q.bias)))

    rows = [r for r in rows if quality_of(r[1]) >= 0.5]
    rows = [r for r in rows if (x := langid.predict(r[1], lang))[0] != "und" and x[1] >= 0.5]
    sets, root = [shingle_set(t) for _, t, _ in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    sizes = Counter(s for *_, s in rows)
    plain, want = Tokenizer.from_file(default_path()), Counter()
    for key, text, source in rows:
        copies = poisson_copies(len(rows) / len(sizes) / sizes[source], source, key)
        if copies:
            want[key] = copies * (len(plain.encode(text, add_special_tokens=False).ids) + 1)
    begun = len(lineage.made())
    got, pieces = Counter(), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
        pieces[r.sequence_id] += r.length
    assert got == want and all(n == 4096 or n & (n - 1) == 0 for n in pieces.values())
    assert len(lineage.made(begun)) == 1  # only what the last stage reads is still there


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_copies_are_dropped(spark, rounds):
    rng, rows = random.Random(8), []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(900)}" for _ in range(rng.randrange(4, 200))]
        for _ in range(10):  # edits that leave similarities on both sides of 0.8
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words + ["a line that all of them have in common"])))
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in jaccard.keep_one(spark, df, rounds=rounds).collect()}
    assert kept == set(root) and len(kept) < len(rows) / 2
    if rounds == 2:
        assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()} == kept
