"""Encoding and decoding by merge rounds, against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from graphloom.llm import pieces

PARTS = ["the", "Über", "naïve", "ing", " ", " ", "  ", "     ", "\n", "\n\n", "\t", "▁", "<s>", "</s>", "<0x41>", "<unk>", "漢字", "한국어", "😀", "\x00", "\r", "é", "é", "aaaa", "aaa", "====", "----", "0000", "http://", "x" * 30, "İ", "﻿", " ", "ab", "follow", "Foot", "fa", ">()", "bcbc", "reres"]


@pytest.fixture(scope="module")
def both():
    path = pieces.default_path()
    return pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def own(m, text, chunk=pieces.CHUNK):
    ids = np.frombuffer(b"".join(m.encode_parts(list(pieces.parts_of(text, chunk)))), "<u4")
    return [m.bos, *ids.tolist(), m.eos]


def made_up(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            yield "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30)))
        elif kind == 1:
            yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(0x100, 0x3000), rng.randrange(0x10000, 0x11000)])) for _ in range(rng.randrange(40)))
        elif kind == 2:
            yield "".join(rng.choice("abcdehinorst ") for _ in range(rng.randrange(200)))
        else:
            yield "".join(rng.choice("ab ") for _ in range(rng.randrange(60)))


def test_same_as_the_library(both):
    m, library = both
    texts = ["", " ", "   ", "\n", *PARTS, *made_up(3000, 1)]
    for text in texts:
        want = library.encode(text, add_bos=True, add_eos=True)
        assert own(m, text) == want, text
        assert m.decode(np.array(want)).decode() == library.decode(want), text
        assert own(m, text, 3) == want, text  # whatever the chunks


def test_all_words_of_a_batch_at_once(both):
    m, library = both
    texts = [t for t in made_up(2000, 2) if t]
    m.known.clear()
    data = m.encode_parts([" " + t.replace("▁", " ") for t in texts])
    assert [np.frombuffer(b, "<u4").tolist() for b in data] == [library.encode(t) for t in texts]


def test_long_words(both):
    m, library = both
    rng = random.Random(4)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz=-/0123456789") for _ in range(20_000)), "a" * 5000, " " * 3000, "漢" * 2000, "in" * 700, "the" * 171 + "é"):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert own(m, text) == want
    word = " " + "".join(rng.choice("aeinrst") for _ in range(pieces.LONG - 1))
    assert m.agenda(m.symbol[[ord(c) if c != " " else 0x2581 for c in word]]).tolist() == m.merge([word.replace(" ", pieces.SPACE)])[0].tolist()


def test_decoding_any_ids(both):
    m, library = both
    rng = random.Random(5)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(m.size), rng.randrange(3, 259), 0, 1, 2]) for _ in range(rng.randrange(12))]
        assert m.decode(np.array(ids, np.int64)).decode() == library.decode(ids), ids


def test_operator(spark, both, tmp_path):
    _, library = both
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, long, "x"), (None, "no id", "x"), (5, "twice", "x"), (5, "twice", "x"), (6, "x" * 40_000, "x"), *((100 + i, t, "x") for i, t in enumerate(made_up(200, 6)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = pieces.encode(docs, chunk=1000)
    assert encoded.where("doc_id = 4").count() > 300
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((key, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    for chunk in (1000, pieces.CHUNK):
        got = [tuple(r) for r in pieces.digests(pieces.decode(pieces.encode(docs, chunk=chunk))).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.digests(pieces.decode(pieces.encode(docs.limit(0)))).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(str(tmp_path / "other.model"))
