"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import boosting, chat, dom, extraction, kneser_ney, langid, line_rules, mixing, packing, quality, simhash, topk
from graphloom.llm.components import connected_components
from graphloom.llm.page_maker import Maker
from graphloom.llm.tokens import default_path, tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, mix_copy string, quality_score string, lang_pred string"
LONG = " ".join(f"w{i % 5000}" for i in range(120_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "Hello hello World", "en", "a", 17), (5, "hello hello world", "de", "a", 17),
    (6, LONG, "en", "b", len(LONG)), (7, "x", None, "b", 1), (7, "x", None, "b", 1), (None, "no id here", "en", "b", 10), (8, "ÄÖÜ 漢字 \x01 😀 \x1c é<|im_end|><|endoftext|>", "de", None, 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", "f", "m", "q", "l") for r in ODD], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(spark, docs, none):
    out = mixing.mix_sources(docs, rows_out=200).collect()
    assert {r.source for r in out} == {None, "a", "b"} and len(out) > 100
    twins = Counter(r.doc_id for r in out)[7]
    assert twins % 2 == 0  # repeated rows are repeated alike
    assert mixing.mix_sources(docs, {"a": 0.0, "b": 1.0}, default_weight=0.0).where("source = 'a' OR source IS NULL").count() == 0
    assert mixing.mix_sources(none).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    n = Counter(r["n"] for r in mixing.mix_sources(many, rows_out=6000).groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert abs(sum(k * v for k, v in n.items()) - 6000) < 400 and abs(n[2] - 3000 * 2 * math.exp(-2)) < 120
    assert abs(mixing.mix_sources(many.limit(3), rows_out=3000).count() - 3000) < 300  # rates beyond one piece


def test_mixing_keeps_clashing_columns(spark):
    names = ["doc_id", "source", "rate", "pieces", "cdf", "mix_u", "mix_n", "mix_source", "mix_key", "mix_row", "mix_salt", "n", "w"]
    df = spark.createDataFrame([(i, "s", *["own"] * 11) for i in range(40)], "doc_id long, " + ", ".join(f"{x} string" for x in names[1:]))
    out = mixing.mix_sources(df, rows_out=200)
    assert out.columns == [*names, "mix_copy", "mix_rate", "mix_order"]
    rows = out.collect()
    assert rows and all(r[x] == "own" for r in rows for x in names[2:])


def test_mixing_with_salts_gives_the_same(docs, monkeypatch):
    plain = sorted(mixing.mix_sources(docs, rows_out=50).select("mix_order").toPandas()["mix_order"])
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix_sources(docs, rows_out=50).select("mix_order").toPandas()["mix_order"]) == plain


def brute_base(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {p for i, w in enumerate(windows) if many[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_line_rules(spark, docs, none):
    rows = line_rules.apply_line_rules(docs).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t, *_ in ODD if i == r.doc_id)
        assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(text)
    assert line_rules.apply_line_rules(none).count() == 0
    letters = "abcdefghijklmnopqrstuvwxyz"

    class own:  # a line of 30 words that is only one document's; digits wouldn't tell lines apart
        format = staticmethod(lambda d: " ".join(letters[d // 26 % 26] + letters[d % 26] + letters[i % 26] + letters[i // 26] for i in range(30)))

    shared = " ".join(f"s{letters[i % 26]}{letters[i // 26]}" for i in range(40))
    rows = [(i, own.format(i) + ("\n" + shared if i < 30 else ""), None, "h", 0) for i in range(60)] + [(100 + i, own.format(100 + i) + "\n" + shared, None, "other", 0) for i in range(5)] + [(200 + i, own.format(200), None, "h", 0) for i in range(25)]
    df = spark.createDataFrame([(*r, "", "", "", "", "") for r in rows], DOCS)
    out = {r.doc_id: r for r in line_rules.apply_line_rules(df, min_left=0.9).collect()}
    assert all(out[i].n_lines_removed == (i < 30) and out[i].kept == (i >= 30) for i in range(60))
    assert all(out[i].kept for i in (100, 104, 200, 224))  # below the limit on their host; exact copies count once
    cleaned = {r.doc_id: r.text for r in line_rules.remove_frequent_lines(df).collect()}
    assert cleaned[3] == own.format(3) and cleaned[40] == own.format(40) and cleaned[100].endswith(shared)


def brute_fp(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_groups(spark, docs, none):
    rows = simhash.near_duplicates(spark, docs).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t, *_ in ODD if i == r.doc_id)
        if text is not LONG:
            assert r.fp % 2**64 == brute_fp(text)
    of = {r.doc_id: r.component_id for r in rows}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == 4 and of[7] == 7 and of[None] is None
    kept = simhash.keep_one(spark, docs).collect()
    assert sorted((r.doc_id for r in kept), key=lambda x: (x is None, x)) == [1, 4, 6, 7, 8, None] and kept[0].asDict().keys() == dict(docs.dtypes).keys()
    assert simhash.near_duplicates(spark, none).count() == 0 and simhash.keep_one(spark, none).count() == 0


@pytest.mark.parametrize("large", [2, 1000])
def test_links_are_all_found(spark, large):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    core = int(base[0])
    fps |= {core ^ (1 << b) ^ (1 << c) for b in range(8) for c in range(8, 14)}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in simhash.links(spark, spark.createDataFrame([(x,) for x in signed], "fp long"), large_key=large).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30)) and got[201] == 200
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, length=64).collect()
    tok = tokenizer(default_path())
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, text, *_ in ODD:
        ids = np.append(np.array(tok.whole.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4")
        pieces = by[i, len(ids)]
        want = sorted((r.start, zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in pieces)
        assert sorted((r.start, r.ids_crc32) for r in pieces) == want
        assert sum(r.length for r in pieces) == len(ids) * (2 if i == 7 else 1)
    used = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert all(n == 64 or n & (n - 1) == 0 for n in used.values())
    assert packing.pack(none).count() == 0


def test_ids_are_those_of_an_unaltered_tokenizer():
    from tokenizers import Tokenizer

    plain, tok, rng = Tokenizer.from_file(default_path()), tokenizer(default_path()), random.Random(3)
    pieces = ["hello ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "it's", " 12é", "Σ", "ΣΑΣ", "ſ", "K", "İ", "\ua7dc", "\u1c89", "\U00010d50", "\u2028", "\x85", "\x1c", "\x01", "e\u0301", "漢字", "😀", "\u0378", "\U0002ebf0", "\u0cf3", "½", "٣", "\n\t", "\ufeff", "\u200b"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(8)) for _ in range(3000)]
    for t in texts:
        assert tok.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_sum_of_squares_choice():
    rng, out = np.random.default_rng(1), []
    p = packing.Packer(lambda pieces: out.append(sum(len(x[3]) for x in pieces)), 16)
    for k in range(400):
        size = int(rng.integers(1, 16))
        n = p.level.copy()
        costs = {}
        for h in range(0, 17 - size):
            if h == 0 or n[h]:
                m = n.copy()
                m[h] -= h > 0
                m[h + size] += h + size < 16
                costs[h] = int((m**2).sum())
        p.place((k, size, 0, np.zeros(size, "<u4")))
        assert int((p.level**2).sum()) == min(costs.values())
    held, before = {fill: [[x[0] for x in pieces] for pieces in found] for fill, found in p.open.items()}, len(out)
    closed = []
    p.done = lambda pieces: closed.append(pieces)
    p.close()
    assert all(x & (x - 1) == 0 for x in out[:before] + [sum(len(x[3]) for x in pieces) for pieces in closed])
    # each open sequence is cut by itself: what was together stays together, in order
    assert sum(map(len, closed)) >= sum(map(len, (k for found in held.values() for k in found)))
    assert sorted(sum(len(x[3]) for x in pieces) for pieces in closed) == sorted(1 << b for fill, found in held.items() for _ in found for b in range(5) if fill >> b & 1)


def test_packed_in_one_task_little_is_left_open():
    """How much of a stream the method's choices decide: what closes full, as against what is cut at the end."""
    rng, full, rest = np.random.default_rng(2), [0], [0]
    p = packing.Packer(lambda pieces: full.__setitem__(0, full[0] + sum(len(x[3]) for x in pieces)))
    for k in range(20_000):
        p.add(k, np.zeros(int(rng.lognormal(5.5, 1.2)) + 1, "<u4"))
    p.done = lambda pieces: rest.__setitem__(0, rest[0] + sum(len(x[3]) for x in pieces))
    p.close()
    assert rest[0] < 0.05 * full[0]


def brute_discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] and n[k] else 0.75
        out.append(d if 0 < d <= k else 0.75)
    return out


class BruteKneserNey:
    """The same model in dictionaries: raw counts of trigrams, numbers of different words before below them."""

    def __init__(self, texts):
        self.words, self.tri = Counter(), Counter()
        for t in texts:
            w = [*(t or "").encode().lower().split(), None]
            self.words.update(w)
            self.tri.update(zip(["<", "<", *w], ["<", *w], w))
        self.pair, self.word = Counter((v, w) for _, v, w in self.tri), Counter()
        self.word.update(w for _, w in self.pair)
        self.d = [brute_discounts(c.values()) for c in (self.word, self.pair, self.tri)]
        self.after_pair, self.after_word = {}, {}
        for (u, v, w), n in self.tri.items():
            self.after_pair.setdefault((u, v), []).append(n)
        for (v, w), n in self.pair.items():
            self.after_word.setdefault(v, []).append(n)

    def step(self, n, d, after, lower):
        if not after:
            return lower
        return (max(n - d[min(n, 3)], 0) + sum(d[min(c, 3)] for c in after) * lower) / sum(after)

    def p(self, u, v, w):
        one = self.step(self.word[w], self.d[0], list(self.word.values()), 1 / (len(self.words) + 1))
        two = self.step(self.pair[v, w], self.d[1], self.after_word.get(v), one)
        return self.step(self.tri[u, v, w], self.d[2], self.after_pair.get((u, v)), two)

    def score(self, text):
        w = [*(text or "").encode().lower().split(), None]
        total, v = sum(self.words.values()), len(self.words)
        base = sum(math.log10((self.words[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w)
        return len(w), sum(self.words[x] > 0 for x in w), total, base, sum(math.log10(self.p(*x)) for x in zip(["<", "<", *w], ["<", *w], w))


@pytest.mark.parametrize("range_bytes, sections", [(16 << 20, 1 << 12), (64, 4), (64, 1)])
def test_kneser_ney_against_dictionaries(spark, monkeypatch, range_bytes, sections):
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(kneser_ney, "MAX_SECTIONS", sections)
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 40) for _ in range(120)] + ["a b c " * 400, None, "", "Only Once", "only once"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    learned = F.col("doc_id") % 4 != 0
    model = kneser_ney.train(spark, df, learned)
    want = BruteKneserNey([t for i, t in enumerate(texts) if i % 4])
    for r in kneser_ney.score(df, model).collect():
        n, known, total, base, score = want.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    words = [w for w in want.words if w is not None]
    ids = np.array([kneser_ney.hashes(w.decode())[0] for w in words] + [int(kneser_ney.END), 12345], np.uint64)
    for text in ("w1 w2", "never seen", "w3 unseen"):  # over all words and one unknown one, probabilities add up to one
        pre = kneser_ney.hashes(text)[:2]
        tokens = np.column_stack([np.tile(pre, (len(ids), 1)), ids]).ravel()
        assert kneser_ney.probabilities(model, tokens, np.arange(0, len(tokens), 3))[1][2::3].sum() == pytest.approx(1, abs=1e-9)


def test_kneser_ney(spark, docs, none):
    model = kneser_ney.train(spark, docs, F.coalesce(F.col("doc_id"), F.lit(0)) != 5)
    rows = {(r.doc_id, r.n_tokens): r for r in kneser_ney.score(docs, model).collect()}
    assert len(rows) == len(ODD) - 1 and rows[1, 1].n_known == 1 and rows[5, 4].n_known == 4
    empty = kneser_ney.train(spark, none, F.lit(True))
    assert kneser_ney.score(none, empty).count() == 0
    assert all(r.score == 0 and r.n_known == 0 for r in kneser_ney.score(docs, empty).collect())


def test_counts_have_64_bits():
    n = np.array([1, 254, 255, 2**40], np.uint64)
    file = {"begin": np.array([0, 3]), "w": np.array([5, 6, 7, 5]), **kneser_ney.small(n)}
    assert kneser_ney.count_of(file, np.array([0, 0, 0, 1, 1]), np.array([5, 7, 8, 5, 7])).tolist() == [1, 255, 0, 2**40, 0]
    a, b = kneser_ney.expand(kneser_ney.squeeze(n, n[::-1]), 2)
    assert a.tolist() == n.tolist() and b.tolist() == n[::-1].tolist()


def test_extraction(spark):
    model = extraction.learned(120)
    assert boosting.fit(np.zeros((5, 2)), np.ones(5), trees=2).log_odds(np.zeros((1, 2)))[0] > 0
    page = "<html><head><title>t</title><script>x='<p>'</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav><article><h1>A   title</h1><p>One &amp; two, <b>bold</b>\n words here.<p>More text follows, with a comma.</article><footer>&copy; me</footer></body>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (3, "u", ""), (4, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "u", "<p title='>" + "x" * 200_000)]
    out = {r.page_id: r.text for r in extraction.extract(spark, spark.createDataFrame(rows, "page_id long, text string, html string"), model).collect()}
    assert out[1] == "A title\nOne & two, bold words here.\nMore text follows, with a comma." and out[2] == out[3] == ""
    assert extraction.extract(spark, spark.createDataFrame([], "page_id long, html string"), model).count() == 0
    maker, wrong = Maker(77), 0
    for _ in range(40):
        nodes, y = extraction.labelled(maker.page())
        kept = extraction.decode(nodes, model.log_odds([nodes]))
        assert all(kept[n.parent] for n, k in zip(nodes, kept) if k and n.parent >= 0)  # no kept element in a dropped one
        wrong += extraction.main_text(nodes, kept) != extraction.main_text(nodes, y > 0)
    assert wrong <= 8


def test_extraction_of_pages_whose_names_were_never_seen():
    model, maker, right, all_of = extraction.learned(400), Maker(78, strange=1.0), 0, 0
    for _ in range(60):
        nodes, y = extraction.labelled(maker.page())
        kept = extraction.decode(nodes, model.log_odds([nodes]))
        for x, a, b in zip(nodes, kept, y > 0):
            size = sum(len(text) for _, text in x.runs)
            right, all_of = right + 2 * size * (a and b), all_of + size * (int(a) + int(b))
    assert right > 0.9 * all_of


def test_weights_of_attribute_words():
    def page(*words):
        return [dom.Node("root", -1, 0, []), *(dom.Node("div", 0, 1, [w]) for w in words)]

    good, bad = extraction.bucket("good"), extraction.bucket("bad")
    w = extraction.token_weights([(page("good", "bad", "both", "both"), np.array([1, 1, 0, 1, 0]))] * 50)
    assert w[good] > 1 and w[bad] < -1 and abs(w[extraction.bucket("both")]) < 0.5
    # by hand: 3/5 of 250 elements hold text, and each of "good"'s 50
    share, held = 0.6, extraction.HELD_BACK
    assert np.isclose(w[good], np.log((50 + held * share) / (held * (1 - share))) - np.log(share / (1 - share)))
    assert (np.delete(w, [good, bad, extraction.bucket("both")]) == 0).sum() == extraction.HASHED - 3  # never seen: nothing
    assert not extraction.token_weights([]).any()


def test_a_head_ends_without_its_end_tag():
    for page in ("<html><head><title>t</title><meta name=a><body><p>text", "<head><title>t</title><script>x</script><p>text", "<head><link rel=a><b>text</b>", "<head></head><body>text"):
        nodes = dom.parse(page)
        assert extraction.main_text(nodes, np.ones(len(nodes), bool)) == "text", page


def test_text_after_a_block_stays_after_it():
    for page, want in (("<div>intro<p>A</p>tail</div>", "intro A tail"), ("<div>a<section>b<p>c</p>d</section>e<p>f</p>g</div>h", "a b c d e f g h")):
        nodes = dom.parse(page)
        assert extraction.main_text(nodes, np.ones(len(nodes), bool)).split() == want.split()


def test_hidden_links_do_not_count():
    nodes = dom.parse("<div hidden><a>x</a><a>y</a></div><div><a>link</a> plain text</div><p>more")
    assert [(n.tag, n.links) for n in nodes] == [("root", 0), ("div", 4), ("p", 0)]


def test_parsing_is_linear():
    began = time.process_time()
    dom.parse("<div>" * 60_000 + "</section>" * 60_000 + "<p><b>" * 60_000 + "</b>" * 60_000)
    assert time.process_time() - began < 20


def test_a_row_closes_the_cell_and_the_row():
    nodes = dom.parse("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table><td>e</table>")
    assert [(n.tag, n.depth) for n in nodes[1:]] == [("table", 1), ("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("td", 3), ("table", 4), ("tr", 5), ("td", 6), ("td", 3)]


def test_language_ngrams_in_chunks(monkeypatch):
    text = "Ab cd! ef  12 ΟΔΟΣ ΣΑΣ x" * 3
    whole = langid.ngrams(text)
    for chunk in (1, 2, 3, 7, 30):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert (langid.ngrams(text) == whole).all(), chunk


def test_language_id_against_dictionaries(spark):
    rng = np.random.default_rng(2)
    sets = {"aa": "abcde ", "bb": "cdefg ", "cc": "xyzab "}
    rows = [(i, "".join(rng.choice(list(sets[lang]), 30)), lang) for i, lang in enumerate(list(sets) * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 45)
    grams = lambda t: [tuple(np.flatnonzero(langid.ngrams(t)).tolist()), langid.ngrams(t)]  # noqa: E731  hashed as the operator hashes
    counts = {lang: sum(langid.ngrams(t) for i, t, x in rows if x == lang and i < 45) + langid.SMOOTH for lang in sets}
    for i, t, _ in rows[45:]:
        n = grams(t)[1]
        logs = {lang: math.log(1 / 3) + sum(float(n[k]) * math.log(c[k] / c.sum()) for k in np.flatnonzero(n)) for lang, c in counts.items()}
        best = max(logs, key=logs.get)
        name, p = langid.predict(t, model)
        assert name == best and p == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel=1e-9)


def test_more_languages_than_a_matrix_holds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    names = [f"l{i}" for i in range(7)]
    sets = {x: "".join(rng.choice(list("abcdefghijklmnop"), 5)) + " " for x in names}
    rows = [(i, "".join(rng.choice(list(sets[names[i % 7]]), 25)), names[i % 7]) for i in range(70)] + [(99, None, "l1"), (98, "12", "l2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(spark, df, langid.train(df, F.col("doc_id") < 50)).collect()}
    for most in (3, 7):
        monkeypatch.setattr(langid, "MAX_LANGUAGES", most)
        model = langid.train(df, F.col("doc_id") < 50)
        out = langid.identify(spark, df.withColumn("lang_sum", F.lit("own")), model)
        assert out.columns == ["doc_id", "text", "lang", "lang_sum", "lang_pred", "lang_score"]
        for r in out.collect():
            assert r.lang_pred == one[r.doc_id][0] and r.lang_score == pytest.approx(one[r.doc_id][1], rel=1e-9) and r.lang_sum == "own"
            if r.doc_id in (3, 60):
                assert langid.predict(r.text, model) == (r.lang_pred, pytest.approx(r.lang_score, rel=1e-9))


def test_language_id(spark, docs, none):
    train = spark.createDataFrame([(i, t, lang, "s", 0, "", "", "", "", "") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)] + [(99, None, "xx", "s", 0, "", "", "", "", ""), (98, "12 34", "yy", "s", 0, "", "", "", "", "")], DOCS)
    model = langid.train(train, F.lit(True))
    assert model.languages == ["de", "en"]
    out = {r.doc_id: r for r in langid.identify(spark, docs, model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[6].lang_pred in ("de", "en") and all(0 <= r.lang_score <= 1 for r in out.values())
    assert langid.predict("the dog", model)[0] == "en" and langid.predict("die katze", model)[0] == "de"
    assert langid.identify(spark, none, langid.train(none, F.lit(True))).count() == 0


def test_quality(spark, docs, none):
    good, bad = "some plain words in a calm row here", "BUY!! NOW!! $$$ ### CHEAP!!"
    texts = spark.createDataFrame([(i, good if i % 2 else bad, None, None, 0, "", "", "", "", "") for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(60)] + [(3, None, ""), (4, 7, ""), (None, 1, "")], "doc_id long, quality int, text string")
    model = quality.train(spark, texts, labels, quality.in_training(F.col("doc_id")))
    held = quality.classify(spark, texts, model).where(~quality.in_training(F.col("doc_id"))).collect()
    assert held and all((r.quality_score >= 0.5) == (r.doc_id % 2 == 1) for r in held)
    out = quality.classify(spark, docs, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.quality_score <= 1 for r in out)
    assert len({r.quality_score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert quality.classify(spark, none, quality.train(spark, none, labels, F.lit(True))).count() == 0
    assert quality.fit([(np.array([1]), np.array([1.0]), 1)]).bias > 0
    for text in ("some calm calm BUY!! words", "row", ""):  # the mean of all features' weights, counted one by one, through the softmax
        n = quality.counted(text)
        words = text.split()
        assert n.sum() == sum(len(quality.features([w])[0]) for w in words) + max(len(words) - 1, 0)
        z = (n @ model.weights / n.sum() if n.sum() else 0) + model.bias
        assert quality.score_texts([text], model, quality.Words(quality.BITS, model.weights))[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_repeated_words_have_no_bucket_in_common():
    words = [f"w{i}" for i in range(400)]
    buckets = set()
    for w in words:
        seen = quality.Words(quality.BITS)
        seen.learn([[w, w]])
        buckets.add(int(seen.pairs(seen.places([w, w]))[0]))
    assert len(buckets) > 380
    seen = quality.Words(quality.BITS)
    seen.learn([["a", "b"]])
    assert seen.pairs(seen.places(["a", "b"]))[0] != seen.pairs(seen.places(["b", "a"]))[0]


def test_training_against_plain_python():
    """Two steps of gradient descent on softmax over the mean vector, written out."""
    rows = [(np.array([1, 5]), np.array([0.25, 0.75]), 1), (np.array([5, 6]), np.array([0.5, 0.5]), 0)]
    own = quality.fit(rows, bits=3, size=2, epochs=1, rate=0.5)
    rng = np.random.default_rng(quality.SEED)
    v = rng.uniform(-0.5, 0.5, (8, 2)).tolist()
    out, bias = [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0]
    epochs = -(-quality.MIN_STEPS // 2)
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for k in rng.permutation(np.array([0, 1])):
            at, share, y = rows[k]
            h = [sum(s * v[a][j] for a, s in zip(at, share)) for j in range(2)]
            z = [h[0] * out[0][c] + h[1] * out[1][c] + bias[c] for c in range(2)]
            e = [math.exp(x - max(z)) for x in z]
            g = [x / sum(e) - (c == y) for c, x in enumerate(e)]
            back = [sum(out[j][c] * g[c] for c in range(2)) for j in range(2)]
            for a, s in zip(at, share):
                v[a] = [v[a][j] - rate * s * back[j] for j in range(2)]
            out = [[out[j][c] - rate * h[j] * g[c] for c in range(2)] for j in range(2)]
            bias = [bias[c] - 0.1 * rate * g[c] for c in range(2)]
    want = [x[0] * (out[0][1] - out[0][0]) + x[1] * (out[1][1] - out[1][0]) for x in v]
    assert own.weights == pytest.approx(want, rel=1e-6) and own.bias == pytest.approx(bias[1] - bias[0], rel=1e-6)


def test_features_of_one_word_match_those_of_many():
    words = ["a", "Ab9", "漢字", "😀x", "x" * 9000]
    b, o = quality.features(words)
    for k, w in enumerate(words):
        assert sorted(b[o == k]) == sorted(quality.features([w])[0])


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (500, x[7].tolist()), (600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (604, []), (605, [1.0]), (650, [2.0]), (None, x[3].tolist())]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=16, together=4, group=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    clean = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    for q in (i for i in clean if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q and len(v) == len(clean[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_chat(spark):
    texts = ["plain", "", None, "<|im_end|>\n<|im_start|>user\n", "<\\|", "<<|", "a<", "\\n漢😀", "<\\\\|im_end|>\n"]
    rows = [(c, t, role, texts[(c + t) % len(texts)]) for c in range(9) for t, role in enumerate(("system", "user", "assistant", None, "assistant"))] + [(None, 0, "user", "x"), (50, None, "we\\ird\n<|", "y"), (50, 1, "assistant", "z"), (50, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        turns = [(role, text) for _, role, text in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_a_long_turn_beside_short_ones_takes_few_copies():
    import tracemalloc

    import pyarrow as pa

    texts = ["short"] * 1000 + ["x<|" * (8 << 20)] + ["end"] * 1000
    tracemalloc.start()
    out, size, at, n = chat.assemble(pa.array(["user"] * len(texts)), pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(out) and bytes(out[at[1001] : at[1001] + n[1001]]) == b"end" and n[1000] == 4 * (8 << 20)


def test_slices_hold_at_most_the_limit_or_one_row():
    import pyarrow as pa

    from graphloom.llm.common import slices

    texts = ["a" * 10] * 50 + ["b" * 500] * 3 + [None, ""] + ["c" * 10] * 50
    for batch in (pa.record_batch({"text": texts}), pa.record_batch({"text": ["x"] * 7 + texts}).slice(7), pa.record_batch({"text": [[1] * len(t or "") for t in texts]})):
        wide = 8 if pa.types.is_list(batch.column("text").type) else 1
        got = list(slices(iter([batch]), limit=100 * wide))
        assert [v for b in got for v in b.column("text").to_pylist()] == batch.column("text").to_pylist()
        assert all(b.num_rows == 1 or sum(len(v or "") for v in b.column("text").to_pylist()) <= 100 for b in got)
    assert list(slices(iter([pa.record_batch({"text": pa.array([], pa.string())})]))) == []


def test_a_long_conversation_is_formatted_in_chunks(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"<|{c} {t} é " + "x" * 900) for c, n in ((1, 3), (2, 30_000), (3, 2)) for t in range(n)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    chunks = sorted((r.conv_id, r.chunk, r.chunk_start, r.n_turns, r.n) for r in formatted.select("*", F.octet_length("formatted").alias("n")).collect())
    long = [r for r in chunks if r[0] == 2]
    assert [r[1] for r in long] == list(range(len(long))) and max(r[4] for r in long) < 12 << 20 and sum(r[3] for r in long) == 30_000
    assert all(b[2] == a[2] + a[4] for a, b in zip(long, long[1:]))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert len(got) == 3
    for c, r in got.items():
        turns = [(role, text) for conv, _, role, text in rows if conv == c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(f"<|im_start|>{role}\n<|im_end|>\n") + len(text) + 1 for role, text in turns)


def test_the_split_is_by_the_ids_text(spark):
    from graphloom.llm.common import crc_mod

    ids = [0, 7, -3, 10**15, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", *[crc_mod(F.col("doc_id"), n).alias(f"m{n}") for n in (3, 4, 10)]).collect()
    for r in rows:
        crc = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode())
        assert (r.m3, r.m4, r.m10) == (crc % 3, crc % 4, crc % 10)


def test_thresholds_of_a_first_cell_lose_nothing(spark):
    """Many cells, ties everywhere, and queries whose first cell has fewer than k candidates."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(400)] + [(1000 + i, [float(i)] * 3) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, together, group in ((3, 2, 3), (10, 5, 100), (128, 64, 5)):
        got = {}
        for r in topk.top_k(df, F.col("vec_id") % 10 == 0, scale=1, block=block, together=together, group=group).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q, v in rows:
            if q % 10 == 0:
                best = sorted((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q and len(w) == len(v))[:5]
                assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_a_lost_model_file_is_an_error(spark):
    import os

    docs = spark.createDataFrame([(i, f"some words w{i % 7} and others again") for i in range(40)], "doc_id long, text string")
    model = kneser_ney.train(spark, docs, F.lit(True))
    assert kneser_ney.score(docs, model).count() == 40 and {n.partition("-")[0] for n in model.names} == {"words", "pairs", "before", "sums"}
    os.remove(kneser_ney.local_path(model.url) + "/" + sorted(model.names)[-1])
    with pytest.raises(Exception, match="FileNotFoundError"):
        kneser_ney.score(docs, model).collect()
