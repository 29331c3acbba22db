"""Encoding and decoding with a SentencePiece byte-pair model: vectorised merge rounds.

A text is cut where no piece of the vocabulary reaches across: before each space that follows another character, and at
newlines. Words that a worker doesn't remember are encoded together: their characters lie in one flat array of symbols;
in each round every word takes its smallest rank of a pair (a segmented minimum) and merges the pairs that have it, from the left,
all at once; merged symbols are compacted away, finished words put aside, until no pair remains. A piece that can become part of
a piece of smaller or equal rank is merged one at a time, as its next merge may come first. So the symbols are those of the
library's own agenda, which always takes the best pair of all, the leftmost of equal ones. Words beyond LONG symbols, on
which rounds would be quadratic, take their merges from such an agenda (a heap).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import slices

#: The space's stand-in in pieces, and what stands for an unknown piece and for a byte that is no UTF-8.
SPACE, UNKNOWN, REPLACED = "▁", " ⁇ ", "�"
WORD = re.compile(r" +[^ \n]*|\n|[^ \n]+")
CUT = re.compile(r"(?<=[^ ])(?= )|(?=\n)|(?<=\n)")
#: Symbols above which a word's merges come from a heap; words remembered at most, and how long these may be; characters encoded at once.
LONG, REMEMBERED, SHORT, CHUNK = 512, 200_000, 64, 1 << 19
NONE = np.iinfo(np.int32).max
SHIFT = 21  # a symbol is a piece's id, or the number of pieces and a code point
ENCODED = "doc_id long, chunk long, ids array<int>"


class PieceModel:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        kinds = [p.type for p in spec.pieces]
        P = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = norm.name == "identity" and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or not plain or not norm.add_dummy_prefix or {P.USER_DEFINED, P.UNUSED} & set(kinds):
            raise ValueError("only byte-pair models with identity normalisation, a prefixed space and byte fallback are known here")
        names = [p.piece for p in spec.pieces]
        normal = {n: i for i, n in enumerate(names) if kinds[i] == P.NORMAL}
        if any("\n" in n or SPACE in n.lstrip(SPACE) for n in normal):
            raise ValueError("a piece reaches across the places where texts are cut")
        self.size, self.bos, self.eos = len(names), self.library.bos_id(), self.library.eos_id()
        self.first_byte = names.index("<0x00>")
        if names[self.first_byte : self.first_byte + 256] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("the pieces of bytes must follow one another")
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for name, i in normal.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self._pairs(normal, [-p.score for p in spec.pieces])
        # decoding: each id's bytes
        shown = [n.replace(SPACE, " ").encode() if k == P.NORMAL else b"" for n, k in zip(names, kinds)]
        shown[self.first_byte : self.first_byte + 256] = [bytes([b]) for b in range(256)]
        if (unknown := self.library.unk_id()) >= 0:
            shown[unknown] = UNKNOWN.encode()
        self.control = np.array([k == P.CONTROL for k in kinds])
        self.spaced = np.array([k == P.NORMAL and n.startswith(SPACE) for n, k in zip(names, kinds)])
        self.data = np.frombuffer(b"".join(shown), np.uint8)
        self.length = np.array([len(b) for b in shown], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.known: dict[str, bytes] = {}

    def _pairs(self, normal: dict[str, int], cost: list[float]) -> None:
        """The table of pairs, by (left symbol, right symbol): rank and merged symbol. ranks are the order of scores; equal scores
        have one. safe: pieces after whose merge no better pair can be near."""
        values = sorted({cost[i] for i in normal.values()})
        rank_of = {c: r for r, c in enumerate(values)}
        count = np.zeros(len(values), np.int64)
        np.add.at(count, [rank_of[cost[i]] for n, i in normal.items() if len(n) > 1], 1)
        self.safe = np.ones(self.size + 0x110000, bool)
        keys, ranks, merged = [], [], []

        def symbol(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else normal.get(part)

        for name, i in normal.items():
            rank = rank_of[cost[i]]
            if len(name) > 1 and count[rank] > 1:
                self.safe[i] = False
            for k in range(1, len(name)):
                left, right = symbol(name[:k]), symbol(name[k:])
                if left is None or right is None:
                    continue
                keys.append(left << SHIFT | right)
                ranks.append(rank)
                merged.append(i)
                for part in (left, right):
                    if part < self.size and rank <= rank_of[cost[part]]:
                        self.safe[part] = False
        order = np.argsort(keys)
        self.key, self.rank, self.to = np.array(keys, np.int64)[order], np.array(ranks, np.int32)[order], np.array(merged, np.int64)[order]
        # a hash of keys says at once that most pairs aren't there
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B97F4A7C1) >> 40) & ((1 << 20) - 1)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NONE where they don't merge."""
        key = left << SHIFT | right
        rank, to = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int64)
        some = np.flatnonzero(self.maybe[self._slot(key)])
        at = np.searchsorted(self.key, key[some])
        at[at == len(self.key)] = 0
        there = self.key[at] == key[some]
        rank[some[there]], to[some[there]] = self.rank[at[there]], self.to[at[there]]
        return rank, to

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Each word's symbols when no pair remains."""
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        lens = np.array([len(w) for w in words], np.int64)
        out: list[np.ndarray] = [sym[:0]] * len(words)
        long = lens > LONG
        ends = np.cumsum(lens)
        for w in np.flatnonzero(long):
            out[w] = self.agenda(sym[ends[w] - lens[w] : ends[w]])
        sym, word, lens = sym[np.repeat(~long, lens)], np.flatnonzero(~long & (lens > 0)), lens[~long & (lens > 0)]
        rank, to = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self.look(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
        while len(word):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                for w, s, n in zip(word[done].tolist(), starts[done].tolist(), lens[done].tolist()):
                    out[w] = sym[s : s + n]
                going = np.repeat(~done, lens)
                sym, rank, to, word, low, lens = sym[going], rank[going], to[going], word[~done], low[~done], lens[~done]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(low, lens))
            # of pairs that overlap, the first, third ... of a run; a word's last symbol has no pair, so runs end with words
            i = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, i, 0))
            at = at[(i - run) % 2 == 0]
            of = np.searchsorted(np.cumsum(lens), at, side="right")
            take = self.safe[to[at]] | (np.diff(of, prepend=-1) != 0)
            at, of = at[take], of[take]
            sym[at] = to[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, rank, to = sym[stay], rank[stay], to[stay]
            lens = lens - np.bincount(of, minlength=len(lens))
            at = at - np.arange(len(at))
            last = np.zeros(len(sym), bool)
            last[np.cumsum(lens) - 1] = True
            new = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[new] = NONE
            new = new[~last[new]]
            rank[new], to[new] = self.look(sym[new], sym[new + 1])
        return out

    def agenda(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long word: the best pair of all first, from a heap of pairs."""
        n, sym = len(sym), sym.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, to = (x.tolist() for x in self.look(np.array(sym[:-1]), np.array(sym[1:])))
        heap = [(r, i, sym[i], sym[i + 1], t) for i, (r, t) in enumerate(zip(rank, to)) if r != NONE]
        heapq.heapify(heap)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, left, right, t = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue
            sym[i], sym[j] = t, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    pair = (sym[a], sym[b])
                    if pair not in found:
                        r, x = self.look(np.array([pair[0]]), np.array([pair[1]]))
                        found[pair] = (int(r[0]), int(x[0]))
                    if found[pair][0] != NONE:
                        heapq.heappush(heap, (found[pair][0], a, *pair, found[pair][1]))
        return np.array([s for s in sym if s >= 0], np.int64)

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit numbers; characters without a piece become their bytes'."""
        merged = self.merge(words)
        sym, lens = np.concatenate(merged), np.array([len(m) for m in merged], np.int64)
        point = sym - self.size
        width = np.where(point < 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        ids = np.repeat(sym, width)
        unknown = np.repeat(point >= 0, width)
        ids[unknown] = np.frombuffer("".join(map(chr, point[point >= 0].tolist())).encode(), np.uint8).astype(np.int64) + self.first_byte
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(lens)))] * 4
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts of texts that begin and end where no piece reaches across."""
        split = [WORD.findall(p) for p in parts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        found = dict(zip(new, self.ids_of(new))) if new else {}
        known.update((w, b) for w, b in found.items() if len(w) <= SHORT)
        get = (known | found).__getitem__ if any(len(w) > SHORT for w in found) else known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        """The text of ids in UTF-8. first: the text begins here, so its prefixed space goes."""
        shown = ids[~self.control[ids]]
        drop = first and bool(len(shown)) and bool(self.spaced[shown[0]])
        out = b"".join(map(self._bytes, np.split(ids, np.flatnonzero(self.control[ids]))))  # bytes on both sides of a control piece aren't one character
        return out[1:] if drop else out

    def _bytes(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        out = self.data[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
        try:
            out.decode()
        except UnicodeDecodeError:
            out = mended(out)
        return out


def mended(data: bytes) -> bytes:
    """Each byte that is no UTF-8 replaced by one mark."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), REPLACED]
            at += e.start + 1
    return "".join(out).encode()


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One for each worker process."""
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def parts_of(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """A text with its prefixed space, in parts of some chunk characters, cut where no piece reaches across."""
    text = text.replace(SPACE, " ")
    if not text:
        return
    at, head = 0, " "
    while at < len(text):
        cut = CUT.search(text, at + chunk) if len(text) - at > chunk else None
        end = cut.start() if cut else len(text)
        yield head + text[at:end]
        at, head = end, ""


def encode(docs: DataFrame, path: str | None = None, *, chunk: int = CHUNK) -> DataFrame:
    """One or more rows per document: doc_id, chunk (0, 1, ...), ids; a document's rows follow one another in a task.

    The ids, put together, are the library's, with the begin id first and the end id last. path: the model's file, which each
    worker opens. Null and empty texts have these two ids. Texts of any length are encoded in chunks of some `chunk` characters
    (more only for a word without a space that is longer). Null and repeated doc_ids are documents of their own. Extra columns
    are ignored; no rows give none.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        begin, end = np.array([m.bos], "<u4").tobytes(), np.array([m.eos], "<u4").tobytes()

        def rows(pending: list[tuple[int | None, int, bool, bool, str]]) -> pa.RecordBatch:
            ids = [begin * first + b + end * last for b, (_, _, first, last, _) in zip(m.encode_parts([p[4] for p in pending]), pending)]
            offsets = np.cumsum([0, *(len(b) // 4 for b in ids)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pending], pa.int64()), pa.array([p[1] for p in pending], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "chunk", "ids"])

        for batch in slices(batches, limit=1 << 20):
            pending, size = [], 0
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                k, before = 0, None
                for part in parts_of(text or "", chunk):
                    if before is not None:
                        pending.append((key, k, k == 0, False, before))
                        k, size = k + 1, size + len(before)
                        if size > 2 * chunk:
                            yield rows(pending)
                            pending, size = [], 0
                    before = part
                pending.append((key, k, k == 0, True, before or ""))
            yield rows(pending)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of encode(), as it gives them, with text: what the library decodes from the ids, chunk by chunk."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in slices(batches, "ids"):
            flat, offsets = batch.column("ids").flatten().to_numpy(), batch.column("ids").offsets.to_numpy()
            offsets = offsets - offsets[0] if len(offsets) else offsets
            texts = [m.decode(flat[a:b], c == 0) for a, b, c in zip(offsets.tolist(), offsets[1:].tolist(), batch.column("chunk").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "chunk", "ids")), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "chunk", "ids", "text"])

    return encoded.mapInArrow(run, ENCODED + ", text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, from the rows of decode() as it gives them."""
    names, kinds = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        def finish() -> None:
            if current is not None:
                key, n, ids, text = current
                done.append((key, n, ids.hexdigest(), text.hexdigest()))

        for batch in slices(batches, "ids"):
            flat, offsets = np.ascontiguousarray(batch.column("ids").flatten().to_numpy()).astype("<u4"), batch.column("ids").offsets.to_numpy()
            offsets = offsets - offsets[0] if len(offsets) else offsets
            data = memoryview(flat.tobytes())
            for key, chunk, a, b, text in zip(batch.column("doc_id").to_pylist(), batch.column("chunk").to_pylist(), offsets.tolist(), offsets[1:].tolist(), batch.column("text").to_pylist()):
                if chunk == 0:
                    finish()
                    current = [key, 0, hashlib.sha256(), hashlib.sha256()]
                current[1] += b - a
                current[2].update(data[4 * a : 4 * b])
                current[3].update(text.encode())
            yield emit()
        finish()
        yield emit()

    return decoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
