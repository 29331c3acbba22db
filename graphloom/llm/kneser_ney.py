"""Language-model scoring: an interpolated modified Kneser-Ney trigram model.

Counting, in three jobs. (1) Each task counts the 64-bit hashes of its words; reducers write sorted arrays of hashes and
counts, one file for each range of hashes, and a word's number is its place in all of them. (2) Each task turns its words
into numbers, counts trigrams in blocks, and hands over sorted arrays, cut by ranges of a mixed key of the first two
words. A reducer holds one range and writes, for each pair of words, what follows it: one word and nothing else where the
pair was seen once, else offsets, sums for the discounts, and the following words with their counts. (3) Each file is read
again for the pairs (second word, third word) of its trigrams; reducers by the same ranges of pairs count how many
different words come before each, and write the counts that are no 1; a last step sums these up for single words.

Ranges are even, since keys are mixed, and follow the corpus: each has about RANGE_BYTES of its text. Counts are 64 bits
wide. Words are told apart by 64 bits of their hash, and by their numbers from then on, so pairs and trigrams never merge.

Scoring. Workers map the files into memory and look up the sorted, distinct keys of a batch, range by range.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import crc_mod, shared_dir, shuffles_removed, slices

BLOCK_WORDS = 1 << 22
#: Bytes of text for each range of pairs, and ranges of pairs for each range of words.
RANGE_BYTES, WORD_RANGE = 16 << 20, 8
#: Numbers of words for each file of sums of single words.
NUMBERS = 1 << 20
#: Keys within a file are stored by their lower 32 bits if it then has at most this many sections of equal upper bits.
MAX_SECTIONS = 1 << 12
OPEN_FILES = 256
#: Text that is scored at once: the more, the fewer times each range is looked at.
SCORED_BYTES = 8 << 20
#: Fixed value: an odd factor that mixes a pair's bits.
MIX = 0x9E3779B97F4A7C15
END = np.uint64(xxh64_intdigest(b" end"))  # no word has a space
#: The number of what stands before a text; words begin at 1.
START = 0
#: A count of this in an array of bytes stands in the array of large ones.
LARGE = 255


# ---------------------------------------------------------------- arrays in the shared folder and in shuffles


def local_path(url: str) -> str | None:
    parts = urlparse(url)
    return parts.path if parts.scheme in ("", "file") else None


def put(url: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays as one file; a task that runs again replaces it by the same."""
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    head = len(head).to_bytes(8, "little") + head
    parts = [head] + [a.tobytes() for a in arrays.values()]
    parts = [p + b"\0" * (-len(p) % 8) for p in parts]
    if folder := local_path(url):
        os.makedirs(folder, exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
            f.writelines(parts)
        os.replace(f.name, f"{folder}/{name}")
    else:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(url)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{name}") as f:
            for p in parts:
                f.write(p)


def mapped(url: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped into memory; None if there is no file. From a store that can't be mapped, a nameless copy is."""
    if folder := local_path(url):
        path = f"{folder}/{name}"
        whole = np.memmap(path, np.uint8, "r") if os.path.exists(path) else None
    else:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(url)
        if store.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
            return None
        with tempfile.NamedTemporaryFile() as f:
            with store.open_input_stream(f"{folder}/{name}") as g:
                while part := g.read(1 << 22):
                    f.write(part)
            f.flush()
            whole = np.memmap(f.name, np.uint8, "r")
    if whole is None:
        return None
    size = int.from_bytes(whole[:8].tobytes(), "little")
    at, out = 8 + size + -(8 + size) % 8, {}
    for k, kind, n in json.loads(whole[8 : 8 + size].tobytes()):
        end = at + n * np.dtype(kind).itemsize
        out[k] = whole[at:end].view(kind)
        at = end + -end % 8
    return out


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, byte by byte of equal weight, compressed; a sorted one is best given by differences."""
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def expand(data: bytes, n: int) -> list[np.ndarray]:
    """The n arrays of squeeze, as 64-bit numbers."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def added(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else values[:0]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = runs(keys)
    return (keys[first], *(added(v[order], first) for v in values))


def ranges(keys: np.ndarray, bits: int, of: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted keys (numbers of that many bits) by their upper bits; of: how many parts, a power of two."""
    shift = bits - (of.bit_length() - 1)
    part = keys >> keys.dtype.type(shift) if shift < 64 else np.zeros_like(keys)
    begins = runs(part)
    for a, b in zip(begins, [*begins[1:], len(keys)]):
        yield int(part[a]), slice(a, b)


def small(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; the large ones apart, by place."""
    at = np.flatnonzero(counts >= LARGE)
    return {"n": np.minimum(counts, LARGE).astype(np.uint8), "large_at": at.astype("<u8"), "large_n": counts[at].astype("<u8")}


ROW = "kind string, part int, v binary"


def batch_of(rows: list[tuple]) -> pa.Table:
    kinds = {"kind": pa.string(), "part": pa.int32(), "v": pa.binary()}
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def numbers(kind: str, part: int, *values: int) -> tuple:
    return (kind, part, np.array(values, "<i8").tobytes())


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    url: str
    pairs: int  # ranges of pairs
    words: int  # ranges of words
    base: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # the number before each range's first word
    end: int = 0  # the end's number
    total: int = 0  # tokens learned from
    vocabulary: int = 0  # different ones
    pair_types: int = 0
    tri_discount: tuple[float, ...] = (0.75, 0.75, 0.75)
    pair_discount: tuple[float, ...] = (0.75, 0.75, 0.75)
    word_discount: tuple[float, ...] = (0.75, 0.75, 0.75)
    word_left: float = 1.0  # what the discounts leave for the uniform distribution
    names: frozenset[str] = frozenset()  # of the files that were written; a range without words or pairs has none
    files: OrderedDict = field(default_factory=OrderedDict, repr=False)

    @property
    def bits(self) -> int:
        """Of a word's number; the largest stands for words that were never seen."""
        return (self.vocabulary + 1).bit_length()

    def file(self, name: str) -> dict[str, np.ndarray] | None:
        if name in self.files:
            self.files.move_to_end(name)
        else:
            while len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)
            self.files[name] = mapped(self.url, name)
            if self.files[name] is None and name in self.names:
                raise FileNotFoundError(f"{self.url}/{name}")
        return self.files[name]

    # a pair of numbers as one key of 2 * bits bits, in which the upper ones are mixed

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) << np.uint64(self.bits)) | b.astype(np.uint64)) * np.uint64(MIX) & self.mask

    def pair(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = key * np.uint64(pow(MIX, -1, 1 << 64)) & self.mask
        return plain >> np.uint64(self.bits), plain & np.uint64((1 << self.bits) - 1)

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << min(2 * self.bits, 64)) - 1)

    @property
    def key_bits(self) -> int:
        return 2 * self.bits

    def sections(self) -> int:
        """Sections of a file by the keys' upper bits, so that 32 bits are left; 1: keys are stored whole."""
        n = 1 << max(0, self.key_bits - 32 - (self.pairs.bit_length() - 1))
        return n if n <= MAX_SECTIONS else 1

    def stored(self, name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
        """A range's sorted keys as they are stored."""
        n = self.sections()
        edge = np.zeros(n + 1, "<u8")
        for k, at in ranges(keys & np.uint64((1 << (self.key_bits - (self.pairs.bit_length() - 1))) - 1), self.key_bits - (self.pairs.bit_length() - 1), n):
            edge[k + 1] = at.stop - at.start
        return {f"{name}_edge": np.cumsum(edge).astype("<u8"), f"{name}_key": keys.astype("<u4" if self.narrow else "<u8")}

    @property
    def narrow(self) -> bool:
        return self.key_bits - (self.pairs.bit_length() - 1) - (self.sections().bit_length() - 1) <= 32

    def whole(self, part: int, file: dict[str, np.ndarray], name: str) -> np.ndarray:
        """All keys of a file, as they were before they were stored."""
        keys = file[f"{name}_key"].astype(np.uint64)
        if not self.narrow:
            return keys
        n = self.sections()
        section = np.repeat(np.arange(n, dtype=np.uint64), np.diff(file[f"{name}_edge"].astype(np.int64)))
        upper = np.uint64(part * n) + section
        return keys | upper << np.uint64(self.key_bits - (self.pairs.bit_length() - 1) - (n.bit_length() - 1))

    def places(self, file: dict[str, np.ndarray], name: str, keys: np.ndarray) -> np.ndarray:
        """Where each of a range's sorted keys stands in the file; -1: nowhere."""
        known, edge = file[f"{name}_key"], file[f"{name}_edge"]
        out = np.full(len(keys), -1, np.int64)
        if not len(keys) or not len(known):
            return out
        shift, n = self.key_bits - (self.pairs.bit_length() - 1), self.sections()
        section = (keys & np.uint64((1 << shift) - 1)) >> np.uint64(shift - (n.bit_length() - 1)) if n > 1 else np.zeros(len(keys), np.uint64)
        first = np.flatnonzero(np.diff(section, prepend=~section[0]))
        q = keys.astype(known.dtype)
        # of each section that has any: from and to which query, from and to which key
        sides = np.stack((first, np.append(first[1:], len(keys)), edge[section[first]].astype(np.int64), edge[section[first] + np.uint64(1)].astype(np.int64)))
        for s, e, a, b in sides[:, sides[2] < sides[3]].T.tolist():
            out[s:e] = known[a:b].searchsorted(q[s:e])
            out[s:e] += a
        inside = (out >= 0) & (out < edge[section + np.uint64(1)].astype(np.int64))  # else the next section's first key might look the same
        out[~inside] = -1
        out[inside] = np.where(known[out[inside]] == q[inside], out[inside], -1)
        return out

    def words_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes -> number (never seen: the largest) and count of each."""
        number, count = np.full(len(hashes), (1 << self.bits) - 1, np.int64), np.zeros(len(hashes), np.int64)
        for k, at in ranges(hashes, 64, self.words):
            if file := self.file(f"words-{k}"):
                i = np.minimum(np.searchsorted(file["key"], hashes[at]), len(file["key"]) - 1)
                hit = file["key"][i] == hashes[at]
                number[at] = np.where(hit, self.base[k] + 1 + i, number[at])
                count[at] = np.where(hit, file["n"][i], 0)
        return number, count

    def sums_of(self, ids: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Sorted numbers -> the sums of single words under these names (0: not there)."""
        out = [np.zeros(len(ids), np.int64) for _ in names]
        part = ids // NUMBERS
        begins = runs(part)
        for a, b in zip(begins, [*begins[1:], len(ids)]):
            if file := self.file(f"sums-{part[a]}"):
                at = np.asarray(ids[a:b] % NUMBERS, np.int64)
                inside = at < len(file["total"])
                for o, name in zip(out, names):
                    o[a:b][inside] = file[name][at[inside]]
        return out


def discounts(n: np.ndarray) -> tuple[float, ...]:
    """Chen and Goodman's three discounts from the numbers of n-grams seen once to four times; 3/4 where one isn't defined."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    found = [k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] and n[k] else 0.75 for k in (1, 2, 3)]
    return tuple(d if 0 < d <= k else 0.75 for k, d in enumerate(found, 1))


def seen(counts: np.ndarray) -> tuple[int, ...]:
    """How many counts are 1, 2, 3, 4, and 3 or more."""
    return tuple(int((counts == k).sum()) for k in (1, 2, 3, 4)) + (int((counts >= 3).sum()),)


# ---------------------------------------------------------------- counting


def hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.array([*map(xxh64_intdigest, words), int(END)], np.uint64)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of texts one after another, where each begins), BLOCK_WORDS or some more at a time."""
    held: list[np.ndarray] = []
    n = 0
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            held.append(hashes(text))
            n += len(held[-1])
            if n >= BLOCK_WORDS:
                yield np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])
                held, n = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])


def before(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second and the first token before each, START where a text hasn't begun."""
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[begins] = two[begins] = START
    second = begins + 1
    two[second[second < len(tokens)]] = START
    return two, one


def train(spark: SparkSession, docs: DataFrame, train_where: Column) -> Model:
    """Learns from all texts with train_where; null texts are an end only."""
    texts = docs.where(train_where).select("text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    pairs = 1 << max(0, (int(size) // RANGE_BYTES).bit_length())
    model = Model(shared_dir(spark, "trigrams"), pairs, max(1, pairs // WORD_RANGE))
    with shuffles_removed(spark):
        _count_words(model, texts)
        if model.total:
            _count_trigrams(model, texts)
            _count_pairs(spark, model)
    model.files.clear()
    model.names = written(spark, model.url)
    return model


def written(spark: SparkSession, url: str) -> frozenset[str]:
    """The names of a folder's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return frozenset(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else frozenset()


def _count_words(model: Model, texts: DataFrame) -> None:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in blocks(batches):
            keys, n = np.unique(tokens, return_counts=True)
            yield from batch_of([("", k, squeeze(steps(keys[at]), n[at])) for k, at in ranges(keys, 64, model.words)]).to_batches()

    def store(key: tuple, table: pa.Table) -> pa.Table:
        part, parts = key[0].as_py(), [expand(x, 2) for x in table["v"].to_pylist()]
        keys, n = summed(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), np.concatenate([n for _, n in parts]))
        put(model.url, f"words-{part}", key=keys, n=n)
        end = np.flatnonzero(keys == END)
        return batch_of([numbers("", part, len(keys), int(n.sum()), int(end[0]) if len(end) else -1)])

    found = {r.part: np.frombuffer(r.v, "<i8") for r in texts.mapInArrow(count, ROW).groupBy("part").applyInArrow(store, ROW).collect()}  # three numbers a range
    types = np.array([found[k][0] if k in found else 0 for k in range(model.words)], np.int64)
    model.base = np.cumsum(types) - types
    model.vocabulary, model.total = int(types.sum()), int(sum(x[1] for x in found.values()))
    model.end = next((int(model.base[k] + 1 + x[2]) for k, x in found.items() if x[2] >= 0), 0)


def _count_trigrams(model: Model, texts: DataFrame) -> None:
    if model.key_bits > 64:
        raise ValueError("more than 2 ** 32 different words")
    model.pairs = min(model.pairs, 1 << model.key_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, begins in blocks(batches):
            u, back = np.unique(tokens, return_inverse=True)
            w = model.words_of(u)[0][back]
            del tokens, u, back
            key = model.key(*before(w, begins))
            order = np.lexsort((w, key))
            key, w = key[order], w[order]
            first = runs(key, w)
            n = np.diff(first, append=len(w))
            key, w = key[first], w[first]
            for k, at in ranges(key, model.key_bits, model.pairs):
                yield from batch_of([("", k, squeeze(steps(key[at]), w[at], n[at]))]).to_batches()

    def store(group: tuple, table: pa.Table) -> pa.Table:
        part, parts = group[0].as_py(), [expand(x, 3) for x in table["v"].to_pylist()]
        key = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, *_ in parts])
        w, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.lexsort((w, key))
        key, w, n = key[order], w[order], n[order]
        first = runs(key, w)
        key, w, n = key[first], w[first], added(n, first)
        first = runs(key)
        length, total = np.diff(first, append=len(key)), added(n, first)
        once = total == 1
        rich, inside = ~once, np.repeat(~once, length)
        ones = lambda x: added(x.astype(np.int64), first)[rich].astype("<u8")
        put(
            model.url, f"pairs-{part}", **model.stored("once", key[first][once]), once_w=w[first][once].astype("<u4"), **model.stored("rich", key[first][rich]),
            begin=(np.cumsum(length[rich]) - length[rich]).astype("<u4"), total=total[rich].astype("<u8"), one=ones(n == 1).astype("<u4"), two=ones(n == 2).astype("<u4"), more=ones(n > 2).astype("<u4"),
            w=w[inside].astype("<u4"), **small(n[inside]),
        )
        return batch_of([numbers("", part, *seen(n))])

    found = texts.mapInArrow(count, ROW).groupBy("part").applyInArrow(store, ROW).collect()  # five numbers a range
    model.tri_discount = discounts(sum(np.frombuffer(r.v, "<i8") for r in found)[:4])


def _count_pairs(spark: SparkSession, model: Model) -> None:
    def by_number(kind: str, ids: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
        part = ids // ids.dtype.type(NUMBERS)
        begins = runs(part)
        for a, b in zip(begins, [*begins[1:], len(ids)]):
            yield kind, int(part[a]), squeeze(steps(ids[a:b]), *(v[a:b] for v in values))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                if file := mapped(model.url, f"pairs-{part}"):
                    length = np.diff(file["begin"].astype(np.int64), append=len(file["w"]))
                    v = np.concatenate((model.pair(model.whole(part, file, "once"))[1], np.repeat(model.pair(model.whole(part, file, "rich"))[1], length)))
                    key, n = np.unique(model.key(v, np.concatenate((file["once_w"], file["w"]))), return_counts=True)
                    for k, at in ranges(key, model.key_bits, model.pairs):
                        yield from batch_of([("pairs", k, squeeze(steps(key[at]), n[at]))]).to_batches()

    def store(group: tuple, table: pa.Table) -> pa.Table:
        part, found = group[1].as_py(), [expand(x, 2) for x in table["v"].to_pylist()]
        key, n = summed(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in found]), np.concatenate([n for _, n in found]).astype(np.int64))
        v, w = model.pair(key)
        kept = (n > 1) | (w == model.end)  # any other pair has 1, and is known as what trigrams begin with
        put(model.url, f"before-{part}", **model.stored("pair", key[kept]), n=n[kept].astype("<u4"))
        one = np.ones(len(n), np.int64)
        rows = [numbers("seen", -1, *seen(n)), *by_number("first", *summed(v, n, (n == 1) * one, (n == 2) * one, (n > 2) * one)), *by_number("second", *summed(w, one))]
        return batch_of(rows)

    def add(group: tuple, table: pa.Table) -> pa.Table:
        part = group[0].as_py()
        rows = list(zip(table["kind"].to_pylist(), table["v"].to_pylist()))
        if part < 0:
            return batch_of([("pairs", -1, sum(np.frombuffer(v, "<i8") for _, v in rows).tobytes())])
        sums = np.zeros((5, min(NUMBERS, model.vocabulary + 1 - part * NUMBERS)), np.int64)
        for kind, v in rows:
            at, *values = expand(v, 5 if kind == "first" else 2)
            at = np.cumsum(at).astype(np.int64) - part * NUMBERS
            sums[slice(0, 4) if kind == "first" else slice(4, 5), at] += np.stack(values).astype(np.int64)
        total, one, two, more, after = sums
        put(model.url, f"sums-{part}", total=total.astype("<u8"), one=one.astype("<u4"), two=two.astype("<u4"), more=more.astype("<u4"), after=after.astype("<u4"))
        return batch_of([numbers("after", -1, int(after.sum()), *seen(after))])

    each = spark.range(0, model.pairs, 1, min(model.pairs, 1 << 14)).mapInArrow(count, ROW)
    found = each.groupBy("kind", "part").applyInArrow(store, ROW).groupBy("part").applyInArrow(add, ROW).groupBy("kind").agg(F.collect_list("v").alias("v")).collect()
    got = {r.kind: sum(np.frombuffer(x, "<i8") for x in r.v) for r in found}  # a few numbers for each NUMBERS words
    model.pair_discount = discounts(got["pairs"][:4])
    model.pair_types, n = int(got["after"][0]), got["after"][1:]
    model.word_discount = d = discounts(n[:4])
    model.word_left = float((d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / model.pair_types)


# ---------------------------------------------------------------- scoring


def minus(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.maximum(counts - np.array((0.0, *d))[np.minimum(counts, 3)], 0)


def interpolated(n: np.ndarray, d: tuple[float, ...], total: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray, lower: np.ndarray) -> np.ndarray:
    safe = np.maximum(total, 1)
    return np.where(total > 0, minus(n, d) / safe + (d[0] * one + d[1] * two + d[2] * more) / safe * lower, lower)


def follow(model: Model, key: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Sorted pairs (key) and a word after each: the trigram's count, and total, one, two, more of what follows the pair."""
    n, total, one, two, more = out = [np.zeros(len(key), np.int64) for _ in range(5)]
    for part, at in ranges(key, model.key_bits, model.pairs):
        if not (file := model.file(f"pairs-{part}")):
            continue
        begin = np.flatnonzero(np.diff(key[at], prepend=~key[at.start]))  # of each distinct pair
        back = np.repeat(np.arange(len(begin)), np.diff(begin, append=at.stop - at.start))
        u, mine = key[at][begin], w[at]
        i = model.places(file, "once", u)
        missing = np.flatnonzero(i < 0)  # a pair is in one of the two lists, or in none
        j = np.full(len(u), -1, np.int64)
        j[missing] = model.places(file, "rich", u[missing])
        i, j = i[back], j[back]
        hit = np.flatnonzero(i >= 0)
        total[at.start + hit] = one[at.start + hit] = 1
        n[at.start + hit] = file["once_w"][i[hit]] == mine[hit]
        i = j
        hit = np.flatnonzero(i >= 0)
        if len(hit):
            i = i[hit]
            for o, name in zip(out[1:], ("total", "one", "two", "more")):
                o[at.start + hit] = file[name][i]
            n[at.start + hit] = count_of(file, i, mine[hit])
    return out


def count_of(file: dict[str, np.ndarray], i: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The counts of words w after the pairs at places i: all are looked up at once, by halving what is left of each list."""
    begin, words = file["begin"], file["w"]
    low = begin[i].astype(np.int64)
    high = np.where(i + 1 < len(begin), begin[np.minimum(i + 1, len(begin) - 1)], len(words)).astype(np.int64)
    end = high.copy()
    while np.any(low < high):
        mid = (low + high) >> 1
        less = (low < high) & (words[np.minimum(mid, len(words) - 1)] < w)
        low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(mid, high))
    at = np.minimum(low, len(words) - 1)
    n = np.where((low < end) & (words[at] == w), file["n"][at], 0).astype(np.int64)
    if len(file["large_at"]):
        j = np.minimum(np.searchsorted(file["large_at"], at), len(file["large_at"]) - 1)
        n = np.where((n == LARGE) & (file["large_at"][j] == at), file["large_n"][j], n)
    return n


def preceded(model: Model, key: np.ndarray) -> np.ndarray:
    """How many different words come before each of sorted, distinct pairs."""
    out = np.zeros(len(key), np.int64)
    for part, at in ranges(key, model.key_bits, model.pairs):
        left = np.arange(at.start, at.stop)
        if file := model.file(f"before-{part}"):
            i = model.places(file, "pair", key[left])
            out[left[i >= 0]] = file["n"][i[i >= 0]]
            left = left[i < 0]
        for name in ("once", "rich"):  # what trigrams begin with, and isn't above, has one
            if len(left) and (file := model.file(f"pairs-{part}")):
                i = model.places(file, name, key[left])
                out[left[i >= 0]] = 1
                left = left[i < 0]
    return out


def probabilities(model: Model, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: its count among those learned from, and the model's probability."""
    words, back = np.unique(tokens, return_inverse=True)
    number, count = model.words_of(words)
    w = number[back]
    u, v = before(w, begins)

    ids, of = np.unique(w, return_inverse=True)
    (after,) = model.sums_of(ids, ("after",))
    p = (minus(after, model.word_discount) / max(model.pair_types, 1) + model.word_left / (model.vocabulary + 1))[of]

    keys, of = np.unique(model.key(v, w), return_inverse=True)
    n = preceded(model, keys)[of]
    ids, of = np.unique(v, return_inverse=True)
    p = interpolated(n, model.pair_discount, *(x[of] for x in model.sums_of(ids, ("total", "one", "two", "more"))), p)

    key = model.key(u, v)
    order = np.argsort(key, kind="stable")
    found = follow(model, key[order], w[order])
    n, *sums = (np.empty_like(x) for x in found)
    for o, x in zip((n, *sums), found):
        o[order] = x
    return count[back], interpolated(n, model.tri_discount, *sums, p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Null, empty and blank texts are one token, the end. Repeated rows are scored alike. If nothing was learned, every
    token has probability 1 of 1 possible (score 0). Very long texts are scored whole; extra columns are ignored.
    """
    base_log = np.log10(model.total + 0.1 * (model.vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SCORED_BYTES):
            held = [hashes(t) for t in batch.column("text").to_pylist()]
            if not held:
                continue
            sizes = np.array([len(x) for x in held])
            begins = np.cumsum(sizes) - sizes
            count, p = probabilities(model, np.concatenate(held), begins)
            base, full = (np.add.reduceat(x, begins) for x in (np.log10(count + 0.1) - base_log, np.log10(p)))
            known = np.add.reduceat((count > 0).astype(np.int64), begins)
            cols = [sizes, known, np.full(len(sizes), model.total), base, full]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def in_training(doc_id: Column) -> Column:
    """The rows that the production model learns from: crc32 of the id modulo 10 isn't 0."""
    return crc_mod(doc_id, 10) != 0
