"""Near-duplicates by the Jaccard similarity of shingle sets: SimHash first, and a complete search for what it can't tell.

Texts whose five-word SimHash fingerprints differ in few bits are found by pigeonring filtering (simhash) and compared; most
copies are connected by these links. At a similarity of 4/5 some 10 of 64 bits differ, which no segments tell from chance.
So prefix filtering completes the search: two sets with similarity of at least 4/5 share one of the first
|A| - ceil(4/5 |A|) + 1 elements of each in any fixed order of all elements (Chaudhuri et al., 2006). Rare shingles come
first here: by a table of counts by hash bucket, then by hash. The table only sets the order, so its collisions lose no pair.

Sets that share such an element are compared if enough can be left in common: of the first element in common, at place i of
one set and j of the other, no earlier one is (Xiao et al., 2008). Comparisons are few where many share an element: first each
set is compared with one leading set, that with the fewest rarer elements before (in a group of copies, the original rather than
a copy with many edits), then with another one, always leaving out sets that are connected already; then all that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import simhash
from .common import cut_lineage, shuffles_removed, slices
from .components import connected_components

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
PART, WHOLE = 4, 5
#: Bits in which fingerprints may differ to be compared first, and segments.
MAX_DIFFERENT, SEGMENTS = 3, 4
#: Rounds of comparisons with one leading set of each element.
ROUNDS = 2
BUCKETS, COUNT_PARTS = 1 << 20, 64
#: Fixed value: an odd factor that mixes bits.
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, or of all of its words if they are fewer. No words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.array([xxh64_intdigest(w, SEED) for w in words], np.uint64)
    size = min(size, len(each))
    total = np.full(len(each) - size + 1, size, np.uint64)
    for i in range(size):
        total = (total * MIX) ^ each[i : len(each) - size + 1 + i]
        total ^= total >> np.uint64(29)
    return np.unique(total * MIX)


def set_id(own: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)) if len(own) else 0


def buckets(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(44)).astype(np.int64)


def prefix(own: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    n = len(own)
    if not n:
        return own
    return own[np.lexsort((own, rarity[buckets(own)]))[: n - (PART * n + WHOLE - 1) // WHOLE + 1]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    both = int((both[1:] == both[:-1]).sum())
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def _rows(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, fp) for each row, fp being the set's id; and how often each bucket's shingles come, in steps of a quarter power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "text_hash", "fp", "part", "counts"]
        for batch in slices(batches):
            ids = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = shingles(text)
                ids[i] = set_id(own)
                np.add.at(counts, buckets(own), 1)
            none = [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(ids), *none], names)
        if counts.any():
            cut = np.minimum(counts, 0xFFFF).astype("<u2").reshape(COUNT_PARTS, -1)
            none = [pa.nulls(COUNT_PARTS, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(COUNT_PARTS), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in table["counts"])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.floor(4 * np.log2(n + 1)).astype(np.uint8).tobytes()], pa.binary())})

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    both = cut_lineage(spark, both.mapInArrow(run, "doc_id long, text_hash long, fp long, part int, counts binary"), "shingle-sets")
    rarity = np.zeros((COUNT_PARTS, BUCKETS // COUNT_PARTS), np.uint8)
    for r in both.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        rarity[r.part] = np.frombuffer(r.counts, np.uint8)
    return both.where("part IS NULL").select("doc_id", "text_hash", "fp"), rarity.ravel()


def _sets(spark: SparkSession, docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(fp, n, bits, prefix, text_hash) for each distinct set; bits is the SimHash fingerprint of the set."""
    shared = spark.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            numbers = [pa.array(x, pa.int64()) for x in ([set_id(s) for s in sets], [len(s) for s in sets], [simhash.signed(simhash.majority(s)) for s in sets])]
            heads = pa.array([prefix(s, shared.value).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*numbers, heads, batch.column("text_hash")], ["fp", "n", "bits", "prefix", "text_hash"])

    # one row of each text before any word is read, one of each set after; equal rows of a task are one before the shuffle
    each = docs.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "fp long, n long, bits long, prefix array<long>, text_hash long")
    return cut_lineage(spark, each.groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"), F.min("text_hash").alias("text_hash")), "prefixes")


def _whole(spark: SparkSession, docs: DataFrame, sets: DataFrame, need: DataFrame) -> DataFrame:
    """(fp, own): all shingles of the sets in need (fp), made from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["fp", "own"])

    one = sets.select("fp", "text_hash").join(need.distinct(), "fp", "left_semi").select("text_hash")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(one, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    return cut_lineage(spark, texts.select("text").mapInArrow(run, "fp long, own binary"), "candidates")


def _compared(spark: SparkSession, whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with ok: whether the sets are similar."""
    both = pairs.join(whole.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(whole.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return cut_lineage(spark, both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, ok boolean"), "compared")


def _first_pairs(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(a, b): of the fingerprints that pigeonring filtering links, the leading sets; and each set with its fingerprint's leading one."""
    leads = sets.groupBy("bits").agg(F.min("fp").alias("lead"))
    linked = simhash.links(spark, leads.select(F.col("bits").alias("fp")), MAX_DIFFERENT, SEGMENTS)
    lead = lambda c: leads.select(F.col("bits").alias(c), F.col("lead").alias(f"{c}_lead"))
    across = linked.join(lead("a"), "a").join(lead("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    within = sets.select("fp", "bits").join(leads, "bits").where("fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    return cut_lineage(spark, across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "first-pairs")


def _joined(spark: SparkSession, roots: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, root) with further links (a, b): only roots and nodes that had no component are connected anew."""
    known = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = more.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    new = connected_components(spark, between.where("a <> b"))
    above = new.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return cut_lineage(spark, roots.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).union(new), "components")


def components(spark: SparkSession, docs: DataFrame, sets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of all sets that are similar to another: root is the component's smallest set id."""
    entries = sets.select("fp", "n", F.posexplode("prefix").alias("i", "token"))
    several = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = cut_lineage(spark, entries.join(several, "token", "left_semi"), "shared-tokens")
    first = _first_pairs(spark, sets)
    whole = _whole(spark, docs, sets, shared.select("fp").union(first.select("a")).union(first.select("b")))
    compared = _compared(spark, whole, first)
    # what can be in common from this element on, against what has to be; a similar pair passes by its first common element
    possible = (WHOLE + PART) * F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= PART * (F.col("n") + F.col("m"))
    roots = cut_lineage(spark, connected_components(spark, compared.where("ok").select("a", "b")), "components")
    for k in range(rounds + 1):
        named = shared.join(roots, shared["fp"] == roots["node"], "left").select("token", "fp", "n", "i", F.coalesce("root", "fp").alias("root"))
        # tokens whose sets aren't all connected
        lead = F.min_by(F.struct("fp", "n", "i", "root"), F.struct("i", F.xxhash64("fp")) if k == 0 else F.xxhash64("fp", F.lit(k)))
        apart = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), lead.alias("lead")).where("low <> high").select("token", "lead")
        if k < rounds:
            found = named.join(apart, "token").select("fp", "n", "i", "root", F.col("lead.fp").alias("other"), F.col("lead.n").alias("m"), F.col("lead.i").alias("j"), F.col("lead.root").alias("other_root"))
        else:
            rest = cut_lineage(spark, named.join(apart, "token", "left_semi"), "apart")
            others = rest.select("token", F.col("fp").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other_root"))
            found = rest.join(others, "token").where("fp < other")
        found = found.where((F.col("root") != F.col("other_root")) & possible).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
        found = cut_lineage(spark, found.join(compared, ["a", "b"], "left_anti"), "pairs")
        if not found.isEmpty():
            new = _compared(spark, whole, found)
            roots, compared = _joined(spark, roots, new.where("ok").select("a", "b")), compared.union(new)
    return roots


def near_duplicates(spark: SparkSession, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row of docs: component_id is the smallest doc_id that is reachable over
    similar sets, fp a hash that the rows of one component share. Null and blank texts are one set. Repeated rows are rows of
    one component. An empty table gives an empty result; extra columns are ignored."""
    with shuffles_removed(spark):
        rows, rarity = _rows(spark, docs)
        sets = _sets(spark, docs, rarity)
        comps = components(spark, docs, sets, rounds)
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")
    # root as fp: a component of null ids only is told apart by it
    return rows.join(named, "fp").select("doc_id", "text_hash", F.col("root").alias("fp"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, **options: int) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id."""
    return simhash.keep_first(docs, near_duplicates(spark, docs, **options))
