"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are cut into m segments, as a ring. Two fingerprints within t differing bits have a segment
from which every chain of l consecutive segments differs in at most floor(l * t / m) bits (Qin and Xiao, 2018). With
m > t the first segment of that chain is equal and the second differs in one bit at most; so both are put in a join key:
a fingerprint is indexed under (start, first two segments) and looked up under that key and under each key with one bit
of the second segment changed. Longer chains are checked on the pairs found, before the whole Hamming distance.

Only different fingerprints are joined, so exact copies cost one row. A key in which very many fingerprints meet
(near copies by the thousand) is refined: by the pigeonhole principle, two fingerprints with at most t differing bits
left agree in one of t + 1 parts of the bits outside the key, so such keys are extended by each of these parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut_lineage, slices
from .components import connected_components

BITS, SHINGLE, SEED = 64, 3, 42
MAX_DIFFERENT, SEGMENTS = 2, 3
#: A key with more different fingerprints than this is refined.
LARGE_KEY = 64
CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: bit b is set if more than half of its shingles' hashes have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        hashes = [xxh64_intdigest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(shingle)))]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that more than half of the hashes have; chunk by chunk, so that memory stays bounded."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for each row of docs; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    ends = [round(BITS * (i + 1) / segments) for i in range(segments)]
    return [sum(1 << b for b in range(s, e)) for s, e in zip([0, *ends], ends)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parts_outside(mask: int, n: int) -> list[int]:
    bits = [b for b in range(BITS) if not mask >> b & 1]
    return [signed(sum(1 << int(b) for b in x)) for x in np.array_split(bits, n)] if bits else [0] * n


def chain_filter(a: Column, b: Column, starts: list[int], max_different: int) -> Column:
    """True if, from the start segment on, all chains stay within their budgets; the longest chain is the whole distance."""
    m, ok = len(starts), F.lit(False)
    for i in range(m):
        good = F.col("start") == i
        for n in range(2, m + 1):
            mask = 0
            for k in range(n):
                mask |= starts[(i + k) % m]
            good &= F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(signed(mask)))) <= n * max_different // m
        ok |= good
    return ok


def links(spark: SparkSession, fps: DataFrame, max_different: int = MAX_DIFFERENT, segments: int = SEGMENTS, large_key: int = LARGE_KEY) -> DataFrame:
    """fps (fp, distinct) -> (a, b), a < b: every two fingerprints with at most max_different differing bits, once."""
    if not max_different < segments <= BITS:
        raise ValueError("more segments than differing bits are needed")
    masks = segment_masks(segments)
    keys, probes = [], []
    for i in range(segments):
        second = masks[(i + 1) % segments]
        both = F.col("fp").bitwiseAND(F.lit(signed(masks[i] | second)))
        keys.append(F.struct(F.lit(i).alias("start"), both.alias("key")))
        change = [0] + [1 << b for b in range(BITS) if second >> b & 1 and 2 * max_different >= segments]
        probes += [F.struct(F.lit(i).alias("start"), both.bitwiseXOR(F.lit(signed(x))).alias("key")) for x in change]
    index = fps.select("fp", F.inline(F.array(*keys)))
    probe = fps.select(F.col("fp").alias("a"), F.inline(F.array(*probes)))
    sizes = index.groupBy("start", "key").agg(F.count("*").alias("n"))
    large = cut_lineage(spark, sizes.where(F.col("n") > large_key).select("start", "key"), "large-keys")
    parts = [parts_outside(masks[i] | masks[(i + 1) % segments], max_different + 1) for i in range(segments)]

    def refined(df: DataFrame, fp: str) -> DataFrame:
        """Rows of large keys, with the part's number and bits; the join is by a key's rows, split where they are many."""
        each = F.when(F.lit(False), F.lit(None).cast("array<struct<part:int,bits:bigint>>"))
        for i in range(segments):
            each = each.when(F.col("start") == i, F.array(*[F.struct(F.lit(k).alias("part"), F.col(fp).bitwiseAND(F.lit(x)).alias("bits")) for k, x in enumerate(parts[i])]))
        return df.join(large, ["start", "key"], "left_semi").select(fp, "start", "key", F.inline(each))

    if large.isEmpty():
        found = probe.join(index, ["start", "key"])
    else:
        usual = probe.join(index.join(large, ["start", "key"], "left_anti"), ["start", "key"]).select("a", "fp", "start")
        found = usual.union(refined(probe, "a").join(refined(index, "fp"), ["start", "key", "part", "bits"]).select("a", "fp", "start"))
    found = found.where((F.col("a") < F.col("fp")) & chain_filter(F.col("a"), F.col("fp"), masks, max_different))
    return found.select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, max_different: int = MAX_DIFFERENT, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that is reachable over links. Null and blank texts have fingerprint 0, which
    links like any other. Null ids take part, but are never the smallest unless all of a component are null. Repeated
    rows are rows of one component. Very long texts are hashed in chunks. An empty table gives an empty result; extra
    columns are ignored.
    """
    rows = cut_lineage(spark, fingerprints(docs), "fingerprints")
    nodes = cut_lineage(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comps = connected_components(spark, links(spark, nodes.select("fp"), max_different, segments))
    of = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_first(docs: DataFrame, near: DataFrame) -> DataFrame:
    """docs with one row of each component of near: that with the smallest doc_id (a null id only where no other is), whole."""
    spark = docs.sparkSession
    # a component of null ids only: its fingerprint tells it apart
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("g")]
    near = cut_lineage(spark, near.select("doc_id", "text_hash", *group).groupBy("doc_id", "text_hash", "component_id", "g").agg(F.count("*").alias("n")), "groups")
    best = near.groupBy("component_id", "g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
    best = best.select(F.col("k.doc_id").alias("d"), F.col("k.text_hash").alias("h"))
    others = near.join(best, near["doc_id"].eqNullSafe(best["d"]) & (near["text_hash"] == best["h"]), "left_anti").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    # only ids and hashes are grouped; of the texts, the rows that go are taken out
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    same = lambda keys: row["doc_id"].eqNullSafe(keys["d"]) & (row["h"] == keys["h"])
    kept = row.join(others, same(others), "left_anti")
    twice = near.where("n > 1").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    if not twice.isEmpty():  # the very same row again
        kept = kept.join(twice, kept["doc_id"].eqNullSafe(twice["d"]) & (kept["h"] == twice["h"]), "left_anti").union(kept.join(twice, kept["doc_id"].eqNullSafe(twice["d"]) & (kept["h"] == twice["h"]), "left_semi").dropDuplicates(["doc_id", "h"]))
    return kept.select("row.*")


def keep_one(spark: SparkSession, docs: DataFrame, **options: int) -> DataFrame:
    """docs with one row of each component of near_duplicates."""
    return keep_first(docs, near_duplicates(spark, docs, **options))
