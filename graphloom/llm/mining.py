"""Hard negatives from blocks along a Hilbert curve, chosen by zone maps.

Vectors become whole numbers and are written once as Parquet blocks in the order of a Hilbert curve through all dimensions:
a row is a block of BLOCK vectors with each dimension's least and largest value (the zone map), the labels that occur, and
the vectors. For an anchor, interval arithmetic over a zone map gives the least and the largest score that a block can hold.

Positives: blocks whose largest score reaches the anchor's k-th best of its own block. Negatives: blocks whose scores can
fall in one of the windows that the anchor's positives open. Zone maps and groups of neighbouring anchors meet first, without
vectors; only the blocks that this chooses for a group are read, and each is scored for those anchors that need it. Groups of anchors and
ranges of blocks are of bounded size, and all rows of one side that meet the other do so in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage
from .vectors import AT_ONCE, BLOCK, GROUP, SCALE, TOGETHER, blocks_of, choose, exact, matrix, meet, needed, quantized, queries_of, windows, zones_of

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Bits of each dimension along the curve, and bytes of the place on it that are kept (the rest of a longer one is lower order).
BITS, KEY_BYTES = 2, 32


def hilbert_keys(x: np.ndarray, unit: float, bits: int = BITS) -> list[bytes]:
    """Each row's place on a Hilbert curve (Skilling, 2004). Coordinates are cut into 2**bits steps of `unit` around zero."""
    n, d = x.shape
    if not d:
        return [b""] * n
    half = 1 << (bits - 1)
    c = np.clip(np.floor(x / (unit or 1.0)) + half, 0, 2 * half - 1).astype(np.int64).T.copy()
    q = half
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (c[i] & q) != 0
            swap = np.where(on, 0, (c[0] ^ c[i]) & p)
            c[0] ^= np.where(on, p, swap)
            c[i] ^= swap
        q >>= 1
    for i in range(1, d):
        c[i] ^= c[i - 1]
    t, q = np.zeros(n, np.int64), half
    while q > 1:
        t ^= np.where(c[d - 1] & q, q - 1, 0)
        q >>= 1
    c ^= t
    planes = np.stack([(c >> b) & 1 for b in range(bits - 1, -1, -1)])  # highest bits of all dimensions first
    return [bytes(r) for r in np.packbits(planes.transpose(2, 0, 1).reshape(n, -1).astype(np.uint8), axis=1)[:, :KEY_BYTES]]


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each column's k largest allowed scores; of equal ones the first rows."""
    m = np.where(allowed, scores, -np.inf)
    kth = np.partition(m, len(m) - k, axis=0)[len(m) - k] if len(m) > k else np.full(m.shape[1], -np.inf)
    above, equal = m > kth, allowed & (m == kth)
    return np.nonzero(above | equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0)))


def score(blocks: DataFrame, chosen: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """anchor_id, vec_id, score, window: each anchor's k best rows for each of its windows, from each range of blocks chosen for its group."""
    def run(c: pa.Table, a: pa.Table) -> pa.Table:
        names = ["anchor_id", "vec_id", "score", "window"]
        none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())], names)
        if not c.num_rows or not a.num_rows:
            return none
        d, out = c["d"][0].as_py(), []
        c = c.select([n for n in c.column_names if n != "d"])
        sizes = np.array([len(i) for i in c["ids"].to_pylist()], np.int64)
        ids, labels = (c[n].combine_chunks().flatten().to_numpy() for n in ("ids", "labels"))
        x = matrix(c["x"].combine_chunks(), len(ids), d)
        of = np.repeat(np.arange(c.num_rows), sizes)
        order = np.argsort(ids, kind="stable")
        ids, labels, x, of = ids[order], labels[order], x[order], of[order]
        for at in range(0, a.num_rows, AT_ONCE):
            own = a.slice(at, AT_ONCE)
            need = needed(c, own, d)
            rows = need.any(axis=1)[of]
            if not rows.any():
                continue
            anchor, label = own["anchor_id"].to_numpy(), own["label"].to_numpy()
            xs, y = exact(x[rows], matrix(own["y"].combine_chunks(), own.num_rows, d))
            s, same = xs @ y.T, own["same"].to_numpy(zero_copy_only=False).astype(bool)
            allowed = ((labels[rows][:, None] == label) == same) & (ids[rows][:, None] != anchor) & need[of[rows]]
            for w, (low, high) in enumerate(windows(own, s.dtype)):
                r, j = best(s, allowed & (s >= low).astype(bool) & (s <= high).astype(bool), k)
                out.append((anchor[j], ids[rows][r], [int(v) for v in s[r, j]], np.full(len(r), w, np.int32)))
        if not out:
            return none
        return pa.table([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), pa.array([v for o in out for v in o[2]], pa.int64()), pa.array(np.concatenate([o[3] for o in out]))], names)

    return meet(blocks, chosen, anchors, run, "anchor_id long, vec_id long, score long, window int")


def mine(spark: SparkSession, vectors: DataFrame, is_anchor: Column, *, label: str = "label", vector: str = "embedding", scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, together: int = TOGETHER, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    An anchor (is_anchor is over vec_id) has as positives the `positives` best other rows of its label; for each of them the
    `negatives` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned, fewer if
    there are fewer. Ties go to the smaller id. Rows without id, label or vector, or with a component that is null, NaN or
    infinite, take no part; rows are known by their id, so of several with one id the one with the least label, then vector, takes
    part. Vectors of other lengths than the anchor's are neither positives nor negatives. Extra columns are ignored; no rows give
    none. Scores are whole numbers; one beyond 64 bits raises an error.
    """
    whole = quantized(vectors, vector, scale, F.col(label).cast("long").alias("label")).where("label IS NOT NULL")
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x", F.size("v.x").alias("d"), F.coalesce(is_anchor.cast("boolean"), F.lit(False)).alias("anchor"))
    rows = cut_lineage(spark, one, "vectors")
    count = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    ranges = max(1, math.ceil(count.n / (block * together)))
    units = rows.groupBy("d").agg(F.avg(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v)) / F.greatest("d", F.lit(1))).alias("unit"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, units, column = batch.column("d").to_numpy(), batch.column("unit").to_numpy(), batch.column("x")
            keys = np.empty(len(ds), object)
            for d in np.unique(ds):
                at = np.flatnonzero(ds == d)
                keys[at] = hilbert_keys(matrix(column.take(pa.array(at)), len(at), int(d)), float(units[at[0]]))
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(keys.tolist(), pa.binary()), *(batch.column(c) for c in ("vec_id", "label", "x", "anchor"))], ["d", "key", "vec_id", "label", "x", "anchor"])

    on_curve = rows.join(units, "d").select("d", "unit", "vec_id", "label", "x", "anchor").mapInArrow(keyed, "d int, key binary, vec_id long, label long, x array<double>, anchor boolean")
    blocks = cut_lineage(spark, blocks_of(on_curve, ranges, positives, block, together), "blocks")

    queries, groups, cells = queries_of(blocks, count.a, group)
    anchors, zones = cut_lineage(spark, queries, "anchors"), zones_of(blocks)

    def found(asked: DataFrame, k: int) -> DataFrame:
        chosen = cut_lineage(spark, choose(asked, zones, groups, cells), "chosen")
        best_first = W.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
        return score(blocks, chosen, asked, k).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)

    anything = F.array(F.lit(None).cast("long"))
    for_positives = anchors.select("*", F.array("least").alias("low"), anything.alias("high"), F.lit(True).alias("same"))
    firsts = cut_lineage(spark, found(for_positives, positives), "positives")
    ordered = firsts.groupBy(F.col("anchor_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))

    def end(percent: int, rounded) -> Column:
        return F.transform("p", lambda v: rounded(v["score"].cast("decimal(20,0)") * percent / 100).cast("long"))

    asked = anchors.join(ordered, F.col("anchor_id") == F.col("of")).select("d", "g", "anchor_id", "label", "y", end(low, F.ceil).alias("low"), end(high, F.floor).alias("high"), F.lit(False).alias("same"))
    seconds = found(asked, negatives).select("anchor_id", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    opened = firsts.select(F.col("anchor_id").alias("of"), (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return seconds.join(opened, (F.col("anchor_id") == F.col("of")) & (F.col("window") == F.col("w"))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, every: int = 7, kinds: int = 10) -> DataFrame:
    """The labels of the query: those of ids divisible by 7 are one further."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % kinds).otherwise(F.col("label")))


MINE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
