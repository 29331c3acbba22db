"""Exact top-k inner products: block-at-a-time pruning over document-range blocks.

Vectors become small integers; a dimension is a term, a vector's component its weight. Candidates are cut into blocks of BLOCK
ids that follow one another; a block keeps each dimension's largest and smallest weight, and its vectors (the forward index).
For a query, a block's bound is the sum over dimensions of the larger of weight times maximum and weight times minimum.

The k-th best score of a query's own block is where it begins: blocks with bounds below it aren't read (see vectors.py). Of
a range of those that are, the blocks are taken in the order of their bounds and scored whole, until the next bound is below
the k-th best score so far; equal bounds are still scored, as a smaller id may win. So nothing that could be in the result is
left out. The k best of each range are ranked once more over all ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage
from .vectors import BLOCK, EXACT, GROUP, SCALE, TOGETHER, blocks_of, choose, matrix, meet, quantized, queries_of, zones_of

K = 5


def cell(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, least: list[int | None] | None = None, block: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores, query's index) of each query's k best in one cell. Rows of x are sorted by id. least: a score
    for each query below which nothing is needed."""
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    largest = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if largest >= EXACT:
        x, high, low, q, plus, minus = (a.astype(object) for a in (x, high, low, q, plus, minus))
        x, high, low, q, plus, minus = (np.vectorize(int, otypes=[object])(a) for a in (x, high, low, q, plus, minus))
    bounds = plus @ high.T + minus @ low.T
    out = []
    for j in range(len(q)):
        best_ids, best = np.empty(0, np.int64), np.empty(0, bounds.dtype)
        order = np.argsort(-bounds[j], kind="stable")
        floor = least[j] if least else None
        for b in order:
            if len(best) == k and bounds[j][b] < best[-1] or floor is not None and bounds[j][b] < floor:
                break
            at = slice(starts[b], starts[b] + block)
            other = ids[at] != query_ids[j]
            best_ids, best = np.concatenate((best_ids, ids[at][other])), np.concatenate((best, (x[at] @ q[j])[other]))
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        out.append((best_ids, best, np.full(len(best), j)))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, *, vector: str = "embedding", scale: float = SCALE, block: int = BLOCK, together: int = TOGETHER, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with is_query (over vec_id) its k best other rows.

    Rows are known by their id: of several with one id the one with the least vector takes part. Ties go to the smaller id; fewer than k
    candidates give fewer rows. Vectors of other lengths than the query's aren't its candidates. Vectors that are
    null, empty of meaning (null, NaN, infinite components) or without id take no part; no rows give none; other columns
    are ignored. Scores are whole numbers; one beyond 64 bits raises an error.
    """
    spark = vectors.sparkSession
    one = quantized(vectors, vector, scale).groupBy("vec_id").agg(F.min("x").alias("x"))
    rows = cut_lineage(spark, one.select("vec_id", "x", F.size("x").alias("d"), F.coalesce(is_query.cast("boolean"), F.lit(False)).alias("anchor"), F.lit(0).cast("long").alias("label"), F.lit(b"").alias("key")), "vectors")
    count = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    # without a place on a curve, blocks are ranges of ids
    blocks = cut_lineage(spark, blocks_of(rows.select("d", "key", "vec_id", "label", "x", "anchor"), max(1, math.ceil(count.n / (block * together))), k, block, together), "blocks")
    queries, groups, cells = queries_of(blocks, count.a, group)
    asked = cut_lineage(spark, queries.select("d", "g", "anchor_id", "label", "y", F.array("least").alias("low"), F.array(F.lit(None).cast("long")).alias("high"), F.lit(True).alias("same")), "queries")
    chosen = cut_lineage(spark, choose(asked, zones_of(blocks), groups, cells), "chosen")

    def run(c: pa.Table, a: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not c.num_rows or not a.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        d, c = c["d"][0].as_py(), c.sort_by("block")
        ids = c["ids"].combine_chunks().flatten().to_numpy()
        query_ids, least = a["anchor_id"].to_numpy(), [v[0] for v in a["low"].to_pylist()]
        found = cell(ids, matrix(c["x"].combine_chunks(), len(ids), d), query_ids, matrix(a["y"].combine_chunks(), a.num_rows, d), k, least, block)
        which = np.concatenate([f[2] for f in found]).astype(np.int64)
        score = [int(s) for f in found for s in f[1]]
        return pa.table([pa.array(query_ids[which]), pa.array(np.concatenate([f[0] for f in found])), pa.array(score, pa.int64())], names)

    by_score = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    met = meet(blocks, chosen, asked, run, "query_id long, vec_id long, score long")
    return met.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
