"""Blocks of vectors with zone maps, and the choice of the blocks that queries need; for exact searches over inner products.

Vectors are whole numbers. A block is a row: BLOCK vectors that follow one another in an order, each dimension's least and
largest value (the zone map), the labels that occur, and the vectors (the forward index). Interval arithmetic over a zone map gives
the least and the largest score that a block can hold for a query. Zone maps and groups of queries meet first, without vectors, and
only the blocks that this chooses for a group are read and shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What components are multiplied by before they are rounded down.
SCALE = 256
#: Sums of products below this are exact in doubles; larger ones are summed as Python integers.
EXACT = 2.0**53
#: Rows of a block, blocks that are read together, queries of a group, about, and blocks whose zone maps meet a group at once.
BLOCK, TOGETHER, GROUP, ZONES = 128, 64, 2048, 4096
#: Queries whose scores are in memory at once.
AT_ONCE = 256
BLOCKS = "part long, range long, block long, d int, lo array<double>, hi array<double>, kinds array<long>, ids array<long>, labels array<long>, x array<double>, anchors array<int>, least array<long>"


def quantized(df: DataFrame, vector: str, scale: float, *more: Column) -> DataFrame:
    """(vec_id, x) and more: floor(scale * component) as doubles; without vectors that are null or hold null, NaN or infinity."""
    def whole(v: Column) -> Column:
        y = v.cast("double") * scale
        return F.when(F.abs(y) >= 2.0**52, y).otherwise(F.floor(y).cast("double"))  # the larger ones are whole already

    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, whole).alias("x"), *more)


def matrix(column: pa.Array, n: int, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, d)


def exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as they are if products of their rows are exact in doubles, else with Python integers."""
    d = arrays[0].shape[-1]
    if d * math.prod(float(np.abs(a).max(initial=0)) for a in (arrays[0], arrays[-1])) < EXACT:
        return arrays
    return tuple(np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object) for a in arrays)


def bounds(lo: np.ndarray, hi: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) possible score of each block (rows) with each vector of y (columns)."""
    both = np.maximum(np.abs(lo), np.abs(hi))
    _, lo, hi, y = exact(both, lo, hi, y)
    plus, minus = np.maximum(y, 0).T, np.minimum(y, 0).T
    return lo @ plus + hi @ minus, hi @ plus + lo @ minus


def kth_of_label(x: np.ndarray, labels: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> list[int | None]:
    """For the rows at, their k-th best score with other rows of their label; None if there are fewer."""
    x_, y = exact(x, x[at])
    scores = x_ @ y.T
    allowed = (labels[:, None] == labels[at]) & (ids[:, None] != ids[at])
    own = [np.sort(scores[allowed[:, j], j]) for j in range(len(at))]
    return [int(o[-k]) if len(o) >= k else None for o in own]


def blocks_of(rows: DataFrame, ranges: int, k: int, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """Blocks of rows (d, key, vec_id, label, x, anchor) along the curve."""
    ordered = rows.repartitionByRange(ranges, "d", "key", "vec_id").sortWithinPartitions("d", "key", "vec_id")
    schema = [x.split() for x in BLOCKS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, made, out, held, held_d = (context.partitionId() if context else 0), 0, [], [], None

        def close() -> None:
            nonlocal made, held
            t = pa.Table.from_batches(held).combine_chunks()
            n, d = t.num_rows, held_d
            x, ids, labels = matrix(t["x"].combine_chunks(), n, d), t["vec_id"].to_numpy(), t["label"].to_numpy()
            at = np.flatnonzero(t["anchor"].to_numpy())
            none = np.zeros(d)
            out.append((part, part << 32 | made // together, part << 32 | made, d, x.min(0, initial=np.inf) if d else none, x.max(0, initial=-np.inf) if d else none, np.unique(labels), ids, labels, x.ravel(), at.astype(np.int32), kth_of_label(x, labels, ids, at, k)))
            made, held = made + 1, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])

        for batch in batches:
            ds = batch.column("d").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ds)) + 1).tolist(), len(ds)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and held_d != ds[a]:
                    close()
                held_d = int(ds[a])
                while a < b:
                    take = min(b - a, block - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, take))
                    a += take
                    if sum(h.num_rows for h in held) == block:
                        close()
                    if len(out) >= 64:
                        yield emit()
        if held:
            close()
        yield emit()

    return ordered.mapInArrow(run, BLOCKS)


def queries_of(blocks: DataFrame, count: int, group: int = GROUP) -> tuple[DataFrame, int, int]:
    """(the queries of blocks: d, g, anchor_id, label, y, least; number of their groups; number of cells of zone maps).

    A group is made of neighbouring parts, so that its queries are alike where the order is one of likeness.
    """
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    per, wide = max(1, int(group * parts / max(1, count))), zones_wide()
    each = blocks.where(F.size("anchors") > 0).select("d", F.floor(F.col("part") / per).alias("g"), "ids", "labels", "x", F.explode(F.arrays_zip("anchors", "least")).alias("own"))
    at = F.col("own.anchors")
    queries = each.select("d", "g", F.get("ids", at).alias("anchor_id"), F.get("labels", at).alias("label"), F.slice("x", at * F.col("d") + 1, F.col("d")).alias("y"), F.col("own.least").alias("least"))
    return queries, (parts - 1) // per + 1, (parts - 1) // wide + 1


def zones_wide(together: int = TOGETHER) -> int:
    """Parts whose zone maps are one cell."""
    return max(1, ZONES // together)


def zones_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("d", F.floor(F.col("part") / zones_wide()).alias("cell"), "range", "block", "lo", "hi", "kinds")


def choose(anchors: DataFrame, zones: DataFrame, groups: int, cells: int) -> DataFrame:
    """(d, g, range, block): the blocks that some anchor of group g needs. anchors: d, g, label, y, low, high (ends of the windows
    of scores it asks for), same (whether it asks for its own label). zones: blocks without their vectors, with a cell."""
    def run(z: pa.Table, a: pa.Table) -> pa.Table:
        names = ["d", "g", "range", "block"]
        if not z.num_rows or not a.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())], names)
        d, need = z["d"][0].as_py(), np.zeros(z.num_rows, bool)
        for at in range(0, a.num_rows, AT_ONCE):
            need |= needed(z, a.slice(at, AT_ONCE), d).any(axis=1)
        return pa.table([z["d"], z["g"], z["range"], z["block"]], names).filter(pa.array(need))

    left = zones.select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), "cell", "range", "block", "lo", "hi", "kinds")
    right = anchors.select(F.col("d").alias("ad"), F.col("g").alias("ag"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("acell"), "label", "y", "low", "high", "same")
    return left.groupBy("d", "g", "cell").cogroup(right.groupBy("ad", "ag", "acell")).applyInArrow(run, "d int, g long, range long, block long")


def needed(z: pa.Table, a: pa.Table, d: int) -> np.ndarray:
    """For each block (rows) and anchor (columns), whether the block may hold what the anchor asks for."""
    lo, hi = (matrix(z[c].combine_chunks(), z.num_rows, d) for c in ("lo", "hi"))
    least, largest = bounds(lo, hi, matrix(a["y"].combine_chunks(), a.num_rows, d))
    label = a["label"].to_numpy()
    first = np.array([k[0] for k in z["kinds"].to_pylist()])
    only = np.array([len(k) == 1 for k in z["kinds"].to_pylist()])
    has = np.zeros(least.shape, bool)
    for i, kinds in enumerate(z["kinds"].to_pylist()):
        has[i] = np.isin(label, kinds)
    same = a["same"].to_numpy(zero_copy_only=False).astype(bool)
    other = ~(only[:, None] & (first[:, None] == label))
    hit = np.zeros(least.shape, bool)
    for low, high in windows(a, least.dtype):
        hit |= (largest >= low).astype(bool) & (least <= high).astype(bool)
    return hit & np.where(same, has, other)


def windows(a: pa.Table, dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(low ends, high ends) of all anchors' first windows, of their second ones ...; a null end is open, and what isn't there is empty."""
    lows, highs = a["low"].to_pylist(), a["high"].to_pylist()
    for w in range(max(map(len, lows), default=0)):
        low = [np.inf if w >= len(v) else -np.inf if v[w] is None else v[w] for v in lows]
        high = [-np.inf if w >= len(v) else np.inf if v[w] is None else v[w] for v in highs]
        yield np.array(low, dtype), np.array(high, dtype)


def meet(blocks: DataFrame, chosen: DataFrame, queries: DataFrame, run, schema: str) -> DataFrame:
    """run(blocks of a range, queries of a group) for each range and group of which chosen has a block; the blocks are the chosen ones."""
    read = blocks.select("d", "block", "lo", "hi", "kinds", "ids", "labels", "x").join(chosen.select("g", "range", "block"), "block")
    cells = chosen.select(F.col("d").alias("cd"), F.col("g").alias("cg"), F.col("range").alias("arange")).distinct()
    asked = queries.join(cells, (F.col("d") == F.col("cd")) & (F.col("g") == F.col("cg"))).select(F.col("d").alias("ad"), F.col("g").alias("ag"), "arange", "anchor_id", "label", "y", "low", "high", "same")
    return read.groupBy("d", "g", "range").cogroup(asked.groupBy("ad", "ag", "arange")).applyInArrow(run, schema)
