"""Idempotent upserts: insert what is new, merge properties into what is there."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import Checkpoint
from ..model import EDGE_KEY, PROPS


@dataclass
class Upserted:
    """items: the store after the upsert; inserted and attempted: one-row DataFrames (n)."""

    items: DataFrame
    inserted: DataFrame
    attempted: DataFrame


def merged(items: DataFrame, key: tuple[str, ...], keep_first: tuple[str, ...] = (), checkpoint: Checkpoint | None = None) -> DataFrame:
    """items (key, keep_first, props, seq) folded by key in the order of seq.

    The first keep_first values win; of a property, the last value wins, and properties that later rows lack stay. The
    fold runs over exploded properties as two aggregations with partial sums of their own, so a key written very often
    is never gathered into one list. With checkpoint(df), for items that are stored, the keys that come more than once are
    written first, and only their rows are folded; the others are what they are.
    """
    if checkpoint is not None:
        repeated = checkpoint(items.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"__{k}") for k in key]))
        on, whole = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in key]), reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        single = items.where(whole).join(repeated, on, "left_anti").select(*key, *keep_first, F.coalesce(F.map_from_entries(F.array_sort(F.map_entries("props"))), F.create_map().cast(PROPS)).alias("props"))
        return single.unionByName(merged(items.join(repeated, on, "left_semi").unionByName(items.where(~whole)), key, keep_first))
    if keep_first:
        heads = items.groupBy(*key).agg(*[F.min_by(c, "seq").alias(c) for c in keep_first])
    else:
        heads = items.select(*key).distinct()
    last = items.select(*key, "seq", F.explode("props").alias("k", "v")).groupBy(*key, "k").agg(F.max_by("v", "seq").alias("v"))
    maps = last.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return heads.join(maps, list(key), "left").withColumn("props", F.coalesce("props", F.create_map().cast(PROPS)))


def _with_store(store: DataFrame, batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Both, what is stored before what is written; seq of the batch may be of any type that has an order."""
    kind = dict(batch.dtypes)["seq"]
    old = store.select(*key, *[c for c in store.columns if c not in key], F.struct(F.lit(0).alias("new"), F.lit(None).cast(kind).alias("seq")).alias("seq"))
    return old.unionByName(batch.withColumn("seq", F.struct(F.lit(1).alias("new"), F.col("seq"))))


def upsert_vertices(store: DataFrame, batch: DataFrame) -> Upserted:
    """store (id, t, usr, props), batch (the same and seq, the order of writing). The first label of an id wins."""
    fresh = batch.select("id").distinct().join(store, "id", "left_anti")
    out = merged(_with_store(store, batch, ("id",)), ("id",), ("t", "usr")).select("id", "t", "usr", "props")
    return Upserted(out, fresh.agg(F.count("*").alias("n")), batch.agg(F.count("*").alias("n")))


def upsert_edges(store: DataFrame, batch: DataFrame, vertices: DataFrame) -> Upserted:
    """store (outbound_id, inbound_id, t, props), batch (the same and seq). Edges without both ends stored are dropped and not counted as inserted."""
    ids = vertices.select("id")
    held = batch.join(ids, batch["outbound_id"] == ids["id"], "left_semi").join(ids, batch["inbound_id"] == ids["id"], "left_semi")
    fresh = held.select(*EDGE_KEY).distinct().join(store, list(EDGE_KEY), "left_anti")
    out = merged(_with_store(store, held, EDGE_KEY), EDGE_KEY).select("outbound_id", "inbound_id", "t", "props")
    return Upserted(out, fresh.agg(F.count("*").alias("n")), batch.agg(F.count("*").alias("n")))


def first_wins(items: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key by order."""
    rest = [c for c in items.columns if c not in key]
    best = items.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")) if all(not t.startswith("map") for _, t in items.dtypes) else None
    if best is not None:
        return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*items.columns)
    return items.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def suppress_redundant(references: DataFrame, calls: DataFrame, scope: tuple[str, ...] = ("tu",)) -> DataFrame:
    """References without those that a call between the same two symbols of the same unit repeats."""
    on = [*scope, "source_usr", "target_usr"]
    return references.join(calls.select(*on).distinct(), on, "left_anti")


def partial_success(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results (file, written, attempted, error): sums over the files that worked, and the errors of the others."""
    good = results.where("error IS NULL")
    counters = good.agg(F.count("*").alias("files"), F.coalesce(F.sum("written"), F.lit(0)).alias("written"), F.coalesce(F.sum("attempted"), F.lit(0)).alias("attempted"))
    return counters, results.where("error IS NOT NULL").select("file", "error")
