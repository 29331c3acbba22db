"""Questions about ancestors in tables of tree nodes, by pointer doubling: as many joins as the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..lineage import Checkpoint, shared_writer


def parent_of() -> F.Column:
    """Preorder: a parent comes first; anything else would be a cycle and counts as no parent."""
    return F.when(F.col("parent_id") < F.col("id"), F.col("parent_id"))


def nearest_at(nodes: DataFrame, stops: dict[str, F.Column], checkpoint: Checkpoint | None = None, max_rounds: int = 40) -> DataFrame:
    """(tu, id, stop, ancestor) for nodes that have children: for each name of stops, the node itself if its condition holds, else the
    nearest ancestor for which it does; rows without one are left out. Most nodes of a tree are leaves, and go through one join only.

    Each node points at an ancestor below which nothing stops; a round lets it point where that one points. Nodes whose
    pointer has arrived are only looked up. All conditions go through the same joins. Tables of nodes are never broadcast: as columns of
    a wide table they look smaller than they are.
    """
    checkpoint = checkpoint or shared_writer(nodes.sparkSession)
    flags = F.array(*[F.struct(F.lit(k).alias("stop"), F.coalesce(v, F.lit(False)).alias("done")) for k, v in stops.items()])
    own = nodes.select("tu", "id", parent_of().alias("above"), flags.alias("flags"))
    parents = own.where("above IS NOT NULL").select("tu", F.col("above").alias("id")).distinct()
    # repeated ids count once
    inner = own.join(parents.hint("merge"), ["tu", "id"], "left_semi").dropDuplicates(["tu", "id"]).select("tu", "id", "above", F.inline("flags"))
    now = checkpoint(inner.select("tu", "id", "stop", F.when(F.col("done"), F.col("id")).otherwise(F.col("above")).alias("ptr"), "done").where("ptr IS NOT NULL"))
    for _ in range(max_rounds):
        if now.where(~F.col("done")).isEmpty():
            break
        above = now.select(F.col("tu").alias("ptu"), F.col("id").alias("pid"), F.col("stop").alias("pstop"), F.col("ptr").alias("pptr"), F.col("done").alias("pdone"))
        key = [F.col("tu") == F.col("ptu"), F.col("stop") == F.col("pstop"), F.col("ptr") == F.col("pid")]
        # roots, and nodes whose parent isn't in the table, have none
        moved = now.where(~F.col("done")).join(above.hint("merge"), key).select("tu", "id", "stop", F.col("pptr").alias("ptr"), F.col("pdone").alias("done"))
        now = checkpoint(now.where("done").union(moved))
    else:
        raise GraphError("INTERNAL_ERROR", f"ancestors lie deeper than 2 ** {max_rounds}")
    return now.select("tu", "id", "stop", F.col("ptr").alias("ancestor"))


def nearest_ancestors(nodes: DataFrame, stops: dict[str, F.Column], checkpoint: Checkpoint | None = None, max_rounds: int = 40) -> DataFrame:
    """nodes (tu, id, parent_id, ...) -> (tu, id, stop, ancestor): for each name of stops, the nearest strict ancestor for
    which its condition holds; rows without one are left out. See nearest_at."""
    at = nearest_at(nodes, stops, checkpoint, max_rounds).withColumnRenamed("id", "above")
    below = nodes.select("tu", "id", parent_of().alias("above")).dropDuplicates(["tu", "id"])
    return below.join(at.hint("merge"), ["tu", "above"]).select("tu", "id", "stop", "ancestor")


def nearest_ancestor(nodes: DataFrame, stop: F.Column, checkpoint: Checkpoint | None = None, max_rounds: int = 40) -> DataFrame:
    """(tu, id, ancestor) for one condition; nodes without such an ancestor are left out."""
    return nearest_ancestors(nodes, {"it": stop}, checkpoint, max_rounds).drop("stop")


def without_subtrees(nodes: DataFrame, bad: F.Column, checkpoint: Checkpoint | None = None) -> DataFrame:
    """nodes without those for which bad holds and all that is below them."""
    flagged = nodes.withColumn("__bad", bad)
    above = nearest_ancestor(flagged, F.col("__bad"), checkpoint).select("tu", "id")
    return flagged.where(~F.col("__bad")).join(above.hint("merge"), ["tu", "id"], "left_anti").drop("__bad")
