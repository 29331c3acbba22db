"""Pattern operators over vertices and edges: expansion, paths, closures, semi and anti patterns."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..model import Graph


def expand(rows: DataFrame, edges: DataFrame, from_col: str, to_col: str, *, t: str | None = None, reverse: bool = False, optional: bool = False, edge_col: str | None = None) -> DataFrame:
    """rows with to_col: the ids at the other ends of from_col's edges. optional keeps rows that have none, with null."""
    here, there = ("inbound_id", "outbound_id") if reverse else ("outbound_id", "inbound_id")
    found = edges if t is None else edges.where(F.col("t") == t)
    cols = [F.col(here).alias(from_col), F.col(there).alias(to_col)]
    if edge_col:
        cols.append(F.struct("outbound_id", "t", "inbound_id").alias(edge_col))
    return rows.join(found.select(*cols), from_col, "left" if optional else "inner")


def has_edge(rows: DataFrame, edges: DataFrame, id_col: str, *, t: str | None = None, reverse: bool = False, negate: bool = False) -> DataFrame:
    """Rows whose id_col has (or, negated, has no) edge."""
    here = "inbound_id" if reverse else "outbound_id"
    found = (edges if t is None else edges.where(F.col("t") == t)).select(F.col(here).alias(id_col))
    return rows.join(found, id_col, "left_anti" if negate else "left_semi")


def paths(starts: DataFrame, steps: DataFrame, low: int, high: int | None, checkpoint) -> DataFrame:
    """starts (id), steps (a, b, e: the edge's key, or t and back: see key_of) -> (start_id, end_id, length, edges): paths of low to high steps, no edge twice in a path.

    high None: as long as there are any, which ends because edges aren't used again. One join a step, each step written by
    checkpoint(df), so that none is computed again for the next.
    """
    now = starts.select(F.col("id").alias("start_id"), F.col("id").alias("end_id"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("edges"))
    out = now if low == 0 else None
    keyed = "e" in steps.columns
    step, e = (steps.select("a", "b", "e"), F.col("e")) if keyed else (steps.select("a", "b", "t", "back"), key_of())
    for n in count(1) if high is None else range(1, high + 1):
        now = now.join(step, now["end_id"] == step["a"]).where(~F.array_contains("edges", e))
        now = now.select("start_id", F.col("b").alias("end_id"), F.lit(n).alias("length"), F.array_append("edges", e).alias("edges"))
        now = checkpoint(now) if high is None or high > 1 else now
        if n >= low:
            out = now if out is None else out.union(now)
        if high is None and n >= low and now.isEmpty():
            break
    return out


def key_of() -> F.Column:
    """The key of a step's edge, from its ends (a, b), type (t) and whether it is gone against its direction (back). It is made after
    the join, as with it a step is more than twice as long to shuffle."""
    one, other = F.when(F.col("back"), F.col("b")).otherwise(F.col("a")), F.when(F.col("back"), F.col("a")).otherwise(F.col("b"))
    return F.concat_ws("|", one, F.col("t"), other)


def steps_of(edges: DataFrame, t: str | None = None) -> DataFrame:
    """Edges (of a type) as steps from source to target."""
    found = edges if t is None else edges.where(F.col("t") == t)
    return found.select(F.col("outbound_id").alias("a"), F.col("inbound_id").alias("b"), "t", F.lit(False).alias("back"))


def closure(spark: SparkSession, links: DataFrame, starts: DataFrame, checkpoint, max_rounds: int | None = None) -> DataFrame:
    """links (src, dst), starts (node) -> (start, node, depth): all that can be reached, with the smallest number of steps.

    Breadth first; each round joins only the newest nodes and is written by checkpoint(df), so lineage stays short. What was reached
    before is taken out of the newest at depths that are powers of two, so it is read a logarithm of the depth's times, not in every round; cycles end
    there, and what was reached again in between goes by the smallest depth. With max_rounds, nodes that are further away are an error.
    """
    seen = checkpoint(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    newest, due, repeated = seen, 1, False
    for depth in count(1):
        step = newest.join(links, newest["node"] == links["src"]).select("start", F.col("dst").alias("node")).distinct()
        if depth == due or (max_rounds is not None and depth > max_rounds):
            step, due = step.join(seen, ["start", "node"], "left_anti"), 2 * depth
        else:
            repeated = True
        newest = checkpoint(step.withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        if max_rounds is not None and depth > max_rounds:
            raise GraphError("INVALID_ARGUMENT", f"some nodes are more than {max_rounds} steps away")
        seen = seen.union(newest)
    return seen.groupBy("start", "node").agg(F.min("depth").alias("depth")) if repeated else seen


def labels(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("t").alias("label")).distinct()


def relationship_types(g: Graph) -> DataFrame:
    return g.edges.select(F.col("t").alias("relationshipType")).distinct()


def property_keys(g: Graph) -> DataFrame:
    keys = g.vertices.select(F.explode(F.map_keys("props")).alias("propertyKey")).distinct()
    return keys.union(g.edges.select(F.explode(F.map_keys("props")).alias("propertyKey")).distinct()).distinct()
