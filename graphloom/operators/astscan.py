"""Scans of syntax trees: line ranges, depth, budgets, edges, diagnostics.

nodes: tu, id (preorder), parent_id, kind, spelling, usr, type, storage_class, start_line, start_col, end_line, end_col.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import Checkpoint, shared_writer
from .trees import without_subtrees

#: Kinds of children that make an edge more than a child; names of severities.
TYPE_REF_KINDS = ("TYPE_REF", "TEMPLATE_REF", "NAMESPACE_REF", "OVERLOADED_DECL_REF")
CALL_KINDS = ("CALL_EXPR", "CXX_METHOD")
SEVERITIES = ("NOTE", "WARNING", "WARNING", "ERROR", "FATAL")
FIELDS = ("id", "kind", "spelling", "usr", "type", "storage_class", "start_line", "start_col", "end_line", "end_col")


def in_line_range(nodes: DataFrame, low: int, high: int, checkpoint: Checkpoint | None = None) -> DataFrame:
    """Nodes that overlap the lines; a node that doesn't takes all below it along."""
    return without_subtrees(nodes, ~((F.col("start_line") <= high) & (F.col("end_line") >= low)), checkpoint)


def with_depth(nodes: DataFrame, max_depth: int, checkpoint: Checkpoint | None = None) -> DataFrame:
    """Nodes of at most max_depth steps below a root, with depth: one join a level, of which only keys are written for the next.

    Ends early where no level has nodes any more."""
    checkpoint = checkpoint or shared_writer(nodes.sparkSession)
    level = checkpoint(nodes.where("parent_id IS NULL").select("tu", "id", F.lit(0).alias("depth")))
    out = level
    for d in range(1, max_depth + 1):
        above = level.select("tu", F.col("id").alias("parent_id"))
        level = checkpoint(nodes.select("tu", "id", "parent_id").join(above, ["tu", "parent_id"]).select("tu", "id", F.lit(d).alias("depth")))
        if level.isEmpty():
            break
        out = out.union(level)
    return nodes.join(out, ["tu", "id"]).select(*nodes.columns, "depth")


def depth_cut(nodes: DataFrame, max_depth: int, checkpoint: Checkpoint | None = None) -> DataFrame:
    """with_depth and truncated: whether a node at the last level has children in the tree."""
    kept = with_depth(nodes, max_depth, checkpoint)
    parents = nodes.where("parent_id IS NOT NULL").select("tu", F.col("parent_id").alias("id"), F.lit(True).alias("has_child")).distinct()
    return kept.join(parents, ["tu", "id"], "left").withColumn("truncated", (F.col("depth") >= max_depth) & F.coalesce("has_child", F.lit(False))).drop("has_child")


def json_string_bytes(text: Column) -> Column:
    """Length of the text as a JSON string of ASCII characters: other characters are six each, or twelve beyond the basic plane."""
    safe = F.coalesce(text, F.lit(""))
    short = F.length(safe) - F.length(F.regexp_replace(safe, r'["\\\n\r\t\x08\f]', ""))
    other = F.length(safe) - F.length(F.regexp_replace(safe, r"[\x00-\x07\x0b\x0e-\x1f\x{80}-\x{ffff}]", ""))
    far = F.length(safe) - F.length(F.regexp_replace(safe, r"[\x{10000}-\x{10ffff}]", ""))
    return F.length(safe) + 2 + short + 5 * other + 11 * far


def node_bytes() -> Column:
    """Length of a node's JSON object with ', ' and ': ' between its ten fields."""
    total = F.lit(2 + 2 * (len(FIELDS) - 1) + sum(len(f) + 4 for f in FIELDS))
    for f in FIELDS:
        number = f.endswith(("_line", "_col"))
        total = total + (F.length(F.coalesce(F.col(f), F.lit(0)).cast("string")) if number or f == "id" else json_string_bytes(F.col(f)))
    return total


def budget_cut(nodes: DataFrame, max_nodes: int = 5000, max_bytes: int = 1 << 20, bytes_of: Column | None = None) -> DataFrame:
    """Nodes in preorder while the unit's budget lasts, with truncated on the one that reaches it: the node that reaches a cap is kept.

    Only a unit's first max_nodes can be kept, so a row_number limit precedes the running sum.
    """
    w = W.partitionBy("tu").orderBy("id")
    size = node_bytes() if bytes_of is None else bytes_of
    first = nodes.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_nodes).withColumn("__size", size)
    run = first.withColumn("__sum", F.sum("__size").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    kept = run.where(F.col("__sum") - F.col("__size") < max_bytes)
    return kept.withColumn("truncated", (F.col("__n") >= max_nodes) | (F.col("__sum") >= max_bytes)).drop("__n", "__size", "__sum")


def tree_edges(nodes: DataFrame) -> DataFrame:
    """(tu, source_id, target_id, edge_type) from parents to children."""
    t = F.when(F.col("kind").isin(*TYPE_REF_KINDS), "TYPE_REF").when(F.col("kind").isin(*CALL_KINDS), "CALL").otherwise("CHILD")
    parents = nodes.select("tu", F.col("id").alias("source_id"))
    return nodes.where("parent_id IS NOT NULL").select("tu", F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), t.alias("edge_type")).join(parents, ["tu", "source_id"], "left_semi")


def severity(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), F.when((code >= 0) & (code < len(SEVERITIES)), code.cast("int"))), F.lit("UNKNOWN"))


def diagnostics(rows: DataFrame) -> DataFrame:
    return rows.select("tu", severity(F.col("severity")).alias("severity"), "message", "file", "line", "col")


def failed_units(nodes: DataFrame, diags: DataFrame) -> DataFrame:
    """Units (tu) with a fatal diagnostic and no cursor below the root."""
    return diags.groupBy("tu").agg(F.max("severity").alias("s")).where("s >= 4").select("tu").join(nodes.where("parent_id IS NOT NULL").select("tu"), "tu", "left_anti")


def tree_texts(nodes: DataFrame, max_depth: int, checkpoint: Checkpoint | None = None) -> DataFrame:
    """(tu, id, tree): each root as one JSON text of its fields and children, these in preorder, down to max_depth.

    A fold from the leaves up: a level's texts, in the order of ids, become the children of the level above. A node whose parent
    isn't in nodes (after in_line_range, say) is a root. The text of a unit is one value, so nodes should be within a budget
    (budget_cut) before.
    """
    checkpoint = checkpoint or shared_writer(nodes.sparkSession)
    nodes = checkpoint(nodes)  # read by each level below; what nodes are made from isn't computed for each
    here = nodes.select("tu", F.col("id").alias("parent_id"))
    lost = nodes.where("parent_id IS NOT NULL").join(here, ["tu", "parent_id"], "left_anti").select("tu", "id", F.lit(True).alias("lost"))
    rooted = nodes.join(lost, ["tu", "id"], "left").withColumn("parent_id", F.when(F.col("lost").isNull(), F.col("parent_id"))).drop("lost")
    levels = checkpoint(with_depth(checkpoint(rooted), max_depth, checkpoint))
    deepest = levels.agg(F.max("depth")).first()[0]
    own = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = levels.where(F.col("depth") == depth).select("tu", "id", "parent_id", own.alias("own"))
        if below is None:
            level = level.withColumn("children", F.lit(""))
        else:
            texts = below.groupBy("tu", F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "tree"))), lambda c: c["tree"]), ",").alias("children"))
            level = level.join(texts, ["tu", "id"], "left")
        tree = F.concat(F.expr("left(own, length(own) - 1)"), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        below = checkpoint(level.select("tu", "id", "parent_id", tree.alias("tree")))
    return nodes.sparkSession.createDataFrame([], "tu string, id long, tree string") if below is None else below.select("tu", "id", "tree")
