"""Steps at a vertex with many edges."""

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.model import EDGE_SCHEMA, VERTEX_SCHEMA, Graph
from graphloom.operators.patterns import at, edge, holding, match, node


def test_edges_of_a_hub_are_dealt_to_parts(spark):
    """Pairs at one vertex are many tasks', and what is at the edges' other ends is joined before them, not to each pair."""
    people = [(f"p{i}", "P", f"p{i}", {"n": str(i)}) for i in range(40)]
    g = Graph(spark.createDataFrame([("hub", "H", "hub", {}), *people], VERTEX_SCHEMA), spark.createDataFrame([(p[0], "hub", "IN", {}) for p in people], EDGE_SCHEMA))
    person = lambda name: holding(node(name, "P"), n=lambda text: text.cast("long"))
    pattern = person("a"), edge("IN"), node(label="H"), edge("IN", direction="in", spread=8), person("b")
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalescing)
    spark.conf.set(coalescing, "false")
    try:
        rows = match(g, *pattern).select(at("a", "n").alias("a"), at("b", "n").alias("b"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set(coalescing, before)
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for a in range(40) for b in range(40) if a != b]
    assert len({r.task for r in rows}) > 1
    whole = match(g, node("a", "P"), edge("IN"), node("h", "H"), edge("IN", name="r", direction="in", spread=3), node("b", "P", n=7)).select(at("a"), at("h"), at("b"), at("r", "key")).collect()
    assert {(r.a__id, r.h__id, r.b__id, r.r__key) for r in whole} == {(f"p{i}", "hub", "p7", "p7|IN|hub") for i in range(40) if i != 7} and len(whole) == 39
    assert match(g, node("a", "P"), edge("IN"), node("h"), edge("IN", direction="in", spread=3), node("a")).count() == 0  # a known vertex; the one edge isn't gone back along
    with pytest.raises(GraphError):
        edge("IN", hops=2, spread=2)
