"""The seven read-only graph verbs.

Each gives rows in a fixed order under a limit; without a limit, all rows in no order. A type filter and a key filter are
pushed to the scan; a limit over an order is a top-k in each task and one merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import EDGE_KEY, Graph, empty_props

OUTBOUND, INBOUND = "outbound", "inbound"


def first_rows(df: DataFrame, key: tuple[str, ...], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*key).limit(limit)


def all_vertices(g: Graph, limit: int | None = None) -> DataFrame:
    return first_rows(g.vertices, ("id",), limit)


def all_edges(g: Graph, limit: int | None = None) -> DataFrame:
    return first_rows(g.edges, EDGE_KEY, limit)


def vertex_with_type(g: Graph, t: str, limit: int | None = None) -> DataFrame:
    return first_rows(g.vertices_typed(t), ("id",), limit)


def edge_with_type(g: Graph, t: str, limit: int | None = None) -> DataFrame:
    return first_rows(g.edges_typed(t), EDGE_KEY, limit)


def vertex_with_property_equal(g: Graph, name: str, value: object, limit: int | None = None) -> DataFrame:
    return first_rows(g.vertices_with(name, value), ("id",), limit)


def edge_with_property_equal(g: Graph, name: str, value: object, limit: int | None = None) -> DataFrame:
    return first_rows(g.edges_with(name, value), EDGE_KEY, limit)


def pipe_edges(g: Graph, vertex_id: str, direction: str, t: str | None = None, limit: int | None = None, seen: Observation | None = None) -> DataFrame:
    """seen: gets n, the number of edges before the limit, from the job that runs anyway."""
    found = g.edges_at([vertex_id], direction, t)
    return first_rows(found if seen is None else found.observe(seen, F.count(F.lit(1)).alias("n")), EDGE_KEY, limit)


def pipe(g: Graph, vertex_id: str, direction: str, t: str | None = None, limit: int | None = None, seen: Observation | None = None) -> DataFrame:
    """One hop: neighbours over the vertex's edges, of which the limit is taken first.

    Parallel edges give a row each. A neighbour that isn't stored gives none, though its edge counts for the limit.
    """
    there = "inbound_id" if direction == OUTBOUND else "outbound_id"
    ends = pipe_edges(g, vertex_id, direction, t, limit, seen).select(F.col(there).alias("id"))
    return g.neighbours(ends, limit)


def specific_vertices(g: Graph, ids: DataFrame) -> DataFrame:
    """Vertices of the given ids (id)."""
    return g.vertices_in(ids)


def specific_edges(g: Graph, keys: DataFrame) -> DataFrame:
    """Edges of the given keys (outbound_id, t, inbound_id)."""
    return g.edges_in(keys)


def attach_properties(items: DataFrame, props: DataFrame, key: list[str]) -> DataFrame:
    """items with props, looked up by key; an empty map where there are none."""
    return items.join(props.select(*key, "props"), key, "left").withColumn("props", F.coalesce("props", empty_props()))
