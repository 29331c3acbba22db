"""The property graph: DataFrames of vertices and edges.

vertices: id, t (label), usr, props. edges: outbound_id, inbound_id, t (type), props. props is a map from property
name to JSON text. An edge is identified by (outbound_id, t, inbound_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.ids import vertex_id
from .functions.scalars import equals

#: The vocabulary of code graphs and its version. Stores accept other labels and types as well.
LABELS = ("File", "Namespace", "Class", "Function", "Variable", "GlobalVariable", "Field", "Parameter", "Type", "Macro", "TypeAlias")
EDGE_TYPES = ("DEFINES", "DECLARES", "CALLS", "INHERITS", "REFERENCES", "INCLUDES", "MEMBER_OF", "RETURNS", "HAS_PARAM", "OF_TYPE", "POINTS_TO", "REFERS_TO")
SCHEMA_VERSION = "v2"

PROPS = "map<string,string>"
VERTEX_SCHEMA = f"id string, t string, usr string, props {PROPS}"
EDGE_SCHEMA = f"outbound_id string, inbound_id string, t string, props {PROPS}"
EDGE_KEY = ("outbound_id", "t", "inbound_id")


@dataclass
class Graph:
    """Look-ups are filters here; a stored graph (sources/store.py) answers them from few files, a view over tables
    (sources/tables.py) from the tables of the labels and types that are named."""

    vertices: DataFrame
    edges: DataFrame

    def vertices_typed(self, *labels: str) -> DataFrame:
        """Vertices of any of the labels; of all, if none is named."""
        return self.vertices.where(F.col("t").isin(*labels)) if labels else self.vertices

    def edges_typed(self, *types: str) -> DataFrame:
        """Edges of any of the types; of all, if none is named."""
        return self.edges.where(F.col("t").isin(*types)) if types else self.edges

    def vertices_of(self, ids: list[str]) -> DataFrame:
        return self.vertices.where(F.col("id").isin(ids))

    def edges_at(self, ids: list[str], direction: str = "outbound", t: str | None = None) -> DataFrame:
        """Edges whose end on that side is one of ids."""
        return self.edges_typed(*([] if t is None else [t])).where(F.col(f"{direction}_id").isin(ids))

    def vertices_in(self, ids: DataFrame) -> DataFrame:
        """Vertices whose id is in a table (id)."""
        return self.vertices.join(ids.select("id"), "id", "left_semi")

    def edges_in(self, keys: DataFrame) -> DataFrame:
        """Edges whose key is in a table (outbound_id, t, inbound_id)."""
        return self.edges.join(keys.select(*EDGE_KEY), list(EDGE_KEY), "left_semi")

    def vertices_with(self, name: str, value: object) -> DataFrame:
        return self.vertices.where(equals(F.try_element_at("props", F.lit(name)), value))

    def edges_with(self, name: str, value: object) -> DataFrame:
        return self.edges.where(equals(F.try_element_at("props", F.lit(name)), value))

    def neighbours(self, ends: DataFrame, few: int | None) -> DataFrame:
        """Vertices by the ids of ends (id), one row for each of its rows; few: how many there are at most."""
        return self.vertices.join(ends, "id")


def empty_props() -> Column:
    return F.create_map().cast(PROPS)


def vertices_from(nodes: DataFrame) -> DataFrame:
    """nodes (t, usr, props) with ids."""
    return nodes.select(vertex_id(F.col("usr")).alias("id"), "t", "usr", "props")


def edges_from(links: DataFrame) -> DataFrame:
    """links (source_usr, target_usr, t, props) with ids for the ends."""
    return links.select(vertex_id(F.col("source_usr")).alias("outbound_id"), vertex_id(F.col("target_usr")).alias("inbound_id"), "t", "props")
