"""A graph view over the star-schema tables: a row is a vertex, a foreign key an edge."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import properties
from ..model import Graph, edges_from, empty_props, vertices_from

#: label: (table, key columns)
VERTICES = {
    "Region": ("region", ["r_regionkey"]), "Nation": ("nation", ["n_nationkey"]), "Customer": ("customer", ["c_custkey"]), "Supplier": ("supplier", ["s_suppkey"]),
    "Part": ("part", ["p_partkey"]), "Orders": ("orders", ["o_orderkey"]), "Event": ("events", ["event_id"]), "Document": ("documents", ["doc_id"]), "Label": ("labels", ["doc_id"]), "Turn": ("conversations", ["conv_id", "turn"]),
}
#: type: (table, source (table, columns), target (table, columns), whether a pair can come more than once)
EDGES = {
    "IN_REGION": ("nation", ("nation", ["n_nationkey"]), ("region", ["n_regionkey"]), False),
    "LIVES_IN": ("customer", ("customer", ["c_custkey"]), ("nation", ["c_nationkey"]), False),
    "BASED_IN": ("supplier", ("supplier", ["s_suppkey"]), ("nation", ["s_nationkey"]), False),
    "PLACED_BY": ("orders", ("orders", ["o_orderkey"]), ("customer", ["o_custkey"]), False),
    "CONTAINS": ("lineitem", ("orders", ["l_orderkey"]), ("part", ["l_partkey"]), True),
    "SUPPLIED_BY": ("lineitem", ("part", ["l_partkey"]), ("supplier", ["l_suppkey"]), True),
    "LABELS": ("labels", ("labels", ["doc_id"]), ("documents", ["doc_id"]), False),
}
#: Properties of edges: columns of the edge's table.
EDGE_PROPS = {"LIVES_IN": ["c_mktsegment"], "PLACED_BY": ["o_orderstatus"]}


def usr(table: str, columns: list) -> F.Column:
    return F.concat_ws(":", F.lit(table), *[c.cast("string") if isinstance(c, F.Column) else F.col(c).cast("string") for c in columns])


def usr_sql(table: str, columns: list[str]) -> str:
    return " || ':' || ".join([f"'{table}'", *[f"({c})::VARCHAR" for c in columns]])


#: Schemas by path: the graph has all tables, and looking a schema up in a file is a job of its own.
_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def vertices(spark: SparkSession, sf_dir: str, *labels: str) -> DataFrame:
    """Vertices of the labels (default: all)."""
    out = None
    for t in labels or VERTICES:
        table, key = VERTICES[t]
        df = read(spark, sf_dir, table)
        props = properties(**{c: F.col(c).cast("string") if kind.startswith("timestamp") else F.col(c) for c, kind in df.dtypes})
        part = vertices_from(df.select(F.lit(t).alias("t"), usr(table, key).alias("usr"), props.alias("props")))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """Edges of the types (default: all, with NEXT_TURN); a pair that comes more than once is one edge."""
    out = None
    for t in types or [*EDGES, "NEXT_TURN"]:
        if t == "NEXT_TURN":
            turns = read(spark, sf_dir, "conversations").select("conv_id", "turn")
            later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
            links = turns.join(later, ["conv_id", "turn"]).select(usr("conversations", ["conv_id", "turn"]).alias("source_usr"), usr("conversations", ["conv_id", F.col("turn") + 1]).alias("target_usr"), F.lit(t).alias("t"))
        else:
            table, (source, source_key), (target, target_key), repeated = EDGES[t]
            df = read(spark, sf_dir, table)
            # the keys are made distinct before the ids are computed: fewer bytes shuffled, fewer hashes
            df = df.select(*source_key, *target_key).distinct() if repeated else df
            props = properties(**{c: F.col(c) for c in EDGE_PROPS[t]}) if t in EDGE_PROPS else empty_props()
            links = df.select(usr(source, source_key).alias("source_usr"), usr(target, target_key).alias("target_usr"), F.lit(t).alias("t"), props.alias("props"))
        part = edges_from(links if "props" in links.columns else links.withColumn("props", empty_props()))
        out = part if out is None else out.unionByName(part)
    return out


class TableGraph(Graph):
    """The view as a graph: named labels and types are planned from their own tables, the whole only where it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def vertices(self) -> DataFrame:
        return vertices(self.spark, self.sf_dir)

    @cached_property
    def edges(self) -> DataFrame:
        return edges(self.spark, self.sf_dir)

    def vertices_typed(self, *labels: str) -> DataFrame:
        known = [t for t in VERTICES if t in labels]
        return vertices(self.spark, self.sf_dir, *known) if known else super().vertices_typed(*labels)

    def edges_typed(self, *types: str) -> DataFrame:
        known = [t for t in [*EDGES, "NEXT_TURN"] if t in types]
        return edges(self.spark, self.sf_dir, *known) if known else super().edges_typed(*types)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return TableGraph(spark, sf_dir)
