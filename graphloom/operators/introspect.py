"""What a graph's labels, edge types and properties are, counted and sampled live."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import as_string
from ..model import EDGE_KEY, SCHEMA_VERSION, Graph

#: The names that may be put into generated queries.
SAFE_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
NOTES = ("Property keys come from a sample of each type and may miss rare ones.", "Counts are live; ingestion at the same time may shift them.")


def type_counts(items: DataFrame) -> DataFrame:
    """(name, count): partial counts meet in one row per type."""
    return items.groupBy(F.col("t").alias("name")).agg(F.count("*").alias("count"))


def sampled_keys(items: DataFrame, key: tuple[str, ...], sample: int = 100) -> DataFrame:
    """(name, property_keys): sorted names of the properties of the first items of each type, by key.

    The first items are found by keeping the sample smallest of each task and type (Spark's window group limit), so a
    type that holds most rows doesn't meet in one task.
    """
    first = items.select("t", *[k for k in key if k != "t"], F.map_keys("props").alias("k")).withColumn("n", F.row_number().over(W.partitionBy("t").orderBy(*key))).where(F.col("n") <= sample)
    return first.select("t", F.explode_outer("k").alias("k")).groupBy(F.col("t").alias("name")).agg(F.array_sort(F.collect_set("k")).alias("property_keys"))


def sampled_key_sets(items: DataFrame, sample: int = 100) -> DataFrame:
    """(name, property_keys) from that many distinct sets of names instead of items; types with unsafe names are left out."""
    sets = items.where(F.col("t").rlike(SAFE_NAME)).select("t", F.array_sort(F.map_keys("props")).alias("k")).distinct()
    first = sets.withColumn("n", F.row_number().over(W.partitionBy("t").orderBy("k"))).where(F.col("n") <= sample)
    return first.groupBy(F.col("t").alias("name")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("property_keys"))


def describe(items: DataFrame, key: tuple[str, ...], sample: int = 100) -> DataFrame:
    """(name, count, property_keys), the most frequent types first."""
    return type_counts(items).join(sampled_keys(items, key, sample), "name", "left").withColumn("property_keys", F.coalesce("property_keys", F.array().cast("array<string>"))).orderBy(F.desc("count"), "name")


def totals(g: Graph) -> DataFrame:
    """(kind, total) for vertices and edges."""
    return g.vertices.agg(F.count("*").alias("total")).select(F.lit("vertices").alias("kind"), "total").union(g.edges.agg(F.count("*").alias("total")).select(F.lit("edges").alias("kind"), "total"))


def version_state(vertices: DataFrame) -> DataFrame:
    """One row: versions found on File vertices other than the current one; whether the current one, and whether files without any, are there.

    A file without properties counts for nothing."""
    files = vertices.where((F.col("t") == "File") & (F.size("props") > 0))
    stored = F.try_element_at("props", F.lit("schema_version"))
    version = F.coalesce(as_string(stored), stored)
    return files.agg(
        F.array_sort(F.collect_set(F.when(version != SCHEMA_VERSION, version))).alias("other"),
        F.coalesce(F.bool_or(version == SCHEMA_VERSION), F.lit(False)).alias("current"),
        F.coalesce(F.bool_or(version.isNull()), F.lit(False)).alias("unstamped"),
    )


def version_notes(vertices: DataFrame) -> DataFrame:
    """(note): one for each other version; or one if all files lack a stamp."""
    state = version_state(vertices)
    skewed = F.transform("other", lambda v: F.concat(F.lit("File vertices have schema_version="), v, F.lit(f"; the code is at {SCHEMA_VERSION}. Ingest again to stamp them anew.")))
    bare = F.array(F.lit(f"No File vertex has a schema_version; the code is at {SCHEMA_VERSION}. Ingest again to stamp them."))
    none = F.array().cast("array<string>")
    return state.select(F.explode(F.when(F.size("other") > 0, skewed).when(F.col("unstamped") & ~F.col("current"), bare).otherwise(none)).alias("note"))


@dataclass
class Description:
    schema_version: str
    node_types: list[dict]
    edge_types: list[dict]
    totals: dict[str, int]
    notes: list[str]


def description(g: Graph, sample: int = 100) -> Description:
    """The whole description on the driver: one row for each type, a few notes."""
    nodes = [r.asDict() for r in describe(g.vertices, ("id",), sample).collect()]
    links = [r.asDict() for r in describe(g.edges, EDGE_KEY, sample).collect()]
    sums = {"vertices": sum(r["count"] for r in nodes), "edges": sum(r["count"] for r in links)}
    return Description(SCHEMA_VERSION, nodes, links, sums, [*NOTES, *(r.note for r in version_notes(g.vertices).collect())])
