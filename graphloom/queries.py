"""A query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphError
from .functions import tokens as T
from .functions.ids import file_usr, type_usr, vertex_id, vertex_id_sql
from .functions.scalars import as_string, greatest_of, less, nested_text, properties, same, shown, sort_key
from .lineage import cut_lineage, shared_dir, shared_writer
from .model import EDGE_KEY, PROPS, Graph, empty_props, vertices_from
from .operators import astscan, extract, includes, introspect, position, preproc, traverse, upsert, verbs
from .operators.patterns import as_node, as_path, as_relationship, at, edge, holding, match, matching, node, prop
from .plans import verbs_json
from .plans.guard import codes, read_only_sql
from .sources import tables
from .sources.cursor_view import CURSORS_SQL, cursors
from .sources.files import compile_db, flags_of, resolve_flags, source_files
from .sources.store import ParquetStore, changed_documents, edge_documents, node_documents
from .sources.units import UnitCache, unit_rows
from .streaming.ingest import ingest_files, unit_errors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def v_sql(*labels: str) -> str:
    parts = []
    for t in labels or tables.VERTICES:
        table, key = tables.VERTICES[t]
        parts.append(f"SELECT {vertex_id_sql('usr')} AS id, '{t}' AS t, usr FROM (SELECT {tables.usr_sql(table, key)} AS usr FROM {table})")
    return " UNION ALL ".join(parts)


def e_sql(*types: str) -> str:
    parts = []
    for t in types or [*tables.EDGES, "NEXT_TURN"]:
        if t == "NEXT_TURN":
            rows = "SELECT 'conversations:' || a.conv_id || ':' || a.turn AS s, 'conversations:' || b.conv_id || ':' || b.turn AS d FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
        else:
            table, (s, sk), (d, dk), repeated = tables.EDGES[t]
            rows = f"SELECT {'DISTINCT' if repeated else ''} {tables.usr_sql(s, sk)} AS s, {tables.usr_sql(d, dk)} AS d FROM {table}"
        parts.append(f"SELECT {vertex_id_sql('s')} AS outbound_id, {vertex_id_sql('d')} AS inbound_id, '{t}' AS t FROM ({rows})")
    return " UNION ALL ".join(parts)


def id_of(usr: str) -> str:
    return str(uuid.uuid5(uuid.UUID("8f6e2c1b-7d3a-4f59-9a4b-1c0d2e5f8a91"), usr))


def verb(g: Graph, verb_: str, limit_: int | None = None, **args) -> DataFrame:
    """The verb in its JSON form, parsed and planned."""
    df = verbs_json.plan(verbs_json.parse(json.dumps({"query": verb_, "args": args})), g, limit_)
    return df.select("id", "t", "usr") if "usr" in df.columns else df.select("outbound_id", "inbound_id", "t")


def sorted_json(props: F.Column) -> F.Column:
    """All properties as one text: name=JSON, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


# ---------------------------------------------------------------- verbs


@query(v_sql())
def verb_all_vertices(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "all_vertices")


@query(e_sql())
def verb_all_edges(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "all_edges")


@query(v_sql("Customer"))
def verb_vertex_with_type(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "vertex_with_type", t="Customer")


@query(e_sql("PLACED_BY"))
def verb_edge_with_type(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "edge_with_type", t="PLACED_BY")


@query(f"SELECT {vertex_id_sql('usr')} AS id, 'c_custkey=' || c_custkey || ';c_mktsegment=\"' || c_mktsegment || '\";c_name=\"' || c_name || '\";c_nationkey=' || c_nationkey AS props FROM (SELECT *, 'customer:' || c_custkey AS usr FROM customer)")
def verb_properties(spark, sf_dir):
    """The properties of a type's vertices, whole (but for one that is a fraction, which SQL writes in another way)."""
    g = tables.graph(spark, sf_dir)
    df = verbs_json.plan(verbs_json.parse(json.dumps({"query": "vertex_with_type", "args": {"t": "Customer"}})), g)
    return df.select("id", sorted_json(F.map_filter("props", lambda k, _: k != "c_acctbal")).alias("props"))


@query("SELECT 'outbound=' || 'c_mktsegment=\"' || c_mktsegment || '\"' AS props, count(*) AS n FROM customer GROUP BY c_mktsegment")
def verb_edge_properties(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    df = verbs_json.plan(verbs_json.parse(json.dumps({"query": "edge_with_type", "args": {"t": "LIVES_IN"}})), g)
    return df.groupBy(F.concat(F.lit("outbound="), sorted_json(F.col("props"))).alias("props")).agg(F.count("*").alias("n"))


@query(f"SELECT {vertex_id_sql('usr')} AS id, 'Customer' AS t, usr FROM (SELECT 'customer:' || c_custkey AS usr FROM customer WHERE c_mktsegment = 'BUILDING')")
def verb_vertex_prop_equal(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "vertex_with_property_equal", name="c_mktsegment", value="BUILDING")


@query(v_sql(*[t for t in tables.VERTICES if t != "Orders"]) + f" UNION ALL SELECT {vertex_id_sql('usr')}, 'Orders', usr FROM (SELECT 'orders:' || o_orderkey AS usr FROM orders WHERE o_orderstatus IS NULL)")
def verb_vertex_prop_equal_null(spark, sf_dir):
    """null matches a missing property."""
    return verb(tables.graph(spark, sf_dir), "vertex_with_property_equal", name="o_orderstatus", value=None)


@query(f"SELECT {vertex_id_sql('usr')} AS id, 'Part' AS t, usr FROM (SELECT 'part:' || p_partkey AS usr FROM part WHERE p_size = 1) UNION ALL SELECT {vertex_id_sql('usr')} AS id, 'Label' AS t, usr FROM (SELECT 'labels:' || doc_id AS usr FROM labels WHERE 1 = 0)")
def verb_vertex_prop_equal_bool_int(spark, sf_dir):
    """true equals 1."""
    return verb(tables.graph(spark, sf_dir), "vertex_with_property_equal", name="p_size", value=True)


@query(f"SELECT {vertex_id_sql('s')} AS outbound_id, {vertex_id_sql('d')} AS inbound_id, 'PLACED_BY' AS t FROM (SELECT 'orders:' || o_orderkey AS s, 'customer:' || o_custkey AS d FROM orders WHERE o_orderstatus = 'F')")
def verb_edge_prop_equal(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "edge_with_property_equal", name="o_orderstatus", value="F")


@query(f"SELECT v.* FROM ({e_sql()}) e JOIN ({v_sql()}) v ON e.inbound_id = v.id WHERE e.outbound_id = '{id_of('customer:1')}'")
def verb_pipe_out(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "pipe", vertex_id=id_of("customer:1"), direction="outbound")


@query(f"SELECT v.* FROM ({e_sql()}) e JOIN ({v_sql()}) v ON e.outbound_id = v.id WHERE e.inbound_id = '{id_of('nation:3')}'")
def verb_pipe_in(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "pipe", vertex_id="{" + id_of("nation:3").upper() + "}", direction="inbound")


@query(f"SELECT v.* FROM ({e_sql('LIVES_IN')}) e JOIN ({v_sql('Customer')}) v ON e.outbound_id = v.id WHERE e.inbound_id = '{id_of('nation:3')}'")
def verb_pipe_typed(spark, sf_dir):
    return verb(tables.graph(spark, sf_dir), "pipe", vertex_id=id_of("nation:3"), direction="inbound", t="LIVES_IN")


@query(f"SELECT * FROM ({v_sql()}) ORDER BY id LIMIT 200")
def verb_row_limit(spark, sf_dir):
    """The limit is the feature: the first rows by id."""
    return verb(tables.graph(spark, sf_dir), "all_vertices", limit_=200)


@query(f"SELECT * FROM ({v_sql()}) WHERE usr IN ('customer:1', 'part:7', 'region:2', 'no:1')")
def specific_vertices(spark, sf_dir):
    ids = spark.createDataFrame([(id_of(u),) for u in ("customer:1", "part:7", "region:2", "no:1")], "id string")
    return verbs.specific_vertices(tables.graph(spark, sf_dir), ids).select("id", "t", "usr")


@query(f"SELECT * FROM ({e_sql('LIVES_IN')}) WHERE outbound_id IN ('{id_of('customer:1')}', '{id_of('customer:2')}')")
def specific_edges(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    keys = tables.read(spark, sf_dir, "customer").where("c_custkey IN (1, 2)").select(vertex_id(tables.usr("customer", ["c_custkey"])).alias("outbound_id"), F.lit("LIVES_IN").alias("t"), vertex_id(tables.usr("nation", ["c_nationkey"])).alias("inbound_id"))
    return verbs.specific_edges(g, keys).select("outbound_id", "inbound_id", "t")


@query(f"SELECT v.id, CASE WHEN c_mktsegment IS NULL THEN 0 ELSE 1 END AS has_segment FROM ({v_sql('Customer')}) v LEFT JOIN (SELECT 'customer:' || c_custkey AS usr, c_mktsegment FROM customer WHERE c_custkey % 2 = 0) c ON v.usr = c.usr")
def attach_properties(spark, sf_dir):
    v = tables.vertices(spark, sf_dir, "Customer")
    stored = v.where(F.element_at(F.split("usr", ":"), 2).cast("long") % 2 == 0)
    out = verbs.attach_properties(v.select("id", "t"), stored, ["id"])
    return out.select("id", F.map_contains_key("props", "c_mktsegment").cast("int").alias("has_segment"))


# ---------------------------------------------------------------- introspection


@query(f"SELECT t AS name, count(*) AS count FROM ({v_sql()}) GROUP BY t")
def describe_node_types(spark, sf_dir):
    return introspect.type_counts(tables.vertices(spark, sf_dir)).orderBy(F.desc("count"), "name")


@query(f"SELECT t AS name, count(*) AS count FROM ({e_sql()}) GROUP BY t")
def describe_edge_types(spark, sf_dir):
    return introspect.type_counts(tables.edges(spark, sf_dir)).orderBy(F.desc("count"), "name")


@query(f"SELECT 'vertices' AS kind, (SELECT count(*) FROM ({v_sql()})) AS total UNION ALL SELECT 'edges', (SELECT count(*) FROM ({e_sql()}))")
def describe_totals(spark, sf_dir):
    return introspect.totals(tables.graph(spark, sf_dir))


def keys_sql(label: str, columns: list[str], sample: int) -> str:
    table, key = tables.VERTICES[label]
    first = f"SELECT * FROM {table} ORDER BY {vertex_id_sql(tables.usr_sql(table, key))} LIMIT {sample}"
    return " UNION ALL ".join(f"SELECT '{label}' AS name, '{c}' AS k WHERE EXISTS (SELECT 1 FROM ({first}) WHERE {c} IS NOT NULL)" for c in columns)


KEYED = {"Customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "Region": ["r_regionkey", "r_name"], "Label": ["doc_id", "quality", "toxic"]}


@query(f"SELECT name, string_agg(k, ',' ORDER BY k) AS property_keys FROM ({' UNION ALL '.join(keys_sql(t, c, 100) for t, c in KEYED.items())}) GROUP BY name")
def describe_keys_sampled(spark, sf_dir):
    found = introspect.sampled_keys(tables.vertices(spark, sf_dir, *KEYED), ("id",), 100)
    return found.select("name", F.array_join("property_keys", ",").alias("property_keys"))


@query("""WITH s AS (SELECT DISTINCT list_sort(list_filter(['name', CASE WHEN c_custkey % 2 = 0 THEN 'segment' END, CASE WHEN c_custkey % 3 = 0 THEN 'vip' END], lambda k: k IS NOT NULL)) AS k FROM customer),
f AS (SELECT k FROM s ORDER BY k LIMIT 2) SELECT 'Customer' AS name, string_agg(DISTINCT x, ',' ORDER BY x) AS property_keys FROM (SELECT unnest(k) AS x FROM f)""")
def describe_key_sets(spark, sf_dir):
    """The sample is the feature: two of four sets of names."""
    customers = tables.read(spark, sf_dir, "customer")
    some = properties(name=F.col("c_name"), segment=F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), vip=F.when(F.col("c_custkey") % 3 == 0, F.lit(True)))
    found = introspect.sampled_key_sets(vertices_from(customers.select(F.lit("Customer").alias("t"), tables.usr("customer", ["c_custkey"]).alias("usr"), some.alias("props"))), 2)
    return found.select("name", F.array_join("property_keys", ",").alias("property_keys"))


@query("SELECT DISTINCT 'File vertices have schema_version=v' || (doc_id % 5) || '; the code is at v2. Ingest again to stamp them anew.' AS note FROM documents WHERE doc_id % 5 IN (0, 1)")
def describe_version_notes(spark, sf_dir):
    stamp = F.when(F.col("doc_id") % 5 < 3, F.concat(F.lit("v"), (F.col("doc_id") % 5).cast("string")))
    nodes = tables.read(spark, sf_dir, "documents").select(F.lit("File").alias("t"), tables.usr("file", ["doc_id"]).alias("usr"), properties(path=F.col("source"), schema_version=stamp).alias("props"))
    return introspect.version_notes(vertices_from(nodes))


# ---------------------------------------------------------------- upserts


def upsert_inputs(spark, sf_dir):
    customers = tables.read(spark, sf_dir, "customer")
    usr = tables.usr("customer", ["c_custkey"])
    store = vertices_from(customers.where("c_custkey % 3 <> 0").select(F.lit("Customer").alias("t"), usr.alias("usr"), properties(segment=F.col("c_mktsegment"), name=F.col("c_name")).alias("props")))
    late = customers.where("c_custkey % 2 = 0").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    batch = late.select(vertex_id(usr).alias("id"), F.lit("Client").alias("t"), usr.alias("usr"), properties(segment=F.concat(F.lit("late"), F.col("n").cast("string")), vip=F.col("n") == 2).alias("props"), F.col("n").alias("seq"))
    return store, batch


UPSERTED = f"""
SELECT {vertex_id_sql("'customer:' || c_custkey")} AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'Customer' ELSE 'Client' END AS t,
  CASE WHEN c_custkey % 2 = 0 THEN 'late2' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'true' END AS vip
FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"""


def flat(items: DataFrame) -> DataFrame:
    get = lambda k: F.try_element_at("props", F.lit(k))
    return items.select("id", "t", as_string(get("segment")).alias("segment"), as_string(get("name")).alias("name"), get("vip").alias("vip"))


@query(UPSERTED)
def upsert_vertices(spark, sf_dir):
    return flat(upsert.upsert_vertices(*upsert_inputs(spark, sf_dir)).items)


@query(UPSERTED)
def upsert_idempotent(spark, sf_dir):
    store, batch = upsert_inputs(spark, sf_dir)
    return flat(upsert.upsert_vertices(upsert.upsert_vertices(store, batch).items, batch).items)


@query("SELECT count(*) FILTER (c_custkey % 3 = 0) AS inserted, 2 * count(*) AS attempted FROM customer WHERE c_custkey % 2 = 0")
def upsert_vertices_counts(spark, sf_dir):
    done = upsert.upsert_vertices(*upsert_inputs(spark, sf_dir))
    return done.inserted.select(F.col("n").alias("inserted")).join(done.attempted.select(F.col("n").alias("attempted")))


@query(f"SELECT {vertex_id_sql("'orders:' || o_orderkey")} AS outbound_id, {vertex_id_sql("'customer:' || o_custkey")} AS inbound_id, 'PLACED_BY' AS t FROM orders WHERE o_custkey % 7 <> 0")
def upsert_edges_dangling(spark, sf_dir):
    """Edges to customers that aren't stored are dropped."""
    held = tables.vertices(spark, sf_dir, "Orders", "Customer").where(~((F.col("t") == "Customer") & (F.element_at(F.split("usr", ":"), 2).cast("long") % 7 == 0)))
    batch = tables.edges(spark, sf_dir, "PLACED_BY").withColumn("seq", F.lit(0))
    none = batch.drop("seq").where(F.lit(False))
    return upsert.upsert_edges(none, batch, held).items.select("outbound_id", "inbound_id", "t")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_returnflag = 'R')")
def suppress_redundant_edges(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "lineitem").select(F.lit("all").alias("tu"), F.col("l_orderkey").alias("source_usr"), F.col("l_partkey").alias("target_usr"), "l_returnflag")
    kept = upsert.suppress_redundant(rows.drop("l_returnflag").distinct(), rows.where("l_returnflag = 'R'").drop("l_returnflag"))
    return kept.select(F.col("source_usr").alias("l_orderkey"), F.col("target_usr").alias("l_partkey"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_wins_dedup(spark, sf_dir):
    return upsert.first_wins(tables.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ("user_id",), ("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("SELECT count(*) AS files, coalesce(sum(o_shippriority), 0)::BIGINT AS written, sum(n)::BIGINT AS attempted FROM (SELECT o_orderkey, 1 AS o_shippriority, 2 AS n FROM orders WHERE o_orderstatus <> 'P')")
def partial_success_counters(spark, sf_dir):
    done = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit(1).alias("written"), F.lit(2).alias("attempted"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"))
    return upsert.partial_success(done)[0]


@query("SELECT 'node:' || substr(sha256('customer:' || c_custkey), 1, 16) AS key FROM customer")
def document_sink_keys(spark, sf_dir):
    return node_documents(tables.vertices(spark, sf_dir, "Customer")).select("key")


@query("SELECT count(*) AS n FROM nation")
def edge_document_count(spark, sf_dir):
    return edge_documents(tables.edges(spark, sf_dir, "IN_REGION")).select("key").distinct().agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- stores


def stored(spark, sf_dir, split_rows: int = 400):
    """Customers, nations and where customers live in a new store, a third of the customers by a later upsert, opened anew with another setting."""
    url = shared_dir(spark, "store")
    customers = tables.vertices(spark, sf_dir, "Customer")
    late = F.element_at(F.split("usr", ":"), 2).cast("long") % 3 == 0
    first = customers.where(~late).unionByName(tables.vertices(spark, sf_dir, "Nation"))
    ids = first.select(F.col("id").alias("outbound_id"))
    lives = tables.edges(spark, sf_dir, "LIVES_IN")
    ParquetStore(spark, url, buckets=4, split_rows=split_rows).write(Graph(first, lives.join(ids, "outbound_id", "left_semi")))
    store = ParquetStore(spark, url, buckets=16, split_rows=split_rows)
    store.upsert(customers.where(late).withColumn("seq", F.lit(1)), lives.withColumn("seq", F.lit(1)))
    return store


@query(UPSERTED)
def store_upsert(spark, sf_dir):
    """An upsert into a store that has rows, opened with another number of buckets than it was written with."""
    store, batch = upsert_inputs(spark, sf_dir)
    url, none = shared_dir(spark, "store"), tables.edges(spark, sf_dir, "LIVES_IN").where(F.lit(False))
    ParquetStore(spark, url, buckets=8).write(Graph(store, none))
    again = ParquetStore(spark, url, buckets=2, share=0.5)
    again.upsert(batch, none.withColumn("seq", F.lit(0)))
    return flat(again.read().vertices)


@query(f"SELECT * FROM ({v_sql('Customer', 'Nation')})")
def store_vertices(spark, sf_dir):
    return stored(spark, sf_dir).read().vertices.select("id", "t", "usr")


@query(f"SELECT outbound_id, inbound_id, t FROM ({e_sql('LIVES_IN')}) WHERE inbound_id IN ('{id_of('nation:3')}', '{id_of('nation:11')}')")
def store_edges_at(spark, sf_dir):
    """A look-up of edges by the end they come in at: the second copy of the edges is dealt by it."""
    return stored(spark, sf_dir).read().edges_at([id_of("nation:3"), id_of("nation:11")], "inbound", "LIVES_IN").select("outbound_id", "inbound_id", "t")


@query(f"SELECT v.* FROM ({e_sql('LIVES_IN')}) e JOIN ({v_sql('Customer')}) v ON e.outbound_id = v.id WHERE e.inbound_id = '{id_of('nation:3')}' ORDER BY v.id")
def store_pipe(spark, sf_dir):
    return verb(stored(spark, sf_dir).read(), "pipe", vertex_id=id_of("nation:3"), direction="inbound", t="LIVES_IN")


@query(f"SELECT {vertex_id_sql('usr')} AS id, 'Customer' AS t, usr FROM (SELECT 'customer:' || c_custkey AS usr FROM customer WHERE c_mktsegment = 'BUILDING')")
def store_property_equal(spark, sf_dir):
    """The filter is pushed to a column of the property's own."""
    return verb(stored(spark, sf_dir).read(), "vertex_with_property_equal", name="c_mktsegment", value="BUILDING")


@query("""SELECT 'vertices' AS kind, 'Customer' AS name, count(*) AS count, 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' AS property_keys FROM customer
UNION ALL SELECT 'vertices', 'Nation', count(*), 'n_name,n_nationkey,n_regionkey' FROM nation UNION ALL SELECT 'edges', 'LIVES_IN', count(*), 'c_mktsegment' FROM customer""")
def store_description(spark, sf_dir):
    """Counts and names of properties from the manifest, after an upsert; no data file is read."""
    store = stored(spark, sf_dir)
    rows = [(kind, t, n, ",".join(keys)) for kind in ("vertices", "edges") for t, n, keys in store.describe(kind)]
    return spark.createDataFrame(rows, "kind string, name string, count long, property_keys string")


# ---------------------------------------------------------------- patterns


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def two_hop(spark, sf_dir):
    """(order)-[PLACED_BY]->(customer)-[LIVES_IN]->(nation)"""
    g = tables.graph(spark, sf_dir)
    orders = tables.vertices(spark, sf_dir, "Orders").select(F.col("id").alias("o"), F.col("usr").alias("ou"))
    hop = traverse.expand(traverse.expand(orders, g.edges_typed("PLACED_BY"), "o", "c"), g.edges_typed("LIVES_IN"), "c", "n")
    nations = tables.vertices(spark, sf_dir, "Nation").select(F.col("id").alias("n"), F.col("usr").alias("nu"))
    number = lambda c: F.element_at(F.split(c, ":"), 2)
    return hop.join(nations, "n").select(number("ou").cast("long").alias("o_orderkey"), number("nu").cast("int").alias("c_nationkey"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def optional_match(spark, sf_dir):
    customers = tables.vertices(spark, sf_dir, "Customer").select(F.col("id").alias("c"), F.element_at(F.split("usr", ":"), 2).cast("long").alias("c_custkey"))
    found = traverse.expand(customers, tables.edges(spark, sf_dir, "PLACED_BY"), "c", "o", reverse=True, optional=True)
    return found.groupBy("c_custkey").agg(F.count("o").alias("n"))


VAR_PATHS = """
WITH s AS (SELECT c_custkey, c_nationkey FROM customer)
SELECT c_custkey, 1 AS length, 'nation:' || c_nationkey AS target FROM s
UNION ALL SELECT c_custkey, 2, 'region:' || n_regionkey FROM s JOIN nation ON n_nationkey = c_nationkey"""


@query(VAR_PATHS)
def var_length_paths(spark, sf_dir):
    starts = tables.vertices(spark, sf_dir, "Customer")
    found = traverse.paths(starts.select("id"), traverse.steps_of(tables.edges(spark, sf_dir, "LIVES_IN", "IN_REGION")), 1, 3, shared_writer(spark))
    names = tables.vertices(spark, sf_dir, "Nation", "Region").select(F.col("id").alias("end_id"), F.col("usr").alias("target"))
    own = starts.select(F.col("id").alias("start_id"), F.element_at(F.split("usr", ":"), 2).cast("long").alias("c_custkey"))
    return found.join(own, "start_id").join(names, "end_id").select("c_custkey", "length", "target")


CLOSURE = """
WITH RECURSIVE r(start, node, depth) AS (
  SELECT p_partkey, p_partkey, 0 FROM part
  UNION ALL SELECT start, node // 2, depth + 1 FROM r WHERE node > 1)
SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY ALL"""


@query(CLOSURE)
def include_closure(spark, sf_dir):
    """Transitive inclusion: part p includes part p / 2."""
    parts = tables.read(spark, sf_dir, "part").select("p_partkey")
    links = parts.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
    return traverse.closure(spark, links, parts.select(F.col("p_partkey").alias("node")), shared_writer(spark))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_targets(spark, sf_dir):
    """Documents that no label points at."""
    docs = tables.vertices(spark, sf_dir, "Document").select("id", F.element_at(F.split("usr", ":"), 2).cast("long").alias("doc_id"))
    return traverse.has_edge(docs, tables.edges(spark, sf_dir, "LABELS"), "id", reverse=True, negate=True).select("doc_id")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)")
def semi_pattern(spark, sf_dir):
    rows = tables.vertices(spark, sf_dir, "Supplier").select("id", F.element_at(F.split("usr", ":"), 2).cast("long").alias("s_suppkey"))
    return traverse.has_edge(rows, tables.edges(spark, sf_dir, "SUPPLIED_BY"), "id", reverse=True).select("s_suppkey")


def with_views(spark, sf_dir, *names):
    for n in names:
        tables.read(spark, sf_dir, n).createOrReplaceTempView(n)


@query("SELECT c_custkey, unnest(string_split(c_name, '#')) AS part FROM customer")
def unwind(spark, sf_dir):
    with_views(spark, sf_dir, "customer")
    return read_only_sql(spark, "SELECT c_custkey, explode(split(c_name, '#')) AS part FROM customer")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3")
def agg_topk(spark, sf_dir):
    with_views(spark, sf_dir, "customer")
    return read_only_sql(spark, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10")
def sort_skip_limit(spark, sf_dir):
    with_views(spark, sf_dir, "nation")
    return read_only_sql(spark, "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10")


@query("SELECT n.n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n")
def correlated_apply(spark, sf_dir):
    with_views(spark, sf_dir, "nation", "customer")
    return read_only_sql(spark, "SELECT n.n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def cross_small(spark, sf_dir):
    """Five rows each: the pattern MATCH (a), (b)."""
    with_views(spark, sf_dir, "region")
    return read_only_sql(spark, "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")


@query(f"SELECT DISTINCT t AS label FROM ({v_sql()})")
def distinct_labels(spark, sf_dir):
    return traverse.labels(tables.graph(spark, sf_dir))


@query(f'SELECT DISTINCT t AS "relationshipType" FROM ({e_sql()})')
def relationship_types(spark, sf_dir):
    return traverse.relationship_types(tables.graph(spark, sf_dir))


@query(" UNION ".join(f'SELECT column_name AS "propertyKey" FROM (DESCRIBE {t})' for t in sorted({t for t, _ in tables.VERTICES.values()})))
def property_keys(spark, sf_dir):
    """Names of properties of all vertices and edges; each column of the tables has a value somewhere."""
    return traverse.property_keys(tables.graph(spark, sf_dir))


@query("SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name ORDER BY customers DESC, nation LIMIT 5")
def cypher_aggregate(spark, sf_dir):
    """MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.c_mktsegment = 'BUILDING' RETURN n.n_name AS nation, count(c) AS customers ORDER BY customers DESC, nation LIMIT 5"""
    found = match(tables.graph(spark, sf_dir), node("c", "Customer"), edge("LIVES_IN"), node("n", "Nation"), where=lambda: same(prop("c", "c_mktsegment"), "BUILDING"))
    return found.groupBy(shown(prop("n", "n_name")).alias("nation")).agg(F.count(at("c")).alias("customers")).orderBy(F.desc("customers"), "nation").limit(5)


@query("SELECT c_name AS customer, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def cypher_two_hops(spark, sf_dir):
    """MATCH (c:Customer)-[:LIVES_IN]->(:Nation)-[:IN_REGION]->(r:Region) RETURN c.c_name AS customer, r.r_name AS region"""
    found = match(tables.graph(spark, sf_dir), node("c", "Customer"), edge("LIVES_IN"), node(label="Nation"), edge("IN_REGION"), node("r", "Region"))
    return found.select(shown(prop("c", "c_name")).alias("customer"), shown(prop("r", "r_name")).alias("region"))


@query("SELECT DISTINCT s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3')")
def cypher_reverse_distinct(spark, sf_dir):
    """MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE n.n_name IN [..] RETURN DISTINCT s.s_name AS supplier"""
    found = match(tables.graph(spark, sf_dir), node("n", "Nation"), edge("BASED_IN", direction="in"), node("s", "Supplier"), where=lambda: shown(prop("n", "n_name")).isin("NATION_1", "NATION_2", "NATION_3"))
    return found.select(shown(prop("s", "s_name")).alias("supplier")).distinct()


@query("SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey")
def pattern_uses_an_edge_once(spark, sf_dir):
    """MATCH (a:Customer)-[:LIVES_IN]->(:Nation)<-[:LIVES_IN]-(b:Customer) RETURN a.c_custkey, b.c_custkey: nobody is their own neighbour, as the two
    edges differ. All pairs of a nation: the result grows with the square of a nation's customers, and a nation's are 16 parts."""
    customer = lambda v: holding(node(v, "Customer"), c_custkey=lambda text: text.cast("long"))
    found = match(tables.graph(spark, sf_dir), customer("a"), edge("LIVES_IN"), node(label="Nation"), edge("LIVES_IN", direction="in", spread=16), customer("b"))
    return found.select(at("a", "c_custkey").alias("a"), at("b", "c_custkey").alias("b"))


@query("SELECT r_name AS region, n.n_name AS nation FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 12) n ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def pattern_optional_with_condition(spark, sf_dir):
    """MATCH (r:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation) WHERE n.n_nationkey > 12 AND r.r_regionkey <> 2 RETURN r.r_name, n.n_name"""
    g = tables.graph(spark, sf_dir)
    found = match(g, node("r"), edge("IN_REGION", direction="in"), node("n", "Nation"), rows=match(g, node("r", "Region")), optional=True, where=lambda: less(12, prop("n", "n_nationkey")) & ~same(prop("r", "r_regionkey"), 2))
    return found.select(shown(prop("r", "r_name")).alias("region"), shown(prop("n", "n_name")).alias("nation"))


@query("SELECT 'orders:' || o_orderkey AS source, 1 AS hops, 'customer:' || o_custkey AS target FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'orders:' || o_orderkey, 2, 'nation:' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' UNION ALL SELECT 'orders:' || o_orderkey, 3, 'region:' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
def pattern_any_length(spark, sf_dir):
    """MATCH (o:Orders {o_orderstatus: 'P'})-[r:PLACED_BY|LIVES_IN|IN_REGION*]->(x) RETURN o, size(r), x"""
    vertices = tables.vertices(spark, sf_dir, "Orders", "Customer", "Nation", "Region")
    kept = vertices.withColumn("props", F.when(F.col("t") == "Orders", F.create_map(F.lit("o_orderstatus"), F.try_element_at("props", F.lit("o_orderstatus")))).otherwise(empty_props()))
    g = Graph(kept, tables.edges(spark, sf_dir, "PLACED_BY", "LIVES_IN", "IN_REGION"))
    found = match(g, node("o", "Orders", o_orderstatus="P"), edge(name="r", hops=(1, None)), node("x"))
    usr = vertices.select("id", "usr")
    named = found.select(at("o").alias("id"), at("r", "length").alias("hops"), at("x").alias("x")).join(usr.withColumnRenamed("usr", "source"), "id")
    return named.select("source", "hops", F.col("x").alias("id")).join(usr.withColumnRenamed("usr", "target"), "id").select("source", "hops", "target")


@query("SELECT p_brand AS brand, max(p_size)::VARCHAR AS largest FROM part GROUP BY p_brand ORDER BY max(p_size), brand")
def pattern_largest_of_numbers(spark, sf_dir):
    """MATCH (p:Part) RETURN p.p_brand, max(p.p_size) ORDER BY max(p.p_size): numbers are ordered by value, not as text."""
    found = match(tables.graph(spark, sf_dir), node("p", "Part")).groupBy(shown(prop("p", "p_brand")).alias("brand")).agg(greatest_of(prop("p", "p_size")).alias("largest"))
    return found.orderBy(sort_key(F.col("largest")), "brand")


@query("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def pattern_top_by_number(spark, sf_dir):
    """MATCH (p:Part) RETURN p.p_partkey ORDER BY p.p_retailprice DESC, p.p_partkey LIMIT 10"""
    found = match(tables.graph(spark, sf_dir), node("p", "Part"))
    return found.orderBy(sort_key(prop("p", "p_retailprice")).desc(), sort_key(prop("p", "p_partkey"))).limit(10).select(prop("p", "p_partkey").cast("long").alias("p_partkey"))


@query("SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1 AS neighbours FROM nation")
def pattern_undirected_types(spark, sf_dir):
    """MATCH (n:Nation)-[:LIVES_IN|BASED_IN|IN_REGION]-(x) RETURN n.n_name, count(x)"""
    found = match(tables.graph(spark, sf_dir), node("n", "Nation"), edge("LIVES_IN", "BASED_IN", "IN_REGION", direction="both"), node("x"))
    return found.groupBy(shown(prop("n", "n_name")).alias("nation")).agg(F.count(at("x")).alias("neighbours"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def pattern_without_match(spark, sf_dir):
    """MATCH (c:Customer) WHERE NOT EXISTS { (c)<-[:PLACED_BY {o_orderstatus: 'F'}]-() } RETURN c.c_custkey"""
    g = tables.graph(spark, sf_dir)
    found = matching(g, match(g, node("c", "Customer")), node("c"), edge("PLACED_BY", direction="in", o_orderstatus="F"), node(label="Orders"), negate=True)
    return found.select(prop("c", "c_custkey").cast("long").alias("c_custkey"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c_custkey AND x.o_orderstatus = 'P') UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def pattern_chained(spark, sf_dir):
    """MATCH (c:Customer)-[:LIVES_IN]->(:Nation) OPTIONAL MATCH (c)<-[:PLACED_BY]-(o:Orders), (c)-[:LIVES_IN]->(:Nation)-[:IN_REGION]->(:Region)
    WHERE NOT EXISTS { (c)<-[:PLACED_BY {o_orderstatus: 'P'}]-() } RETURN c, o: unnamed vertices in each part."""
    g = tables.graph(spark, sf_dir)
    rows = match(g, node("c", "Customer"), edge("LIVES_IN"), node(label="Nation"))
    rows = matching(g, rows, node("c"), edge("PLACED_BY", direction="in", o_orderstatus="P"), node(), negate=True)
    rows = match(g, node("c"), edge("LIVES_IN"), node(label="Nation"), edge("IN_REGION"), node(label="Region"), rows=rows)
    rows = match(g, node("c"), edge("PLACED_BY", direction="in"), node("o", "Orders"), rows=rows, optional=True)
    return rows.select(prop("c", "c_custkey").cast("long").alias("c_custkey"), prop("o", "o_orderkey").cast("long").alias("o_orderkey"))


@query(f"""SELECT {vertex_id_sql("'nation:' || n_nationkey")} AS id, 'Nation' AS label, n_name AS name, 'IN_REGION' AS type, {vertex_id_sql("'region:' || n_regionkey")} AS target, 2 AS nodes FROM nation""")
def pattern_results(spark, sf_dir):
    """MATCH p = (n:Nation)-[r:IN_REGION]->(:Region) RETURN n, r, p: vertices, edges and paths as results."""
    found = match(tables.graph(spark, sf_dir), node("n", "Nation"), edge("IN_REGION", name="r"), node("m", "Region"))
    rows = found.select(as_node("n").alias("n"), as_relationship("r").alias("r"), as_path("n", "r", "m").alias("p"))
    name = as_string(F.try_element_at("n.props", F.lit("n_name")))
    return rows.select("n._id", F.get("n._labels", F.lit(0)).alias("label"), name.alias("name"), F.col("r._type").alias("type"), F.col("r._end").alias("target"), F.size("p._nodes").alias("nodes")).withColumnRenamed("_id", "id")


# ---------------------------------------------------------------- code analytics over the cursor view

CUR = f"WITH cur AS MATERIALIZED ({CURSORS_SQL})"
LABEL = "CASE kind WHEN 'NAMESPACE' THEN 'Namespace' WHEN 'CLASS_DECL' THEN 'Class' WHEN 'STRUCT_DECL' THEN 'Class' WHEN 'UNION_DECL' THEN 'Class' WHEN 'FUNCTION_DECL' THEN 'Function' WHEN 'CXX_METHOD' THEN 'Function' WHEN 'CONSTRUCTOR' THEN 'Function' WHEN 'VAR_DECL' THEN 'GlobalVariable' WHEN 'FIELD_DECL' THEN 'Field' END"
CTX = f"""{CUR}, own AS MATERIALIZED (SELECT *, {LABEL} AS label, file = tu AS mine FROM cur),
ctx AS MATERIALIZED (SELECT o.*, p.kind AS pk, p.usr AS pu, p.mine AS pmine, p.label AS pl FROM own o LEFT JOIN own p ON o.tu = p.tu AND o.parent_id = p.id)"""


def context(spark, sf_dir):
    return extract.in_context(cursors(spark, sf_dir), shared_writer(spark))


@query(f"{CTX} SELECT tu, arg_min(label, id) AS t, usr, min(id) AS seq, arg_min(spelling, id) AS spelling FROM ctx WHERE mine AND label IS NOT NULL AND usr <> '' GROUP BY tu, usr")
def extract_nodes(spark, sf_dir):
    nodes = extract.symbol_nodes(context(spark, sf_dir))
    return nodes.select("tu", "t", "usr", "seq", as_string(F.try_element_at("props", F.lit("spelling"))).alias("spelling"))


@query(f"""{CTX} SELECT tu, CASE WHEN m THEN usr ELSE holder END AS source_usr, CASE WHEN m THEN holder ELSE usr END AS target_usr,
  CASE WHEN m THEN 'MEMBER_OF' WHEN is_definition THEN 'DEFINES' ELSE 'DECLARES' END AS t,
  CASE WHEN m THEN coalesce(lower(access), CASE WHEN pk IN ('STRUCT_DECL', 'UNION_DECL') THEN 'public' ELSE 'private' END) END AS access
  FROM (SELECT *, CASE WHEN pmine AND pl IS NOT NULL THEN pu ELSE 'file://' || tu END AS holder,
    kind IN ('FIELD_DECL', 'CXX_METHOD', 'CONSTRUCTOR') AND coalesce(pmine AND pk IN ('CLASS_DECL', 'STRUCT_DECL', 'UNION_DECL'), false) AS m
    FROM ctx WHERE mine AND label IS NOT NULL AND usr <> '')""")
def extract_containment(spark, sf_dir):
    edges = extract.containment(context(spark, sf_dir))
    return edges.select("tu", "source_usr", "target_usr", "t", as_string(F.try_element_at("props", F.lit("access"))).alias("access"))


@query(f"{CTX} SELECT c.tu, c.usr AS source_usr, b.definition_usr AS target_usr FROM ctx c JOIN cur b ON b.tu = c.tu AND b.parent_id = c.id AND b.kind = 'CXX_BASE_SPECIFIER' WHERE c.mine AND c.kind IN ('CLASS_DECL', 'STRUCT_DECL')")
def extract_inheritance(spark, sf_dir):
    return extract.inheritance(context(spark, sf_dir)).select("tu", "source_usr", "target_usr")


@query(f"{CTX} SELECT tu, CASE WHEN pmine AND pl = 'Function' THEN pu ELSE 'file://' || tu END AS source_usr, referenced_usr AS target_usr FROM ctx WHERE kind IN ('DECL_REF_EXPR', 'MEMBER_REF_EXPR', 'TYPE_REF')")
def extract_references(spark, sf_dir):
    return extract.references(context(spark, sf_dir)).select("tu", "source_usr", "target_usr")


@query(f"{CTX} SELECT tu, CASE WHEN pmine THEN pu ELSE 'file://' || tu END AS source_usr, referenced_usr AS target_usr FROM ctx WHERE kind = 'CALL_EXPR' AND mine")
def extract_calls(spark, sf_dir):
    return extract.calls(context(spark, sf_dir)).select("tu", "source_usr", "target_usr")


@query(f"{CUR} SELECT DISTINCT tu, 'file://' || tu AS source_usr, 'file://' || included_file AS target_usr FROM cur WHERE included_file IS NOT NULL")
def extract_includes(spark, sf_dir):
    return extract.files_and_includes(context(spark, sf_dir))[1].select("tu", "source_usr", "target_usr")


@query(f"""{CTX}, n AS (SELECT tu, usr, min(id) AS id FROM ctx WHERE mine AND label IS NOT NULL AND usr <> '' GROUP BY tu, usr)
SELECT c.tu, c.usr, c.label AS t, c.spelling, c.file, c.line, c.col, CASE c.kind WHEN 'CLASS_DECL' THEN 'class' WHEN 'STRUCT_DECL' THEN 'struct' WHEN 'UNION_DECL' THEN 'union' END AS record_kind,
  CASE WHEN label = 'Function' THEN 'false' END AS is_deleted, CASE WHEN label IN ('Field', 'GlobalVariable') THEN 'none' END AS storage_class,
  CASE WHEN label = 'Class' THEN CASE WHEN EXISTS (SELECT 1 FROM ctx a WHERE a.tu = c.tu AND a.parent_id = c.id AND a.kind = 'CXX_FINAL_ATTR') THEN 'true' ELSE 'false' END END AS is_final
FROM ctx c JOIN n ON n.tu = c.tu AND n.id = c.id""")
def extract_properties(spark, sf_dir):
    """Properties by label: those of all, of classes, of functions and of variables."""
    # tokens of a class hold those of its members: a final member function among them makes no class final
    tokens = F.array(F.lit("struct"), F.lit("void"), F.lit("f"), F.lit("final"))
    nodes = extract.symbol_nodes(extract.in_context(cursors(spark, sf_dir).withColumn("tokens", tokens), shared_writer(spark)))
    get = lambda k: F.try_element_at("props", F.lit(k))
    text = [as_string(get(k)).alias(k) for k in ("spelling", "file", "record_kind", "storage_class")]
    return nodes.select("tu", "usr", "t", *text, get("line").cast("int").alias("line"), get("col").cast("int").alias("col"), get("is_deleted").alias("is_deleted"), get("is_final").alias("is_final"))


@query(f"{CUR} SELECT DISTINCT 'file://' || f AS usr, f AS path FROM (SELECT tu AS f FROM cur UNION SELECT included_file FROM cur WHERE included_file IS NOT NULL)")
def extract_files(spark, sf_dir):
    files = extract.files_and_includes(context(spark, sf_dir))[0]
    return files.select("usr", as_string(F.try_element_at("props", F.lit("path"))).alias("path")).distinct()


@query("SELECT n_nationkey, '{\"a\":' || n_regionkey || ',\"b\":' || n_nationkey || '}' AS stored FROM nation")
def nested_properties(spark, sf_dir):
    """A map as a property is stored as one text with sorted names."""
    rows = tables.read(spark, sf_dir, "nation")
    return rows.select("n_nationkey", nested_text(F.create_map(F.lit("b"), F.col("n_nationkey"), F.lit("a"), F.col("n_regionkey"))).alias("stored"))


@query("SELECT 'node:' || substr(sha256('customer:' || c_custkey), 1, 16) AS key, c_custkey % 3 = 0 AS is_new FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def updated_documents(spark, sf_dir):
    """Documents of new keys, and changed ones of known keys; unchanged ones aren't written."""
    customers = tables.vertices(spark, sf_dir, "Customer")
    number = F.element_at(F.split("usr", ":"), 2).cast("long")
    known = node_documents(customers.where(number % 3 != 0))
    changed = customers.withColumn("props", F.when(number % 2 == 0, F.map_concat("props", F.create_map(F.lit("vip"), F.lit("true")))).otherwise(F.col("props")))
    return changed_documents(known, node_documents(changed)).select("key", "is_new")


@query(f"{CUR} SELECT tu, 'a parent that isn''t in the unit' AS error FROM cur WHERE kind = 'CLASS_DECL' GROUP BY tu")
def failing_units(spark, sf_dir):
    """Units whose cursors make no tree: here, classes are taken out and leave their members without a parent."""
    return unit_errors(cursors(spark, sf_dir).where("kind <> 'CLASS_DECL'"))


def refreshed(spark, sf_dir):
    """Units extracted in an earlier state, in which every third unit was another and one wasn't there, and then as they are."""
    cur, nations = cursors(spark, sf_dir), tables.read(spark, sf_dir, "nation")
    late = F.col("n_nationkey") % 3 == 0
    unit = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".cpp"))
    files = lambda old: nations.select(unit.alias("tu"), F.concat("n_name", F.when(late & F.lit(old), " then").otherwise("")).alias("text"), F.when(late & ~F.lit(old), F.lit("2024-01-02")).otherwise("2024-01-01").cast("timestamp").alias("modified"))
    changed = cur.withColumn("spelling", F.concat("spelling", F.lit("?")))
    third = nations.where(late).select(unit.alias("tu"))
    cache = UnitCache(spark, shared_dir(spark, "units"))
    cache.refresh(unit_rows(files(True).where("tu <> 'n4.cpp'")), changed.join(third, "tu", "left_semi").unionByName(cur.join(third, "tu", "left_anti")).where("tu <> 'n4.cpp'"))
    # the cursors of units that are unchanged aren't asked for: without them the result is the same
    return cache.refresh(unit_rows(files(False)), cur.join(nations.where(late | (F.col("n_nationkey") == 4)).select(unit.alias("tu")), "tu", "left_semi"))


@query(f"{CTX} SELECT tu, arg_min(label, id) AS t, usr, min(id) AS seq, arg_min(spelling, id) AS spelling FROM ctx WHERE mine AND label IS NOT NULL AND usr <> '' GROUP BY tu, usr")
def incremental_nodes(spark, sf_dir):
    """Only changed units are extracted, and the graph is that of a full run."""
    nodes = refreshed(spark, sf_dir).nodes.where("t <> 'File'")
    return nodes.select("tu", "t", "usr", "seq", as_string(F.try_element_at("props", F.lit("spelling"))).alias("spelling"))


@query("SELECT count(*) FILTER (n_nationkey % 3 <> 0 AND n_nationkey <> 4) AS hits, count(*) FILTER (n_nationkey % 3 = 0 OR n_nationkey = 4) AS misses, count(*) FILTER (n_nationkey % 3 = 0) AS evictions FROM nation")
def incremental_counts(spark, sf_dir):
    done = refreshed(spark, sf_dir)
    return spark.createDataFrame([(done.hits, done.misses, done.evictions)], "hits long, misses long, evictions long")


@query(f"{CTX} SELECT tu, usr FROM ctx WHERE mine AND label IS NOT NULL AND usr <> '' AND tu <> 'n2.cpp' AND tu <> 'n5.cpp' GROUP BY tu, usr")
def streamed_files(spark, sf_dir):
    """Files of cursors, one for each unit, streamed into a store; one has a line that can't be read, another makes no tree."""
    cur = cut_lineage(spark, cursors(spark, sf_dir), "cursors")  # read twice below
    lost = (F.col("tu") == "n5.cpp") & (F.col("kind") == "TRANSLATION_UNIT")
    third = cur.where("tu = 'n2.cpp'").select("id").orderBy("id").limit(3).agg(F.when(F.count("*") == 3, F.max("id"))).first()[0]
    text = F.when((F.col("tu") == "n2.cpp") & (F.col("id") == third), F.lit("{broken")).otherwise(F.to_json(F.struct(*cur.columns)))
    folder, state = shared_dir(spark, "cursor-files"), shared_dir(spark, "stream")
    # dealt and sorted by unit before they are texts, which take five times as much
    cur.where(~lost).repartition("tu").sortWithinPartitions("tu").select(text.alias("value"), F.col("tu").alias("unit")).write.partitionBy("unit").text(folder)
    store = ParquetStore(spark, shared_dir(spark, "store"), buckets=4)
    for _ in range(2):  # started again, it reads nothing twice
        stream = ingest_files(spark, f"{folder}/unit=*", store, f"{state}/errors", f"{state}/checkpoint")
        stream.processAllAvailable()
        stream.stop()
    vertices = store.read().vertices.where(~F.col("t").isin("File", "Type", "Parameter"))
    errors = spark.read.schema("path string, tu string, error string, batch long").parquet(f"{state}/errors")
    failed = errors.select(F.coalesce("tu", F.regexp_extract("path", r"unit=([^/]*)/", 1)).alias("tu"))
    emitted = extract.classified(cur).where("emits").select("tu", "usr").distinct()
    return emitted.join(failed, "tu", "left_anti").join(vertices.select("usr"), "usr", "left_semi").select("tu", "usr")


def typed_cursors(spark, sf_dir):
    """Parts as variables of type '<brand> *', with functions returning it that have parameters."""
    part = tables.read(spark, sf_dir, "part")
    t = lambda s, pointer: F.struct(s.alias("spelling"), F.lit(False).alias("is_const"), F.lit(False).alias("is_volatile"), F.lit(pointer).alias("is_pointer"), F.lit(False).alias("is_lvalue_reference"), F.lit(False).alias("is_rvalue_reference"), F.lit("K").alias("kind"))
    chain = F.array(t(F.concat("p_brand", F.lit(" *")), True), t(F.col("p_brand"), False))
    unit = F.concat(F.lit("u"), (F.col("p_partkey") % 7).cast("string"))
    arg = F.struct(F.when(F.col("p_size") % 2 == 0, F.lit("x")).otherwise("").alias("name"), F.array(F.lit("int"), F.lit("x"), F.lit("="), F.col("p_size").cast("string")).alias("tokens"), F.array(t(F.col("p_brand"), False)).alias("type"), unit.alias("file"), F.lit(1).alias("line"), F.lit(2).alias("col"))
    base = part.select(unit.alias("tu"), F.col("p_partkey").alias("id"), F.lit(None).cast("bigint").alias("parent_id"), F.when(F.col("p_partkey") % 2 == 0, "VAR_DECL").otherwise("FUNCTION_DECL").alias("kind"), F.concat(F.lit("s:"), F.col("p_partkey").cast("string")).alias("usr"), unit.alias("file"), chain.alias("chain"), F.array(arg).alias("args"))
    odd = F.col("kind") == "FUNCTION_DECL"
    return base.select("tu", "id", "parent_id", "kind", "usr", "file", F.when(~odd, F.col("chain")).alias("own_type"), F.when(odd, F.col("chain")).alias("result_type"), F.when(odd, F.col("args")).alias("args"))


@query("""WITH p AS (SELECT 'u' || (p_partkey % 7) AS tu, 's:' || p_partkey AS usr, p_partkey % 2 AS odd, p_brand FROM part),
t AS (SELECT *, 'type:' || sha1(p_brand || ' *') AS outer_t, 'type:' || sha1(p_brand) AS inner_t FROM p)
SELECT tu, usr AS source_usr, outer_t AS target_usr, CASE odd WHEN 1 THEN 'RETURNS' ELSE 'OF_TYPE' END AS t FROM t
UNION ALL SELECT tu, usr || '#param:0', inner_t, 'OF_TYPE' FROM t WHERE odd = 1
UNION ALL SELECT DISTINCT tu, outer_t, inner_t, 'POINTS_TO' FROM t""")
def type_chain_edges(spark, sf_dir):
    context = extract.in_context(typed_cursors(spark, sf_dir), shared_writer(spark))
    return extract.types(context)[1].select("tu", "source_usr", "target_usr", "t")


@query("SELECT DISTINCT 'u' || (p_partkey % 7) AS tu, 'type:' || sha1(b) AS usr FROM (SELECT p_partkey, unnest([p_brand, p_brand || ' *']) AS b FROM part)")
def type_nodes(spark, sf_dir):
    return extract.types(extract.in_context(typed_cursors(spark, sf_dir), shared_writer(spark)))[0].select("tu", "usr")


@query("SELECT 'u' || (p_partkey % 7) AS tu, 's:' || p_partkey || '#param:0' AS usr, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE '<param#0>' END AS spelling, p_size::VARCHAR AS default_value FROM part WHERE p_partkey % 2 = 1")
def parameter_nodes(spark, sf_dir):
    nodes = extract.parameters(extract.in_context(typed_cursors(spark, sf_dir), shared_writer(spark)))[0]
    get = lambda k: as_string(F.try_element_at("props", F.lit(k)))
    return nodes.select("tu", "usr", get("spelling").alias("spelling"), get("default_value").alias("default_value"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'const volatile' WHEN 1 THEN 'const' ELSE '' END AS cv, 'a ' || p_size AS default_value,
  CASE WHEN p_partkey % 4 = 0 THEN 'thread_local' WHEN p_partkey % 4 = 1 THEN 'static' ELSE 'none' END AS storage FROM part""")
def token_scans(spark, sf_dir):
    lit = F.lit
    part = tables.read(spark, sf_dir, "part").select("p_partkey", "p_size")
    words = F.concat(F.array(lit("void"), lit("f"), lit("("), lit("volatile"), lit(")"), lit("const")), F.when(F.col("p_size") % 3 == 0, F.array(lit("volatile"))).otherwise(F.array().cast("array<string>")), F.array(lit("{"), lit("volatile")))
    value = F.array(lit("int"), lit("="), lit("a"), F.col("p_size").cast("string"))
    mark = F.when(F.col("p_partkey") % 4 == 0, F.array(lit("extern"), lit("thread_local"))).otherwise(F.array(lit("int")))
    return part.select("p_partkey", T.cv_qualifiers(F.col("p_size") % 3 < 2, words).alias("cv"), T.default_value(value).alias("default_value"), T.storage_class(lit("GlobalVariable"), mark, F.when(F.col("p_partkey") % 4 == 1, "STATIC").otherwise("INVALID")).alias("storage"))


POINTS = "SELECT tu, file, line AS p_line, 25 AS p_col FROM cur WHERE kind IN ('CXX_METHOD', 'FUNCTION_DECL')"


@query(f"""{CUR}, pts AS (SELECT DISTINCT * FROM ({POINTS})), hit AS (
  SELECT p.*, c.id, row_number() OVER (PARTITION BY p.tu, p.file, p_line, p_col ORDER BY c.line DESC, c.col DESC, c.end_line, c.end_col, c.id DESC) AS n
  FROM pts p JOIN cur c ON c.tu = p.tu AND c.file = p.file AND c.parent_id IS NOT NULL AND (c.line < p_line OR c.line = p_line AND c.col <= p_col) AND (c.end_line > p_line OR c.end_line = p_line AND c.end_col >= p_col))
SELECT tu, file, p_line, p_col, id FROM hit WHERE n = 1""")
def point_in_extent(spark, sf_dir):
    cur = cursors(spark, sf_dir)
    points = cur.where("kind IN ('CXX_METHOD', 'FUNCTION_DECL')").select("tu", "file", "line", F.lit(25).alias("col"))
    return position.cursors_at(points, cur).select("tu", "file", "p_line", "p_col", "id")


@query(f"""{CUR}, u AS (SELECT DISTINCT usr FROM cur WHERE kind = 'CXX_METHOD')
SELECT DISTINCT c.referenced_usr AS usr, c.tu, c.file, c.line, c.col, CASE WHEN l.line IS NULL THEN '' ELSE 'line  ' || l.line END AS context_snippet
FROM cur c JOIN u ON u.usr = c.referenced_usr LEFT JOIN (SELECT DISTINCT file, line FROM cur WHERE kind = 'CXX_METHOD') l ON l.file = c.file AND l.line = c.line""")
def references_with_snippet(spark, sf_dir):
    cur = cursors(spark, sf_dir)
    hits = position.references_to(cur.where("kind = 'CXX_METHOD'").select("usr"), cur)
    lines = cur.where("kind = 'CXX_METHOD'").select("file", "line", F.concat(F.lit("\t\u2003line  "), F.col("line").cast("string"), F.lit(" \r\x0b")).alias("text")).distinct()
    return position.with_snippets(hits, lines).drop("seq")


@query(f"""{CUR}, pts AS (SELECT tu, file, line AS p_line, 25 AS p_col, id FROM cur WHERE kind = 'DECL_REF_EXPR'),
d AS (SELECT tu, usr, min(line) AS x, arg_min(line, id) AS def_line FROM cur WHERE is_definition GROUP BY tu, usr),
h AS (SELECT p.tu, p.file, p_line, p_col, arg_max(coalesce(c.definition_usr, c.referenced_usr, c.usr), (c.line, c.col, -c.end_line, -c.end_col, c.id)) AS usr FROM (SELECT DISTINCT tu, file, p_line, p_col FROM pts) p
  JOIN cur c ON c.tu = p.tu AND c.file = p.file AND c.parent_id IS NOT NULL AND (c.line, c.col) <= (p_line, p_col) AND (c.end_line, c.end_col) >= (p_line, p_col) GROUP BY ALL)
SELECT h.tu, h.file, h.p_line, h.p_col, d.usr IS NOT NULL AS found, h.usr, d.def_line FROM h LEFT JOIN d ON d.tu = h.tu AND d.usr = h.usr""")
def definition_lookup(spark, sf_dir):
    cur = cursors(spark, sf_dir)
    points = cur.where("kind = 'DECL_REF_EXPR'").select("tu", "file", "line", F.lit(25).alias("col"))
    return position.definitions(points, cur).select("tu", "file", "p_line", "p_col", "found", "usr", "def_line")


CAP = """h AS (SELECT c.referenced_usr AS usr, tu, file, line, col, min(id) AS seq FROM cur c WHERE referenced_usr IN (SELECT usr FROM cur WHERE kind = 'CXX_METHOD') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY usr, tu ORDER BY seq) AS n FROM h)"""


@query(f"{CUR}, {CAP} SELECT usr, tu, count(*) AS total, count(*) > 2 AS truncated, greatest(count(*) - 2, 0)::BIGINT AS omitted_count, max(seq) FILTER (n <= 2) AS last_shown FROM k GROUP BY usr, tu")
def references_capped(spark, sf_dir):
    """The cap is the feature: of each symbol and unit the first two references in preorder, and how many there are besides."""
    cur = cursors(spark, sf_dir)
    rows, summary = position.capped(position.references_to(cur.where("kind = 'CXX_METHOD'").select("usr"), cur), 2)
    return summary.join(rows.groupBy("usr", "tu").agg(F.max("seq").alias("last_shown")), ["usr", "tu"])


TYPED = "kind AS type_spelling, CASE WHEN kind = 'VAR_DECL' THEN 'int' END AS canonical_type, id % 100 - 1 AS size_bytes, kind = 'FIELD_DECL' AS is_const"


@query(f"""{CUR}, c AS (SELECT *, {TYPED} FROM cur), pts AS (SELECT DISTINCT tu, file, line AS p_line, 25 AS p_col FROM cur WHERE kind = 'FIELD_DECL'),
h AS (SELECT p.tu, p.file, p_line, p_col, arg_max(c.id, (c.line, c.col, -c.end_line, -c.end_col, c.id)) AS id FROM pts p
  JOIN c ON c.tu = p.tu AND c.file = p.file AND c.parent_id IS NOT NULL AND (c.line, c.col) <= (p_line, p_col) AND (c.end_line, c.end_col) >= (p_line, p_col) GROUP BY ALL)
SELECT h.tu, h.file, h.p_line, h.p_col, type_spelling AS display_type, coalesce(canonical_type, type_spelling) AS canonical_type, CASE WHEN size_bytes > 0 THEN size_bytes END AS size_bytes, is_const, false AS is_pointer
FROM h JOIN c ON c.tu = h.tu AND c.id = h.id""")
def type_infos(spark, sf_dir):
    """Types at points; sizes that aren't positive are unknown."""
    cur = cursors(spark, sf_dir)
    typed = cur.selectExpr("*", *[x.strip() for x in TYPED.split(", ")])
    points = cur.where("kind = 'FIELD_DECL'").select("tu", "file", "line", F.lit(25).alias("col"))
    return position.type_infos(points, typed).select("tu", "file", "p_line", "p_col", "display_type", "canonical_type", "size_bytes", "is_const", "is_pointer")


def ast(spark, sf_dir):
    return cursors(spark, sf_dir).select("tu", "id", "parent_id", "kind", "spelling", "usr", F.lit("int").alias("type"), F.lit("NONE").alias("storage_class"), F.col("line").alias("start_line"), F.col("col").alias("start_col"), "end_line", "end_col")


AST_BYTES = "(length(id::VARCHAR) + length(kind) + length(spelling) + length(usr) + length('int') + length('NONE') + length(line::VARCHAR) + length(col::VARCHAR) + length(end_line::VARCHAR) + length(end_col::VARCHAR) + 10 + 2 + 18 + 68 + 40)"


@query(f"""{CUR}, f AS MATERIALIZED (SELECT tu, id, parent_id, id // 10000000000 * 10000000000 AS class_id, line <= 50000 AND end_line >= 20000 AS fits FROM cur), bad AS MATERIALIZED (SELECT tu, id FROM f WHERE NOT fits)
SELECT f.tu, f.id FROM f LEFT JOIN bad p ON p.tu = f.tu AND p.id = f.parent_id LEFT JOIN bad c ON c.tu = f.tu AND c.id = f.class_id WHERE f.fits AND p.id IS NULL AND c.id IS NULL""")
def range_overlap(spark, sf_dir):
    return astscan.in_line_range(ast(spark, sf_dir), 20000, 50000, shared_writer(spark)).select("tu", "id")


@query(f"{CUR}, d AS (SELECT tu, id, 0 AS depth FROM cur WHERE parent_id IS NULL UNION ALL SELECT tu, id, 1 FROM cur WHERE parent_id = 0) SELECT d.tu, d.id, d.depth, d.depth = 1 AND EXISTS (SELECT 1 FROM cur c WHERE c.tu = d.tu AND c.parent_id = d.id) AS truncated FROM d")
def ast_depth_cut(spark, sf_dir):
    return astscan.depth_cut(ast(spark, sf_dir), 1).select("tu", "id", "depth", "truncated")


@query(f"""{CUR}, r AS (SELECT *, {AST_BYTES} AS b FROM cur),
s AS (SELECT tu, id, b, row_number() OVER (PARTITION BY tu ORDER BY id) AS n, sum(b) OVER (PARTITION BY tu ORDER BY id) AS s FROM r)
SELECT tu, id, n >= 500 OR s >= 80000 AS truncated FROM s WHERE n <= 500 AND s - b < 80000""")
def ast_budget_cut(spark, sf_dir):
    """The budget is the feature: 500 nodes or 80,000 bytes of each unit."""
    return astscan.budget_cut(ast(spark, sf_dir), 500, 80_000).select("tu", "id", "truncated")


@query(f"{CUR} SELECT tu, parent_id AS source_id, id AS target_id, CASE WHEN kind = 'TYPE_REF' THEN 'TYPE_REF' WHEN kind IN ('CALL_EXPR', 'CXX_METHOD') THEN 'CALL' ELSE 'CHILD' END AS edge_type FROM cur WHERE parent_id IS NOT NULL")
def ast_edges(spark, sf_dir):
    return astscan.tree_edges(ast(spark, sf_dir))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NOTE' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'FATAL' ELSE 'WARNING' END AS severity FROM events")
def diagnostic_severity(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", astscan.severity(F.col("event_id") % 5).alias("severity"))


@query(f"{CUR} SELECT DISTINCT 'n' || c_nationkey || '.cpp' AS tu FROM customer WHERE c_custkey % 9 = 4 AND 'n' || c_nationkey || '.cpp' NOT IN (SELECT tu FROM cur WHERE parent_id IS NOT NULL AND tu <> 'n3.cpp')")
def failed_units(spark, sf_dir):
    nodes = ast(spark, sf_dir).where("tu <> 'n3.cpp' OR parent_id IS NULL")
    diags = tables.read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".cpp")).alias("tu"), F.when(F.col("c_custkey") % 9 == 4, 4).otherwise(2).alias("severity"))
    return astscan.failed_units(nodes, diags)


def include_rows(spark, sf_dir):
    return tables.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), (F.col("l_suppkey") % 20).cast("string")).alias("tu"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_linenumber").alias("depth"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("path"))


INC = "SELECT 't' || (l_suppkey % 20) AS tu, l_orderkey * 10 + l_linenumber AS pos, l_linenumber AS depth, 'p' || (l_partkey % 50) AS path FROM lineitem"


@query(f"SELECT tu, path, min(pos) AS pos FROM ({INC}) WHERE depth = 1 GROUP BY ALL")
def direct_includes(spark, sf_dir):
    return includes.direct_includes(include_rows(spark, sf_dir))


@query(f"SELECT tu, path, min(pos) AS pos FROM ({INC}) GROUP BY ALL")
def transitive_includes(spark, sf_dir):
    return includes.transitive_includes(include_rows(spark, sf_dir))


@query("SELECT 't' || (o_custkey % 20) AS tu, o_orderpriority || '.h' AS path, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL")
def missing_includes(spark, sf_dir):
    message = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("fatal: '"), "o_orderpriority", F.lit(".h' file not found"))).otherwise(F.lit("unused 'x'"))
    return includes.missing_includes(tables.read(spark, sf_dir, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 20).cast("string")).alias("tu"), F.col("o_orderkey").alias("pos"), message.alias("message")))


HEADER = "CASE WHEN file = 'h.hpp' THEN concat('h', CAST(id {div} 10000000000 % 50 AS {string}), '.hpp') ELSE file END"


@query(f"""{CUR}, d AS (SELECT DISTINCT tu, {HEADER.format(div='//', string='VARCHAR')} AS path, usr FROM cur WHERE file = 'h.hpp' AND usr <> ''), u AS (SELECT DISTINCT tu, referenced_usr FROM cur WHERE file = tu AND referenced_usr <> '')
SELECT tu, path FROM d LEFT JOIN u ON u.tu = d.tu AND u.referenced_usr = d.usr GROUP BY d.tu, path HAVING count(u.tu) = 0""".replace("SELECT tu, path FROM d", "SELECT d.tu, path FROM d"))
def orphaned_includes(spark, sf_dir):
    """The view's header as fifty: a class and all within it is in one of them."""
    cur = cursors(spark, sf_dir)
    cur = cur.withColumn("file", F.expr(HEADER.format(div="DIV", string="STRING")))
    found = cur.where("file LIKE 'h%.hpp'").select("tu", F.lit(1).alias("pos"), F.lit(1).alias("depth"), F.col("file").alias("path")).distinct()
    return includes.orphaned_includes(found, cur)


@query(f"{CUR} SELECT tu, kind, usr, spelling FROM cur WHERE file = tu AND usr <> '' AND kind IN ('FUNCTION_DECL', 'CXX_METHOD', 'CONSTRUCTOR', 'STRUCT_DECL', 'CLASS_DECL', 'NAMESPACE', 'VAR_DECL')")
def exported_symbols(spark, sf_dir):
    return includes.exported_symbols(cursors(spark, sf_dir))


DIRECTIVES = """SELECT 'f' || user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS line,
  CASE event_id % 7 WHEN 0 THEN 'ifdef' WHEN 1 THEN 'else' WHEN 2 THEN 'endif' WHEN 3 THEN 'if' WHEN 4 THEN 'elif' WHEN 5 THEN 'endif' END AS directive, event_id FROM events"""
#: A stack machine by recursion, one line at a time: for each directive, the depth before it.
STACK = f"""WITH RECURSIVE l AS ({DIRECTIVES}), d AS (SELECT file, line, directive, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM l WHERE directive IS NOT NULL),
r(file, k, line, directive, before, after) AS (
  SELECT file, k, line, directive, 0, CASE WHEN directive LIKE 'if%' THEN 1 ELSE 0 END FROM d WHERE k = 1
  UNION ALL SELECT d.file, d.k, d.line, d.directive, r.after, CASE WHEN d.directive LIKE 'if%' THEN r.after + 1 WHEN d.directive = 'endif' THEN greatest(r.after - 1, 0) ELSE r.after END FROM r JOIN d ON d.file = r.file AND d.k = r.k + 1),
v AS (SELECT *, CASE WHEN directive LIKE 'if%' THEN after ELSE before END AS level FROM r),
w AS (SELECT file, line, directive, level, (SELECT min(x.line) FROM v x WHERE x.file = v.file AND x.level = v.level AND x.line > v.line) AS nl FROM v WHERE level > 0),
b AS (SELECT w.*, n.directive AS nd FROM w LEFT JOIN v n ON n.file = w.file AND n.line = w.nl WHERE w.directive <> 'endif'),
m AS (SELECT file, max(line) AS last_line FROM l GROUP BY file),
e AS (SELECT b.file, directive, line AS start_line, CASE WHEN nl IS NULL THEN last_line WHEN nd = 'endif' THEN nl ELSE nl - 1 END AS end_line, nl IS NOT NULL AS closed FROM b JOIN m ON m.file = b.file)"""


def directive_lines(spark, sf_dir):
    from pyspark.sql import Window as W

    names = F.array(*[F.lit(x) for x in ("#ifdef A", "# else", "#endif", "  #IF defined(B)", "#elif C", "#endif // x", "text")])
    rows = tables.read(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), "event_id", F.get(names, (F.col("event_id") % 7).cast("int")).alias("text"))
    return rows.withColumn("line", F.row_number().over(W.partitionBy("file").orderBy("event_id")))


@query(f"{STACK} SELECT file, directive, start_line, end_line, closed FROM e")
def directive_pairing(spark, sf_dir):
    lines = directive_lines(spark, sf_dir)
    found = preproc.conditionals(preproc.directives(lines), lines.groupBy("file").agg(F.max("line").alias("last_line")))
    return found.select("file", "directive", "start_line", "end_line", "closed")


@query(f"{STACK} SELECT file, directive, start_line, closed AND EXISTS (SELECT 1 FROM l WHERE l.file = e.file AND l.event_id % 11 = 0 AND l.line > e.start_line AND l.line <= e.end_line) AS evaluated_result FROM e")
def directive_activity(spark, sf_dir):
    lines = directive_lines(spark, sf_dir)
    found = preproc.conditionals(preproc.directives(lines), lines.groupBy("file").agg(F.max("line").alias("last_line")))
    return preproc.with_activity(found, lines.where("event_id % 11 = 0")).select("file", "directive", "start_line", "evaluated_result")


@query("SELECT 'all' AS tu, event_type AS name, arg_min('a ' || event_id, event_id) AS value, min(event_id) % 1000 AS def_line FROM events GROUP BY event_type")
def macro_table(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "events").select(F.lit("all").alias("tu"), F.lit("MACRO_DEFINITION").alias("kind"), F.col("event_type").alias("spelling"), F.array(F.col("event_type"), F.lit("a"), F.col("event_id").cast("string")).alias("tokens"), F.lit("f").alias("file"), (F.col("event_id") % 1000).alias("line"), F.col("event_id").alias("id"))
    return preproc.macros(rows).select("tu", "name", "value", "def_line")


@query(f"{CUR} SELECT tu, line AS start_line, arg_min(spelling, id) AS condition FROM cur WHERE kind = 'CALL_EXPR' GROUP BY tu, line")
def macro_uses_as_conditionals(spark, sf_dir):
    """Calls taken as uses of macros: one a line."""
    used = cursors(spark, sf_dir).where("kind = 'CALL_EXPR'").withColumn("kind", F.lit("MACRO_INSTANTIATION"))
    return preproc.macro_uses(used).select("tu", "start_line", "condition")


def quoted(text: F.Column) -> F.Column:
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


#: Statements about a text, with {t} for its literal and {p} for a path; the first ones may run.
STATEMENTS = (
    "SELECT {t} AS t", "WITH a AS (SELECT {t} AS x) SELECT upper(x) FROM a WHERE EXISTS (SELECT 1 FROM nation)", "INSERT INTO nation SELECT {t}", "SELECT reflect('java.lang.String', 'valueOf', {t})",
    "SELECT 1 WHERE {t} IN (SELECT value FROM text.`/{p}`)", "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/{p}`", "SELECT (SELECT max(java_method('java.lang.String', 'valueOf', {t})) FROM nation)",
)


@query(f"SELECT doc_id, doc_id % {len(STATEMENTS) + 1} < 2 AS allowed FROM documents")
def read_only_guard(spark, sf_dir):
    """Documents' texts as statements, and statements about them; tasks parse them."""
    with_views(spark, sf_dir, "nation")
    text = F.coalesce("text", F.lit(""))
    forms = [F.replace(F.replace(F.lit(x), F.lit("{t}"), quoted(text)), F.lit("{p}"), F.col("doc_id").cast("string")) for x in STATEMENTS] + [text]
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*forms), (F.col("doc_id") % len(forms)).cast("int")).alias("statement"))
    return codes(rows, shared_writer(spark)).select("doc_id", (F.col("code") == "").alias("allowed"))


#: JSON verbs about an event, with {e} for its type, and their errors' codes.
VERB_TEXTS = (
    ('{"query": "all_edges"}', ""), ('{"query": "vertex_with_type", "args": {"t": "{e}"}}', ""), ('{"query": "vertex_with_property_equal", "args": {"name": "{e}", "value": {n}}}', ""), ("{e}", "QUERY_PARSE_ERROR"), ("[{n}]", "QUERY_PARSE_ERROR"),
    ('{"query": "{e}"}', "QUERY_UNSUPPORTED"), ('{"query": "vertex_with_type", "args": {"{e}": 1}}', "QUERY_PARSE_ERROR"), ('{"query": "pipe", "args": {"vertex_id": "{n}", "direction": "outbound"}}', "QUERY_PARSE_ERROR"), ('{"query": "vertex_with_type", "args": {"t": "{e}-{n}"}}', "QUERY_PARSE_ERROR"),
)


@query(f"SELECT event_id, [{', '.join(repr(code) for _, code in VERB_TEXTS)}][1 + event_id % {len(VERB_TEXTS)}] AS code FROM events")
def verb_errors(spark, sf_dir):
    """Verbs made from events, checked as they come."""
    forms = [F.replace(F.replace(F.lit(x), F.lit("{e}"), F.col("event_type")), F.lit("{n}"), F.col("event_id").cast("string")) for x, _ in VERB_TEXTS]
    return tables.read(spark, sf_dir, "events").select("event_id", verbs_json.code_of(F.get(F.array(*forms), (F.col("event_id") % len(forms)).cast("int"))).alias("code"))


WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PLANTED = "replace(replace(coalesce(text, ''), '. ', '.' || chr(9) || chr(13) || chr(10) || chr(8195)), 'a', 'a')"
LINES = f"(SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM (SELECT doc_id, string_split_regex({PLANTED}, '\\r\\n|\\r|\\n') AS l FROM documents))"


def planted_lines(spark, sf_dir):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\t\r\n\u2003"))
    return preproc.source_lines(tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), text.alias("text")))


@query(f"SELECT doc_id, i::INT AS line, regexp_replace(l[i], '^{WHITE}+|{WHITE}+$', '', 'g') AS snippet FROM {LINES}, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)")
def source_line_snippets(spark, sf_dir):
    """Lines that end in CR LF too, without tabs, CR and wide spaces around them."""
    return planted_lines(spark, sf_dir).select(F.col("file").alias("doc_id"), "line", preproc.stripped(F.col("text")).alias("snippet"))


@query(f"""WITH p AS (SELECT doc_id, (doc_id % 6)::INT AS line, (doc_id % 90)::INT AS col, l FROM {LINES}) SELECT doc_id, line, col, CASE WHEN line < 1 OR col < 1 THEN 'lines and columns count from 1'
  WHEN line > greatest(len(l), 1) THEN 'the line is beyond the end of the file' ELSE 'the column is beyond the end of the line' END AS error
FROM p WHERE line < 1 OR col < 1 OR line > greatest(len(l), 1) OR col > coalesce(length(l[line]), 0) + 1""")
def position_errors(spark, sf_dir):
    points = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), (F.col("doc_id") % 6).cast("int").alias("line"), (F.col("doc_id") % 90).cast("int").alias("col"))
    lines = planted_lines(spark, sf_dir)
    # a document without text is a file without lines, not one that can't be read
    empty = points.select("file").join(lines.select("file").distinct(), "file", "left_anti").select("file", F.lit(1).alias("line"), F.lit("").alias("text"))
    return position.position_errors(points, lines.unionByName(empty)).withColumnRenamed("file", "doc_id")


AST_JSON = """'{{"id":' || {a}.id || ',"kind":"' || {a}.kind || '","spelling":"' || {a}.spelling || '","usr":"' || {a}.usr || '","type":"int","storage_class":"NONE","start_line":' || {a}.line || ',"start_col":' || {a}.col || ',"end_line":' || {a}.end_line || ',"end_col":' || {a}.end_col"""


@query(f"""{CUR}, r AS (SELECT *, {AST_BYTES} AS b FROM cur), s AS (SELECT *, row_number() OVER (PARTITION BY tu ORDER BY id) AS n, sum(b) OVER (PARTITION BY tu ORDER BY id) AS s FROM r),
k AS MATERIALIZED (SELECT *, {AST_JSON.format(a='s')} || ',"children":[' AS j FROM s WHERE n <= 500 AND s - b < 80000),
k3 AS (SELECT tu, parent_id, string_agg(j || ']}}', ',' ORDER BY id) AS kids FROM k WHERE id % 10000000000 > 9 AND id % 10 > 0 GROUP BY ALL),
k2 AS (SELECT k.tu, k.parent_id, string_agg(j || coalesce(k3.kids, '') || ']}}', ',' ORDER BY k.id) AS kids FROM k LEFT JOIN k3 ON k3.tu = k.tu AND k3.parent_id = k.id WHERE k.id % 10000000000 > 0 AND (k.id % 10 = 0 OR k.id % 10000000000 < 10) GROUP BY ALL),
k1 AS (SELECT k.tu, k.parent_id, string_agg(j || coalesce(k2.kids, '') || ']}}', ',' ORDER BY k.id) AS kids FROM k LEFT JOIN k2 ON k2.tu = k.tu AND k2.parent_id = k.id WHERE k.id > 0 AND k.id % 10000000000 = 0 GROUP BY ALL)
SELECT k.tu, md5(j || coalesce(k1.kids, '') || ']}}') AS digest FROM k LEFT JOIN k1 ON k1.tu = k.tu AND k1.parent_id = k.id WHERE k.id = 0""".replace("]}}'", "]}'"))
def ast_trees(spark, sf_dir):
    """One JSON text for each unit, within the budget: 500 nodes or 80,000 bytes."""
    kept = astscan.budget_cut(ast(spark, sf_dir), 500, 80_000).drop("truncated")
    return astscan.tree_texts(kept, 8, shared_writer(spark)).select("tu", F.md5("tree").alias("digest"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN '-O' || (c_custkey % 4) || ' -DX' ELSE '-std=c++17' END AS flags, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'compilation_db' ELSE 'default' END AS flags_source FROM customer""")
def resolve_compile_flags(spark, sf_dir):
    customers = tables.read(spark, sf_dir, "customer")
    file = F.concat(F.lit("/d/"), F.col("c_custkey").cast("string"), F.lit(".cpp"))
    odd = F.when(F.col("c_custkey") % 4 == 2, " -- ").otherwise(" ")
    command = F.concat(F.lit("g++ -O"), (F.col("c_custkey") % 4).cast("string"), F.lit(" -DX"), odd, file)
    entries = customers.where("c_custkey % 4 < 3").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.lit("/d").alias("directory"), F.when(F.col("pos") == 0, command).otherwise("g++ -later x").alias("command"), F.lit(None).cast("array<string>").alias("arguments"), file.alias("file"))
    found = resolve_flags(customers.select("c_custkey", file.alias("file")), flags_of(entries), ["-std=c++17"])
    return found.select("c_custkey", F.array_join("flags", " ").alias("flags"), "flags_source")


def put(spark, path: str, text: str) -> None:
    """Writes a small file, as another program would."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    out.write(bytearray(text.encode()))
    out.close()


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN '-O' || (s_suppkey % 4) || ' -DN=' || s_nationkey ELSE '-std=c++20' END AS flags, CASE WHEN s_suppkey % 4 < 2 THEN 'compilation_db' ELSE 'default' END AS flags_source FROM supplier""")
def compile_database(spark, sf_dir):
    """Flags from a folder's compile_commands.json: commands, lists of arguments, entries that can't be told, and files without one."""
    suppliers = tables.read(spark, sf_dir, "supplier")
    file = F.concat(F.lit("/src/s"), F.col("s_suppkey").cast("string"), F.lit(".cpp"))
    flag, number = F.concat(F.lit("-O"), (F.col("s_suppkey") % 4).cast("string")), F.concat(F.lit("-DN="), F.col("s_nationkey").cast("string"))
    odd = F.when(F.col("s_suppkey") % 4 == 2, " -- ").otherwise(" ")
    command = F.when(F.col("s_suppkey") % 4 != 1, F.concat(F.lit("c++ "), flag, F.lit(" "), number, odd, file))
    entries = suppliers.where("s_suppkey % 4 < 3").select(F.struct(F.lit("/src").alias("directory"), command.alias("command"), F.when(F.col("s_suppkey") % 4 == 1, F.array(F.lit("c++"), flag, number, file)).alias("arguments"), F.element_at(F.split(file, "/"), -1).alias("file")).alias("e"))
    folder = shared_dir(spark, "build")
    put(spark, f"{folder}/compile_commands.json", entries.agg(F.to_json(F.collect_list("e")).alias("text")).first().text or "[]")
    found = resolve_flags(suppliers.select("s_suppkey", file.alias("file")), compile_db(spark, folder), ["-std=c++20"])
    return found.select("s_suppkey", F.array_join("flags", " ").alias("flags"), "flags_source")


@query("SELECT n_name AS text, 'd' || (n_nationkey % 3) || '/n' || n_nationkey || ['.cpp', '.h', '.txt', '.cc'][1 + n_nationkey % 4] AS path, strlen(n_name) AS length FROM nation WHERE n_nationkey % 4 <> 2")
def source_file_list(spark, sf_dir):
    """Source files of a folder and those below it, by their endings; a file for each nation."""
    folder = shared_dir(spark, "sources")
    for r in tables.read(spark, sf_dir, "nation").collect():
        put(spark, f"{folder}/d{r.n_nationkey % 3}/n{r.n_nationkey}{('.cpp', '.h', '.txt', '.cc')[r.n_nationkey % 4]}", r.n_name)
    return source_files(spark, folder).select("text", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "length")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
