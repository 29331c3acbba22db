"""Verbs, equality, introspection, upserts and patterns over small graphs made by hand."""

import json
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.errors import GraphError, envelope
from graphloom.functions.ids import vertex_id
from graphloom.functions.scalars import equals, greatest_of, least_of, less, same, shown, sort_key
from graphloom.model import EDGE_SCHEMA, VERTEX_SCHEMA, Graph
from graphloom.operators import introspect, traverse, upsert, verbs
from graphloom.operators.patterns import as_node, as_path, as_relationship, at, edge, match, matching, node, prop
from graphloom.plans import verbs_json
from graphloom.plans.guard import check
from graphloom.plans.results import plain, run_json

A, B, C, D = (f"00000000-0000-5000-8000-00000000000{i}" for i in range(1, 5))


def props(**values):
    return {k: json.dumps(v) for k, v in values.items()}


@pytest.fixture(scope="module")
def graph(spark):
    v = [(A, "Function", "a", props(name="main", n=1)), (B, "Variable", "b", props(name="x", flag=True)), (C, "Function", "c", props(n=1.0, none=None))]
    e = [(A, B, "DEFINES", {}), (A, B, "REFERENCES", props(w=2)), (A, D, "CALLS", {}), (C, B, "REFERENCES", {})]
    return Graph(spark.createDataFrame(v, VERTEX_SCHEMA).cache(), spark.createDataFrame(e, EDGE_SCHEMA).cache())


def run(g, verb_, limit=None, **args):
    return run_json(g, json.dumps({"query": verb_, "args": args}), limit, 120)


def test_verbs(graph):
    assert [r["id"] for r in run(graph, "all_vertices").rows] == [A, B, C]
    assert run(graph, "all_vertices", 1).truncated and not run(graph, "all_vertices", 3).truncated
    assert len(run(graph, "all_edges").rows) == 4
    assert [r["id"] for r in run(graph, "vertex_with_type", t="Function").rows] == [A, C]
    assert run(graph, "all_vertices").rows[1] == {"id": B, "t": "Variable", "properties": {"name": "x", "flag": True}}
    assert [r["id"] for r in run(graph, "vertex_with_property_equal", name="n", value=1).rows] == [A, C]
    assert [r["id"] for r in run(graph, "vertex_with_property_equal", name="flag", value=1).rows] == [B]
    assert [r["id"] for r in run(graph, "vertex_with_property_equal", name="none", value=None).rows] == [A, B, C]
    assert len(run(graph, "edge_with_property_equal", name="w", value=2.0).rows) == 1
    assert run(graph, "edge_with_property_equal", name="w", value="2").rows == []


def test_pipe_counts_edges_for_its_limit(graph):
    out = run(graph, "pipe", vertex_id=A.upper(), direction="outbound")
    assert [r["id"] for r in out.rows] == [B, B] and out.truncated  # parallel edges; one neighbour isn't stored
    assert [r["id"] for r in run(graph, "pipe", vertex_id=B, direction="inbound", t="REFERENCES").rows] == [A, C]


@pytest.mark.parametrize(
    "text, code",
    [
        ("nope", "QUERY_PARSE_ERROR"), ("[]", "QUERY_PARSE_ERROR"), ('{"query": "drop"}', "QUERY_UNSUPPORTED"), ('{"query": "drop", "args": 1}', "QUERY_PARSE_ERROR"),
        ('{"query": "vertex_with_type", "args": {"t": "1x"}}', "QUERY_PARSE_ERROR"), ('{"query": "vertex_with_type", "args": {}}', "QUERY_PARSE_ERROR"), ('{"query": "all_edges", "args": {"x": 1}}', "QUERY_PARSE_ERROR"),
        ('{"query": "pipe", "args": {"vertex_id": "zz", "direction": "outbound"}}', "QUERY_PARSE_ERROR"), ('{"query": "vertex_with_property_equal", "args": {"name": "a", "value": [1]}}', "QUERY_PARSE_ERROR"),
    ],
)
def test_refused(text, code):
    with pytest.raises(GraphError) as e:
        verbs_json.parse(text)
    assert e.value.code == code


VALUES = [1, 1.0, True, "1", 0, False, None, 100, 1e2, 0.1, -0.0, "true", 2**62, "a\"b\n"]


def test_equality_is_pythons(spark):
    texts = [json.dumps(v) for v in VALUES] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[equals(F.col("t"), v).alias(f"v{k}") for k, v in enumerate(VALUES)]).orderBy("i").collect()
    for i, stored in enumerate([*VALUES, None]):
        for k, v in enumerate(VALUES):
            assert rows[i][f"v{k}"] == (stored == v), (stored, v)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=20))
def test_ids_are_uuid5(spark, names):
    import uuid

    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", vertex_id(F.col("n")).alias("i")).collect()
    assert all(r.i == str(uuid.uuid5(uuid.UUID("8f6e2c1b-7d3a-4f59-9a4b-1c0d2e5f8a91"), r.n)) for r in got)


def test_upsert_merges_and_counts(spark):
    schema = VERTEX_SCHEMA + ", seq int"
    store = spark.createDataFrame([(A, "Class", "a", props(x=1, y=2))], VERTEX_SCHEMA)
    batch = spark.createDataFrame([(A, "Other", "a", props(y=3), 1), (B, "File", "b", props(z=1), 2), (B, "Late", "b", props(z=2), 3)], schema)
    done = upsert.upsert_vertices(store, batch)
    rows = {r.id: (r.t, dict(r.props)) for r in done.items.collect()}
    assert rows == {A: ("Class", props(x=1, y=3)), B: ("File", props(z=2))}
    assert (done.inserted.first().n, done.attempted.first().n) == (1, 3)
    again = upsert.upsert_vertices(done.items, batch)
    assert {r.id: (r.t, dict(r.props)) for r in again.items.collect()} == rows and again.inserted.first().n == 0
    edges = spark.createDataFrame([(A, B, "CALLS", props(k=1), 1), (A, D, "CALLS", {}, 2)], EDGE_SCHEMA + ", seq int")
    held = upsert.upsert_edges(spark.createDataFrame([], EDGE_SCHEMA), edges, done.items)
    assert [(r.outbound_id, r.inbound_id) for r in held.items.collect()] == [(A, B)]
    assert (held.inserted.first().n, held.attempted.first().n) == (1, 2)


def test_describe_and_notes(spark, graph):
    assert [(r.name, r["count"], r.property_keys) for r in introspect.describe(graph.vertices, ("id",)).collect()] == [("Function", 2, ["n", "name", "none"]), ("Variable", 1, ["flag", "name"])]
    notes = lambda *stamps: [r.note for r in introspect.version_notes(spark.createDataFrame([(str(i), "File", str(i), p) for i, p in enumerate(stamps)], VERTEX_SCHEMA)).collect()]
    assert notes(props(schema_version="v2")) == [] and notes({}) == [] and notes(props(p=1), props(schema_version="v2")) == []
    assert len(notes(props(p=1))) == 1 and len(notes(props(schema_version="v0"), props(schema_version="v1"))) == 2


def test_paths_use_an_edge_once_and_closure_ends(spark):
    e = spark.createDataFrame([("a", "b", "T", {}), ("b", "a", "T", {}), ("b", "c", "T", {})], EDGE_SCHEMA)
    starts = spark.createDataFrame([("a",)], "id string")
    assert sorted((r.end_id, r.length) for r in traverse.paths(starts, traverse.steps_of(e), 1, 4, lambda df: df.cache()).collect()) == [("a", 2), ("b", 1), ("c", 2)]
    links = e.select(F.col("outbound_id").alias("src"), F.col("inbound_id").alias("dst"))
    found = traverse.closure(spark, links, starts.select(F.col("id").alias("node")), lambda df: df.cache())
    assert sorted((r.node, r.depth) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_closure_loses_no_far_nodes(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long").cache()
    starts = spark.createDataFrame([(0,)], "node long")
    close = lambda **more: sorted(r.depth for r in traverse.closure(spark, links, starts, lambda df: df.cache(), **more).collect())
    assert close() == close(max_rounds=4) == [0, 1, 2, 3, 4]
    with pytest.raises(GraphError):
        close(max_rounds=3)


@pytest.mark.parametrize("text", ["SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (SELECT 1)", "SELECT upper('a'), transform(array(1, 2), x -> x + 1), sum(id) OVER (ORDER BY id) FROM range(3) LATERAL VIEW explode(array(1)) t AS c", "SELECT CASE WHEN 'INSERT INTO t' = 'reflect(x)' THEN 1 END", "SELECT id FROM range(3) GROUP BY id HAVING count(*) > 0 ORDER BY id LIMIT 2"])
def test_guard_accepts(spark, text):
    check(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE t", "CREATE TABLE t (a INT)", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SET x = 1", "CACHE TABLE t", "SELECT reflect('java.lang.System', 'exit', 1)",
        "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hosts`", "SELECT * FROM text.`/etc/hosts`", "SELECT * FROM binaryFile.`/etc`", "SELECT 1 WHERE 1 IN (SELECT length(value) FROM text.`/etc/hosts`)",
        "SELECT (SELECT max(reflect('java.lang.System', 'exit', 1)))", "SELECT transform(array(1), x -> reflect('java.lang.System', 'exit', x))", "SELECT id FROM range(1) ORDER BY java_method('java.lang.System', 'nanoTime')", "SELECT * FROM IDENTIFIER('text.`/etc/hosts`')",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'exit', 1)", "SELECT * FROM no_such_table", "SELECT my_own_function(1)", "SELECT * FROM no_such_function(1)", "WITH a AS (SELECT * FROM text.`/etc/hosts`) SELECT * FROM a", "SELECT * FROM a.b.c.`/etc`", "SELECT * FROM range(1) JOIN LATERAL (SELECT * FROM csv.`/etc/hosts`)",
        "SELECT * FROM parquet.`/etc`", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", "SELECT java_method('java.lang.Math', 'abs', 1)", "nonsense",
    ],
)
def test_guard_refuses(spark, text):
    with pytest.raises(GraphError) as e:
        check(spark, text)
    assert e.value.code in ("READ_ONLY_VIOLATION", "QUERY_PARSE_ERROR")


@pytest.fixture(scope="module")
def chain(spark):
    v = [(x, t, x, props(**p)) for x, t, p in (("a", "E", dict(n=9, s="x", i=1)), ("b", "E", dict(n=10, i="1")), ("c", "F", dict(n=100, s="y", f=True)))]
    e = [("a", "b", "R", props(w=1)), ("b", "c", "R", {})]
    return Graph(spark.createDataFrame(v, VERTEX_SCHEMA).cache(), spark.createDataFrame(e, EDGE_SCHEMA).cache())


def test_an_edge_is_used_once_in_a_match(chain):
    both_ways = (node("x"), edge("R"), node("y"), edge("R", direction="in"), node("z"))
    assert match(chain, *both_ways).count() == 0
    assert match(chain, node("x"), edge("R"), node("y"), also=((node("z"), edge("R"), node("y")),)).count() == 0
    first = match(chain, node("x"), edge("R"), node("y"))
    assert match(chain, node("y"), edge("R", direction="in"), node("z"), rows=first).count() == 2  # a second MATCH begins anew


def test_paths_of_any_length(chain):
    n = lambda hops, **more: match(chain, node("x"), edge("R", hops=hops, **more), node("y")).count()
    assert [n(1), n((1, None)), n((2, None)), n(2), n((0, None)), n((0, 1))] == [2, 3, 1, 1, 6, 5]
    assert n((1, None), direction="both") == 6
    rows = match(chain, node("x"), edge(name="r", hops=(2, None)), node("y")).select(at("x"), at("y"), at("r", "key")).collect()
    assert [tuple(r) for r in rows] == [("a", "c", ["a|R|b", "b|R|c"])]


def test_optional_keeps_rows_without_a_whole_match(chain):
    every = match(chain, node("x"))
    found = lambda *pattern, **more: {(r.x__id, r.y__id) for r in match(chain, *pattern, rows=every, optional=True, **more).collect()}
    assert found(node("x"), edge("R"), node("y")) == {("a", "b"), ("b", "c"), ("c", None)}
    assert found(node("x"), edge("R"), node("y", "F")) == {("a", None), ("b", "c"), ("c", None)}
    assert found(node("x"), edge("R"), node("y"), where=lambda: less(prop("y", "n"), 50)) == {("a", "b"), ("b", None), ("c", None)}
    assert match(chain, node("x"), edge("R"), node("y", "F"), rows=every, optional=True).groupBy(at("x").alias("x")).agg(F.count(at("y")).alias("n")).where("n = 1").count() == 1


def test_properties_compare_by_kind(chain):
    ids = lambda where: {r.x__id for r in match(chain, node("x"), where=where).collect()}
    assert ids(lambda: same(prop("x", "i"), 1)) == {"a"} and ids(lambda: same(prop("x", "i"), "1")) == {"b"} and ids(lambda: same(prop("x", "f"), 1)) == set()
    assert ids(lambda: ~same(prop("x", "s"), "x")) == {"c"}  # a missing property is neither equal nor unequal
    assert ids(lambda: less(prop("x", "n"), 50)) == {"a", "b"} and ids(lambda: less(prop("x", "s"), 5)) == set() and ids(lambda: less("w", prop("x", "s"))) == {"a", "c"}
    assert ids(lambda: less(10, prop("x", "n"), or_equal=True)) == {"b", "c"}
    everything = match(chain, node("x"))
    assert everything.agg(greatest_of(prop("x", "n")).alias("m"), least_of(prop("x", "s")).alias("s")).first().asDict() == {"m": "100", "s": '"x"'}
    assert [r.x__id for r in everything.orderBy(sort_key(prop("x", "n"))).collect()] == ["a", "b", "c"]
    assert [r.x__id for r in everything.orderBy(sort_key(prop("x", "s")), at("x")).collect()] == ["a", "c", "b"]
    assert [r.x__id for r in everything.orderBy(sort_key(prop("x", "i"))).collect()] == ["b", "a", "c"]


def test_patterns_of_types_directions_and_properties(chain, graph):
    assert match(chain, node("x"), edge(direction="both"), node("y")).count() == 4
    assert match(chain, node("x"), edge("R", "S", w=1), node("y", "E")).count() == 1 and match(chain, node("x", n=10.0)).count() == 1
    assert match(chain, node("x"), edge("R"), node("x")).count() == 0 and match(chain, node("x", "E"), also=((node("y", "F"),),)).count() == 2
    every = match(chain, node("x"))
    assert {r.x__id for r in matching(chain, every, node("x"), edge("R"), node()).collect()} == {"a", "b"}
    assert {r.x__id for r in matching(chain, every, node("x"), edge("R"), node("y"), negate=True, where=lambda: same(prop("y", "f"), True)).collect()} == {"a", "c"}
    assert [(r.a__id, r.name) for r in match(graph, node("a", "Function"), edge("REFERENCES"), node("b"), where=lambda: same(prop("a", "n"), 1)).select(at("a"), shown(prop("b", "name")).alias("name")).orderBy("a__id").collect()] == [(A, "x"), (C, "x")]
    for bad in (lambda: edge(hops=(3, 2)), lambda: edge(direction="up"), lambda: match(chain, node("x"), edge()), lambda: match(chain, node("x"), optional=True)):
        with pytest.raises(GraphError):
            bad()


def test_vertices_edges_and_paths_as_results(chain):
    row = match(chain, node("x"), edge(name="r"), node("y", "F")).select(as_node("x").alias("x"), as_relationship("r").alias("r"), as_path("x", "r", "y").alias("p")).first()
    out = plain(row)
    assert out["x"] == {"_id": "b", "_labels": ["E"], "n": 10, "i": "1"} and out["r"] == {"_type": "R", "_start": "b", "_end": "c"}
    assert [n["_id"] for n in out["p"]["_nodes"]] == ["b", "c"] and len(out["p"]["_rels"]) == 1


def test_envelope_hides_folders():
    assert envelope(GraphError("PATH_VIOLATION", "no /a/b/c.cpp"))["error"] == {"code": "PATH_VIOLATION", "message": "no <path>/c.cpp"}
    assert envelope(RuntimeError("/secret"))["error"]["code"] == "INTERNAL_ERROR"


def test_limit_and_specific(spark, graph):
    assert verbs.all_vertices(graph, 2).count() == 2
    assert verbs.specific_vertices(graph, spark.createDataFrame([(B,)], "id string")).first().id == B


def test_unnamed_vertices_in_chained_matches(spark):
    v = spark.createDataFrame([(x, t, x, {}) for x, t in (("c1", "C"), ("c2", "C"), ("n1", "N"), ("o1", "O"), ("o2", "O"))], VERTEX_SCHEMA)
    e = spark.createDataFrame([("c1", "n1", "IN", {}), ("c2", "n1", "IN", {}), ("o1", "c1", "BY", {}), ("o2", "c1", "BY", {})], EDGE_SCHEMA)
    g = Graph(v, e)
    rows = match(g, node("c", "C"), edge("IN"), node(label="N"))
    assert rows.columns == ["c__id", "c__t", "c__props"]
    more = match(g, node("c"), edge("BY", direction="in"), node(label="O"), rows=rows)
    assert sorted(r.c__id for r in more.collect()) == ["c1", "c1"]
    assert sorted(r.c__id for r in match(g, node("c"), edge("BY", direction="in"), node(), rows=rows, optional=True).collect()) == ["c1", "c1", "c2"]
    assert [r.c__id for r in matching(g, rows, node("c"), edge("BY", direction="in"), node()).collect()] == ["c1"]
    assert [r.c__id for r in matching(g, rows, node("c"), edge("BY", direction="in"), node(), negate=True).collect()] == ["c2"]


def test_a_pipes_flag_comes_with_its_own_job(spark):
    v = spark.createDataFrame([(str(uuid.UUID(int=i)), "T", f"u{i}", {}) for i in range(6)], VERTEX_SCHEMA)
    e = spark.createDataFrame([(str(uuid.UUID(int=0)), str(uuid.UUID(int=i)), "R", {}) for i in (1, 2, 3, 9)], EDGE_SCHEMA)
    g, counted = Graph(v, e), []
    plain = verbs.pipe_edges

    def counting(*args, **more):
        counted.append("seen" not in more and len(args) < 6)
        return plain(*args, **more)

    verbs.pipe_edges = counting
    try:
        for limit, rows, flag in ((5, 3, True), (4, 3, True), (3, 3, True), (2, 2, True), (1, 1, True)):
            out = run_json(g, json.dumps({"query": "pipe", "args": {"vertex_id": str(uuid.UUID(int=0)), "direction": "outbound"}}), limit)
            assert (out.rows_returned, out.truncated) == (rows, flag), limit
        whole = Graph(v, e.where(F.col("inbound_id") != str(uuid.UUID(int=9))))
        for limit, flag in ((4, False), (3, False), (2, True)):
            assert run_json(whole, json.dumps({"query": "pipe", "args": {"vertex_id": str(uuid.UUID(int=0)), "direction": "outbound"}}), limit).truncated == flag
    finally:
        verbs.pipe_edges = plain
    assert not any(counted)  # no second count of the edges
