"""The store against an upsert in plain Python: deltas, compaction, splits, look-ups, pushed filters, counts."""

import io
import json
import os
import random
import uuid
from contextlib import redirect_stdout

import pytest

from graphloom.errors import GraphError
from graphloom.model import EDGE_SCHEMA, VERTEX_SCHEMA, Graph
from graphloom.operators import verbs
from graphloom.plans.results import run_json
from graphloom.sources import manifest
from graphloom.sources.store import ParquetStore


def folded(state, batch):
    """vertices {id: (t, usr, props)} after a batch of (id, t, usr, props, seq)."""
    for i, t, usr, props, _ in sorted(batch, key=lambda r: r[4]):
        old = state.get(i)
        state[i] = (old[0], old[1], old[2] | props) if old else (t, usr, dict(props))


def folded_edges(state, batch, ids):
    for a, b, t, props, _ in sorted(batch, key=lambda r: r[4]):
        if a in ids and b in ids:
            state[a, t, b] = state.get((a, t, b), {}) | props


def seen(g):
    v = {r.id: (r.t, r.usr, dict(r.props)) for r in g.vertices.collect()}
    e = {(r.outbound_id, r.t, r.inbound_id): dict(r.props) for r in g.edges.collect()}
    return v, e


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def batch_of(rng, n, ids, seq=0):
    vertices = [(f"v{rng.randrange(ids)}", rng.choice(["A", "B", "C d:%"]), f"u{k}", rng.choice([{}, {"x": str(rng.randrange(5))}, {"y": '"s"', "x": "true"}]), seq + k) for k in range(n)]
    edges = [(f"v{rng.randrange(ids)}", f"v{rng.randrange(ids)}", rng.choice(["R", "S"]), rng.choice([{}, {"w": str(k)}]), seq + k) for k in range(n)]
    return vertices, edges


def frames(spark, vertices, edges):
    return spark.createDataFrame(vertices, VERTEX_SCHEMA + ", seq int"), spark.createDataFrame(edges, EDGE_SCHEMA + ", seq int")


def test_random_upserts_splits_and_compactions(spark, tmp_path):
    rng, url = random.Random(3), f"file://{tmp_path}/g"
    vertices, edges = {}, {}
    for step in range(3):
        # opened anew each time, and with another number of buckets, which the manifest overrules
        store = ParquetStore(spark, url, buckets=(4, 16, 1)[step], split_rows=12, share=0.3, max_deltas=3)
        own = batch_of(rng, (60, 80, 3)[step], 90, 1000 * step)
        before = set(vertices), set(edges)
        counts = store.upsert(*frames(spark, *own))
        folded(vertices, own[0])
        folded_edges(edges, own[1], set(vertices))
        g = store.read()
        assert seen(g) == (vertices, edges)
        assert counts == {"vertices_inserted": len(set(vertices) - before[0]), "vertices_attempted": len(own[0]), "edges_inserted": len(set(edges) - before[1]), "edges_attempted": len(own[1])}
        # the manifest's counts are those of a scan
        for kind, rows in (("vertices", [(t, p) for t, _, p in vertices.values()]), ("edges", [(k[1], p) for k, p in edges.items()])):
            want = {t: (sum(x[0] == t for x in rows), sorted({k for x in rows if x[0] == t for k in x[1]})) for t in {x[0] for x in rows}}
            assert {t: (n, keys) for t, n, keys in store.describe(kind)} == want
        i = rng.choice(sorted(vertices))
        assert {r.id: (r.t, r.usr, dict(r.props)) for r in g.vertices_of([i, "nobody"]).collect()} == {i: vertices[i]}
        for side, at in (("outbound", 0), ("inbound", 2)):
            assert {(r.outbound_id, r.t, r.inbound_id) for r in g.edges_at([i], side, "R").collect()} == {k for k in edges if k[at] == i and k[1] == "R"}
        for value, fits in ((1, lambda p: p.get("x") in ("1", "true")), (None, lambda p: "x" not in p)):
            assert {r.id for r in g.vertices_with("x", value).collect()} == {k for k, v in vertices.items() if fits(v[2])}
        assert {r.id for r in store.read(types={"C d:%"}).vertices.collect()} == {k for k, v in vertices.items() if v[0] == "C d:%"}
    m = store.manifest()
    assert len(m.buckets["vertices"]) > 4 and max(d for d, _ in m.buckets["vertices"]) > 2  # split
    assert any(not e.base for e in m.entries)
    store.compact()
    assert seen(store.read()) == (vertices, edges) and all(e.base for e in store.manifest().entries)
    store.expire(keep=1)
    assert seen(store.read()) == (vertices, edges)
    with pytest.raises(GraphError):
        ParquetStore(spark, url, buckets=3)


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("large")
    store = ParquetStore(spark, f"file://{folder}/g", buckets=8)
    v = spark.range(60_000).selectExpr("format_string('v%06d', id) AS id", "'P' AS t", "concat('u', id) AS usr", "map('size', cast(id % 500 AS string), 'name', concat('\"n', id, '\"'), 'flag', if(id % 1000 = 0, 'true', 'false')) AS props")
    e = spark.range(60_000).selectExpr("format_string('v%06d', id) AS outbound_id", "format_string('v%06d', id % 100) AS inbound_id", "'R' AS t", "map('w', cast(id AS string)) AS props")
    store.write(Graph(v, e))
    return store, f"{folder}/g"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_ten_rows_into_many_write_kilobytes(spark, large):
    store, folder = large
    before = size_of(folder)
    rows = [(f"v{k:06d}", "Q", "x", {"name": '"new"', "extra": "1"}, k) for k in range(0, 18, 2)] + [("fresh", "Q", "x", {}, 99)]
    counts = store.upsert(*frames(spark, rows, [("fresh", "v000001", "R", {}, 1)]))
    assert counts["vertices_inserted"] == 1 and counts["edges_inserted"] == 1 and size_of(folder) - before < 100_000 < before
    assert store.totals() == {"vertices": 60_001, "edges": 60_001}
    g = store.read()
    assert g.vertices.count() == 60_001 and g.vertices_with("name", "n4").count() == 0 and g.vertices_with("name", "new").count() == 9


def test_lookups_open_few_files(spark, large):
    store, _ = large
    g = store.read()
    everything = len(store.manifest().of("vertices"))
    found = g.vertices_of(["v000004"])
    assert everything > 8 and len(found.inputFiles()) <= 4
    assert [(r.t, dict(r.props)["size"]) for r in found.collect()] == [("P", "4")]
    hop = g.edges_at(["v000007"], "inbound", "R")
    assert len(hop.inputFiles()) <= 4 and hop.count() == 600
    assert sorted(r.usr for r in verbs.pipe(g, "v000123", "outbound", limit=10).collect()) == ["u23"]
    assert {r.usr for r in verbs.pipe(g, "v000007", "inbound", limit=3).collect()} == {"u7", "u107", "u207"}


def test_tables_of_ids_and_answers(spark, large):
    store, _ = large
    g = store.read()
    ids = spark.createDataFrame([("v000004",), ("v000123",), ("nobody",)], "id string")
    assert len(verbs.specific_vertices(g, ids).inputFiles()) <= 8 and {r.id for r in verbs.specific_vertices(g, ids).collect()} == {"v000004", "v000123"}
    many = spark.range(0, 60_000, 20).selectExpr("format_string('v%06d', id) AS id")
    assert verbs.specific_vertices(g, many).count() == 3000 and verbs.specific_vertices(store.read(types={"Q"}), ids).count() == 0
    keys = spark.createDataFrame([("v000205", "R", "v000005"), ("v000205", "R", "v000006")], "outbound_id string, t string, inbound_id string")
    assert [r.inbound_id for r in verbs.specific_edges(g, keys).collect()] == ["v000005"]


def test_a_pipe_over_a_store_is_answered(spark, tmp_path):
    ids = [str(uuid.UUID(int=i)) for i in range(5)]
    store = ParquetStore(spark, f"file://{tmp_path}/g", buckets=2)
    store.upsert(*frames(spark, [(i, "T", i, {}, 0) for i in ids], [(ids[0], i, "R", {}, 0) for i in ids[1:]]))
    for limit, rows, flag in ((2, 2, True), (4, 4, False), (9, 4, False)):
        out = run_json(store.read(), json.dumps({"query": "pipe", "args": {"vertex_id": ids[0], "direction": "outbound"}}), limit)
        assert (out.rows_returned, out.truncated) == (rows, flag)
    assert run_json(store.read(), json.dumps({"query": "pipe", "args": {"vertex_id": ids[3], "direction": "outbound"}})).rows == []


def test_filters_reach_the_scan(spark, large):
    store, _ = large
    g = store.read()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    plain = Graph(g.vertices, g.edges)
    for name, value, column in (("name", "n77", "s$name"), ("size", 77, "n$size"), ("flag", True, "n$flag"), ("flag", 0, "n$flag"), ("size", None, "s$size"), ("none", 1, None)):
        df = verbs.vertex_with_property_equal(g, name, value)
        assert same(df, verbs.vertex_with_property_equal(plain, name, value))
        pushed = [x for x in plan_of(df).splitlines() if "PushedFilters" in x]
        assert column is None or any(column in x for x in pushed), pushed
    assert any("n$w" in x for x in plan_of(verbs.edge_with_property_equal(g, "w", 5)).splitlines() if "PushedFilters" in x)


def test_bloom_filters_and_hashes(spark):
    ids = [f"id{i}" for i in range(300)]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").selectExpr("id", "xxhash64(id) AS h").withColumn("p", manifest.bloom_positions(manifest.F.col("h"))).collect()
    assert all(manifest.hash_of(r.id) == r.h % 2**64 for r in rows)
    import base64

    bloom = base64.b64decode(manifest.bloom_of(p for r in rows for p in r.p))
    assert all(manifest.may_hold(bloom, manifest.hash_of(i)) for i in ids)
    assert sum(manifest.may_hold(bloom, manifest.hash_of(f"other{i}")) for i in range(2000)) < 100
    assert manifest.bloom_of(range(5000)) is None
    buckets = [(1, 0), (2, 1), (3, 3), (3, 7)]
    at = spark.createDataFrame([(i,) for i in ids], "id string").select("id", manifest.bucket_index(manifest.F.col("id"), buckets).alias("b")).collect()
    assert all(manifest.hash_of(r.id) & (1 << buckets[r.b][0]) - 1 == buckets[r.b][1] for r in at)
