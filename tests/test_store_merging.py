"""Only keys that come more than once in a batch are folded, and a new store isn't looked into."""

from graphloom.lineage import cut_lineage
from graphloom.model import VERTEX_SCHEMA
from graphloom.operators.upsert import merged
from graphloom.sources.store import ParquetStore

BATCH = f"{VERTEX_SCHEMA}, seq string"
ROWS = [("a", "T", "a1", {"y": "1", "x": "1"}, "1"), ("a", "S", "a2", {"x": "2", "z": None}, "2"), ("b", "T", "b", {"y": "1", "x": "3"}, "1"), (None, "T", "n1", {"x": "1"}, "2"), (None, "T", "n0", {"x": "4"}, "1"), ("c", "T", "c", {}, "1"), ("d", "T", "d", None, "1"), ("e", None, "e", {"x": None}, "2")]


def test_the_same_as_folding_all(spark):
    items = spark.createDataFrame(ROWS, BATCH)
    written = []
    some = merged(items, ("id",), ("t", "usr"), lambda df: written.append(df.count()) or cut_lineage(spark, df))
    as_rows = lambda df: sorted(str((r.id, r.t, r.usr, list(r.props.items()))) for r in df.select("id", "t", "usr", "props").collect())
    assert as_rows(some) == as_rows(merged(items, ("id",), ("t", "usr"))) and written == [2]  # a, and none
    keys = spark.createDataFrame([("a", None, "b", {"x": "1"}, "1"), ("a", None, "b", {"x": "2"}, "2"), ("a", "T", "b", {"x": "3"}, "2")], "outbound_id string, t string, inbound_id string, props map<string,string>, seq string")
    some = merged(keys, ("outbound_id", "t", "inbound_id"), (), lambda df: cut_lineage(spark, df))
    assert sorted(map(str, some.collect())) == sorted(map(str, merged(keys, ("outbound_id", "t", "inbound_id")).select(some.columns).collect())) and some.count() == 2


def test_single_rows_are_not_exploded(spark, tmp_path, monkeypatch):
    import graphloom.sources.store as module

    folded, fold = [], module.merged
    monkeypatch.setattr(module, "merged", lambda *args: folded.append(fold(*args)) or folded[-1])
    store = ParquetStore(spark, f"file://{tmp_path}/g", buckets=2)
    batch = spark.createDataFrame([(f"v{i}", "T", f"u{i}", {"x": str(i)}, "1") for i in range(3000)], BATCH)
    edges = spark.createDataFrame([(f"v{i}", f"v{i + 1}", "R", {}, "1") for i in range(3100)], "outbound_id string, inbound_id string, t string, props map<string,string>, seq string")
    counts = store.upsert(batch, edges)
    assert counts == {"vertices_inserted": 3000, "vertices_attempted": 3000, "edges_inserted": 2999, "edges_attempted": 3100}
    plan = folded[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan[plan.index("Generate explode") :].count("LeftSemi") == 1  # only keys that come again are exploded
    files = store.manifest().of("vertices")
    assert sum(e.rows for e in files) == sum(e.fresh for e in files) == 3000 and all(e.keys == {"x": e.rows} and e.low <= e.high for e in files)
    assert sorted(r.id for r in store.read().vertices_of(["v7", "v2999", "none"]).collect()) == ["v2999", "v7"]
    assert store.upsert(spark.createDataFrame([("v7", "T", "u7", {"y": "1"}, "1")], BATCH), edges.limit(0))["vertices_inserted"] == 0
    assert [r.props for r in store.read().vertices_of(["v7"]).collect()] == [{"x": "7", "y": "1"}]
