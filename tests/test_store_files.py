"""Many buckets and files: small plans, few tasks that list, files moved by the tasks that wrote them."""

from py4j.java_gateway import JavaMember

from graphloom.model import Graph
from graphloom.sources import manifest
from graphloom.sources.store import ParquetStore


def test_places_of_many_buckets_are_one_literal(spark, monkeypatch):
    buckets = [*manifest.split((0, 0))[:1], *[b for a in manifest.whole(10) if a[1] & 1 for b in manifest.split(a)]]
    calls, call = [], JavaMember.__call__
    with monkeypatch.context() as m:
        m.setattr(JavaMember, "__call__", lambda self, *args: calls.append(self.name) or call(self, *args))
        at = manifest.bucket_index(manifest.F.col("id"), buckets)
    assert len(calls) < 100, len(calls)
    rows = spark.range(500).selectExpr("CAST(id AS STRING) AS id").select("id", at.alias("b")).collect()
    assert all(manifest.hash_of(r.id) & (1 << buckets[r.b][0]) - 1 == buckets[r.b][1] for r in rows) and len({r.b for r in rows}) > 100


def test_files_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "LISTING_TASKS", 3)
    v = spark.range(300).selectExpr("CAST(id AS STRING) AS id", "'T' AS t", "CAST(id AS STRING) AS usr", "map('x', '1') AS props")
    e = spark.createDataFrame([], "outbound_id string, inbound_id string, t string, props map<string,string>")
    store = ParquetStore(spark, f"file://{tmp_path}/g", buckets=64)
    store.write(Graph(v, e))
    m = store.manifest()
    assert len(m.of("vertices")) > 40 and m.version == 1
    spark.sparkContext.setJobGroup("listing", "")
    try:
        rows = store.read().vertices
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert any(s.numTasks == 3 for s in stages) and max(s.numTasks for s in stages) <= 4
    assert rows.count() == 300 and spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") != "3"
