"""The cache of units, and files of cursors as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.operators.extract import extract
from graphloom.sources.store import ParquetStore
from graphloom.sources.units import UnitCache, changes, unit_rows
from graphloom.streaming.ingest import ingest_files, stream_sources

CURSOR = "tu string, id long, parent_id long, kind string, usr string, spelling string, file string, line int, col int"


def unit(tu, names):
    return [(tu, 0, None, "TRANSLATION_UNIT", "", tu, tu, 1, 1)] + [(tu, k, 0, "CLASS_DECL", n, n, tu, k, 1) for k, n in enumerate(names, 1)]


def cursors_of(spark, units):
    return spark.createDataFrame([r for tu, names in units.items() for r in unit(tu, names)], CURSOR)


def files_of(spark, units, at="2024-01-01"):
    return spark.createDataFrame([(tu, " ".join(names), at) for tu, names in units.items()], "tu string, text string, at string").select("tu", "text", F.col("at").cast("timestamp").alias("modified"))


def seen(df):
    return sorted(str(tuple(r)) for r in df.drop("seq").select(sorted(c for c in df.columns if c != "seq")).collect())


def test_only_changed_units_are_extracted(spark, tmp_path):
    cache = UnitCache(spark, f"file://{tmp_path}/u")
    one = {"a.cpp": ["A"], "b.cpp": ["B", "A"], "c.cpp": ["C"]}
    done = cache.refresh(unit_rows(files_of(spark, one)), cursors_of(spark, one))
    assert (done.hits, done.misses, done.evictions) == (0, 3, 0)
    two = {"a.cpp": ["A"], "b.cpp": ["B2"], "d.cpp": ["D"]}
    # a.cpp's cursors are wrong here: they aren't looked at
    done = cache.refresh(unit_rows(files_of(spark, two)), cursors_of(spark, two | {"a.cpp": ["wrong"]}))
    assert (done.hits, done.misses, done.evictions) == (1, 2, 2) and done.counts == {"hit": 1, "changed": 1, "new": 1, "gone": 1}
    nodes, edges = extract(cursors_of(spark, two))
    assert seen(done.nodes) == seen(nodes) and seen(done.edges) == seen(edges)
    touched = cache.refresh(unit_rows(files_of(spark, two, "2024-05-05")), cursors_of(spark, {"x": []}))
    assert (touched.hits, touched.misses) == (3, 0) and touched.counts == {"touched": 3} and seen(touched.nodes) == seen(nodes)
    cache.compact()
    assert seen(cache.rows("nodes")) == seen(nodes) and len(cache.manifest().generations) == 1
    assert cache.refresh(unit_rows(files_of(spark, two, "2024-05-05")), cursors_of(spark, {"x": []})).hits == 3
    # other options are another unit
    assert cache.refresh(unit_rows(files_of(spark, two, "2024-05-05")), cursors_of(spark, two), emit_calls=True).misses == 3
    assert cache.invalidate(spark.createDataFrame([("a.cpp",), ("no",)], "tu string")) == 1
    again = cache.refresh(unit_rows(files_of(spark, two, "2024-05-05")), cursors_of(spark, two), emit_calls=True)
    assert (again.hits, again.misses) == (2, 1) and seen(again.nodes) == seen(nodes)
    stale = cache.manifest()
    cache.compact()
    with pytest.raises(GraphError):
        cache.manifests.publish(stale)


def test_changes_with_nulls_and_repeated_units(spark):
    rows = [("a", "x", None, ["-O"]), ("a", "y", "2024-01-01", ["-O"]), ("a", "y", "2024-01-01", ["-O"]), ("a", "y", "2024-01-01", None), ("n", None, None, None), (None, "z", None, None)]
    files = spark.createDataFrame(rows, "tu string, text string, at string, flags array<string>").withColumn("modified", F.col("at").cast("timestamp"))
    units = unit_rows(files)
    assert sorted((r.tu, r.length) for r in units.collect()) == [("a", 1), ("a", 1), ("n", 0)]
    known = units.withColumn("generation", F.lit(0))
    assert {r.state for r in changes(known, units).collect()} == {"hit"}
    assert {r.state for r in changes(known, units.limit(0)).collect()} == {"gone"} and changes(known.limit(0), units.limit(0)).count() == 0


def write(path, rows, broken=False):
    names = [x.split()[0] for x in CURSOR.split(", ")]
    text = "".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows)
    path.write_text(text + ("{not json\n" if broken else ""))


def test_files_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = ParquetStore(spark, f"file://{tmp_path}/g", buckets=2)
    run = lambda: ingest_files(spark, str(folder), store, f"{tmp_path}/errors", f"{tmp_path}/state")
    write(folder / "a.json", unit("a.cpp", ["A"]))
    write(folder / "bad.json", unit("bad.cpp", ["Bad"]), broken=True)
    write(folder / "lost.json", unit("lost.cpp", ["Lost"])[1:])
    q = run()
    q.processAllAvailable()
    write(folder / "b.json", unit("b.cpp", ["B"]))
    q.processAllAvailable()
    q.stop()
    version = store.version()
    q = run()  # a restart reads nothing again, and goes on with what is new
    q.processAllAvailable()
    assert store.version() == version
    write(folder / "c.json", unit("c.cpp", ["C"]))
    q.processAllAvailable()
    q.stop()
    assert {r.usr for r in store.read().vertices.collect()} == {"A", "B", "C", "file://a.cpp", "file://b.cpp", "file://c.cpp"}
    errors = spark.read.parquet(f"{tmp_path}/errors").collect()
    assert sorted((r.tu or r.path.rpartition("/")[2], r.error) for r in errors) == [("bad.json", "a line that can't be read: {not json"), ("lost.cpp", "a parent that isn't in the unit")]


def test_source_files_as_a_stream(spark, tmp_path):
    (tmp_path / "s" / "deep").mkdir(parents=True)
    (tmp_path / "s" / "a.cpp").write_text("#if A\n#endif\n")
    (tmp_path / "s" / "deep" / "b.h").write_text("x")
    (tmp_path / "s" / "no.txt").write_text("x")
    q = stream_sources(spark, str(tmp_path / "s")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.file.rpartition("/")[2], r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a.cpp", "#if A\n#endif\n"), ("b.h", "x")]
