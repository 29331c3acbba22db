"""A batch's units are checked once, in one pass over their cursors."""

from graphloom.lineage import cut_lineage
from graphloom.streaming import ingest

from .test_units import unit, write

ROWS = "tu string, id long, parent_id long"


def test_cursors_are_read_once(spark):
    found = ingest.unit_errors(cut_lineage(spark, spark.createDataFrame([("a", 1, None), ("a", 2, 1)], ROWS)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan") == 1 and found.count() == 0


def test_what_is_wrong_with_units(spark):
    rows = [
        ("good", 1, None), ("good", 2, 1), ("good", 3, 1), ("twice", 1, None), ("twice", 2, 1), ("twice", 2, 1), ("lost", 1, None), ("lost", 3, 2), ("later", 1, None), ("later", 2, 3), ("later", 3, 1), ("self", 1, 1),
        ("none", None, None), (None, 1, None), ("other", 1, None), ("other", 5, 1), ("root twice", 1, None), ("root twice", 1, None),
    ]
    late, lost, twice, none = "a parent that doesn't come before its child", "a parent that isn't in the unit", "an id that comes twice", "a cursor without unit or id"
    want = {"twice": twice, "lost": lost, "later": late, "self": late, "none": none, None: none, "root twice": twice}
    assert {r.tu: r.error for r in ingest.unit_errors(spark.createDataFrame(rows, ROWS)).collect()} == want


def test_a_batch_is_checked_once(spark, tmp_path, monkeypatch):
    checked, kept, check = [], [], ingest.unit_errors
    monkeypatch.setattr(ingest, "unit_errors", lambda rows: checked.append(1) or check(rows))
    monkeypatch.setattr(ingest, "upsert_cursors", lambda store, cursors, errors, **options: kept.extend(r.tu for r in cursors.select("tu").distinct().collect()))
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.json", unit("a.cpp", ["A"]))
    write(tmp_path / "in" / "bad.json", unit("bad.cpp", ["Bad"]), broken=True)
    stream = ingest.ingest_files(spark, str(tmp_path / "in"), None, f"{tmp_path}/errors", f"{tmp_path}/state")
    stream.processAllAvailable()
    stream.stop()
    assert len(checked) == 1 and kept == ["a.cpp"]
