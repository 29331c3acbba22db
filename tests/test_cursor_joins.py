from graphloom.sources.cursor_view import cursors


def test_tables_of_cursors_are_joined_by_merge(spark):
    joins = [x for x in cursors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in f" {x}"]
    assert len(joins) == 3 and all("strategy=merge" in x for x in joins)
