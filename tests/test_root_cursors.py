from graphloom.operators import extract


def test_roots_are_not_dealt_by_a_null_parent(spark):
    rows = spark.createDataFrame([("u", 1, None, "FUNCTION_DECL", "f"), ("u", 2, 1, "DECL_REF_EXPR", ""), ("u", 3, None, "VAR_DECL", "v")], "tu string, id long, parent_id long, kind string, usr string")
    found = extract.in_context(rows)
    assert sorted((r.id, r.parent_usr, r.func_usr) for r in found.collect()) == [(1, None, None), (2, "f", "f"), (3, None, None)]
    # the join with what holds above is one side of a union, whose other side has the roots
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.getClass().getSimpleName() == "Union"
    assert "LeftOuter" not in plan.children().apply(1).toString()
