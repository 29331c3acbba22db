from graphloom.model import EDGE_SCHEMA
from graphloom.operators import traverse


def test_keys_of_edges_are_made_after_the_join(spark):
    e = spark.createDataFrame([("a", "b", "R", {}), ("b", "c", "S", {})], EDGE_SCHEMA)
    sides = []

    def checkpoint(df):
        todo = [df._jdf.queryExecution().optimizedPlan()]
        while todo:
            plan = todo.pop()
            children = [plan.children().apply(i) for i in range(plan.children().length())]
            sides.extend(c.toString() for c in children if len(children) == 2)
            todo += children
        return spark.createDataFrame(df.collect(), df.schema)

    found = traverse.paths(spark.createDataFrame([("a",)], "id string"), traverse.steps_of(e), 1, 2, checkpoint)
    assert sorted(r.edges for r in found.collect()) == [["a|R|b"], ["a|R|b", "b|S|c"]]
    # as a column of a join's side it would be shuffled
    assert sides and not any("concat_ws" in line for x in sides for line in x.splitlines() if "Project" in line)
