from pyspark.sql import functions as F

from graphloom.operators import traverse


def test_what_was_reached_is_read_a_logarithm_of_the_depths_times(spark):
    anti = []

    def checkpoint(df):
        anti.append("LeftAnti" in df._jdf.queryExecution().optimizedPlan().toString())
        return spark.createDataFrame(df.collect(), df.schema)

    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    found = traverse.closure(spark, chain, spark.createDataFrame([(0,)], "node long"), checkpoint)
    assert sorted((r.node, r.depth) for r in found.collect()) == [(i, i) for i in range(13)]
    assert sum(anti) == 4  # at depths 1, 2, 4 and 8


def test_cycles_keep_their_smallest_depth(spark):
    links = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(0, 3)], "src long, dst long")
    found = traverse.closure(spark, links, spark.createDataFrame([(0,), (5,)], "node long"), lambda df: df.localCheckpoint())
    assert sorted(found.where("start = 0").select("node", "depth").collect()) == [(0, 0), (1, 1), (2, 2), (3, 1), (4, 2), (5, 3), (6, 4)]
    assert sorted(found.where("start = 5").select("node", "depth").collect()) == [(0, 2), (1, 3), (2, 4), (3, 3), (4, 4), (5, 0), (6, 1)]
    assert found.groupBy("start", "node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
