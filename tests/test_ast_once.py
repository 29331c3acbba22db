from pyspark.sql import functions as F

from graphloom.operators import astscan


def test_nodes_of_trees_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame([("u", i, None if i == 0 else (i - 1) // 2) for i in range(15)], "tu string, id long, parent_id long")
    filled = plain.select("*", *[F.lit("x").alias(c) for c in ("kind", "spelling", "usr", "type", "storage_class")], *[F.lit(1).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")])
    trees = astscan.tree_texts(filled.mapInArrow(counted, filled.schema), 8).collect()
    assert [(r.tu, r.id, r.tree.count('"id":')) for r in trees] == [("u", 0, 15)]
    assert made.value == 15
