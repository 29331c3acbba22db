"""Statements of a table are parsed by tasks, and judged as the driver judges one."""

import os

import pytest
from py4j.java_gateway import JavaMember

from graphloom import queries
from graphloom.lineage import shared_writer
from graphloom.plans import guard

SF = "/root/testdata/sf0.001"
STATEMENTS = (
    "SELECT 1", "SELEC 1", "", "SELECT id FROM seen", "SELECT id FROM SEEN", "SELECT id FROM unseen", "SELECT id FROM `a, b`", "SELECT id FROM `a`.`b`", "SELECT id FROM `a, c`", "SELECT * FROM default.seen", "SELECT * FROM default.kept", "SELECT * FROM spark_catalog.default.kept", "SELECT * FROM global_temp.wide",
    "SELECT * FROM global_temp.seen", "SELECT * FROM text.`/etc/hosts`", "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "WITH a AS (SELECT 1 AS x) SELECT x FROM b", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT builtin.upper('a')", "SELECT nothing_of_this_name(1)", "INSERT INTO seen SELECT 1", "DROP TABLE kept",
    "SELECT * FROM range(3)", "SELECT * FROM range((SELECT max(value) FROM text.`/etc/hosts`))", "SELECT " + "+".join(["1"] * 3000), "SET x = 1", "SELECT 'it''s\n[{\"class\": 1}]' AS t", "SELECT sum(id) OVER (ORDER BY id) FROM seen WHERE id IN (SELECT id FROM unseen)",
)


@pytest.fixture
def views(spark):
    for name in ("seen", "`a, b`"):
        spark.range(1).createOrReplaceTempView(name)
    spark.range(1).createOrReplaceGlobalTempView("wide")
    spark.range(1).write.mode("overwrite").saveAsTable("kept")
    yield
    for name in ("seen", "a, b"):
        spark.catalog.dropTempView(name)
    spark.catalog.dropGlobalTempView("wide")
    spark.sql("DROP TABLE kept")


def test_codes_are_those_of_check(spark, views):
    found = guard.codes(spark.createDataFrame(list(enumerate(STATEMENTS)), "n int, statement string").repartition(3), shared_writer(spark))
    want = {n: guard.code_of(spark, text, {}) for n, text in enumerate(STATEMENTS)}
    assert found.columns == ["n", "code"] and {r.n: r.code for r in found.collect()} == want and len(set(want.values())) == 3
    other = spark.newSession()  # its views and functions are its own
    rows = guard.codes(other.createDataFrame([(1, "SELECT id FROM seen"), (2, "SELECT 1"), (3, None)], "n int, statement string"), shared_writer(other))
    assert {r.n: r.code for r in rows.collect()} == {1: "READ_ONLY_VIOLATION", 2: "", 3: "QUERY_PARSE_ERROR"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_the_driver_parses_no_statement(spark, monkeypatch):
    calls, call = [], JavaMember.__call__
    monkeypatch.setattr(JavaMember, "__call__", lambda self, *args: calls.append(self.name) or call(self, *args))
    rows = queries.queries()["read_only_guard"](spark, SF).collect()
    assert "parsePlan" not in calls and len(rows) == 200 and all(r.allowed == (r.doc_id % 8 < 2) for r in rows)
