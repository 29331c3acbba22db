"""The guard takes a parsed plan as one text, and walks it only where that text may have left something out."""

import pytest
from py4j.java_gateway import JavaMember

from graphloom.errors import GraphError
from graphloom.plans import guard


@pytest.fixture
def views(spark):
    for name in ("seen", "`a, b`"):
        spark.range(1).createOrReplaceTempView(name)
    yield
    for name in ("seen", "a, b"):
        spark.catalog.dropTempView(name)


def test_a_statement_takes_few_calls(spark, views, monkeypatch):
    calls, call = [], JavaMember.__call__
    monkeypatch.setattr(JavaMember, "__call__", lambda self, *args: calls.append(self.name) or call(self, *args))
    known = {}
    for _ in range(2):  # built-in functions and names are asked for once
        calls.clear()
        guard.check(spark, "WITH a AS (SELECT 'it' AS x) SELECT upper(x), length(x) FROM a WHERE EXISTS (SELECT 1 FROM seen) ORDER BY 1", known)
    assert len(calls) < 12, calls


def test_names_with_commas(spark, views):
    guard.check(spark, "SELECT id FROM `a, b`")
    for text in ("SELECT id FROM `a, c`", "SELECT id FROM `a`.`b`", "SELECT * FROM `text, x`.`/etc/hosts`", "SELECT `up, per`('a')"):
        with pytest.raises(GraphError):
            guard.check(spark, text)
    assert guard.readings("[a, b]") == [["a", "b"], ["a, b"]] and guard.readings("[a, b, c, d]") is None


@pytest.mark.parametrize("inner", ["reflect('java.lang.System', 'exit', 1)", "(SELECT max(value) FROM text.`/etc/hosts`)"])
@pytest.mark.parametrize(
    "outer",
    [
        "SELECT {}", "SELECT CASE WHEN {} IS NULL THEN 1 END", "SELECT sum(id) OVER (PARTITION BY {} ORDER BY id) FROM seen", "SELECT id FROM seen GROUP BY id, {} HAVING count(*) > 0", "SELECT id FROM seen GROUP BY GROUPING SETS ((id, {}))", "VALUES (1, {})", "SELECT * FROM seen LIMIT {}",
        "SELECT id FROM seen a JOIN seen b ON a.id = {}", "SELECT id FROM seen LATERAL VIEW explode(array({})) t AS c", "SELECT * FROM (SELECT id, 1 AS k FROM seen) PIVOT (max({}) FOR k IN (1))", "SELECT sum(id) FILTER (WHERE {} > 1) FROM seen",
        "WITH a AS (WITH b AS (SELECT {} AS x) SELECT * FROM b) SELECT * FROM a", "SELECT id FROM seen ORDER BY {}", "SELECT struct({}).a, array(1)[{}]", "SELECT * FROM seen TABLESAMPLE (10 PERCENT) WHERE id IN (SELECT {})", "SELECT id FROM seen UNION SELECT {}", "SELECT count(DISTINCT {}) FROM seen", "SELECT * FROM range({})", "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY {}) FROM seen",
        "SELECT id FROM seen |> WHERE id = {}", "SELECT /*+ REPARTITION(2) */ {} FROM seen", "SELECT named_struct('a', {}) IN (SELECT named_struct('a', 1))",
    ],
)
def test_nothing_hides_in_the_text(spark, views, outer, inner):
    with pytest.raises(GraphError):
        guard.check(spark, outer.replace("{}", inner))
