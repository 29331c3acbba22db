import re

import pytest

from graphloom import queries
from graphloom.operators import extract

NAMES = ("extract_nodes", "extract_references", "incremental_nodes", "extract_calls", "extract_containment")


@pytest.fixture
def plans(spark, monkeypatch):
    """Physical plans of what is written on the way, planned as if every table were small enough for a broadcast."""
    found = []

    def recording(session, write=extract.shared_writer):
        def checkpoint(df):
            found.append(df._jdf.queryExecution().executedPlan().toString())
            return write(session)(df)

        return checkpoint

    for module in (queries, extract):
        monkeypatch.setattr(module, "shared_writer", recording)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield found
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", NAMES)
def test_only_units_are_broadcast(spark, plans, name):
    """The driver would hold what is broadcast: a table of units may be, one of cursors, symbols or rows of the tables may not."""
    result = queries.queries()[name](spark, "/root/testdata/sf0.001")
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    joins = [x for p in plans for x in p.splitlines() if re.search("Broadcast(HashJoin|NestedLoopJoin)", x)]
    assert len(plans) > 3 and any("SortMergeJoin" in p for p in plans)
    # units are known by names; ids of cursors and keys of the tables' rows are longs
    assert not [x for x in joins if re.search(r"#\d+L\b", x)]
