"""Registered queries against their SQL, over the smallest tables; names and columns of all."""

import os

import duckdb
import pytest

from graphloom import queries
from graphloom.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("verb_vertex_with_type", "verb_vertex_prop_equal_bool_int", "verb_pipe_in", "verb_row_limit", "describe_edge_types", "describe_keys_sampled", "upsert_vertices", "upsert_edges_dangling", "first_wins_dedup", "directive_pairing", "ast_budget_cut", "ast_depth_cut", "cypher_two_hops", "token_scans", "extract_containment", "extract_inheritance", "extract_references", "extract_calls", "range_overlap", "orphan_targets", "orphaned_includes", "pattern_any_length", "pattern_optional_with_condition", "pattern_results", "type_infos", "references_capped", "failing_units", "pattern_chained", "position_errors", "source_line_snippets", "verb_errors", "compile_database", "point_in_extent", "store_pipe", "ast_trees")


def test_each_query_has_sql():
    assert set(queries.oracle_sql()) == set(queries.queries()) and len(queries.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    got = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in got.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_named_types_are_planned_from_their_own_tables(spark):
    g = tables.graph(spark, SF)
    some, links = g.vertices_typed("Customer", "Nation", "NoSuch"), g.edges_typed("LIVES_IN")
    assert {f.rsplit("/", 1)[1] for f in some.inputFiles()} == {"customer.parquet", "nation.parquet"}
    assert {f.rsplit("/", 1)[1] for f in links.inputFiles()} == {"customer.parquet"}
    assert not {"vertices", "edges"} & set(vars(g))  # the whole hasn't been built
    assert g.vertices_typed("NoSuch").count() == g.edges_typed("NoSuch").count() == 0
    key = lambda df: sorted(map(str, df.drop("props").collect()))
    assert key(some) == key(g.vertices.where("t IN ('Customer', 'Nation')")) and key(links) == key(g.edges.where("t = 'LIVES_IN'"))
    assert key(g.edges_typed("NEXT_TURN")) == key(g.edges.where("t = 'NEXT_TURN'")) and g.edges_typed().count() == g.edges.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_edge_once_pattern_goes_over_customers(spark):
    """Every customer with a neighbour in the nation has a pair, whatever else they are like."""
    customers = {(r.c_custkey, r.c_nationkey) for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    want = {(a, b) for a, m in customers for b, n in customers if m == n and a != b}
    got = queries.queries()["pattern_uses_an_edge_once"](spark, SF).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
