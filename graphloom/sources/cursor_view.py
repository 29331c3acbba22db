"""A cursor table over the star-schema tables, so that extraction and code analytics run over data of any size.

A nation is a translation unit, a customer a class in it, an order a member or function of that class, a line item
something within that. CURSORS_SQL is the same table in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

COLUMNS = ("tu", "id", "parent_id", "kind", "usr", "spelling", "file", "line", "col", "end_line", "end_col", "is_definition", "referenced_usr", "definition_usr", "access", "included_file")
CLASS_KIND = "CASE c_custkey % 4 WHEN 0 THEN 'CLASS_DECL' WHEN 1 THEN 'STRUCT_DECL' WHEN 2 THEN 'UNION_DECL' ELSE 'NAMESPACE' END"
MEMBER_KIND = "CASE o_orderkey % 5 WHEN 0 THEN 'CXX_METHOD' WHEN 1 THEN 'CONSTRUCTOR' WHEN 2 THEN 'FIELD_DECL' WHEN 3 THEN 'FUNCTION_DECL' ELSE 'VAR_DECL' END"
ITEM_KIND = "CASE l_linenumber WHEN 1 THEN 'PARM_DECL' WHEN 2 THEN 'DECL_REF_EXPR' WHEN 3 THEN 'TYPE_REF' WHEN 4 THEN 'CALL_EXPR' WHEN 5 THEN 'MEMBER_REF_EXPR' WHEN 6 THEN 'INCLUSION_DIRECTIVE' ELSE 'COMPOUND_STMT' END"
TU = "concat('n', CAST(c_nationkey AS {string}), '.cpp')"
MEMBER_LINE = "CAST(c_custkey % 1000000 * 100 + 1 + o_orderkey % 90 AS INT)"

TEMPLATE = f"""
SELECT concat('n', CAST(n_nationkey AS {{string}}), '.cpp') AS tu, CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'TRANSLATION_UNIT' AS kind, '' AS usr, n_name AS spelling,
  concat('n', CAST(n_nationkey AS {{string}}), '.cpp') AS file, 1 AS line, 1 AS col, 2147483647 AS end_line, 1 AS end_col, false AS is_definition,
  CAST(NULL AS {{string}}) AS referenced_usr, CAST(NULL AS {{string}}) AS definition_usr, CAST(NULL AS {{string}}) AS access, CAST(NULL AS {{string}}) AS included_file
FROM nation
UNION ALL
SELECT {TU}, (c_custkey + 1) * 10000000000, CAST(0 AS BIGINT), {CLASS_KIND}, concat('c:', CAST(c_custkey % 40 AS {{string}})), c_name,
  CASE WHEN c_custkey % 11 = 0 THEN 'h.hpp' ELSE {TU} END, CAST(c_custkey % 1000000 * 100 AS INT), 1, CAST(c_custkey % 1000000 * 100 + 99 AS INT), 2, c_custkey % 2 = 0, NULL, NULL, NULL, NULL
FROM customer
UNION ALL
SELECT {TU}, (c_custkey + 1) * 10000000000 + 5, (c_custkey + 1) * 10000000000, 'CXX_BASE_SPECIFIER', '', '',
  CASE WHEN c_custkey % 11 = 0 THEN 'h.hpp' ELSE {TU} END, CAST(c_custkey % 1000000 * 100 AS INT), 50, CAST(c_custkey % 1000000 * 100 AS INT), 60, false, NULL, concat('c:', CAST(c_custkey % 7 AS {{string}})), NULL, NULL
FROM customer WHERE c_custkey % 3 = 0
UNION ALL
SELECT {TU}, (c_custkey + 1) * 10000000000 + 6, (c_custkey + 1) * 10000000000, 'CXX_FINAL_ATTR', '', 'final',
  CASE WHEN c_custkey % 11 = 0 THEN 'h.hpp' ELSE {TU} END, CAST(c_custkey % 1000000 * 100 AS INT), 30, CAST(c_custkey % 1000000 * 100 AS INT), 34, false, NULL, NULL, NULL, NULL
FROM customer WHERE c_custkey % 5 = 0
UNION ALL
SELECT {TU}, (c_custkey + 1) * 10000000000 + (o_orderkey + 1) * 10, (c_custkey + 1) * 10000000000, {MEMBER_KIND}, concat('m:', CAST(o_orderkey AS {{string}})), o_orderpriority,
  CASE WHEN o_orderkey % 7 = 0 THEN 'h.hpp' ELSE {TU} END, {MEMBER_LINE}, 1, {MEMBER_LINE}, 200, o_orderkey % 2 = 1, NULL, NULL,
  CASE o_orderkey % 3 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PROTECTED' END, NULL
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT {TU}, (c_custkey + 1) * 10000000000 + (o_orderkey + 1) * 10 + l_linenumber, (c_custkey + 1) * 10000000000 + (o_orderkey + 1) * 10, {ITEM_KIND}, '', l_returnflag,
  CASE WHEN o_orderkey % 7 = 0 THEN 'h.hpp' ELSE {TU} END, {MEMBER_LINE}, l_linenumber * 10, {MEMBER_LINE}, l_linenumber * 10 + 9, false,
  CASE WHEN l_linenumber IN (2, 4, 5) THEN concat('m:', CAST(l_partkey AS {{string}})) WHEN l_linenumber = 3 THEN concat('c:', CAST(l_suppkey % 40 AS {{string}})) END, NULL, NULL,
  CASE WHEN l_linenumber = 6 THEN concat('p', CAST(l_partkey % 10 AS {{string}}), '.h') END
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""
CURSORS_SQL = TEMPLATE.format(string="VARCHAR")


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few columns of a large table look small enough for a broadcast, and aren't: the driver would hold all orders, or all customers
    tables = {t: read(spark, sf_dir, t).hint("merge") for t in ("nation", "customer", "orders", "lineitem")}
    text = TEMPLATE.format(string="STRING")
    for t in tables:
        text = text.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **tables).toDF(*COLUMNS)
