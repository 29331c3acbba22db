"""Extraction, trees, positions, preprocessor state, sources, stores and streaming over small inputs made by hand."""

import json
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from graphloom import lineage
from graphloom.errors import GraphError
from graphloom.model import EDGE_SCHEMA, VERTEX_SCHEMA
from graphloom.operators import astscan, extract, includes, position, preproc, trees
from graphloom.sources import files
from graphloom.sources.store import DocumentStore, ParquetStore, node_documents, open_store
from graphloom.streaming.ingest import ingest_stream, unit_errors, upsert_cursors

T = lambda s, p=False: (s, False, False, p, False, False, "K")
COLS = "tu string, id long, parent_id long, kind string, usr string, spelling string, displayname string, file string, line int, col int, end_line int, end_col int, is_definition boolean, referenced_usr string, definition_usr string, access string, is_static boolean, tokens array<string>, included_file string, result_type " + extract.CURSOR_COLUMNS["result_type"] + ", args " + extract.CURSOR_COLUMNS["args"]


def cursor(id, parent, kind, usr="", file="m.cpp", **more):
    row = dict(tu="m.cpp", id=id, parent_id=parent, kind=kind, usr=usr, spelling=more.pop("spelling", usr), displayname=usr + "()", file=file, line=id, col=1, end_line=more.pop("end_line", id), end_col=99, is_definition=True, referenced_usr=None, definition_usr=None, access=None, is_static=None, tokens=None, included_file=None, result_type=None, args=None)
    return tuple((row | more).values())


ROWS = [
    cursor(0, None, "TRANSLATION_UNIT", end_line=99), cursor(1, 0, "NAMESPACE", "N", end_line=20),
    cursor(2, 1, "CLASS_DECL", "C", end_line=9), cursor(3, 2, "CXX_BASE_SPECIFIER", definition_usr="B"),
    cursor(4, 2, "FIELD_DECL", "C.f"), cursor(5, 2, "FIELD_DECL", "C.s", is_static=True), cursor(6, 2, "CXX_METHOD", "C.m", access="PUBLIC", end_line=9, tokens=["void", "m", "(", ")", "const", "volatile", "{", "}"], result_type=[T("int **", True), T("int *", True), T("int")], args=[("a", ["int", "a", "=", "1", "+", "2"], [T("int")], "m.cpp", 6, 3), ("", None, None, "m.cpp", 6, 4)]),
    cursor(7, 6, "PARM_DECL", "p"), cursor(8, 7, "TYPE_REF", referenced_usr="hidden"), cursor(9, 6, "DECL_REF_EXPR", referenced_usr="g"),
    cursor(10, 6, "COMPOUND_STMT"), cursor(11, 10, "CALL_EXPR", referenced_usr="h"), cursor(12, 10, "DECL_REF_EXPR", referenced_usr="h"),
    cursor(13, 1, "STRUCT_DECL", "X", file="x.h"), cursor(14, 13, "FUNCTION_DECL", "X.f"),  # under a class of another file
    cursor(15, 0, "CLASS_DECL", "C", is_definition=False, spelling="again"), cursor(16, 0, "INCLUSION_DIRECTIVE", included_file="x.h"), cursor(17, 16, "DECL_REF_EXPR", referenced_usr="hidden"),
    cursor(18, 0, "TYPE_REF", file="x.h", referenced_usr="t"),
]


@pytest.fixture(scope="module")
def cursors(spark):
    return spark.createDataFrame(ROWS, COLS).cache()


def test_extract(cursors):
    nodes, edges = extract.extract(cursors)
    got = {r.usr: (r.t, {k: json.loads(v) for k, v in r.props.items()}) for r in nodes.collect()}
    assert {u: t for u, (t, _) in got.items() if not u.startswith(("type:", "C.m#"))} == {"N": "Namespace", "C": "Class", "C.f": "Field", "C.s": "GlobalVariable", "C.m": "Function", "X.f": "Function", "file://m.cpp": "File", "file://x.h": "File"}
    assert got["C"][1]["spelling"] == "C" and got["C"][1]["record_kind"] == "class" and got["C.m"][1]["cv_qualifiers"] == "volatile"
    assert got["C.m#param:0"][1]["default_value"] == "1 + 2" and got["C.m#param:1"][1]["spelling"] == "<param#1>"
    links = {(r.source_usr, r.t, r.target_usr) for r in edges.collect()}
    assert {("C.f", "MEMBER_OF", "C"), ("C.m", "MEMBER_OF", "C"), ("C", "INHERITS", "B"), ("N", "DEFINES", "C"), ("file://m.cpp", "DECLARES", "C"), ("file://m.cpp", "DEFINES", "X.f"), ("C.m", "REFERENCES", "g"), ("C.m", "REFERENCES", "h"), ("file://m.cpp", "REFERENCES", "t"), ("file://m.cpp", "INCLUDES", "file://x.h"), ("C.m", "HAS_PARAM", "C.m#param:1")} <= links
    assert not any("hidden" in x for e in links for x in e) and sum(t == "POINTS_TO" for _, t, _ in links) == 2 and sum(t == "RETURNS" for _, t, _ in links) == 1
    access = {r.source_usr: json.loads(r.props["access"]) for r in edges.where("t = 'MEMBER_OF'").collect()}
    assert access == {"C.f": "private", "C.s": "private", "C.m": "public"}
    with_calls = {(r.source_usr, r.t, r.target_usr) for r in extract.extract(cursors, emit_calls=True)[1].collect()}
    assert ("C.m", "CALLS", "h") in with_calls and ("C.m", "REFERENCES", "h") not in with_calls and ("C.m", "REFERENCES", "g") in with_calls


def test_positions(cursors):
    points = cursors.sparkSession.createDataFrame([("m.cpp", "m.cpp", 9, 5), ("m.cpp", "m.cpp", 50, 1)], "tu string, file string, line int, col int")
    assert [r.id for r in position.cursors_at(points, cursors).collect()] == [9]
    hits = position.references_to(cursors.sparkSession.createDataFrame([("h",)], "usr string"), cursors)
    rows, summary = position.capped(hits, 1)
    assert [r.seq for r in rows.collect()] == [11] and summary.first().asDict() == {"usr": "h", "tu": "m.cpp", "total": 2, "truncated": True, "omitted_count": 1}
    other = hits.unionByName(hits.withColumn("usr", F.lit("k")))
    assert position.capped(other, 1)[0].count() == 2  # the cap is each symbol's own


def test_position_checks(spark, cursors):
    lines = preproc.source_lines(spark.createDataFrame([("m.cpp", "\n".join(["x" * 10] * 60) + "\n"), ("none.cpp", "")], "file string, text string"))
    wrong = {(0, 1): "lines and columns count from 1", (1, 0): "lines and columns count from 1", (61, 1): "the line is beyond the end of the file", (9, 12): "the column is beyond the end of the line", (50, 11): "there is no symbol"}
    points = spark.createDataFrame([("m.cpp", "m.cpp", a, b) for a, b in [*wrong, (9, 5), (9, 11)]] + [("m.cpp", "gone.cpp", 1, 1)], "tu string, file string, line int, col int")
    found, errors = position.checked(points, cursors, lines)
    assert sorted((r.p_line, r.p_col, r.id) for r in found.collect()) == [(9, 5, 9), (9, 11, 9)]
    assert {(r.line, r.col): r.error for r in errors.where("file = 'm.cpp'").collect()} == wrong
    assert [r.error for r in errors.where("file = 'gone.cpp'").collect()] == ["the file can't be read"]


def test_many_points_and_cursors_in_one_line(spark):
    """3,000 points and 3,000 cursors that all share a line, half of them with one extent: no pairs of them are made."""
    n = 3000
    rows = [("t", "f", i, 0, 1, i if i % 2 else 1, 1, 10_000 if i % 2 == 0 else i + 1) for i in range(1, n + 1)]
    cur = spark.createDataFrame(rows, "tu string, file string, id long, parent_id long, line int, col int, end_line int, end_col int")
    points = spark.createDataFrame([("t", "f", 1, i) for i in range(1, n + 1)], "tu string, file string, line int, col int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.p_col: r.id for r in position.cursors_at(points, cur).select("p_col", "id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == n and all(i == (p if p % 2 else p - 1) or p < 2 for p, i in got.items())


def test_lines_and_white_space(spark):
    texts = {"a": "#if A\nint x;\n", "b": "one\r\n\t two \u2003\rthree\u2028more", "c": "", "d": None, "e": "\n\n", "f": "x\x0by"}
    df = spark.createDataFrame(list(texts.items()), "file string, text string")
    lines = {}
    for r in preproc.source_lines(df).orderBy("file", "line").collect():
        lines.setdefault(r.file, []).append(r.text)
    assert lines == {"a": ["#if A", "int x;"], "b": ["one", "\t two \u2003", "three\u2028more"], "e": ["", ""], "f": ["x\x0by"]}
    cut = preproc.source_lines(df, preproc.TEXT_ENDS).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in cut} == {k: len(t.replace("\r\n", "\n").splitlines()) for k, t in texts.items() if t}
    odd = spark.createDataFrame([("\t foo();\r",), ("\u2003 x\u00a0y \x85\x1f",), ("",)], "text string")
    assert [r[0] for r in odd.select(preproc.stripped(F.col("text"))).collect()] == ["foo();", "x\u00a0y", ""]
    # an unclosed branch ends at the last line, not one after it
    source = preproc.source_lines(spark.createDataFrame([("u", "#if A\nint x;\n")], "file string, text string"))
    branch = preproc.conditionals(preproc.directives(source), source.groupBy("file").agg(F.max("line").alias("last_line"))).first()
    assert (branch.start_line, branch.end_line, branch.closed) == (1, 2, False)


def test_a_class_is_final_by_its_attribute(spark, cursors):
    words = F.when(F.col("kind") == "CLASS_DECL", F.array(F.lit("class"), F.lit("void"), F.lit("m"), F.lit("final"))).otherwise(F.col("tokens"))
    get = lambda df: {r.usr: r.props["is_final"] for r in extract.symbol_nodes(extract.in_context(df)).where("t = 'Class'").collect()}
    assert get(cursors.withColumn("tokens", words)) == {"C": "false"}
    attribute = spark.createDataFrame([cursor(19, 2, "CXX_FINAL_ATTR")], COLS)
    assert get(cursors.unionByName(attribute)) == {"C": "true"}


def test_trees_as_text(spark):
    rng = random.Random(4)
    rows = [("t", i, rng.randrange(i) if i else None, "K", 'é"\n', None if i % 3 else "u", "int", "NONE", i, 1, 20, 2) for i in range(30)] + [("u", 5, 3, "K", "", "", "", "", 1, 1, 1, 1)]
    nodes = spark.createDataFrame(rows, "tu string, id long, parent_id long, kind string, spelling string, usr string, type string, storage_class string, start_line int, start_col int, end_line int, end_col int")

    def nested(rows, depth):
        by = {r["id"]: {f: r[f] for f in astscan.FIELDS} | {"children": []} for r in rows}
        roots = []
        for r in sorted(rows, key=lambda r: r["id"]):
            (by[r["parent_id"]]["children"] if r["parent_id"] in by else roots).append(by[r["id"]])
        cut = lambda n, d: n | {"children": [cut(c, d - 1) for c in n["children"]] if d else []}
        return [cut(r, depth) for r in roots]

    for kept in (nodes, astscan.budget_cut(nodes, 12, 10**6), astscan.in_line_range(nodes, 10, 12)):
        for depth in (0, 2, 30):
            rows = [r.asDict() for r in kept.collect()]
            got = {}
            for r in sorted(astscan.tree_texts(kept, depth).collect(), key=lambda r: (r.tu, r.id)):
                got.setdefault(r.tu, []).append(json.loads(r.tree))
            assert got == {t: nested([r for r in rows if r["tu"] == t], depth) for t in {r["tu"] for r in rows}}
            if kept is not nodes:
                break
    assert astscan.tree_texts(nodes.limit(0), 3).count() == 0
    with pytest.raises(GraphError):
        trees.nearest_ancestor(nodes.where("tu = 't'"), F.col("id") == 0, max_rounds=1)


def test_positions_against_all_pairs(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        line, col = rng.randrange(1, 3000), rng.randrange(1, 40)
        end = line + rng.choice([0, 0, 1, 7, 500])
        rows.append(("t", "f", i, None if i == 7 else 0, line, col, end, col + rng.randrange(30) if end == line else rng.randrange(1, 40)))
    points = [("t", "f", rng.randrange(1, 3600), rng.randrange(1, 60)) for _ in range(300)]
    cur = spark.createDataFrame(rows, "tu string, file string, id long, parent_id long, line int, col int, end_line int, end_col int")
    df = spark.createDataFrame(points, "tu string, file string, line int, col int")
    want = {}
    for _, _, line, col in points:
        inside = [((b, c, -e, -f, i), i) for _, _, i, parent, b, c, e, f in rows if parent is not None and (b, c) <= (line, col) <= (e, f)]
        if inside:
            want[line, col] = max(inside)[1]
    assert {(r.p_line, r.p_col): r.id for r in position.cursors_at(df, cur).collect()} == want
    for parts in ("1", "7"):  # whatever the ranges
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {(r.p_line, r.p_col): r.id for r in position.cursors_at(df, cur).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_extents_that_outlast_later_ones_come_from_growing_frames(spark):
    cur = spark.createDataFrame([("t", "f", i, 0, i, 1, i + 3, 1) for i in range(1, 9)], "tu string, file string, id long, parent_id long, line int, col int, end_line int, end_col int")
    found = position.cursors_at(spark.createDataFrame([("t", "f", 5, 1)], "tu string, file string, line int, col int"), cur)
    # a frame that ends at its partition's end is computed anew for each row
    assert "unboundedfollowing" not in plan_of(found).lower().replace(" ", "").replace("$()", "")
    assert [r.id for r in found.collect()] == [5]


def test_tables_of_nodes_are_not_broadcast(spark):
    wrote = []

    def checkpoint(df):
        wrote.append(plan_of(df))
        return lineage.cut_lineage(spark, df)

    context = extract.in_context(spark.createDataFrame(ROWS, COLS), checkpoint)
    plans = [*wrote, plan_of(context), *[plan_of(f(context)) for f in (extract.symbol_nodes, extract.inheritance)]]
    assert "Join" in "".join(plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_nearest_ancestor_against_a_walk(spark):
    rng, rows = random.Random(4), []
    for tu in "ab":
        rows += [(tu, i, rng.randrange(i) if i else None, rng.random() < 0.3) for i in range(150)]
    df = spark.createDataFrame(rows, "tu string, id long, parent_id long, s boolean")
    got = {(r.tu, r.id): r.ancestor for r in trees.nearest_ancestor(df, F.col("s")).collect()}
    by = {(t, i): (p, s) for t, i, p, s in rows}
    for (t, i), (p, _) in by.items():
        while p is not None and not by[t, p][1]:
            p = by[t, p][0]
        assert got.get((t, i)) == p


def test_budgets(spark):
    nodes = spark.createDataFrame([("t", i, i - 1 if i else None, "K", 'é"\n', "u", "int", "NONE", i, 1, i, 2) for i in range(10)], "tu string, id long, parent_id long, kind string, spelling string, usr string, type string, storage_class string, start_line int, start_col int, end_line int, end_col int")
    size = [len(json.dumps({f: r[f] for f in astscan.FIELDS})) for r in nodes.orderBy("id").collect()]
    assert [r.b for r in nodes.orderBy("id").select(astscan.node_bytes().alias("b")).collect()] == size
    for max_nodes, max_bytes in ((3, 10**6), (10, 10**6), (11, 10**6), (10, sum(size[:4])), (10, sum(size[:4]) + 1), (10, 1)):
        kept, used, cut = [], 0, False
        for i, n in enumerate(size):
            if len(kept) >= max_nodes or used >= max_bytes:
                break
            kept.append(i)
            used += n
            cut = len(kept) >= max_nodes or used >= max_bytes
        rows = astscan.budget_cut(nodes, max_nodes, max_bytes).collect()
        assert sorted(r.id for r in rows) == kept and any(r.truncated for r in rows) == cut
    assert {r.id: r.truncated for r in astscan.depth_cut(nodes, 2).collect()} == {0: False, 1: False, 2: True}
    assert astscan.in_line_range(nodes, 0, 3).count() == 4


def test_conditionals_against_a_stack(spark):
    rng, rows = random.Random(9), []
    words = ["#if A", "#ifdef B", " # ifndef C", "#elif D", "#ELSE", "#endif", "code", "#endif"]
    for f in range(40):
        rows += [(f"f{f}", i + 1, rng.choice(words)) for i in range(rng.randint(1, 25))]
    lines = spark.createDataFrame(rows, "file string, line int, text string")
    got = preproc.conditionals(preproc.directives(lines), lines.groupBy("file").agg(F.max("line").alias("last_line")))
    want, stack = set(), []
    for i, (f, line, text) in enumerate(rows):
        word = text.replace(" ", "")[1:].lower()
        if word.startswith(("if",)):
            stack.append(line)
        elif word.startswith(("el", "endif")) and text != "code" and stack:
            want.add((f, stack.pop(), line if word == "endif" else line - 1, True))
            if word != "endif":
                stack.append(line)
        if i + 1 == len(rows) or rows[i + 1][0] != f:
            want |= {(f, s, line, False) for s in stack}
            stack = []
    assert {(r.file, r.start_line, r.end_line, r.closed) for r in got.collect()} == want
    active = spark.createDataFrame([(f, n) for f, n, _ in rows if n % 4 == 0], "file string, line int")
    hits = {(f, n) for f, n, _ in rows if n % 4 == 0}
    for r in preproc.with_activity(got, active).collect():
        assert r.evaluated_result == (r.closed and any((r.file, n) in hits for n in range(r.start_line + 1, r.end_line + 1)))


def test_missing_and_orphaned(spark, cursors):
    d = spark.createDataFrame([("t", 1, "'a.h' file not found"), ("t", 2, "'a.h' file not found"), ("t", 3, "other 'b.h'")], "tu string, pos int, message string")
    assert [(r.path, r.pos) for r in includes.missing_includes(d).collect()] == [("a.h", 1)]
    inc = spark.createDataFrame([("m.cpp", 1, 1, "x.h"), ("m.cpp", 2, 2, "y.h"), ("m.cpp", 3, 1, "x.h")], "tu string, pos int, depth int, path string")
    assert includes.direct_includes(inc).count() == 1 and includes.transitive_includes(inc).count() == 2
    assert [r.path for r in includes.orphaned_includes(inc, cursors).collect()] == ["x.h"]


def test_sources(spark, tmp_path):
    for n in ("a.cpp", "b.h", "c.CPP", "d.txt", "sub/e.cc"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(f"// {n}\n")
    found = files.source_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.path.rpartition("/")[2] for r in found] == ["a.cpp", "b.h", "e.cc"] and found[0].text == "// a.cpp\n"
    db = tmp_path / "compile_commands.json"
    db.write_text(json.dumps([{"directory": "/d", "command": "g++ -O2 -DX -include a.cpp a.cpp", "file": "a.cpp"}, {"directory": "/d", "command": "g++ later a.cpp", "file": "a.cpp"}, {"directory": "/d", "command": "g++ -- b.cpp", "file": "b.cpp"}]))
    flags = files.compile_db(spark, str(tmp_path))
    want = spark.createDataFrame([("/d/a.cpp",), ("/d/b.cpp",), ("/d/c.cpp",)], "file string")
    assert {r.file: (r.flags, r.flags_source) for r in files.resolve_flags(want, flags, ["-w"]).collect()} == {"/d/a.cpp": (["-O2", "-DX", "-include", "a.cpp"], "compilation_db"), "/d/b.cpp": (["-w"], "default"), "/d/c.cpp": (["-w"], "default")}
    db.write_text("{not json")
    assert files.compile_db(spark, str(tmp_path)).count() == 0 and files.compile_db(spark, f"{tmp_path}/sub").count() == 0
    with pytest.raises(GraphError) as e:
        files.compile_db(spark, str(db))
    assert e.value.code == "INVALID_ARGUMENT"
    for bad in ("relative", "/a/../b"):
        with pytest.raises(GraphError):
            files.guarded(bad)


def test_store_and_stream(spark, cursors, tmp_path):
    store = open_store(spark, f"parquet://file://{tmp_path}/g")
    assert isinstance(store, ParquetStore) and store.read().vertices.count() == 0
    cursors.write.parquet(f"{tmp_path}/in")
    q = ingest_stream(spark.readStream.schema(cursors.schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    stored = store.read()
    assert stored.vertices.count() > 8 and {r.t for r in stored.edges.select("t").distinct().collect()} >= {"MEMBER_OF", "DEFINES", "OF_TYPE", "HAS_PARAM"}
    again = upsert_cursors(store, cursors)
    assert again["vertices_inserted"] == again["edges_inserted"] == 0 and store.read().vertices.count() == stored.vertices.count()
    assert again["units"] == 1 and again["units_failed"] == 0
    docs = DocumentStore(spark, f"{tmp_path}/d")
    v = spark.createDataFrame([("i", "t", "u", {})], VERTEX_SCHEMA)
    assert docs.upsert(node_documents(v)) == 1 and docs.upsert(node_documents(v)) == 0
    changed = node_documents(spark.createDataFrame([("i", "t", "u", {"a": "1"}), ("j", "t", "w", {})], VERTEX_SCHEMA))
    assert docs.upsert(changed) == 1 and {r.document for r in docs.read().collect()} == {r.document for r in changed.collect()}
    stale = docs.manifest()
    assert docs.upsert(node_documents(spark.createDataFrame([("k", "t", "z", {})], VERTEX_SCHEMA))) == 1
    with pytest.raises(GraphError):  # a second writer that began alike
        docs.manifests.publish(stale)
    assert docs.read().count() == 3
    for bad in ("nowhere", "bolt://x"):
        with pytest.raises(GraphError):
            open_store(spark, bad)
    assert spark.createDataFrame([], EDGE_SCHEMA).count() == 0


def edges_of(spark, *rows):
    return spark.createDataFrame(list(rows), EDGE_SCHEMA + ", seq int")


def vertices_of(spark, *rows):
    return spark.createDataFrame(list(rows), VERTEX_SCHEMA + ", seq int")


def test_readers_and_writers_of_a_store_do_not_meet(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/g", buckets=4)
    store.upsert(vertices_of(spark, *[(f"v{i}", "A B", f"v{i}", {"n": str(i)}, 1) for i in range(20)]), edges_of(spark, ("v0", "v1", "R", {}, 1), ("v0", "gone", "R", {}, 2)))
    assert store.version() == 1 and store.read().vertices.count() == 20 and store.read().edges.count() == 1
    reader = store.read()  # begins before the next write and reads after it
    before = {e.path for e in store.manifest().entries}
    counts = store.upsert(vertices_of(spark, ("v3", "Other", "v3", {"m": "7"}, 1), ("new", "C", "new", {}, 2)), edges_of(spark, ("new", "v3", "S", {}, 1)))
    assert counts == {"vertices_inserted": 1, "vertices_attempted": 2, "edges_inserted": 1, "edges_attempted": 1}
    now = {r.id: (r.t, dict(r.props)) for r in store.read().vertices.collect()}
    assert reader.vertices.count() == 20 and len(now) == 21 and now["v3"] == ("A B", {"n": "3", "m": "7"}) and now["v4"] == ("A B", {"n": "4"})
    assert before & {e.path for e in store.manifest().entries}  # buckets that weren't touched keep their files
    assert [r.id for r in store.read(types={"C"}).vertices.collect()] == ["new"] and store.read(version=1).vertices.count() == 20
    m = store.manifest()
    store.manifests.publish(m)
    with pytest.raises(GraphError):  # a second writer that began from the same version
        store.manifests.publish(m)
    assert store.version() == 3 and store.read().vertices.count() == 21
    store.expire(keep=1)
    assert store.version() == 3 and store.read().vertices.count() == 21 and store.read().edges.count() == 2


def test_failing_units_are_left_out(spark, cursors, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/g")
    other = lambda tu, where=F.lit(True): cursors.where(where).withColumn("tu", F.lit(tu)).withColumn("file", F.when(F.col("file") == "m.cpp", tu).otherwise(F.col("file")))
    batch = other("a.cpp").unionByName(other("lost.cpp", F.col("id") != 2)).unionByName(other("twice.cpp")).unionByName(other("twice.cpp", F.col("id") == 4))
    counts = upsert_cursors(store, batch)
    assert counts["units"] == 1 and counts["units_failed"] == 2
    assert {r.tu: r.error for r in unit_errors(batch).collect()} == {"lost.cpp": "a parent that isn't in the unit", "twice.cpp": "an id that comes twice"}
    assert {r.usr for r in store.read().vertices.where("t = 'File'").collect()} == {"file://a.cpp", "file://x.h"}


def test_types_at_points(spark, cursors):
    typed = cursors.withColumns({"type_spelling": F.when(F.col("id") == 9, "T const &").otherwise("int"), "canonical_type": F.when(F.col("id") == 9, "S const &"), "size_bytes": F.when(F.col("id") == 9, -2).otherwise(4), "is_reference": F.col("id") == 9})
    points = spark.createDataFrame([("m.cpp", "m.cpp", 9, 5), ("m.cpp", "m.cpp", 7, 5), ("m.cpp", "m.cpp", 99, 1)], "tu string, file string, line int, col int")
    got = {r.p_line: r for r in position.type_infos(points, typed).collect()}
    assert set(got) == {7, 9} and (got[9].display_type, got[9].canonical_type, got[9].size_bytes, got[9].alignment_bytes, got[9].is_reference, got[9].is_pod) == ("T const &", "S const &", None, None, True, False)
    assert (got[7].display_type, got[7].canonical_type, got[7].size_bytes, got[7].is_reference) == ("int", "int", 4, False)


def test_macro_uses_stand_in_for_conditionals(spark):
    rows = [("t", 1, "MACRO_INSTANTIATION", "A", "f", 3), ("t", 2, "MACRO_INSTANTIATION", "B", "f", 3), ("t", 3, "MACRO_INSTANTIATION", None, "f", 4), ("t", 4, "MACRO_INSTANTIATION", "C", None, 5), ("t", 5, "VAR_DECL", "x", "f", 6)]
    got = preproc.macro_uses(spark.createDataFrame(rows, "tu string, id long, kind string, spelling string, file string, line int")).orderBy("start_line").collect()
    assert [(r.directive, r.condition, r.start_line, r.end_line, r.evaluated_result) for r in got] == [("#ifdef", "A", 3, 3, True), ("#ifdef", "", 4, 4, True)]


def test_nothing_shared_is_left(spark):
    begun = len(lineage.made())
    first = lineage.cut_lineage(spark, spark.range(3), "a")
    second = lineage.cut_lineage(spark, first, "b")
    old, new = lineage.made(begun)
    lineage.remove(old)
    assert lineage.made(begun) == [new] and second.count() == 3 and not os.path.exists(old.removeprefix("file://")) and os.path.exists(new.removeprefix("file://"))
    lineage.remove(new)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(GraphError):
        lineage.shared_dir(cluster)
