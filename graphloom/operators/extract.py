"""Code graphs from cursor tables: a cursor is a row of a translation unit's tree, in preorder.

Columns that are missing are taken as null. See CURSOR_COLUMNS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.ids import file_usr, type_usr
from ..functions.scalars import json_text, properties
from ..lineage import Checkpoint, shared_writer
from ..model import SCHEMA_VERSION, empty_props
from .trees import nearest_at, parent_of
from .upsert import suppress_redundant

TYPE = "struct<spelling:string,is_const:boolean,is_volatile:boolean,is_pointer:boolean,is_lvalue_reference:boolean,is_rvalue_reference:boolean,kind:string>"
#: A type is an array: itself, what it points or refers to, and so on.
CURSOR_COLUMNS = {
    "tu": "string", "id": "bigint", "parent_id": "bigint", "kind": "string", "usr": "string", "spelling": "string", "displayname": "string", "type_spelling": "string",
    "file": "string", "line": "int", "col": "int", "end_line": "int", "end_col": "int", "is_definition": "boolean", "referenced_usr": "string", "definition_usr": "string", "access": "string",
    "storage_class": "string", "is_static": "boolean", "is_const": "boolean", "is_abstract": "boolean", "is_deleted": "boolean", "is_defaulted": "boolean", "exception_specification": "string",
    "ref_qualifier": "string", "tokens": "array<string>", "included_file": "string", "result_type": f"array<{TYPE}>", "own_type": f"array<{TYPE}>",
    "args": f"array<struct<name:string,tokens:array<string>,type:array<{TYPE}>,file:string,line:int,col:int>>",
}
#: What kinds of cursors become.
KIND_LABELS = {
    "NAMESPACE": "Namespace", "CLASS_DECL": "Class", "STRUCT_DECL": "Class", "CLASS_TEMPLATE": "Class", "UNION_DECL": "Class",
    "FUNCTION_DECL": "Function", "CXX_METHOD": "Function", "CONSTRUCTOR": "Function", "DESTRUCTOR": "Function", "FUNCTION_TEMPLATE": "Function",
    "VAR_DECL": "GlobalVariable", "PARM_DECL": "Parameter", "MACRO_DEFINITION": "Macro", "TYPEDEF_DECL": "TypeAlias", "TYPE_ALIAS_DECL": "TypeAlias", "TYPE_ALIAS_TEMPLATE_DECL": "TypeAlias",
}
CLASS_KINDS = ("CLASS_DECL", "STRUCT_DECL", "CLASS_TEMPLATE", "UNION_DECL")
MEMBER_KINDS = ("FIELD_DECL", "CXX_METHOD", "CONSTRUCTOR", "DESTRUCTOR")
BASE_KINDS = ("CLASS_DECL", "STRUCT_DECL", "CLASS_TEMPLATE")
REFERENCE_KINDS = ("DECL_REF_EXPR", "MEMBER_REF_EXPR", "TYPE_REF")
FUNCTION_KINDS = ("FUNCTION_DECL", "CXX_METHOD", "CONSTRUCTOR", "DESTRUCTOR", "FUNCTION_TEMPLATE")
FINAL_KIND = "CXX_FINAL_ATTR"
RECORD_KINDS = {"CLASS_DECL": "class", "CLASS_TEMPLATE": "class", "STRUCT_DECL": "struct", "UNION_DECL": "union"}


def mapping(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def complete(cursors: DataFrame) -> DataFrame:
    """cursors with all columns, missing ones null."""
    have = set(cursors.columns)
    return cursors.select(*[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in CURSOR_COLUMNS.items()])


def classified(cursors: DataFrame) -> DataFrame:
    """cursors with label (null: no node), own_file and emits: whether the cursor is a symbol of its unit's own file."""
    label = F.when(F.col("kind") == "FIELD_DECL", F.when(F.coalesce("is_static", F.lower("storage_class") == "static", F.lit(False)), "GlobalVariable").otherwise("Field"))
    df = complete(cursors).withColumn("label", F.coalesce(label, mapping(KIND_LABELS, F.col("kind"))))
    own = F.coalesce(F.col("file"), F.lit("")).isin("") | (F.col("file") == F.col("tu"))
    return df.withColumn("own_file", own).withColumn("emits", own & F.col("label").isNotNull() & (F.coalesce(F.col("usr"), F.lit("")) != "") & (F.col("kind") != "PARM_DECL"))


def in_context(cursors: DataFrame, checkpoint: Checkpoint | None = None, stored: bool = False) -> DataFrame:
    """Classified cursors that the walk reaches, with parent_usr and parent_kind (of the nearest emitting ancestor, unless
    a cursor of another file lies between) and func_usr (of the innermost enclosing function).

    Nothing below a parameter or an inclusion is reached. stored: the cursors are rows of files, so they aren't written again.
    """
    checkpoint = checkpoint or shared_writer(cursors.sparkSession)
    nodes = classified(cursors)
    nodes = nodes if stored else checkpoint(nodes)  # read twice below; what cursors are made from isn't computed twice
    stops = {
        "end": F.col("kind").isin("PARM_DECL", "INCLUSION_DIRECTIVE"),
        "parent": F.col("emits") | ~F.col("own_file"),
        "function": F.col("emits") & F.col("kind").isin(*FUNCTION_KINDS),
    }
    # what the search for ancestors needs is narrow; all other columns are read once, at the end
    narrow = nodes.select("tu", "id", "parent_id", "usr", "kind", "own_file", *[v.alias(k) for k, v in stops.items()])
    found = nearest_at(narrow, {k: F.col(k) for k in stops}, checkpoint)
    stopping = narrow.where("end OR parent OR function")
    names = stopping.select("tu", F.col("id").alias("ancestor"), F.col("usr").alias("a_usr"), F.col("kind").alias("a_kind"), F.col("own_file").alias("a_own"))
    at = lambda name, col, when=F.lit(True): F.max(F.when((F.col("stop") == name) & when, F.col(col)))  # noqa: E731  one row at most
    own = F.col("a_own")
    # of nodes with children, what holds below them; each cursor takes that of its parent
    above = found.hint("merge").join(names, ["tu", "ancestor"]).groupBy("tu", F.col("id").alias("above")).agg(F.bool_or(F.col("stop") == "end").alias("cut"), at("parent", "a_usr", own).alias("parent_usr"), at("parent", "a_kind", own).alias("parent_kind"), at("function", "a_usr").alias("func_usr"))
    above = checkpoint(above)
    placed = nodes.withColumn("above", parent_of())
    below = placed.where("above IS NOT NULL").join(above.hint("merge"), ["tu", "above"], "left").where(~F.coalesce("cut", F.lit(False))).drop("cut", "above")
    # roots have nothing above them; in the join, those of a unit would all go to one task
    roots = placed.where("above IS NULL").drop("above")
    return below.unionByName(roots, allowMissingColumns=True)


def symbol_props() -> Column:
    """The properties of a symbol by its label."""
    c, lit = F.col, F.lit
    text = lambda name: F.coalesce(c(name), lit(""))
    base = {"spelling": text("spelling"), "type": text("type_spelling"), "file": text("file"), "line": F.coalesce("line", lit(0)), "col": F.coalesce("col", lit(0))}
    constexpr = T.has_token(c("tokens"), "constexpr")
    own_const = F.coalesce(F.try_element_at("own_type", lit(1))["is_const"], lit(False))
    variable = {"is_const": own_const | constexpr, "is_constexpr": constexpr, "is_static": F.coalesce("is_static", F.lower("storage_class") == "static", lit(False)), "storage_class": T.storage_class(c("label"), c("tokens"), c("storage_class"))}
    function = {
        "signature": text("displayname"), "is_constexpr": constexpr, "is_noexcept": T.is_noexcept(c("exception_specification")), "is_deleted": F.coalesce("is_deleted", lit(False)),
        "is_defaulted": F.coalesce("is_defaulted", lit(False)), "cv_qualifiers": T.cv_qualifiers(c("is_const"), c("tokens")), "ref_qualifier": text("ref_qualifier"),
    }
    record = {"is_final": F.coalesce("has_final", lit(False)), "is_abstract": F.coalesce("is_abstract", lit(False)), "record_kind": F.coalesce(mapping(RECORD_KINDS, c("kind")), lit("class"))}
    of = lambda **more: properties(**base, **more)
    return F.when(c("label").isin("Field", "GlobalVariable"), of(**variable)).when(c("label") == "Function", of(**function)).when(c("label") == "Class", of(**record)).otherwise(of())


def symbol_nodes(context: DataFrame) -> DataFrame:
    """(tu, t, usr, props, seq): the first cursor of each usr of a unit; later ones give edges only. A class is final if a child of it
    is the attribute; that a member function is final says nothing of the class."""
    finals = context.where(F.col("kind") == FINAL_KIND).select("tu", F.col("parent_id").alias("id"), F.lit(True).alias("has_final")).distinct()
    marked = context.where("emits").join(finals.hint("merge"), ["tu", "id"], "left")
    ranked = marked.select("tu", F.col("label").alias("t"), "usr", symbol_props().alias("props"), F.col("id").alias("seq"))
    first = ranked.groupBy("tu", "usr").agg(F.min_by(F.struct("t", "props"), "seq").alias("r"), F.min("seq").alias("seq"))
    return first.select("tu", "r.t", "usr", "r.props", "seq")


def containment(context: DataFrame) -> DataFrame:
    """(tu, source_usr, target_usr, t, props): DEFINES, DECLARES, and MEMBER_OF from members to their class."""
    member = F.col("kind").isin(*MEMBER_KINDS) & F.coalesce(F.col("parent_kind").isin(*CLASS_KINDS), F.lit(False))
    holder = F.coalesce("parent_usr", file_usr(F.col("tu")))
    usual = F.when(F.col("parent_kind").isin("STRUCT_DECL", "UNION_DECL"), "public").otherwise("private")
    access = F.when(F.lower("access").isin("public", "protected", "private"), F.lower("access")).otherwise(usual)
    t = F.when(member, "MEMBER_OF").when(F.coalesce("is_definition", F.lit(False)), "DEFINES").otherwise("DECLARES")
    source, target = F.when(member, F.col("usr")).otherwise(holder), F.when(member, holder).otherwise(F.col("usr"))
    props = F.when(member, properties(access=access)).otherwise(empty_props())
    return context.where("emits").select("tu", source.alias("source_usr"), target.alias("target_usr"), t.alias("t"), props.alias("props"))


def inheritance(context: DataFrame) -> DataFrame:
    bases = context.where((F.col("kind") == "CXX_BASE_SPECIFIER") & (F.coalesce("definition_usr", F.lit("")) != "")).select("tu", F.col("parent_id").alias("id"), F.col("definition_usr").alias("target_usr"))
    heirs = context.where(F.col("emits") & F.col("kind").isin(*BASE_KINDS)).select("tu", "id", F.col("usr").alias("source_usr"))
    return heirs.join(bases.hint("merge"), ["tu", "id"]).select("tu", "source_usr", "target_usr", F.lit("INHERITS").alias("t"), empty_props().alias("props"))


def references(context: DataFrame, kinds: tuple[str, ...] = REFERENCE_KINDS) -> DataFrame:
    """Uses of symbols, from the enclosing function or else the unit's file, whatever file the use is in."""
    used = context.where(F.col("kind").isin(*kinds) & (F.coalesce("referenced_usr", F.lit("")) != ""))
    return used.select("tu", F.coalesce("func_usr", file_usr(F.col("tu"))).alias("source_usr"), F.col("referenced_usr").alias("target_usr"), F.lit("REFERENCES").alias("t"), empty_props().alias("props"))


def calls(context: DataFrame) -> DataFrame:
    used = context.where((F.col("kind") == "CALL_EXPR") & F.col("own_file") & (F.coalesce("referenced_usr", F.lit("")) != ""))
    return used.select("tu", F.coalesce("func_usr", "parent_usr", file_usr(F.col("tu"))).alias("source_usr"), F.col("referenced_usr").alias("target_usr"), F.lit("CALLS").alias("t"), empty_props().alias("props"))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def files_and_includes(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File nodes of units and of what they include; INCLUDES edges from the unit, also for nested inclusions."""
    units = context.select("tu").distinct().select("tu", F.col("tu").alias("path"))
    found = context.where((F.col("kind") == "INCLUSION_DIRECTIVE") & (F.coalesce("included_file", F.lit("")) != "")).select("tu", F.col("included_file").alias("path")).distinct()
    own = units.select("tu", F.lit("File").alias("t"), file_usr(F.col("path")).alias("usr"), properties(path=F.col("path"), spelling=name_of(F.col("path")), schema_version=F.lit(SCHEMA_VERSION)).alias("props"))
    other = found.where("path <> tu").select("tu", F.lit("File").alias("t"), file_usr(F.col("path")).alias("usr"), properties(path=F.col("path"), spelling=name_of(F.col("path")), schema_version=F.lit(SCHEMA_VERSION)).alias("props"))
    edges = found.select("tu", file_usr(F.col("tu")).alias("source_usr"), file_usr(F.col("path")).alias("target_usr"), F.lit("INCLUDES").alias("t"), empty_props().alias("props"))
    return own.union(other).withColumn("seq", F.lit(0).cast("long")), edges


def typed(context: DataFrame) -> DataFrame:
    """(tu, owner, t, chain): which type each function returns, and which type variables, fields and parameters are of."""
    own = context.where(F.col("emits") & F.col("label").isin("Field", "GlobalVariable") & (F.size("own_type") > 0)).select("tu", F.col("usr").alias("owner"), F.lit("OF_TYPE").alias("t"), F.col("own_type").alias("chain"))
    returns = context.where(F.col("emits") & (F.col("label") == "Function") & (F.size("result_type") > 0)).select("tu", F.col("usr").alias("owner"), F.lit("RETURNS").alias("t"), F.col("result_type").alias("chain"))
    params = exploded_parameters(context).where(F.size("a.type") > 0).select("tu", F.col("param_usr").alias("owner"), F.lit("OF_TYPE").alias("t"), F.col("a.type").alias("chain"))
    return own.union(returns).union(params)


def exploded_parameters(context: DataFrame) -> DataFrame:
    rows = context.where(F.col("emits") & (F.col("label") == "Function")).select("tu", "usr", "id", F.posexplode("args").alias("index", "a"))
    return rows.withColumn("param_usr", F.concat("usr", F.lit("#param:"), F.col("index").cast("string")))


def types(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type nodes and the edges to and between them; a type of a unit is one node however often it is used."""
    uses = typed(context)
    links = uses.select("tu", "owner", "t", F.posexplode("chain").alias("i", "x"), "chain")
    props = properties(
        spelling=F.col("x.spelling"), is_const=F.coalesce("x.is_const", F.lit(False)), is_volatile=F.coalesce("x.is_volatile", F.lit(False)), is_pointer=F.coalesce("x.is_pointer", F.lit(False)),
        is_reference=F.coalesce("x.is_lvalue_reference", F.lit(False)) | F.coalesce("x.is_rvalue_reference", F.lit(False)), is_lvalue_reference=F.coalesce("x.is_lvalue_reference", F.lit(False)),
        is_rvalue_reference=F.coalesce("x.is_rvalue_reference", F.lit(False)), kind=F.coalesce("x.kind", F.lit("")),
    )
    one = links.select("tu", "x").distinct()
    nodes = one.select("tu", F.lit("Type").alias("t"), type_usr(F.col("x.spelling")).alias("usr"), props.alias("props")).groupBy("tu", "usr").agg(F.min_by(F.struct("t", "props"), F.to_json("props")).alias("r"))
    nodes = nodes.select("tu", "r.t", "usr", "r.props", F.lit(0).cast("long").alias("seq"))
    owner = links.where("i = 0").select("tu", F.col("owner").alias("source_usr"), type_usr(F.col("x.spelling")).alias("target_usr"), "t")
    below = F.try_element_at("chain", F.col("i") + 2)
    chain = links.select("tu", type_usr(F.col("x.spelling")).alias("source_usr"), type_usr(below["spelling"]).alias("target_usr"), F.when(F.coalesce("x.is_pointer", F.lit(False)), "POINTS_TO").otherwise("REFERS_TO").alias("t"), below.alias("b")).where("b IS NOT NULL").drop("b").distinct()
    edges = owner.union(chain).withColumn("props", empty_props())
    return nodes, edges


def parameters(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parameter nodes of the first declaration of each function, and HAS_PARAM edges with their index."""
    rows = exploded_parameters(context)
    name = F.coalesce("a.name", F.lit(""))
    shown = F.when(name != "", name).otherwise(F.concat(F.lit("<param#"), F.col("index").cast("string"), F.lit(">")))
    props = properties(spelling=shown, name=name, index=F.col("index"), default_value=T.default_value(F.col("a.tokens")), file=F.coalesce("a.file", F.lit("")), line=F.coalesce("a.line", F.lit(0)), col=F.coalesce("a.col", F.lit(0)))
    nodes = rows.groupBy("tu", F.col("param_usr").alias("usr")).agg(F.min_by(F.struct(F.lit("Parameter").alias("t"), props.alias("props")), "id").alias("r"), F.min("id").alias("seq")).select("tu", "r.t", "usr", "r.props", "seq")
    edges = rows.select("tu", F.col("usr").alias("source_usr"), F.col("param_usr").alias("target_usr"), F.lit("HAS_PARAM").alias("t"), F.map_from_arrays(F.array(F.lit("index")), F.array(json_text(F.col("index")))).alias("props"))
    return nodes, edges


def extract(cursors: DataFrame, *, emit_calls: bool = False, checkpoint: Checkpoint | None = None, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """cursors -> nodes (tu, t, usr, props, seq) and edges (tu, source_usr, target_usr, t, props), all units at once."""
    checkpoint = checkpoint or shared_writer(cursors.sparkSession)
    context = checkpoint(in_context(cursors, checkpoint, stored))
    file_nodes, includes = files_and_includes(context)
    type_nodes, type_edges = types(context)
    param_nodes, param_edges = parameters(context)
    uses = references(context)
    edges = containment(context).union(inheritance(context)).union(includes).unionByName(type_edges).union(param_edges)
    if emit_calls:
        called = calls(context)
        edges = edges.union(called)
        uses = suppress_redundant(uses, called).select("tu", "source_usr", "target_usr", "t", "props")
    nodes = file_nodes.unionByName(symbol_nodes(context)).unionByName(type_nodes).unionByName(param_nodes)
    return nodes, edges.unionByName(uses)
