"""Include graphs. includes: tu, pos (order of inclusion), depth (1: direct), path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of cursors that are a header's interface.
EXPORTED_KINDS = ("FUNCTION_DECL", "CXX_METHOD", "CONSTRUCTOR", "DESTRUCTOR", "STRUCT_DECL", "CLASS_DECL", "CLASS_TEMPLATE", "FUNCTION_TEMPLATE", "TYPEDEF_DECL", "TYPE_ALIAS_DECL", "NAMESPACE", "VAR_DECL", "ENUM_DECL")


def direct_includes(includes: DataFrame) -> DataFrame:
    return includes.where("depth = 1").groupBy("tu", "path").agg(F.min("pos").alias("pos"))


def transitive_includes(includes: DataFrame) -> DataFrame:
    return includes.groupBy("tu", "path").agg(F.min("pos").alias("pos"))


def missing_includes(diags: DataFrame) -> DataFrame:
    """diags (tu, pos, message) -> (tu, path, pos): files that weren't found, each once, as first reported."""
    message = F.lower("message")
    quoted = F.get(F.split(F.translate("message", "'", '"'), '"'), F.lit(1))  # what stands between the first two quotation marks of either kind
    closed = F.length(F.regexp_replace("message", "[^'\"]", "")) > 1
    found = diags.where((message.contains("file not found") | message.contains("no such file")) & closed).withColumn("path", quoted).where("path <> ''")
    return found.groupBy("tu", "path").agg(F.min("pos").alias("pos"))


def orphaned_includes(includes: DataFrame, cursors: DataFrame) -> DataFrame:
    """(tu, path): direct includes that declare symbols of which the unit's own file refers to none."""
    direct = direct_includes(includes).select("tu", "path")
    declared = cursors.where(F.coalesce("usr", F.lit("")) != "").select("tu", F.col("file").alias("path"), "usr").join(direct, ["tu", "path"], "left_semi")
    used = cursors.where((F.col("file") == F.col("tu")) & (F.coalesce("referenced_usr", F.lit("")) != "")).select("tu", F.col("referenced_usr").alias("usr")).distinct()
    alive = declared.join(used, ["tu", "usr"], "left_semi").select("tu", "path")
    return declared.select("tu", "path").distinct().join(alive, ["tu", "path"], "left_anti")


def exported_symbols(cursors: DataFrame, *, as_documented: bool = True) -> DataFrame:
    """(tu, kind, usr, spelling) of the symbols that a unit's own file exports; none unless as_documented."""
    found = cursors.where(F.col("kind").isin(*EXPORTED_KINDS) & (F.coalesce("usr", F.lit("")) != "") & (F.col("file") == F.col("tu")))
    return found.select("tu", "kind", "usr", "spelling") if as_documented else found.select("tu", "kind", "usr", "spelling").where(F.lit(False))
