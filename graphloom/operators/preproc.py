"""Preprocessor state: macros, conditional directives, and whether their branches are active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import macro_value

#: The directives that begin, continue and end a branch.
DIRECTIVES = ("if", "ifdef", "ifndef", "elif", "else", "endif")
#: A line that is one of them: the number sign, the word, and what is left as its condition.
DIRECTIVE = "(?i)^[ \\t]*#[ \\t]*(" + "|".join(sorted(DIRECTIVES, key=len, reverse=True)) + ")(?![A-Za-z0-9_])(.*)$"


def macros(cursors: DataFrame) -> DataFrame:
    """(tu, name, value, def_file, def_line): the first definition of each name; built-in ones have no place."""
    defined = cursors.where("kind = 'MACRO_DEFINITION'").select("tu", F.col("spelling").alias("name"), F.struct(macro_value(F.col("tokens")).alias("value"), F.col("file").alias("def_file"), F.when(F.col("file").isNotNull(), F.col("line")).alias("def_line")).alias("r"), "id")
    return defined.groupBy("tu", "name").agg(F.min_by("r", "id").alias("r")).select("tu", "name", "r.*")


#: What ends a line in files read line by line, and in texts cut into lines; white space as strings are stripped of it.
LINE_ENDS, TEXT_ENDS = r"\r\n|\r|\n", r"\r\n|[\r\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]"


def source_lines(files: DataFrame, ends: str = LINE_ENDS) -> DataFrame:
    """files (file, text) -> (file, line, text), lines from 1, without their ends. What follows the last end is a line only if
    there is something; an empty or null text has none."""
    parts = F.split(F.coalesce("text", F.lit("")), ends, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("file", F.posexplode(whole).alias("line", "text")).withColumn("line", F.col("line") + 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+\\z", "")


def directives(lines: DataFrame) -> DataFrame:
    """(file, line, directive, condition) of the lines that are conditional directives."""
    name = F.lower(F.regexp_extract("text", DIRECTIVE, 1))
    return lines.where(F.col("text").rlike(DIRECTIVE)).select("file", "line", name.alias("directive"), F.trim(F.regexp_extract("text", DIRECTIVE, 2)).alias("condition"))


def conditionals(found: DataFrame, last_lines: DataFrame) -> DataFrame:
    """(file, directive, condition, start_line, end_line, closed): one row a branch; last_lines (file, last_line).

    Windows do what a stack does: an opening directive is one deeper, #endif one shallower, and the depth never falls
    below zero, which is the running sum less its smallest value so far. A branch ends at the next directive of its own
    depth: before it if that is #elif or #else, at it if it is #endif. Directives outside any #if are dropped; a
    branch that never ends goes to the last line.
    """
    by_file = W.partitionBy("file").orderBy("line")
    so_far = by_file.rowsBetween(W.unboundedPreceding, W.currentRow)
    opens, ends = F.col("directive").isin("if", "ifdef", "ifndef"), F.col("directive") == "endif"
    s = found.withColumn("s", F.sum(F.when(opens, 1).when(ends, -1).otherwise(0)).over(so_far))
    s = s.withColumn("low", F.least(F.lit(0), F.min("s").over(so_far)))
    s = s.withColumn("before", F.coalesce(F.lag(F.col("s") - F.col("low")).over(by_file), F.lit(0)))
    # the level that a directive belongs to: an opening one the level it makes, others the level they are in
    s = s.withColumn("level", F.when(opens, F.col("before") + 1).otherwise(F.col("before"))).where("level > 0")
    by_level = W.partitionBy("file", "level").orderBy("line")
    s = s.withColumn("next", F.lead("directive").over(by_level)).withColumn("next_line", F.lead("line").over(by_level))
    s = s.where(~(F.col("directive") == "endif")).join(last_lines, "file")
    closed = F.col("next_line").isNotNull()
    end = F.when(~closed, F.col("last_line")).when(F.col("next") == "endif", F.col("next_line")).otherwise(F.col("next_line") - 1)
    return s.select("file", "directive", "condition", F.col("line").alias("start_line"), end.alias("end_line"), closed.alias("closed"), (F.col("next") == "endif").alias("at_end"))


def macro_uses(cursors: DataFrame) -> DataFrame:
    """What stands in for conditionals where lines can't be read: each line's first use of a macro, as an active #ifdef of that line."""
    used = cursors.where("kind = 'MACRO_INSTANTIATION' AND file IS NOT NULL")
    first = used.groupBy("tu", "line").agg(F.min_by("spelling", "id").alias("condition"))
    return first.select("tu", F.lit("#ifdef").alias("directive"), F.coalesce("condition", F.lit("")).alias("condition"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(True).alias("evaluated_result"))


def with_activity(branches: DataFrame, active_lines: DataFrame) -> DataFrame:
    """branches with evaluated_result: whether a cursor stands after the branch's first line and within it.

    active_lines (file, line). The next active line after a branch's start is found by one window over both tables in
    line order, not by comparing each with each. Branches that never close are false.
    """
    marks = active_lines.select("file", "line").distinct().select("file", F.col("line").alias("at"), F.lit(1).alias("what"), F.col("line").alias("hit"), F.lit(None).cast("struct<directive:string,condition:string,start_line:int,end_line:int,closed:boolean,at_end:boolean>").alias("b"))
    cols = F.struct("directive", "condition", F.col("start_line").cast("int"), F.col("end_line").cast("int"), "closed", "at_end")
    rows = branches.select("file", F.col("start_line").alias("at"), F.lit(2).alias("what"), F.lit(None).cast("int").alias("hit"), cols.alias("b"))
    following = W.partitionBy("file").orderBy("at", "what").rowsBetween(1, W.unboundedFollowing)
    both = marks.union(rows).withColumn("hit", F.min("hit").over(following)).where("b IS NOT NULL")
    inside = F.coalesce(F.col("hit") <= F.col("b.end_line"), F.lit(False)) & F.col("b.closed")
    return both.select("file", "b.*", inside.alias("evaluated_result")).drop("at_end")
