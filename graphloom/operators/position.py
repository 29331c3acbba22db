"""Questions about positions in source files: the cursor at a point, definitions, references, types."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .preproc import stripped


def position_errors(points: DataFrame, lines: DataFrame) -> DataFrame:
    """points (file, line, col) that can't be positions in their file, with error. lines (file, line, text), see preproc.source_lines.

    Lines and columns count from 1; a column may be one past the line's end. A file without lines has one empty line; a file that
    isn't in lines at all can't be read.
    """
    p = points.select("file", "line", "col").distinct()
    last = lines.groupBy("file").agg(F.max("line").alias("last_line"))
    known = p.join(last, "file", "left").join(lines.select("file", "line", F.length("text").alias("length")), ["file", "line"], "left")
    error = (
        F.when(F.col("line").isNull() | F.col("col").isNull() | (F.col("line") < 1) | (F.col("col") < 1), "lines and columns count from 1")
        .when(F.col("last_line").isNull(), "the file can't be read").when(F.col("line") > F.greatest("last_line", F.lit(1)), "the line is beyond the end of the file")
        .when(F.col("col") > F.coalesce("length", F.lit(0)) + 1, "the column is beyond the end of the line")
    )
    return known.withColumn("error", error).where("error IS NOT NULL").select("file", "line", "col", "error")


def checked(points: DataFrame, cursors: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cursors_at for the points that are positions in their files, (tu, file, line, col, error) for all others and those at which there is no symbol)."""
    p = points.select("tu", "file", "line", "col").distinct()
    wrong = p.join(position_errors(p, lines), ["file", "line", "col"]).select("tu", "file", "line", "col", "error")
    found = cursors_at(p.join(wrong, ["tu", "file", "line", "col"], "left_anti"), cursors)
    here = found.select("tu", "file", F.col("p_line").alias("line"), F.col("p_col").alias("col"))
    nothing = p.join(wrong, ["tu", "file", "line", "col"], "left_anti").join(here, ["tu", "file", "line", "col"], "left_anti")
    return found, wrong.unionByName(nothing.withColumn("error", F.lit("there is no symbol")))


#: What a place in a file is sorted by: starts of extents before points there, outer extents before inner ones.
PLACE = ("tu", "file", "line", "col", "what", "end_order", "id")
SWEPT = "tu string, file string, p_line int, p_col int, id long"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each point the last extent begun before it that ends at it or later; rows come sorted by part and PLACE.

    Extents that have ended leave the stack for good, so a row is put there and taken away once.
    """
    key, stack = None, []
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("part", "tu", "file", "line", "col", "what", "end_line", "end_col", "id"))
        for part, tu, file, line, col, what, end_line, end_col, i in zip(*columns):
            if (part, tu, file) != key:
                key, stack = (part, tu, file), []
            while stack and stack[-1][:2] < (line, col):
                stack.pop()
            if what == 0:
                stack.append((end_line, end_col, i))
            elif stack:
                out.append((tu, file, line, col, stack[-1][2]))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)], [x.split()[0] for x in SWEPT.split(", ")])


def cursors_at(points: DataFrame, cursors: DataFrame) -> DataFrame:
    """points (tu, file, line, col) -> these (p_line, p_col) and the innermost cursor whose extent holds the point; points in none are left out.

    Innermost is what begins last, of these what ends first, of these the last in order. A unit's roots are no answer; points
    and extents with nulls have none.

    Points and starts of extents are sorted together by ranges, and each range is swept by a stack: no pairs of points and cursors are
    made, however many share a line. What is still open where a range begins goes along to it, without extents that a later
    one outlasts: as many as extents are nested there.
    """
    spark = cursors.sparkSession
    p = points.select("tu", "file", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), F.lit(1).alias("what"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("int").alias("end_col"), F.lit(None).cast("long").alias("id")).distinct()
    c = cursors.where("parent_id IS NOT NULL AND end_line IS NOT NULL AND end_col IS NOT NULL").select("tu", "file", "line", "col", F.lit(0).alias("what"), "end_line", "end_col", "id")
    both = p.unionByName(c.where("(end_line, end_col) >= (line, col)")).where("tu IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL AND col IS NOT NULL")
    both = both.withColumn("end_order", F.struct((-F.col("end_line")).alias("l"), (-F.col("end_col")).alias("c")))
    placed = cut_lineage(spark, both.repartitionByRange(*PLACE).withColumn("part", F.spark_partition_id()), "places")

    begins = F.struct("line", "col")
    bounds = placed.groupBy("part").agg(F.min(F.struct("tu", "file", "line", "col")).alias("first"))  # a row for each range
    nth = F.row_number().over(W.orderBy("part"))
    bounds = bounds.select("part", nth.alias("n"), "first.*").withColumn("place", begins)
    ends = F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col"))
    # of a range's extents, those that end after all that begin later in it
    # (a frame that grows from its begin: one that ends at the partition's end would be computed anew for each row)
    later = W.partitionBy("part", "tu", "file").orderBy(*[F.col(x).desc() for x in PLACE[2:]]).rowsBetween(W.unboundedPreceding, -1)
    lasting = placed.where("what = 0").withColumn("end", ends).withColumn("other", F.max("end").over(later)).where("other IS NULL OR end > other").drop("other")
    own = bounds.select(F.col("part"), F.col("n").alias("own_n"))
    following = bounds.select(F.col("n").alias("next_n"), F.col("part").alias("to_part"), F.col("tu").alias("b_tu"), F.col("file").alias("b_file"), "place")
    reach = (F.col("tu") == F.col("b_tu")) & (F.col("file") == F.col("b_file")) & (F.col("place") <= F.col("end"))
    crossing = lasting.join(own, "part").join(following, (F.col("next_n") == F.col("own_n") + 1) & reach).select(*lasting.columns, "own_n")
    carried = crossing.join(following, reach & (F.col("next_n") > F.col("own_n"))).select(*[x for x in placed.columns if x != "part"], F.col("to_part").alias("part"))
    ready = placed.unionByName(carried).repartition("part").sortWithinPartitions("part", *PLACE)
    found = ready.select("part", "tu", "file", "line", "col", "what", "end_line", "end_col", "id").mapInArrow(sweep, SWEPT)
    return found.join(cursors.drop("file"), ["tu", "id"])


def definitions(points: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each point: found, usr, and file, line and column of the definition of what stands there."""
    here = cursors_at(points, cursors).select("tu", "file", "p_line", "p_col", F.coalesce("definition_usr", "referenced_usr", "usr").alias("target"), F.col("usr").alias("own_usr"))
    defined = cursors.where("is_definition").groupBy(F.col("tu"), F.col("usr").alias("target")).agg(F.min_by(F.struct(F.col("file").alias("def_file"), F.col("line").alias("def_line"), F.col("col").alias("def_col")), "id").alias("d"))
    return here.join(defined, ["tu", "target"], "left").select("tu", "file", "p_line", "p_col", F.col("d").isNotNull().alias("found"), F.coalesce("target", "own_usr").alias("usr"), "d.def_file", "d.def_line", "d.def_col")


def references_to(usrs: DataFrame, cursors: DataFrame) -> DataFrame:
    """usrs (usr) -> (usr, tu, file, line, col, seq): places that refer to the symbol, each once a unit, without the symbol's own
    cursors; seq is the first cursor there."""
    hits = cursors.where(F.col("file").isNotNull() & (F.coalesce("usr", F.lit("")) != F.col("referenced_usr"))).select(F.col("referenced_usr").alias("usr"), "tu", "file", "line", "col", "id")
    return hits.join(usrs.select("usr").distinct(), "usr", "left_semi").groupBy("usr", "tu", "file", "line", "col").agg(F.min("id").alias("seq"))


def capped(hits: DataFrame, cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Of each symbol and unit, the first hits in the order of the unit's cursors; and (usr, tu, total, truncated, omitted_count).

    The first hits are kept by a window's group limit in each task, so a symbol that is used everywhere isn't gathered.
    """
    by = W.partitionBy("usr", "tu").orderBy("seq")
    first = hits.withColumn("n", F.row_number().over(by)).where(F.col("n") <= cap).drop("n")
    omitted = F.greatest(F.count("*") - cap, F.lit(0))
    return first, hits.groupBy("usr", "tu").agg(F.count("*").alias("total"), (F.count("*") > cap).alias("truncated"), omitted.alias("omitted_count"))


def with_snippets(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """hits with context_snippet, the source line without white space around it ('' if it isn't known); lines (file, line, text)."""
    return hits.join(lines.select("file", "line", stripped(F.col("text")).alias("context_snippet")), ["file", "line"], "left").withColumn("context_snippet", F.coalesce("context_snippet", F.lit("")))


def type_infos(points: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each point: the type's spelling, canonical spelling, size and alignment (null if unknown), and flags.

    Columns that cursors lack count as unknown and false."""
    here = cursors_at(points, cursors)
    have = set(cursors.columns)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c)) if c in have else F.lit(None).cast("bigint")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    canonical = F.coalesce("canonical_type", "type_spelling") if "canonical_type" in have else F.col("type_spelling")
    return here.select("tu", "file", "p_line", "p_col", F.col("type_spelling").alias("display_type"), canonical.alias("canonical_type"), positive("size_bytes").alias("size_bytes"), positive("alignment_bytes").alias("alignment_bytes"), *[flag(c).alias(c) for c in ("is_pod", "is_const", "is_reference", "is_pointer")])
