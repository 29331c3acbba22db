"""Continuous ingestion: each micro-batch of cursors is extracted and upserted, so a batch that comes again changes nothing.

A unit whose cursors make no tree is left out and reported; all others of its batch are ingested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import vertex_id
from ..lineage import cut_lineage
from ..operators.extract import CURSOR_COLUMNS, extract
from ..sources.files import EXTENSIONS, guarded
from ..sources.store import ParquetStore


def unit_errors(cursors: DataFrame) -> DataFrame:
    """(tu, error): units that can't be ingested, with the first of what is wrong with them.

    Cursors are read once: each counts at its own id, and as a child at its parent's. Partial aggregates by (tu, id): a unit with most rows is never gathered.
    """
    at = lambda key, n, parent: F.struct(key.alias("id"), F.lit(n).alias("n"), parent.alias("parent_id"))
    none = F.lit(None).cast("bigint")
    own, child = at(F.col("id").cast("bigint"), 1, F.col("parent_id").cast("bigint")), at(F.col("parent_id").cast("bigint"), 0, none)
    both = cursors.select("tu", F.inline(F.when(F.col("parent_id").isNull(), F.array(own)).otherwise(F.array(own, child))))
    ids = both.groupBy("tu", "id").agg(F.sum("n").alias("n"), F.min("parent_id").alias("parent_id"))
    error = F.when(F.col("tu").isNull() | F.col("id").isNull(), "a cursor without unit or id").when(F.col("parent_id") >= F.col("id"), "a parent that doesn't come before its child").when(F.col("n") == 0, "a parent that isn't in the unit").when(F.col("n") > 1, "an id that comes twice")
    return ids.select("tu", error.alias("error")).where("error IS NOT NULL").groupBy("tu").agg(F.min("error").alias("error"))


def upsert_cursors(store: ParquetStore, cursors: DataFrame, errors: DataFrame | None = None, **options) -> dict[str, int]:
    """Extracts the sound units of cursors and upserts them; a later unit's properties overwrite an earlier one's, by name.

    Counts of rows, of units and of units that failed (errors, if known already: see unit_errors).
    """
    spark = cursors.sparkSession
    errors = cut_lineage(spark, unit_errors(cursors), "unit-errors") if errors is None else errors
    failed = errors.count()
    sound = cursors.where("tu IS NOT NULL").join(errors.select("tu"), "tu", "left_anti") if failed else cursors
    nodes, edges = extract(sound, **options)
    # units are written in the order of their names
    v = nodes.select(vertex_id(F.col("usr")).alias("id"), "t", "usr", "props", F.col("tu").alias("seq"))
    e = edges.select(vertex_id(F.col("source_usr")).alias("outbound_id"), vertex_id(F.col("target_usr")).alias("inbound_id"), "t", "props", F.col("tu").alias("seq"))
    return store.upsert(v, e) | {"units": sound.select("tu").distinct().count(), "units_failed": failed}


def ingest_stream(stream: DataFrame, store: ParquetStore, checkpoint: str, **options) -> StreamingQuery:
    """stream: a streaming DataFrame of cursors, whole units a micro-batch (a unit's file is one row group of its producer)."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert_cursors(store, batch, **options)).start()


CORRUPT = "_corrupt"


def ingest_files(spark: SparkSession, folder: str, store: ParquetStore, errors: str, checkpoint: str, files_per_batch: int = 1000, **options) -> StreamingQuery:
    """Streams files of cursors (JSON lines, a unit or more a file) from a folder into a store, each file once, across restarts.

    A file with a line that can't be read is left out whole and is one row of the errors table (path, tu, error, batch), as is each unit
    whose cursors make no tree; all else of the batch is ingested. A batch that runs again overwrites its own errors.
    """
    schema = ", ".join(f"{c} {t}" for c, t in CURSOR_COLUMNS.items())
    reader = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.json(folder).withColumn("path", F.col("_metadata.file_path"))

    def ingest(batch: DataFrame, number: int) -> None:
        rows = cut_lineage(spark, batch, "batch")
        bad = rows.where(F.col(CORRUPT).isNotNull()).groupBy("path").agg(F.concat(F.lit("a line that can't be read: "), F.min(F.substring(CORRUPT, 1, 200))).alias("error"))
        bad = cut_lineage(spark, bad, "bad-files")
        sound = rows.join(F.broadcast(bad.select("path")), "path", "left_anti").drop("path", CORRUPT)  # a row for a file of the batch, at most
        failed = cut_lineage(spark, unit_errors(sound), "unit-errors")
        wrong = bad.select("path", F.lit(None).cast("string").alias("tu"), "error").unionByName(failed.select(F.lit(None).cast("string").alias("path"), "tu", "error"))
        wrong.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{errors.rstrip('/')}/batch={number}")
        upsert_cursors(store, sound, failed, stored=True, **options)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(ingest).start()


def stream_sources(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (file, modified, text) of a folder's source files, each once; for source_lines and directives in foreachBatch."""
    found = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(guarded(folder))
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
