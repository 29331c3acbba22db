"""Source files and compile databases as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError

#: Endings of source files, case as given.
EXTENSIONS = ("cpp", "h", "hpp", "cc", "cxx")
COMPILE_ENTRY = "directory string, command string, arguments array<string>, file string"


def guarded(path: str, roots: list[str] | None = None) -> str:
    """The path, if it is absolute, has no '..' and (given roots) lies within one of them; stores' URLs are taken as they are."""
    if "://" in path:
        return path
    p = Path(path)
    if not p.is_absolute() or ".." in p.parts or "\0" in path:
        raise GraphError("PATH_VIOLATION", "the path must be absolute and without '..'")
    if roots and not any(p.resolve().is_relative_to(Path(r).resolve()) for r in roots):
        raise GraphError("PATH_VIOLATION", "the path is outside the allowed folders")
    return path


def source_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, modified, length, text) of the source files in a folder; sort by path where order matters."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").option("recursiveFileLookup", str(recursive).lower()).load(guarded(path))
    return found.select("path", F.col("modificationTime").alias("modified"), "length", F.decode("content", "UTF-8").alias("text"))


def compile_db(spark: SparkSession, folder: str) -> DataFrame:
    """(file, flags): of each file's first entry in the folder's compile_commands.json, its arguments without compiler and
    file; null where they can't be told.

    A folder without the file, or with one that can't be read, is an empty database; a file in place of the folder is refused.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(guarded(folder))
    store, database = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), f"{folder.rstrip('/')}/compile_commands.json"
    if store.exists(path) and not store.getFileStatus(path).isDirectory():
        raise GraphError("INVALID_ARGUMENT", "the build path must be a folder")
    if not store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(database)):
        return spark.createDataFrame([], "file string, flags array<string>")
    text = spark.read.text(database, wholetext=True)
    entries = text.select(F.posexplode(F.coalesce(F.from_json("value", f"array<struct<{COMPILE_ENTRY.replace(' ', ':').replace(',:', ',')}>>", {"mode": "PERMISSIVE"}), F.array())).alias("pos", "e"))
    return flags_of(entries.select("pos", "e.*"))


def flags_of(entries: DataFrame) -> DataFrame:
    """entries (pos, directory, command, arguments, file) -> (file, flags)."""
    full = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    args = F.coalesce("arguments", F.split(F.trim("command"), r"\s+"))
    rest = F.slice(args, 2, F.greatest(F.size(args) - 2, F.lit(0)))  # without the compiler, which is first, and the file, which is last
    flags = F.when(F.array_contains(args, "--") | (F.size(args) < 1), F.lit(None)).otherwise(rest)
    return entries.where("file IS NOT NULL").select(full.alias("file"), "pos", flags.alias("flags")).groupBy("file").agg(F.min_by(F.struct("flags"), "pos").alias("r")).select("file", "r.flags")


def resolve_flags(files: DataFrame, db: DataFrame, defaults: list[str]) -> DataFrame:
    """files (file) with flags and flags_source: those of the database, else the defaults."""
    usual = F.array(*map(F.lit, defaults)) if defaults else F.array().cast("array<string>")
    return files.join(db, "file", "left").withColumn("flags_source", F.when(F.col("flags").isNotNull(), "compilation_db").otherwise("default")).withColumn("flags", F.coalesce("flags", usual))
