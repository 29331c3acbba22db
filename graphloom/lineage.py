"""Tables in the folder that the driver and all executors share: cutting lineage, and removing what was written for a while.

Folders made here are removed when their maker says so, and otherwise when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from .errors import GraphError

Checkpoint = Callable[[DataFrame], DataFrame]
_made: list[str] = []


def shared_dir(spark: SparkSession, name: str = "table") -> str:
    """A new folder's name under spark.checkpoint.dir. Where that is unset, a folder of this machine serves a local master; any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise GraphError("INVALID_ARGUMENT", "set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{os.path.abspath(os.environ.get('TMPDIR', '/tmp'))}/graphloom-shared"
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made(since: int = 0) -> list[str]:
    """The folders made and not removed, from that many on."""
    return _made[since:]


def remove(*folders: str) -> None:
    """Deletes folders through Hadoop, wherever they are."""
    context = SparkContext._active_spark_context
    for folder in folders:
        if context is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _made:
            _made.remove(folder)


@atexit.register
def _remove_all() -> None:
    try:
        remove(*made())
    except Exception:  # the JVM may be gone by now
        pass


def cut_lineage(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later failures recompute nothing before it."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_writer(spark: SparkSession) -> Checkpoint:
    return lambda df: cut_lineage(spark, df)
