"""Tables that a query writes on its way, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables that have not been deleted yet.
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or setCheckpointDir names. Where neither does, a temporary one, if all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="edgeloom-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_forget_all)
    _tables.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again: its lineage ends there, and lost executors don't lose it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget_all() -> None:
    from pyspark import SparkContext

    with contextlib.suppress(Exception):  # the driver ends; its JVM may have gone first
        jvm, sc = SparkContext._gateway.jvm, SparkContext._active_spark_context
        conf = sc._jsc.hadoopConfiguration() if sc else jvm.org.apache.hadoop.conf.Configuration()
        while _tables:
            where = jvm.org.apache.hadoop.fs.Path(_tables.pop())
            where.getFileSystem(conf).delete(where, True)
