"""Tables in the folder that driver and executors share: scratch paths and cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set on the context. A session of one machine that names none gets a
    temporary one; on a cluster executors couldn't read that back, so it is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str = "tables") -> str:
    """A new path under the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _located(spark, path)
    files.deleteOnExit(where)
    return path


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def recording(into: list[str]) -> Iterator[None]:
    """Notes in ``into`` the tables that ``materialise`` writes meanwhile."""
    token = _written.set(into)
    try:
        yield
    finally:
        _written.reset(token)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more, so that they don't pile up till the session ends."""
    for path in paths:
        files, where = _located(spark, path)
        files.delete(where, True)
    paths.clear()


def materialise(df: DataFrame, *by: str) -> DataFrame:
    """Cuts lineage: writes df under the shared folder, reads it again."""
    path = scratch(df.sparkSession)
    if (into := _written.get()) is not None:
        into.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
