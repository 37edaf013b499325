"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a new temporary one is set in local mode, and an error raised on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-hushlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders of prepared tables by application, name and source, with the state of the source's files then.
_prepared: dict[tuple[str, str, str], tuple[str, str]] = {}


def state_of(spark: SparkSession, source: str) -> str:
    """Names, sizes and times of what lies in a folder: it changes when a table there is written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return ";".join(sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in found))


def prepared(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """Folder of a table that is written once for a session and a source folder: write(folder) makes it at the first call, and again after a table of the source has changed."""
    own, state = (spark.sparkContext.applicationId, name, source), state_of(spark, source)
    old = _prepared.get(own, ("", ""))
    if old[1] != state:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        with freed(spark):
            write(path)
        _prepared[own] = path, state
        if old[0]:
            removed(spark, old[0])
    return _prepared[own][0]


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """While it holds, a query's shuffle files are deleted as soon as the query has ended, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str = "staged") -> DataFrame:
    """df written as Parquet and read back, so that costly columns (ciphertexts) are computed once. The folder stays until ``dropped`` takes it away."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the folders of stored tables that nothing will read again; None and other tables are left alone."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            removed(table.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
