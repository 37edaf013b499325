"""What several operators need: tables in the shared folder, components of a graph, small expressions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


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


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage.

    Every executor sees the files, so losing an executor loses nothing. The folder stays until ``dropped`` or ``swept`` takes it away.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for own in _sweeping:
        own.append(path)
    return out


#: Paths written since each sweep that is under way began.
_sweeping: list[list[str]] = []


def removed(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing will read again; other tables are left alone."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            removed(table.sparkSession, path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end, also after an error, every table stored within but those put into the list that it gives."""
    paths: list[str] = []
    kept: list[DataFrame] = []
    _sweeping.append(paths)
    try:
        yield kept
    finally:
        _sweeping.remove(paths)
        for path in set(paths) - {t.stored_at for t in kept}:
            removed(spark, path)


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


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, with the memory that it no longer needs given back to the system at its end.

    Spark keeps Python workers for later tasks; without this they keep what their largest task took.
    """

    def wrapped(batches: Iterator) -> Iterator:
        libc = ctypes.CDLL(None)
        known = hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim")  # the GNU library's
        if known:
            libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on go back when they are freed
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if known:
                libc.malloc_trim(0)

    return wrapped


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves all else."""
    return F.translate(text, UPPER, LOWER)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node.

    Alternates the large-star and small-star steps, which touch each edge once and need
    O(log n) rounds in practice; it goes on until they settle. Nodes without edges don't appear. Nothing is collected but a
    count and a checksum of each round; a hub with very many edges is spread by adaptive
    skew joins, since the smallest neighbour comes from a partial aggregation.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = stored(e, "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        last, e = e, stored(small.filter("u <> v").distinct(), "edges")
        dropped(last)
        mark = F.xxhash64("u", "v")
        now = tuple(e.agg(F.count("*"), F.bit_xor(mark), F.sum(F.pmod(mark, F.lit(1000003)))).first())
        if now == before:
            break
        before = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
