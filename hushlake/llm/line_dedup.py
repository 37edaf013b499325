"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANKS, ascii_lower, bound, shared_folder, stored

#: Stands for a null id, which so comes after all others.
LAST = 2**63 - 1


class SortedRuns:
    """Runs (key, holder) as tables that are bucketed and sorted by key, each free of the keys of older runs.

    A level takes ``fanout`` runs; when it is full they are merged into one run of the next level, so n batches leave
    O(fanout * log n) runs to read. All runs have as many buckets as a shuffle has partitions, and one sorted file a bucket: a batch
    that is grouped by key is merged with them without shuffling or sorting them again.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4) -> None:
        self.spark, self.fanout, self.levels, self.names = spark, fanout, [[]], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def written(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """rows as a bucketed table, and its folder. rows must be dealt out by key."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name), path

    def add(self, run: DataFrame) -> None:
        self.levels[0].append(run)
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = self.levels[k][0]
                for other in self.levels[k][1:]:
                    merged = merged.union(other)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.written(merged.repartition(self.buckets, "key"))[0])
                self.levels[k] = []

    def dropped(self) -> None:
        """Takes the tables out of the catalog; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for a while."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Ids that cut docs into ``batches`` ranges of about equal rows."""
    if batches < 2:
        return []
    at = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(at or []))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drops lines whose key another document with a smaller id holds.

    Returns all columns of docs, with text_col as kept, and n_lines, n_dropped (long). A line's key
    is the line stripped of blanks with A-Z lower-cased; keys under ``min_chars`` code points stay.
    Documents go in ``batches`` ranges of ascending id. Each batch merges its sorted keys with
    each of the runs of the earlier ones (by 128-bit hash): known keys are dropped, keys new to the runs
    become a run of their own, kept by the smallest id of the batch; runs are compacted by level.

    A null or empty text is one empty line and stays as ''. A null id counts as the largest id. Rows
    with the same id are one document: they never drop each other's lines. Lines repeated within
    their first document all stay. An empty table gives an empty one. Extra columns pass through, but those named n_lines or
    n_dropped are replaced; internal ones start with '__ld_'.
    """
    spark = docs.sparkSession
    doc, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(F.col(text_col))
    cuts, runs, dropped = batch_bounds(docs, id_col, batches), SortedRuns(spark, fanout), None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        # The bounds reach the scan; null ids come with the last batch.
        inside = F.lit(True) if low is None else F.col(id_col) > low
        inside = inside & (F.col(id_col) <= high) if high is not None else inside | F.col(id_col).isNull()
        part = docs.filter(inside).select(doc.alias("doc"), mark.alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        lines = part.select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        lines = lines.select("doc", "mark", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
        lines = stored(lines.select("doc", "mark", "pos", F.unhex(F.md5("key")).alias("key")), "lines")
        own = lines.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        own = own.withColumn("holder", F.lit(None).cast("long"))
        for run in runs.runs():
            own = own.join(run.withColumnRenamed("holder", "older").hint("merge"), "key", "left").withColumn("holder", F.coalesce("holder", "older")).drop("older")
        known = F.col("holder").isNotNull()
        merged = own.select("key", F.coalesce("holder", "first").alias("holder"), (~known).alias("fresh"), (known | (F.col("first") < F.col("last"))).alias("shared"))
        with setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            table, path = runs.written(merged)
            runs.add(table.filter("fresh").select("key", "holder"))
        # Read as plain files, so that a line that very many documents hold can be dealt out by a skew join.
        merged = spark.read.schema(table.schema).parquet(path)
        hit = lines.join(merged.filter("shared").select("key", "holder"), "key").filter("doc <> holder").select("doc", "mark", "pos")
        dropped = hit if dropped is None else dropped.union(hit)
    runs.dropped()
    cut = dropped.groupBy(F.col("doc").alias("__ld_doc"), F.col("mark").alias("__ld_mark")).agg(F.collect_set("pos").alias("__ld_cut"))
    out = docs.withColumns({"__ld_doc": doc, "__ld_mark": mark}).join(cut, ["__ld_doc", "__ld_mark"], "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    kept = bound(lines, lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__ld_cut")), lambda i: own[i]), "\n"))
    text = F.when(F.col("__ld_cut").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept)
    return out.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("__ld_cut"), F.lit(0)).cast("long"), text_col: text}).drop("__ld_doc", "__ld_mark", "__ld_cut")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT doc_id, pos, line, coalesce(first < doc_id, false) AS cut FROM keyed LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (cut) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""
