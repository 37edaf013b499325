"""Postings in blocks by document range, and ranked search that reads only blocks which can still reach the first results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import runs_in_blocks
from ..sources.staging import dropped, stored
from .search import FILTER_TOKENS

#: Documents of a tenant that form a range; ranges that the first pass looks at for a query, and how many times more each further pass.
RANGE_DOCS, FIRST_RANGES, GROWTH = 1024, 2, 4


def by_document(rows: DataFrame) -> DataFrame:
    """Rows dealt out by ranges of (tenant_id, doc_id) and sorted by them."""
    return rows.repartitionByRange("tenant_id", "doc_id").sortWithinPartitions("tenant_id", "doc_id")


def build_blocks(postings: DataFrame, size: int = RANGE_DOCS, dealt: bool = False) -> DataFrame:
    """(tenant_id, token, range, n, first_doc, last_doc, docs): the documents of a token in a range, sorted; a block holds ``size`` documents at most.

    A range is a run of ``size`` documents of a tenant in the order of their ids; its number ascends with the ids. Blocks of all tokens are cut at the same documents, so
    the blocks of one range tell how many words a document of it can match. Postings are dealt out once, by ranges of (tenant_id, doc_id), so a large tenant
    is the work of many tasks; a document's postings stay together, and those of one run at a time are put into blocks. dealt: they have been made of documents
    dealt out by_document, which are much smaller than their tokens.
    """
    rows = postings.select("tenant_id", "token", "doc_id")
    rows = (rows if dealt else by_document(rows)).withColumn("part", F.spark_partition_id())
    return rows.mapInArrow(runs_in_blocks(size), "tenant_id string, token string, range long, n int, first_doc string, last_doc string, docs array<string>")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Parquet by tenant; each file holds a range of documents, sorted by token and range, so that a scan for few tokens and ranges skips most row groups and pages."""
    blocks.sortWithinPartitions("tenant_id", "token", "range").write.partitionBy("tenant_id").parquet(path)


@dataclass
class BlockSearch:
    """Hits of a search over blocks, and one row of what it read: postings_read of postings_held by the query's tokens, passes."""

    hits: DataFrame
    work: DataFrame


def top_by_blocks(blocks: DataFrame, tokens: DataFrame, limit: int = 10) -> BlockSearch:
    """The first ``limit`` of each query and tenant by score (matched keywords), then doc_id, with rank: the rows of search.top(search.score(...)).

    blocks as build_blocks makes them (stored), tokens as search.query_tokens does. The heads of the tokens' blocks, without their documents, bound the
    score in each range by the words that occur there. Ranges are taken up by descending bound, of equal ones in the order of
    documents; a query is done when its last hit comes before all that the next range can hold. Passes grow, and only
    queries that aren't done take part in the next.
    """
    own = ["query_id", "tenant_id"]
    distinct = [r.token for r in tokens.select("token").distinct().limit(FILTER_TOKENS + 1).collect()]
    held = blocks.filter(F.col("token").isin(distinct)) if len(distinct) <= FILTER_TOKENS else blocks
    tokens = stored(tokens.select(*own, "token", "keyword").distinct(), "tokens")
    heads = held.select("tenant_id", "token", "range", "n", "first_doc").join(tokens, ["tenant_id", "token"])
    heads = heads.groupBy(*own, "range").agg(F.countDistinct("keyword").alias("most"), F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"))
    place = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("most"), "range"))
    heads = stored(heads.withColumn("place", place), "heads")
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("score"), "doc_id"))
    best, open_queries, done, many, passes, read = None, heads.select(*own).distinct(), 0, FIRST_RANGES, 0, 0
    while open_queries is not None and open_queries.limit(1).count():
        chosen = stored(heads.filter(F.col("place").between(done + 1, done + many)).join(open_queries, own, "left_semi"), "chosen")
        read += chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # The ranges reach the scan where they are few.
        ranges = [r.range for r in chosen.select("range").distinct().limit(FILTER_TOKENS + 1).collect()]
        part = held.filter(F.col("range").isin(ranges)) if len(ranges) <= FILTER_TOKENS else held
        met = part.join(tokens, ["tenant_id", "token"]).join(chosen.select(*own, "range"), [*own, "range"])
        found = met.select(*own, "keyword", F.explode("docs").alias("doc_id")).groupBy(*own, "doc_id").agg(F.countDistinct("keyword").alias("score"))
        found = found if best is None else found.unionByName(best.drop("rank"))
        last_best, best = best, stored(found.withColumn("rank", rank).filter(F.col("rank") <= limit), "best")
        done, many, passes = done + many, many * GROWTH, passes + 1
        last = best.filter(F.col("rank") == limit).select(*own, "score", F.col("doc_id").alias("last_doc"))
        following = heads.filter(F.col("place") == done + 1).select(*own, "most", "first_doc").join(last, own, "left")
        reach = F.col("score").isNull() | (F.col("most") > F.col("score")) | ((F.col("most") == F.col("score")) & (F.col("first_doc") <= F.col("last_doc")))
        last_open, open_queries = open_queries, stored(following.filter(reach).select(*own), "open")
        dropped(last_best, last_open, chosen)
    spark = blocks.sparkSession
    if best is None:
        best = tokens.select(*own, F.lit("").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings_held")).first()[0]
    return BlockSearch(best, spark.createDataFrame([(read, total, passes)], "postings_read long, postings_held long, passes int"))
