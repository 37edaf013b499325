"""From raw documents to token ids: language, repeated lines, near copies, benchmark leaks, tokens."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.bpe import encode_texts, vocabulary_path
from hushlake.llm.decontaminate import find_leaks
from hushlake.llm.language_id import identify, learn_languages
from hushlake.llm.line_dedup import dedup_lines
from hushlake.llm.ngram_jaccard import jaccard_groups
from hushlake.llm.shared import dropped, stored, swept

#: Ids that are broadcast at most to take documents out; beyond that the join shuffles.
BROADCAST_IDS = 2_000_000
#: Words of a shingle and similarity in percent from which documents are near copies.
SHINGLE, SIMILAR = 5, 80
#: What a worker of the last stage keeps and takes up at a time: less than by default, since the executor's memory is used by the stages before.
CACHE_WORDS, PART_CHARS = 80_000, 2_000_000
#: Bytes that an executor gathers at most before it hands rows to a Python worker, and Spark's setting of it. Results don't depend on it.
BATCH_BYTES, BATCH_CONF = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES; a lower one stays.

    With Spark's 64 MB a task holds its whole split in the executor's native memory (twice, while a buffer grows) and once more in the worker. It
    stays lowered, since a stage's result is computed after the stage has returned.
    """
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", str(spark.conf.get(BATCH_CONF, "64m")).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those whose doc_id is among ids (doc_id); a null doc_id stays."""
    ids = stored(ids.select("doc_id").distinct(), "out")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no name clashes with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("string")).alias("__row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from packed rows; n_chars follows the text."""
    out = rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__row.`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no language go: null text, or none with a letter.

    The network names a language for all others, and an uncertain one is no reason to drop a clean document. Without any labelled
    row nothing is judged, and only texts without letters go. Whole texts of any length are read; an empty table stays empty;
    repeated rows are judged alike; no column is changed.
    """
    small_batches(spark)
    judged = identify(packed(docs), learn_languages(docs))
    # Without labels the operator says 'und' to all.
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return unpacked(judged.filter((F.col("lang_pred") != "und") | lettered), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document; a document that has lost all its words goes.

    A null text becomes empty. Rows of one id are one document and keep each other's lines; a null id counts as the largest. An empty
    table stays empty. Of the columns only text changes, and n_chars with it.
    """
    kept = dedup_lines(packed(docs))
    return unpacked(kept.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")), docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Documents without words are no copies; rows of one id are one document and stay or go together; a null id stays, since it
    names no one document. An empty table stays empty; no column is changed.
    """
    small_batches(spark)
    groups = jaccard_groups(docs.select("doc_id", "text"), k=SHINGLE, percent=SIMILAR)
    return without(docs, groups.filter("doc_id <> component_id"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null or empty texts hold nothing; all rows of an id go if one of them does; a null id stays, since it names no one document. An
    empty table stays empty; no column is changed.
    """
    small_batches(spark)
    return without(docs, find_leaks(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded of every row; null text is like an empty one."""
    small_batches(spark)
    return encode_texts(docs, vocabulary_path(), cache_words=CACHE_WORDS, part_chars=PART_CHARS, tidy=True)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_copy_stage),
    ("decontamination", leak_stage),
    ("bpe", token_stage),
]

#: Learned languages and merges can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each one's result is written and read again, and what it was made from deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with swept(spark) as kept:
            made = stored(stage(spark, docs, sf_dir), name)
            kept.append(made)
        dropped(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
