"""Keyword postings and search over them: ranked, all words, any words, boolean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords, query_keywords
from ..functions.tokens import keyword_token, try_decrypt
from ..sources.keys import Key

#: Query tokens broadcast at most; a larger batch of queries is joined by a shuffle on the token.
BROADCAST_TOKENS = 500_000
#: Tokens that are written into the filter of the scan at most; beyond that the join alone finds them.
FILTER_TOKENS = 200


def build_postings(docs: DataFrame, search: Key, words: Column | None = None) -> DataFrame:
    """(tenant_id, token, doc_id) of docs (tenant_id, doc_id, content); words overrides the keywords of the content."""
    found = keywords(F.col("content")) if words is None else words
    rows = docs.withColumn("__word", F.explode(F.array_distinct(F.transform(found, F.lower))))
    return rows.select("tenant_id", keyword_token(F.col("__word"), search).alias("token"), "doc_id")


def token_array(content: Column, search: Key) -> Column:
    """Sorted distinct tokens of one document."""
    return F.array_sort(F.transform(keywords(content), lambda w: keyword_token(w, search)))


def query_tokens(queries: DataFrame, search: Key) -> DataFrame:
    """(query_id, tenant_id, keyword, token, needed) of queries (query_id, tenant_id, query), for every version of the tenant's search key.

    needed counts keywords, not tokens, so that a search for all words also works after a key has been rotated.
    """
    words = queries.withColumn("__words", F.array_distinct(query_keywords(F.col("query"))))
    rows = words.withColumn("keyword", F.explode("__words"))
    return rows.select("query_id", "tenant_id", "keyword", keyword_token(F.col("keyword"), search).alias("token"), F.size("__words").alias("needed"))


def score(postings: DataFrame, tokens: DataFrame, mode: str = "any") -> DataFrame:
    """(query_id, tenant_id, doc_id, score): distinct matched keywords of each document; mode 'all' wants every keyword.

    The postings are filtered by the query tokens before anything is shuffled, and grouped by document,
    never by token, so a very frequent keyword makes no hot group.
    """
    distinct = [r.token for r in tokens.select("token").distinct().limit(FILTER_TOKENS + 1).collect()]
    if len(distinct) <= FILTER_TOKENS:
        postings, few = postings.filter(F.col("token").isin(distinct)), True
    else:
        few = tokens.count() <= BROADCAST_TOKENS
    met = postings.join(F.broadcast(tokens) if few else tokens, ["tenant_id", "token"])
    out = met.groupBy("query_id", "tenant_id", "doc_id").agg(F.countDistinct("keyword").alias("score"), F.max("needed").alias("needed"))
    return (out.filter("score >= needed") if mode == "all" else out).drop("needed")


def top(scored: DataFrame, limit: int = 10) -> DataFrame:
    """Adds rank and keeps the first ``limit`` of each query and tenant: by score, then doc_id."""
    order = Window.partitionBy("query_id", "tenant_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits joined with live documents of their tenant; hits are few after the limit."""
    live = documents.filter(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in documents.columns else documents
    return hits.join(live, ["tenant_id", "doc_id"])


def retrieve(hits: DataFrame, documents: DataFrame, document_key: Key) -> DataFrame:
    """Hits with the decrypted content: only the hits are decrypted; null where the key doesn't fit."""
    return with_documents(hits, documents).withColumn("content", try_decrypt(F.col("encrypted_document"), document_key.raw).cast("string")).drop("encrypted_document")


def retrieve_by_key(hits: DataFrame, documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Hits with the decrypted content, each document with its own key: keys is (tenant_id, key_id, key) and joined by tenant and encryption_key_id.

    The key table is small beside the documents, but only the hits are joined with it; content is null where the key is missing or doesn't fit.
    """
    own = keys.select("tenant_id", F.col("key_id").alias("encryption_key_id"), F.col("key").alias("__key"))
    rows = with_documents(hits, documents).join(own, ["tenant_id", "encryption_key_id"], "left")
    return rows.withColumn("content", try_decrypt(F.col("encrypted_document"), F.col("__key")).cast("string")).drop("encrypted_document", "__key")


@dataclass(frozen=True)
class Bool:
    """AND or OR of at least two keywords or further such nodes."""

    operator: str
    operands: tuple

    def __post_init__(self) -> None:
        if self.operator not in ("AND", "OR"):
            raise ValueError(f"operator must be AND or OR, not {self.operator}")
        if len(self.operands) < 2:
            raise ValueError("at least two operands are needed")

    def words(self) -> list[str]:
        return [w for x in self.operands for w in (x.words() if isinstance(x, Bool) else [x.lower()])]

    def on_array(self, tokens: Column, search: Key) -> Column:
        """Predicate on an array of tokens."""
        parts = [x.on_array(tokens, search) if isinstance(x, Bool) else F.array_contains(tokens, keyword_token(F.lit(x), search)) for x in self.operands]
        return self.combined(parts)

    def on_flags(self, flags: dict[str, Column]) -> Column:
        return self.combined([x.on_flags(flags) if isinstance(x, Bool) else flags[x.lower()] for x in self.operands])

    def combined(self, parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out & p if self.operator == "AND" else out | p
        return out


def boolean_search(postings: DataFrame, query: Bool, search_rows: DataFrame, search: Key) -> DataFrame:
    """(tenant_id, doc_id) of documents for which query holds. search_rows is one row with the search key's columns.

    Each document's flags come from one aggregation over the postings of the query's tokens.
    """
    words = sorted(set(query.words()))
    asked = search_rows.select(F.explode(F.array(*[F.lit(w) for w in words])).alias("keyword"), *[c for c in search_rows.columns]).select("keyword", keyword_token(F.col("keyword"), search).alias("token"))
    met = postings.join(F.broadcast(asked), "token")
    names = {w: f"__f{i}" for i, w in enumerate(words)}
    flags = met.groupBy("tenant_id", "doc_id").agg(*[F.max(F.col("keyword") == w).alias(n) for w, n in names.items()])
    return flags.filter(query.on_flags({w: F.col(n) for w, n in names.items()})).select("tenant_id", "doc_id")


def boolean_by_sets(postings: DataFrame, query: Bool, tokens: dict[str, str]) -> DataFrame:
    """The same by unions and intersections of postings; tokens by lower-cased keyword."""
    parts = [boolean_by_sets(postings, x, tokens) if isinstance(x, Bool) else postings.filter(F.col("token") == tokens[x.lower()]).select("tenant_id", "doc_id").distinct() for x in query.operands]
    out = parts[0]
    for p in parts[1:]:
        out = out.intersect(p) if query.operator == "AND" else out.union(p).distinct()
    return out


def match_index(rows: DataFrame, values: DataFrame, column: str = "index") -> DataFrame:
    """Many-value equality search: rows whose index is among values (index, value_id); Spark broadcasts values where their size allows it, else shuffles."""
    return rows.join(values, column)


def last_by_index(rows: DataFrame, column: str = "index", order: str = "seq") -> DataFrame:
    """Of each index value the last record."""
    w = Window.partitionBy(column).orderBy(F.desc(order))
    return rows.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def record_index(records: DataFrame, field: str, index) -> DataFrame:
    """Records that have the field, as text, with its index: index is a function of the text column."""
    rows = records.filter(F.col(field).isNotNull()).withColumn(field, F.col(field).cast("string"))
    return rows.withColumn("index", index(F.col(field)))
