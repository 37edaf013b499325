"""Upkeep of the encrypted index: ingest, delete, forward-private updates, backward-private deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import entry_key, expand_chain
from ..functions.prf import hmac256
from ..functions.text import keywords
from ..functions.tokens import encrypt, keyword_token, try_decrypt
from ..sources.keys import Key, without_keys
from ..sources.staging import stored
from .search import build_postings

DOC = ["tenant_id", "doc_id"]


def split_new(docs: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected are ids that the tenant has already."""
    ids = stored.select(*DOC)
    return docs.join(ids, DOC, "left_anti"), docs.join(ids, DOC, "left_semi")


def ingest(docs: DataFrame, document_key: Key, search: Key, key_id: str, search_key_id: str, as_of: Column, words: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of docs (tenant_id, doc_id, content, metadata): encrypted rows and their tokens."""
    postings = build_postings(docs, search, words)
    found = keywords(F.col("content")) if words is None else words
    documents = docs.select(
        *DOC,
        encrypt(F.col("content"), document_key.raw).alias("encrypted_document"),
        F.lit("AES-256-GCM").alias("algorithm"),
        F.lit(key_id).alias("encryption_key_id"),
        F.lit(search_key_id).alias("search_key_id"),
        *([F.col("metadata")] if "metadata" in docs.columns else []),
        F.size(F.array_distinct(found)).alias("token_count"),
        F.lit(False).alias("deleted"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    return documents, postings


def delete(documents: DataFrame, postings: DataFrame, ids: DataFrame, soft: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, postings, report): ids (tenant_id, doc_id) taken out, and for each whether it existed. soft only marks the documents."""
    ids = ids.select(*DOC).distinct()
    report = ids.join(documents.select(*DOC).distinct().withColumn("existed", F.lit(True)), DOC, "left").select(*DOC, F.coalesce("existed", F.lit(False)).alias("existed"))
    if soft:
        marked = documents.join(ids.withColumn("__gone", F.lit(True)), DOC, "left")
        return marked.withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone"), postings, report
    return documents.join(ids, DOC, "left_anti"), postings.join(ids, DOC, "left_anti"), report


#: Steps of a chain between two states that are kept, steps that a task walks (about), and tasks at most.
ANCHOR_STEPS, WALK_STEPS, MAX_WALKS = 10_000, 100_000, 20_000


@dataclass
class ForwardIndex:
    """Tables of a forward-private index: states (keyword, initial, current, counter), secure (token, doc_id), aux (tag, entry), and updates since the last re-encryption.

    anchors (keyword, step, state) holds every ANCHOR_STEPS-th state of each chain, from which a long chain is walked in parts; where it is None, a chain is
    walked from its initial state. A job returns a new index; its tables are written together as one version.
    """

    states: DataFrame
    secure: DataFrame
    aux: DataFrame
    updates: int = 0
    anchors: DataFrame | None = None


def empty_forward(spark) -> ForwardIndex:
    return ForwardIndex(spark.createDataFrame([], "keyword string, initial binary, current binary, counter long"), spark.createDataFrame([], "token string, doc_id string"), spark.createDataFrame([], "tag string, entry binary"), 0, spark.createDataFrame([], "keyword string, step long, state binary"))


def numbered_in_order(rows: DataFrame) -> DataFrame:
    """(keyword, doc_id, step) of rows (keyword, doc_id, __order): the place of each document among those of its keyword, from 0.

    Rows are dealt out by ranges of (keyword, __order), so a very frequent keyword is spread over partitions: rows are numbered within
    their range, and the counts of the keyword's earlier ranges are added.
    """
    dealt = stored(rows.repartitionByRange("keyword", "__order").withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("keyword", "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("keyword").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("keyword", "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("keyword", "__range").orderBy("__order"))
    return dealt.withColumn("__place", place).join(counts, ["keyword", "__range"]).select("keyword", "doc_id", (F.col("__place") - 1 + F.col("__before")).cast("long").alias("step"))


def forward_add(index: ForwardIndex, docs: DataFrame, state_key: Key, search: Key, mode: str = "balanced", order: str = "doc_id", anchor_steps: int = ANCHOR_STEPS) -> ForwardIndex:
    """Adds docs (doc_id, content, keys) in order. mode 'off' writes plain tokens to the secure index.

    Each keyword's new documents are numbered, its chain is expanded once by that many steps, and the entries are encrypted in parallel.
    """
    rows = docs.withColumn("keyword", F.explode(F.array_distinct(F.transform(keywords(F.col("content")), F.lower))))
    if mode == "off":
        return ForwardIndex(index.states, index.secure.union(rows.select(keyword_token(F.col("keyword"), search).alias("token"), "doc_id")).distinct(), index.aux, index.updates, index.anchors)
    numbered = numbered_in_order(rows.select("keyword", "doc_id", F.col(order).alias("__order")))
    fresh = rows.groupBy("keyword").agg(F.count("*").alias("steps"), F.first(hmac256(state_key, F.col("keyword"))).alias("first"))
    # What is read again is stored, here and below: else plans hold each other several times over and grow beyond the driver's memory.
    grown = stored(fresh.join(index.states, "keyword", "left").select("keyword", "steps", F.coalesce("initial", "first").alias("initial"), F.coalesce("current", "first").alias("start"), F.coalesce("counter", F.lit(0)).cast("long").alias("counter")), "grown")
    chain = stored(expand_chain(grown), "chain")
    # A salt by state and document: every read of these tables sees the same, also after a task was run again.
    salt = F.unhex(F.sha2(F.concat(F.lit("salt").cast("binary"), F.col("state"), F.col("doc_id").cast("binary")), 256))
    entries = numbered.join(chain, ["keyword", "step"]).withColumn("salt", salt)
    entries = entries.select("tag", F.concat("salt", encrypt(F.col("doc_id"), entry_key(F.col("state"), F.col("salt")))).alias("entry"))
    ends = chain.filter("next_state IS NOT NULL").select("keyword", F.col("next_state").alias("current"))
    states = grown.join(ends, "keyword").select("keyword", "initial", "current", (F.col("counter") + F.col("steps")).alias("counter"))
    kept = index.states.join(states.select("keyword"), "keyword", "left_anti")
    anchors = index.anchors
    if anchors is not None:
        at = chain.join(grown.filter("counter > 0").select("keyword", "counter"), "keyword").withColumn("at", F.col("step") + F.col("counter"))
        begun = chain.filter(F.col("step") % anchor_steps == 0).join(grown.filter("counter = 0").select("keyword"), "keyword", "left_semi").select("keyword", "step", "state")
        going = at.filter(F.col("at") % anchor_steps == 0).select("keyword", F.col("at").alias("step"), "state")
        anchors = stored(anchors.union(begun).union(going) if grown.filter("counter > 0").limit(1).count() else anchors.union(begun), "anchors")
    return ForwardIndex(stored(kept.union(states.select(*kept.columns)), "states"), index.secure, index.aux.union(entries), index.updates, anchors)


def chain_walks(known: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """(keyword, first, start, steps) of states (keyword, initial, current, counter): the parts in which their chains are walked, dealt out over all tasks."""
    if anchors is None:
        return known.select("keyword", F.lit(0).cast("long").alias("first"), F.col("initial").alias("start"), F.col("counter").alias("steps"))
    own = anchors.join(known.select("keyword", "counter"), "keyword").filter("step < counter").select("keyword", F.col("step").alias("first"), F.col("state").alias("start"), "counter")
    following = F.lead("first").over(Window.partitionBy("keyword").orderBy("first"))
    own = own.withColumn("steps", F.coalesce(following, "counter") - F.col("first")).select("keyword", "first", "start", "steps")
    # By steps, not by bytes: parts are a few bytes each, and adaptive execution would put them all into one task.
    total = own.agg(F.coalesce(F.sum("steps"), F.lit(0))).first()[0]
    return own.repartition(int(max(1, min(MAX_WALKS, -(-total // WALK_STEPS)))), "keyword", "first")


def forward_open(index: ForwardIndex, words: DataFrame | None, search_rows: DataFrame, search: Key) -> tuple[ForwardIndex, DataFrame]:
    """(index, found (keyword, doc_id)): walks the chains of words (keyword; all if None), moves their entries to the secure index and re-keys the states.

    search_rows is one row with the search key's columns.
    """
    known = index.states.join(words.select(F.lower("keyword").alias("keyword")).distinct(), "keyword", "left_semi") if words is not None else index.states
    chain = expand_chain(chain_walks(known, index.anchors)).select("keyword", "state", "tag")
    blob = F.substr(F.col("entry"), F.lit(33), F.length("entry") - 32)
    doc = try_decrypt(blob, entry_key(F.col("state"), F.substring("entry", 1, 32))).cast("string").alias("doc_id")
    if words is None:
        # Of all entries one pass tells both which are opened and which are left.
        both = index.aux.join(chain, "tag", "left")
        both = stored(both.select("keyword", doc, *[F.when(F.col("keyword").isNull(), F.col(c)).alias(c) for c in ("tag", "entry")]), "opened")
        opened, aux = both.filter("keyword IS NOT NULL").select("keyword", "doc_id"), both.filter("keyword IS NULL").select("tag", "entry")
    else:
        opened = stored(chain.join(index.aux, "tag").select("keyword", "tag", doc), "opened")
        aux = index.aux.join(opened.select("tag"), "tag", "left_anti")
    token = lambda df: df.join(F.broadcast(search_rows)).withColumn("token", keyword_token(F.col("keyword"), search))
    secure = index.secure.union(token(opened).select("token", "doc_id")).distinct()
    # The next start of a chain needs the search key, so that who has seen the old one can't follow.
    start = hmac256(search, F.concat(F.lit("renewed").cast("binary"), F.col("initial"), F.col("keyword").cast("binary")))
    renewed = known.join(F.broadcast(search_rows)).select("keyword", start.alias("initial")).select("keyword", "initial", F.col("initial").alias("current"), F.lit(0).cast("long").alias("counter"))
    states = index.states.join(known.select("keyword"), "keyword", "left_anti").union(renewed)
    found = opened.select("keyword", "doc_id")
    if words is not None:
        asked = token(words.select(F.lower("keyword").alias("keyword")).distinct()).select("keyword", "token")
        found = found.union(index.secure.join(F.broadcast(asked), "token").select("keyword", "doc_id")).distinct()
    anchors = None if index.anchors is None else index.anchors.join(known.select("keyword"), "keyword", "left_anti")
    return ForwardIndex(states, secure, aux, 0 if words is None else index.updates, anchors), without_keys(found)


def forward_update(index: ForwardIndex, docs: DataFrame, state_key: Key, search_rows: DataFrame, search: Key, mode: str = "strong", threshold: int = 1000, order: str = "doc_id") -> ForwardIndex:
    """forward_add, which counts the updated keywords; in mode 'strong' everything moves to the secure index once they reach threshold since the last time."""
    if mode not in ("strong", "balanced", "off"):
        raise ValueError("mode must be strong, balanced or off")
    grown = forward_add(index, docs, state_key, search, mode, order)
    if mode == "off":
        return grown
    grown.updates = index.updates + (docs.select(F.sum(F.size(F.array_distinct(F.transform(keywords(F.col("content")), F.lower))))).first()[0] or 0)
    return forward_open(grown, None, search_rows, search)[0] if mode == "strong" and grown.updates >= threshold else grown


def index_statistics(index: ForwardIndex, documents: DataFrame) -> DataFrame:
    """One row: entries of the secure and auxiliary index, keywords, documents, updates."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(index.secure, "secure_entries").join(one(index.aux, "auxiliary_entries")).join(one(index.states, "keywords")).join(one(documents, "documents"))
    return out.withColumn("updates", F.lit(index.updates).cast("long"))


def delete_token(doc_id: Column, keyword: Column, delete_key: Key) -> Column:
    """Token of a deletion; it can't be linked with the search token of the keyword."""
    return F.base64(hmac256(delete_key, F.concat(doc_id, F.lit("\0"), F.lower(keyword))))


def backward_add(docs: DataFrame, search: Key) -> tuple[DataFrame, DataFrame]:
    """(server postings (doc_id, token), client keywords (doc_id, keyword)) of docs (doc_id, content)."""
    rows = docs.withColumn("keyword", F.explode(keywords(F.col("content"))))
    return rows.select("doc_id", keyword_token(F.col("keyword"), search).alias("token")), rows.select("doc_id", "keyword")


def backward_search(server: DataFrame, words: DataFrame, search: Key) -> DataFrame:
    """(keyword, doc_id) of words (keyword, keys) on the server's postings; words are few and broadcast."""
    asked = words.select(F.lower("keyword").alias("keyword"), keyword_token(F.col("keyword"), search).alias("token")).distinct()
    return server.join(F.broadcast(asked), "token").select("keyword", "doc_id").distinct()


def server_view(server: DataFrame) -> DataFrame:
    """(doc_id, tokens) as the server sees them: no keyword, and nothing of deletions."""
    return server.groupBy("doc_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def backward_delete(server: DataFrame, client: DataFrame, ids: DataFrame, delete_key: Key, deletions: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame, int, bool]:
    """(server, client, tokens (doc_id, keyword, delete_token), deletions, needs_reencryption): all traces of ids (doc_id, keys) are taken out."""
    gone = client.join(ids, "doc_id").withColumn("delete_token", delete_token(F.col("doc_id"), F.col("keyword"), delete_key)).select("doc_id", "keyword", "delete_token")
    deletions += ids.select("doc_id").distinct().join(client.select("doc_id").distinct(), "doc_id", "left_semi").count()
    out = ids.select("doc_id")
    return server.join(out, "doc_id", "left_anti"), client.join(out, "doc_id", "left_anti"), gone, deletions, deletions >= threshold


def backward_renew(client: DataFrame, search: Key) -> DataFrame:
    """Server postings rebuilt from the client's keywords (doc_id, keyword, keys) under a new search key."""
    return client.select("doc_id", keyword_token(F.col("keyword"), search).alias("token"))


def reindexed(records: DataFrame, blob: str, document_key: Key, index) -> DataFrame:
    """Records with their index made anew under a new master key, from the encrypted field; null where that doesn't open.

    index is a function of the text column. Old indexes stay valid until the records are replaced by these.
    """
    return records.withColumn("index", index(try_decrypt(F.col(blob), document_key.raw).cast("string")))


def collect_garbage(server: DataFrame, client: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(server without stale documents, one row removed): stale documents have no client keywords."""
    known = client.select("doc_id").distinct()
    removed = server.select("doc_id").distinct().join(known, "doc_id", "left_anti").agg(F.count("*").alias("removed"))
    return server.join(known, "doc_id", "left_semi"), removed
