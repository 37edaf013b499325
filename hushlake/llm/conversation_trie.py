"""Prefix trie of conversations, its subtree sums rolled up band by band."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

#: Depths of a band: a node is exploded to at most so many ancestors.
BAND = 32
#: Ids that are hashed in one go; longer runs are cut into pieces of so many.
PIECE_IDS = 100_000
#: The root's id and what a node's ids are stored as.
NODE = "struct<a:bigint,b:bigint>"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def root_id() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def numbered(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, mark, chars): every turn's place in its conversation from 1, MD5 of its role and text, and code points of the text.

    Order is by turn, null first, then by mark. Rows are dealt out by ranges of conversation and turn and numbered by range, so that a very
    long conversation is the work of many tasks; a range then adds the turns of its first conversation that lie in ranges before it. Null roles and texts
    count as empty. Rows without a conversation take no part.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = table.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), mark.alias("mark"), F.length(text).alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("mark")]
    dealt = stored(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A range goes on with one conversation of the range before it at most, so there are fewer rows than ranges.
    before = counts.select("conv", "part", before.alias("before")).filter("before IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order))
    local = dealt.select("conv", "part", "mark", "chars", place.alias("place"))
    return local.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "mark", "chars")


def prefix_ids(items: DataFrame, deepest: int, band: int) -> tuple[DataFrame, list[DataFrame]]:
    """Ids of the prefixes that end at each row of items (conv, pos, a, b, more columns), and their ancestors in the band.

    A prefix's id is the XOR of its items' hashes (a, b), which hold the place of each. Runs of ``band`` items are put together by windows; the
    runs of a conversation are then items of a level above, and so on, so that no window is longer than a band. Returns items with id
    and path (ids from the band's top down to the parent), and (id, path) of the band tops of each level above.
    """
    whole = Window.partitionBy("conv", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = items.withColumn("run", F.floor((F.col("pos") - 1) / band)).withColumns({k: F.bit_xor(k).over(whole) for k in ("a", "b")})
    above: list[DataFrame] = []
    if deepest >= band:
        runs = stored(local.filter(F.col("pos") % band == 0).select("conv", (F.col("pos") / band).cast("long").alias("pos"), "a", "b"), "runs")
        upper, above = prefix_ids(runs, deepest // band, band)
        upper = stored(upper, "band_tops")
        tops = upper.select("conv", F.col("pos").alias("run"), F.col("id.a").alias("ta"), F.col("id.b").alias("tb"))
        local = local.join(tops, ["conv", "run"], "left")
        above = [upper.select("id", "path").distinct(), *above]
    else:
        local = local.withColumns({"ta": F.lit(0).cast("long"), "tb": F.lit(0).cast("long")})
    of = {k: F.coalesce(f"t{k}", F.lit(0).cast("long")) for k in ("a", "b")}
    local = local.withColumns({"id": F.struct(*[F.col(k).bitwiseXOR(of[k]).alias(k) for k in of]), "top": F.struct(*[of[k].alias(k) for k in of])})
    path = F.concat(F.array("top"), F.collect_list("id").over(whole.rowsBetween(Window.unboundedPreceding, -1)))
    return local.withColumn("path", path).drop("a", "b", "ta", "tb", "top", "run"), above


def rolled_up(nodes: DataFrame, above: list[DataFrame], deepest: int, band: int) -> DataFrame:
    """(id, leaves, saved, children): sums of leaves and saved over the subtree of each of nodes (id, depth, path, leaves, saved).

    Nodes explode to their ancestors of the same band only. The tops of the bands, which are ``band`` levels apart, then are a trie of their own with
    the sums of their bands as values; its totals (by the same function) go from each top to the ancestors in the band above it. So a node
    makes at most ``band`` rows, and there are as many rounds as ``band`` has to be multiplied to reach the depth.
    """
    top = F.col("depth") % band == 0
    zero = F.lit(0).cast("long")
    own = lambda p, leaves, saved, child, is_top: F.struct(p.alias("id"), leaves.alias("leaves"), saved.alias("saved"), child.alias("children"), is_top.alias("top"))
    last = F.size("path") - 1
    parent_only = F.when(F.size("path") > 0, F.array(own(F.element_at("path", -1), zero, zero, F.lit(1).cast("long"), last == 0)))
    ancestors = F.transform("path", lambda p, i: own(p, F.col("leaves"), F.col("saved"), (i == last).cast("long"), i == 0))
    targets = F.concat(F.array(own(F.col("id"), F.col("leaves"), F.col("saved"), zero, top)), F.when(top, F.coalesce(parent_only, F.slice(ancestors, 1, 0))).otherwise(ancestors))
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved", "children")]
    parts = nodes.select(F.explode(targets).alias("t")).select("t.*").groupBy("id", "top").agg(*sums)
    if deepest < band:
        return parts.drop("top")
    parts = stored(parts, "band_sums")
    tops = nodes.filter(top).select("id", (F.col("depth") / band).cast("long").alias("depth"), F.col("path").alias("under"))
    tops = tops.join(parts.select("id", "leaves", "saved"), "id").join(above[0], "id", "left")
    tops = stored(tops.withColumn("path", F.coalesce("path", F.array().cast(f"array<{NODE}>"))), "band_tops")
    totals = stored(rolled_up(tops, above[1:], deepest // band, band).drop("children"), "band_totals")
    # The first of a top's ancestors is the top of the band above, which has its total already.
    down = tops.select("id", F.expr("slice(under, 2, greatest(size(under) - 1, 0))").alias("under")).join(totals, "id")
    down = down.select(F.explode("under").alias("id"), "leaves", "saved", zero.alias("children"))
    tops_of = parts.filter("top").select("id", zero.alias("leaves"), zero.alias("saved"), "children")
    every = parts.filter("NOT top").drop("top").unionByName(down).unionByName(tops_of).unionByName(totals.withColumn("children", zero))
    return every.groupBy("id").agg(*sums)


def ids_digest(rows: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the ascending decimal convs of each id of rows (id, conv), joined by commas.

    Rows are dealt out by ranges of (id, conv) and hashed as they stream by. Ids at either end of a range, and those of very many convs, come out as pieces
    of text instead, which another pass joins in order; that pass also holds one piece at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, pieces, first_run, out = None, [], False, True, []

        def piece() -> None:
            out.append((*key, ids[0], None, ",".join(map(str, ids))))

        for batch in batches:
            a, b, conv = (batch.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else []
            for s, e in zip(starts, [*starts[1:], len(a)], strict=True):
                here = (int(a[s]), int(b[s]))
                if here != key:
                    if key is not None:
                        if pieces or first_run:
                            piece()
                        else:
                            out.append((*key, ids[0], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), None))
                        first_run = False
                    key, ids, pieces = here, [], False
                for k in range(s, e, PIECE_IDS):
                    if ids and len(ids) + min(e, k + PIECE_IDS) - k > PIECE_IDS:
                        piece()
                        ids, pieces = [], True
                    ids.extend(conv[k : min(e, k + PIECE_IDS)].tolist())
            if out:
                yield as_batch(out)
                out = []
        if key is not None:
            piece()
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["a", "b", "first", "sha", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256(text.encode())
                else:
                    sha.update(b",")
                    sha.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=["a", "b", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=["a", "b", "sha"])

    order = ["a", "b", "conv"]
    dealt = rows.select("id.a", "id.b", "conv").repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(joined, "a long, b long, first long, sha string, piece string"), "digests")
    pieces = found.filter("piece IS NOT NULL").select("a", "b", "first", "piece").repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "piece")
    every = found.filter("sha IS NOT NULL").select("a", "b", "sha").union(pieces.mapInArrow(hashed, "a long, b long, sha string"))
    return every.select(F.struct("a", "b").alias("id"), F.col("sha").alias("ends_sha256"))


def prefix_trie(turns: DataFrame, members: DataFrame, band: int = BAND) -> DataFrame:
    """Nodes of the trie of numbered turns (conv, pos, mark, chars) of members (conv, n turns), as ``conversation_trie`` returns them.

    pos counts from 1 without gaps and ends at n. Two prefixes are one node if their 128-bit hashes agree. An empty table of members gives no node.
    """
    deepest = members.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    ends = members.select("conv", F.col("n").alias("pos"), F.lit(True).alias("end")).filter("pos > 0")
    items = turns.join(ends, ["conv", "pos"], "left").select("conv", "pos", "chars", F.coalesce("end", F.lit(False)).alias("end"), F.xxhash64("mark", "pos").alias("a"), F.xxhash64("pos", F.lit("b"), "mark").alias("b"))
    found, above = prefix_ids(items, deepest, band)
    found = stored(found.withColumnRenamed("pos", "depth"), "prefixes")
    nodes = found.groupBy("id", "depth", "chars", "path").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("end").alias("n_ends"))
    root = members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("n") == 0).alias("n_ends")).filter("n_convs > 0")
    root = root.select(root_id().alias("id"), F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.array().cast(f"array<{NODE}>").alias("path"), "conv_id", "n_convs", "n_ends")
    nodes = nodes.unionByName(root).withColumns({"depth": F.col("depth").cast("long"), "leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars").cast("long")})
    nodes = stored(nodes, "nodes")
    sums = rolled_up(nodes, above, deepest, band)
    digests = ids_digest(found.filter("end").select("id", "conv").unionByName(members.filter("n = 0").select(root_id().alias("id"), "conv")))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own = nodes.select("id", "depth", F.try_element_at("path", F.lit(-1)).alias("parent"), "conv_id", "n_convs")
    out = own.join(sums, "id").join(digests, "id", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), F.col("id.a").alias("node_a"), F.col("id.b").alias("node_b"))


def conversation_trie(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", band: int = BAND) -> DataFrame:
    """Every distinct beginning (role and text of the first turns) of the conversations of table, the empty one included, as a node.

    Returns conv_id (smallest conversation that begins so), depth (turns), parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (beginnings below it that nothing goes on from, itself included), saved_tokens (sum over its subtree of code points of a node's last text,
    times the conversations beyond the first that share it), ends_sha256 (digest of the conversations that end there, ascending, joined by commas) and the
    node's hash (node_a, node_b). Turns are ordered by turn, null first, ties by their MD5; null roles and texts are like empty ones; repeated rows are turns of their own; rows without
    a conversation take no part. An empty table has no nodes. Other columns are left out. ``band`` bounds the ancestors that a node explodes to.
    """
    turns = stored(numbered(table, conv_col, turn_col, role_col, text_col), "turns")
    return prefix_trie(turns, turns.groupBy("conv").agg(F.max("pos").alias("n")), band)


#: What the registered query rebuilds conversations by: ids that share beginnings, and turns that may be taken over.
GROUP, TAKEN = 100, 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of the registered query: the first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % 6."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    base, h = F.col("conv") - F.col("conv") % GROUP, (F.crc32(F.col("conv").cast("string").cast("binary")) % TAKEN).cast("int")
    donors = convs.filter(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), "n")
    convs = convs.select("conv", F.col("n").alias("had"), base.alias("base"), h.alias("h")).join(donors, "base", "left")
    convs = convs.select("conv", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"), "had")
    convs = stored(convs.withColumn("n", F.col("taken") + F.greatest(F.col("had") - F.col("h"), F.lit(0))), "rebuilt")
    own = turns.withColumn("h", h).filter("pos > h").join(convs.select("conv", "taken"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "mark", "chars")
    heads = turns.filter((F.col("conv") % GROUP == 0) & (F.col("pos") < TAKEN)).select(F.col("conv").alias("base"), "pos", "mark", "chars")
    lent = convs.filter("taken > 0").select("conv", "base", "taken").join(heads, "base").filter("pos <= taken").select("conv", "pos", "mark", "chars")
    return own.unionByName(lent), convs.select("conv", "n")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie(*rebuilt(turns)).drop("node_a", "node_b")


OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda x, y: list_reduce(list_concat([xor(x, y)], [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), CAST(4294967295 AS BIGINT)) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.pos <= h.h UNION ALL SELECT h.c, t.pos + 1000000, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
seqs AS (SELECT h.c, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (r.c IS NOT NULL), []) AS seq FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
begun AS (SELECT c, len(seq) AS n, unnest(list_transform(range(len(seq) + 1), lambda d: {'d': d, 'p': list_slice(seq, 1, d)})) AS x FROM seqs),
nodes AS (SELECT x.p AS p, x.d AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = x.d), '')) AS ends_sha256, (count(*) - 1) * coalesce(length(x.p[-1].text), 0) AS own FROM begun GROUP BY x.p, x.d),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.p = nodes.p),
up AS (SELECT list_slice(p, 1, k) AS p, own, n_children FROM (SELECT p, own, n_children, unnest(range(depth + 1)) AS k FROM full_nodes)),
sums AS (SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM up GROUP BY p)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums ON sums.p = f.p LEFT JOIN nodes parent ON f.depth > 0 AND parent.p = list_slice(f.p, 1, f.depth - 1)
"""
