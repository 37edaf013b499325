"""Hard negatives of anchors by exact inner-product search over lists that the anchors of a cluster share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .embedding_dedup import fit_centers
from .shared import stored, thrifty

#: Distinct anchors (about) that cluster centers are fitted on, anchors of a cluster (about), and clusters at most.
SAMPLE, CLUSTER, MAX_CLUSTERS = 16_384, 64, 1024
#: Rows of a cell of candidates (about); cells at most, so that what is known of each fits the driver.
CELL, MAX_CELLS = 4096, 16_384
#: Rows of a list that are compared at a time, members that walk together, and members that share a copy of a cell.
STEP, MEMBERS, VISITORS = 256, 256, 4096
#: Cells that each member visits before the others are bounded by what it found there.
FIRST = 2


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def angles(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Angles of rows to centers (unit); that of a zero vector is 0, since its products are all 0 anyway."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.divide(x @ centers.T, norm, out=np.ones((len(x), len(centers))), where=norm > 0)
    return np.arccos(np.clip(cos, -1, 1))


def walk(u: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, bounds: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """First k rows of a shared list for each member and window: (member, window, place in the list, score).

    The list (x, ids, labels) is sorted by descending bounds: no member's score with a row passes its length times the row's bound. A member
    walks until that is below what each of its windows [low, high] still needs: ``least``, or the k-th best score found in it.
    """
    norm, top = np.linalg.norm(u, axis=1), np.full((*low.shape, k), -np.inf)
    need, found = np.maximum(least, low), []
    for start in range(0, len(x), STEP):
        reach = norm * bounds[start]
        live = np.flatnonzero(reach + 1e-9 * np.abs(reach) + 1e-6 >= need.min(axis=1))
        if not len(live):
            break
        scores = np.rint(u[live] @ x[start : start + STEP].T)
        fits = (label[live, None] == labels[None, start : start + STEP]) == same
        for w in range(low.shape[1]):
            ok = fits & (scores >= need[live, w, None]) & (scores <= high[live, w, None])
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            found.append((live[i], np.full(len(i), w), start + j, scores[i, j]))
            some = np.unique(i)
            best = np.sort(np.concatenate([top[live[some], w], np.where(ok[some], scores[some], -np.inf)], axis=1), axis=1)[:, -k:]
            top[live[some], w] = best
            need[live[some], w] = np.maximum(need[live[some], w], best[:, 0])
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    member, window, place, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids[place], -score, window, member))
    member, window, place, score = member[order], window[order], place[order], score[order]
    first = np.concatenate([[True], (member[1:] != member[:-1]) | (window[1:] != window[:-1])])
    rank = np.arange(len(member)) - np.maximum.accumulate(np.where(first, np.arange(len(member)), 0))
    return member[rank < k], window[rank < k], place[rank < k], score[rank < k]


class Cells:
    """Candidates (id, label, mark, vector) in cells of near equal angle to their nearest center, and what bounds each cell's scores."""

    def __init__(self, candidates: DataFrame, centers: np.ndarray, size: int) -> None:
        spark = candidates.sparkSession
        self.size, self.sent = size, []
        self.centers = self.broadcast(spark, centers)
        sent, n = self.centers, candidates.count()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(3), size)
                far = angles(x, sent.value)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far[np.arange(len(x)), near]), pa.array(np.linalg.norm(x, axis=1))], names=[*batch.schema.names, "center", "angle", "norm"])

        placed = candidates.select("id", "label", "mark", "vector").mapInArrow(thrifty(place), "id long, label long, mark long, vector array<int>, center long, angle double, norm double")
        # Neighbours in (center, angle), in cells of about equal size whatever their density.
        dealt = placed.repartitionByRange(max(1, min(MAX_CELLS, -(-n // CELL))), "center", "angle", "id")
        self.rows = stored(dealt.withColumn("cell", F.spark_partition_id() * F.lit(len(centers)).cast("long") + F.col("center")), "cells")
        known = self.rows.groupBy("cell", "center").agg(F.min("angle"), F.max("angle"), F.min("norm"), F.max("norm")).toPandas().sort_values("cell")
        self.known = self.broadcast(spark, {"cell": known["cell"].to_numpy(), "center": known["center"].to_numpy(), "angle": known[["min(angle)", "max(angle)"]].to_numpy(), "norm": known[["min(norm)", "max(norm)"]].to_numpy()})

    def broadcast(self, spark: SparkSession, value) -> Broadcast:
        self.sent.append(spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def close(self) -> None:
        for sent in self.sent:
            sent.destroy()

    def visits(self, members: DataFrame, first: bool) -> DataFrame:
        """members once for each cell that they visit: the FIRST of the highest bounds, or all others whose bound reaches what a window needs."""
        centers, known, size = self.centers, self.known, self.size
        names = members.columns
        at = {c: names.index(c) for c in ("vector", "least")}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = known.value
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    part = batch.slice(start, 64)
                    u = matrix(part.column(at["vector"]), size)
                    far = angles(u, centers.value)[:, cells["center"]]
                    cos = np.cos(np.maximum(0, np.maximum(far - cells["angle"][:, 1], cells["angle"][:, 0] - far)))
                    reach = np.linalg.norm(u, axis=1)[:, None] * np.where(cos >= 0, cos * cells["norm"][:, 1], cos * cells["norm"][:, 0])
                    best = np.argsort(-reach, axis=1, kind="stable")[:, :FIRST]
                    chosen = np.zeros(reach.shape, bool)
                    np.put_along_axis(chosen, best, True, 1)
                    if not first:
                        need = np.array([min(own) for own in part.column(at["least"]).to_pylist()])[:, None]
                        chosen = ~chosen & (reach + 1e-9 * np.abs(reach) + 1e-6 >= need)
                    i, j = np.nonzero(chosen)
                    if len(i):
                        taken = part.take(pa.array(i))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells["cell"][j])], names=[*names, "cell"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
        return members.mapInArrow(thrifty(run), f"{schema}, cell long")

    def search(self, members: DataFrame, first: bool, same: bool, k: int, radii: Broadcast) -> DataFrame:
        """(cls, high, score, id, mark): first k rows in each window of each of members (cls, label, vector, cluster, low, high, least) by cell.

        A cell's rows come before the members that visit it, which stream by cluster after cluster; a task holds one cell and one sorted list. Cells with
        very many visitors are copied, each copy for a part of them.
        """
        visits = stored(self.visits(members, first), "visits")
        copies = visits.groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("copies"))
        copies = F.broadcast(copies)  # MAX_CELLS rows per center that a cell may touch at most
        none = F.lit(None)
        rows = self.rows.join(copies, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(-1).cast("long").alias("cluster"), "id", "label", "mark", "vector", *[none.cast("array<double>").alias(c) for c in ("low", "high", "least")])
        asked = visits.join(copies, "cell").select("cell", F.pmod(F.xxhash64("cls"), F.col("copies")).cast("int").alias("copy"), "cluster", F.col("cls").alias("id"), "label", none.cast("long").alias("mark"), "vector", "low", "high", "least")
        both = rows.unionByName(asked).repartition("cell", "copy").sortWithinPartitions("cell", "copy", "cluster")
        centers, size = self.centers, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, list_of, x, shared = None, [], None, None, None
            for batch in batches:
                key = np.stack([batch.column(c).to_numpy() for c in ("cell", "copy", "cluster")], axis=1)
                starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.empty(0, np.int64)
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                    part = batch.slice(s, e - s)
                    cell, cluster = tuple(key[s, :2].tolist()), int(key[s, 2])
                    if cluster < 0:
                        if cell != now:
                            now, held = cell, []
                        held.append(part)
                        x = None
                        continue
                    if x is None:
                        x = np.concatenate([matrix(p.column("vector"), size) for p in held])
                        ids, labels, marks = (np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("id", "label", "mark"))
                        lengths, far, list_of, held = np.linalg.norm(x, axis=1), angles(x, centers.value), None, []
                    if list_of != cluster:
                        list_of = cluster
                        cos = np.cos(np.maximum(0, far[:, cluster] - radii.value[cluster]))
                        bounds = lengths * cos
                        order = np.argsort(-bounds, kind="stable")
                        shared = bounds[order], x[order], ids[order], labels[order]
                        places = marks[order]
                    for m in range(0, len(part), MEMBERS):
                        block = part.slice(m, MEMBERS)
                        windows = {c: block.column(c).to_pylist() for c in ("low", "high", "least")}
                        width = max(map(len, windows["low"]))
                        low, high, least = (np.array([[*own, *[np.inf] * (width - len(own))] for own in windows[c]]) for c in ("low", "high", "least"))
                        member, window, place, score = walk(matrix(block.column("vector"), size), block.column("label").to_numpy(), low, high, least, *shared, same, k)
                        if len(member):
                            yield pa.RecordBatch.from_arrays([pa.array(block.column("id").to_numpy()[member]), pa.array(high[member, window]), pa.array(score.astype(np.int64)), pa.array(shared[2][place]), pa.array(places[place])], names=["cls", "high", "score", "id", "mark"])

        return both.mapInArrow(thrifty(run), "cls long, high double, score long, id long, mark long")


def mine_hard_negatives(table: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", levels: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """The rows of other labels that come closest below each positive of each anchor.

    Components become floor(levels * x); a score is the inner product of two rows. ``anchor`` says which rows are anchors. An anchor's positives
    are its first other rows of the same label by descending score, ties by the smaller id; for each of them, the first rows of other labels follow whose score is not
    above the positive's and at least ``percent`` of it. Returns anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    Method: anchors are clustered by angle; for a cluster, a candidate's score with any member is at most the member's length times the candidate's
    length times the cosine of what its angle to the center exceeds the cluster's radius by. Candidates lie in cells; for each cell that may hold a
    result, its rows are sorted by that bound once for a cluster, and every member walks the list until the bound falls below what it needs. Results are
    exact. Equal vectors of one label are one class: an anchor's results depend on its class, and of a class only the smallest ids can be among the first rows.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of different lengths don't meet; empty ones have score 0. Repeated rows (id, label and
    vector) count once; an id with several vectors or labels is as many rows. Scores must stay below 2**53, else an error is raised. An empty table, and anchors
    without positives or negatives, give no rows. Extra columns are left out.
    """
    spark = table.sparkSession
    whole = F.transform(vector_col, lambda v: F.floor(v.cast("double") * levels))
    fine = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("label"), whole.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    most = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).first()[0]
    if most is not None and most >= 2.0**53:
        raise ValueError("scores reach 2**53 and would not be exact")
    rows = rows.select("id", "label", F.col("vector").cast("array<int>").alias("vector"), "anchor", F.xxhash64("vector", "label").alias("mark")).distinct()
    rows = stored(rows, "vectors")
    keep = max(positives + 1, negatives)
    out = None
    for size in sorted(r[0] for r in rows.filter("anchor").select(F.size("vector")).distinct().collect()):
        part = mine_of_size(spark, rows.filter(F.size("vector") == size), size, keep, positives, negatives, percent)
        out = part if out is None else out.union(part)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], names) if out is None else out


def mine_of_size(spark: SparkSession, rows: DataFrame, size: int, keep: int, positives: int, negatives: int, percent: int) -> DataFrame:
    smallest = F.row_number().over(Window.partitionBy("vector", "label").orderBy("id"))
    candidates = stored(rows.withColumn("nth", smallest).filter(F.col("nth") <= keep), "candidates")
    anchors = rows.filter("anchor")
    classes = stored(anchors.groupBy("vector", "label", "mark").agg(F.min("id").alias("cls")), "classes")
    # Centers from a sample of bounded size; anything else covers all rows.
    n = classes.count()
    share = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / n)))
    picked = classes.filter(share).orderBy(F.xxhash64("cls")).limit(2 * SAMPLE).select("vector").collect()
    sample = np.array([r[0] for r in picked], np.float64).reshape(len(picked), size)
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    few = max(1, min(MAX_CLUSTERS, -(-n // CLUSTER), len(sample)))
    centers = fit_centers(sample, few) if len(sample) else np.eye(1, max(size, 1))[:, :size]
    cells = Cells(candidates, centers, size)
    sent = cells.centers

    def clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = angles(matrix(batch.column(2), size), sent.value)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far[np.arange(len(near)), near])], names=["cls", "label", "vector", "cluster", "angle"])

    members = stored(classes.select("cls", "label", "vector").mapInArrow(thrifty(clustered), "cls long, label long, vector array<int>, cluster long, angle double"), "members")
    radius = np.zeros(len(centers))
    for cluster, angle in members.groupBy("cluster").agg(F.max("angle")).collect():
        radius[cluster] = angle
    radii = cells.broadcast(spark, radius + 1e-9)
    members = members.drop("angle")

    def best(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """First k of every window: from the likeliest cells, then from all others that can still hold one."""
        place = F.row_number().over(Window.partitionBy("cls", "high").orderBy(F.desc("score"), "id"))
        first = stored(cells.search(asked, True, same, k, radii).withColumn("place", place).filter(F.col("place") <= k).drop("place"), "first")
        full = first.groupBy("cls", "high").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("worst")).filter(F.col("n") == k)
        full = full.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("high", "worst"))).alias("worst"))
        needs = F.transform(F.arrays_zip("high", "least"), lambda w: F.greatest(w["least"], F.coalesce(F.try_element_at("worst", w["high"]), w["least"])))
        rest = asked.join(full, "cls", "left").withColumn("least", needs).drop("worst").select(asked.columns)
        return stored(first.union(cells.search(rest, False, same, k, radii)).withColumn("place", place).filter(F.col("place") <= k), "best")

    free = lambda v: F.array(F.lit(v))
    near = best(members.withColumns({"low": free(float("-inf")), "high": free(float("inf")), "least": free(float("-inf"))}), True, positives + 1)
    lowest = F.when(F.col("score") >= 0, F.expr(f"({percent} * score + 99) div 100")).otherwise(F.expr(f"({percent} * score) div 100"))
    windows = near.select("cls", F.col("score").cast("double").alias("high"), lowest.cast("double").alias("low")).filter("low <= high").distinct()
    windows = windows.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("high", "low"))).alias("w"))  # positives + 1 at most
    windows = windows.select("cls", F.transform("w", lambda w: w["low"]).alias("low"), F.transform("w", lambda w: w["high"]).alias("high"))
    below = best(members.join(windows, "cls").withColumn("least", F.col("low")).select("cls", "label", "vector", "cluster", "low", "high", "least"), False, negatives)
    cells.close()
    own = anchors.join(classes.select("vector", "label", "cls"), ["vector", "label"]).select("id", "mark", "cls")
    near = near.select("cls", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"), F.col("mark").alias("positive_mark"))
    near = own.join(near, "cls").filter((F.col("id") != F.col("positive_id")) | (F.col("mark") != F.col("positive_mark")))
    nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("nth", nth).filter(F.col("nth") <= positives)
    below = below.select("cls", F.col("high").cast("long").alias("positive_score"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(below, ["cls", "positive_score"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) QUALIFY row_number() OVER w <= 5
"""
