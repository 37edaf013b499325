"""Near-duplicate vectors by range search in a flat, robust-pruned graph built on overlapping cluster shards."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import components, stored

#: Stands for a null id, which so comes after all others.
LAST = 2**63 - 1
#: Neighbours kept of a node in a shard, candidates looked at, and how much farther a pruned one may be.
DEGREE, POOL, ALPHA = 24, 64, 1.2
#: Vectors (about) that the centers of a split are fitted on, and at most that recall is audited with.
SAMPLE, AUDIT = 20_000, 400
#: Centers of a level that are broadcast at most (10 MB of 64 dimensions), and rows of a cell that meet its centers at a time beyond that.
BROADCAST_CENTERS, ROUTED = 20_000, 20_000
LOG = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.empty((0, 1))


def fit_centers(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means on unit vectors by cosine."""
    x = unit(x)
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centers)
    return centers


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Up to DEGREE neighbours of each unit vector: the nearest first, without those that a chosen one leads to (ALPHA times nearer)."""
    n, pool = len(x), min(POOL, len(x) - 1)
    out: list[np.ndarray] = []
    for start in range(0, n, 256):
        block = x[start : start + 256]
        sims = block @ x.T
        sims[np.arange(len(block)), start + np.arange(len(block))] = -2
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool] if pool else np.empty((len(block), 0), np.int64)
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1), 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
        among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nid,njd->nij", x[near], x[near])))
        alive, rows = np.ones(near.shape, bool), np.arange(len(block))
        picked = np.zeros(near.shape, bool)
        for _ in range(min(DEGREE, pool)):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            picked[rows[some], first[some]] = True
            alive &= ~(ALPHA * among[rows, first] <= far)
            alive[rows, first] = False
        out += [near[i][picked[i]] for i in range(len(block))]
    return out


def build_graph(shard: pd.DataFrame) -> pd.DataFrame:
    """Edges (node, next) of one shard, in both directions."""
    if len(shard) < 2:
        return pd.DataFrame({"node": [], "next": []}, dtype="int64")
    ids = shard["id"].to_numpy(np.int64)
    near = robust_prune(unit(vectors(shard["vector"])))
    a, b = np.repeat(ids, [len(x) for x in near]), ids[np.concatenate(near)]
    return pd.DataFrame({"node": np.concatenate([a, b]), "next": np.concatenate([b, a])})


def search_graph(x: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of similarity least or more, met by a greedy search of all unit queries from start.

    The best ``beam`` nodes of a query are expanded until none of them is new; then every node in range is expanded, until the range stops growing.
    """
    q, beam = len(queries), min(beam, len(x))
    rows = np.arange(q)
    met = np.zeros((q, len(x)), bool)
    met[:, start] = True
    ids, sims = np.full((q, beam), start), np.full((q, beam), -2.0)
    sims[:, 0] = queries @ x[start]
    done = np.ones((q, beam), bool)
    done[:, 0] = False
    hit = np.flatnonzero(sims[:, 0] >= least)
    found = [(hit, np.full(len(hit), start))]
    opened = np.zeros((q, len(x)), bool)

    def expand(at: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New neighbours of nodes[i] for query at[i]: places in at, neighbours, similarities."""
        opened[at, nodes] = True
        near = links[nodes]
        i, j = np.nonzero((near >= 0) & ~met[at[:, None], near])
        to = near[i, j]
        # Two nodes of one query may lead to the same neighbour.
        key = np.unique(at[i] * len(x) + to, return_index=True)[1]
        i, to = i[key], to[key]
        met[at[i], to] = True
        said = np.einsum("kd,kd->k", queries[at[i]], x[to])
        fits = said >= least
        found.append((at[i[fits]], to[fits]))
        return i, to, said

    while True:
        best = np.where(done, -3.0, sims).argmax(axis=1)
        at = rows[~done[rows, best]]
        if not len(at):
            break
        done[at, best[at]] = True
        i, to, said = expand(at, ids[at, best[at]])
        if not len(i):
            continue
        owner = at[i]
        order = np.argsort(owner, kind="stable")
        owner, to, said = owner[order], to[order], said[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
        width = int(place.max()) + 1
        some = np.unique(owner)
        row = np.searchsorted(some, owner)
        more, value = np.full((len(some), width), start), np.full((len(some), width), -2.0)
        more[row, place], value[row, place] = to, said
        all_ids, all_sims = np.concatenate([ids[some], more], axis=1), np.concatenate([sims[some], value], axis=1)
        all_done = np.concatenate([done[some], value == -2.0], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[some], sims[some], done[some] = (np.take_along_axis(v, keep, 1) for v in (all_ids, all_sims, all_done))
    frontier = tuple(np.concatenate(v) for v in zip(*found, strict=True))
    while len(frontier[0]):
        todo = ~opened[frontier]
        at, nodes = frontier[0][todo], frontier[1][todo]
        mark = len(found)
        for k in range(0, len(at), 4096):
            expand(at[k : k + 4096], nodes[k : k + 4096])
        frontier = tuple(np.concatenate(v) for v in zip(*found[mark:], strict=True)) if len(found) > mark else (np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def search_shard(least: float, beam: int):
    """Function of (nodes, queries) of one shard to pairs (a, b) of cosine least or more, checked in double precision."""

    def run(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if not len(nodes) or not len(queries):
            return empty
        ids = nodes["id"].to_numpy(np.int64)
        x, asked = unit(vectors(nodes["vector"])), unit(vectors(queries["vector"]))
        place = {v: i for i, v in enumerate(ids.tolist())}
        lists = [np.array([place[v] for v in (own if own is not None else []) if v in place], np.int64) for own in nodes["links"]]
        lists = [own[np.argsort(-(x[own] @ x[i]), kind="stable")[: 2 * DEGREE]] if len(own) > 2 * DEGREE else own for i, own in enumerate(lists)]
        links = np.full((len(ids), max(1, max(map(len, lists)))), -1)
        for i, own in enumerate(lists):
            links[i, : len(own)] = own
        start = int((x @ x.mean(axis=0)).argmax())
        a, b = [], []
        own_ids = queries["id"].to_numpy(np.int64)
        for k in range(0, len(asked), 256):
            block = asked[k : k + 256]
            i, j = search_graph(x, links, start, block, least - 1e-6, beam)
            exact = np.einsum("kd,kd->k", block[i], x[j]) >= least
            left, right = own_ids[k : k + 256][i[exact]], ids[j[exact]]
            a.append(left[left != right])
            b.append(right[left != right])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else empty

    return run


def exact_shard(least: float):
    """Function of (nodes, queries) of one shard to all its pairs (a, b) of cosine least or more, in blocks."""

    def run(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(nodes) and len(queries):
            ids, own_ids = nodes["id"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
            x, asked = unit(vectors(nodes["vector"])), unit(vectors(queries["vector"]))
            for k in range(0, len(asked), 256):
                i, j = np.nonzero(asked[k : k + 256] @ x.T >= least - 1e-6)
                fits = (np.einsum("kd,kd->k", asked[k + i], x[j]) >= least) & (own_ids[k + i] != ids[j])
                a.append(own_ids[k + i[fits]])
                b.append(ids[j[fits]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


class Shards:
    """A tree of centers: vectors go down it, at each split to the cells of their nearest centers.

    The first split has up to ``fan`` cells, fitted on a sample of up to SAMPLE vectors. A cell of more than twice ``shard`` vectors
    is split again by centers fitted on a sample of its own, so the size of a shard does not depend on the number of vectors. The splits of one
    level are a table (shard, centers), a row for each split cell. Cells whose vectors no centers tell apart stay whole.
    """

    def __init__(self, rows: DataFrame, shard: int, fan: int) -> None:
        self.levels: list[Split] = []
        self.shard, self.fan = shard, fan
        cells = rows.select(F.lit("").alias("shard"), "id", "vector")
        whole: DataFrame | None = None
        while True:
            sizes = cells.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > (2 * shard if self.levels else 0))
            sizes = stored(sizes if whole is None else sizes.join(whole, "shard", "left_anti"), "sizes")
            if not sizes.limit(1).count():
                break
            # By the hash of the id, so that the sample of a cell is the same again; about SAMPLE of a larger cell.
            place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
            sample = cells.join(sizes, "shard").filter(place < F.lit(float(SAMPLE)) / F.col("n"))
            found = stored(sample.groupBy("shard").applyInPandas(self.split(), "shard string, centers array<array<double>>"), "centers")
            alone = found.filter(F.size("centers") < 2).select("shard")
            whole = stored(alone if whole is None else whole.union(alone), "whole")
            if self.levels and not found.filter(F.size("centers") > 1).limit(1).count():
                break
            self.levels.append(Split(found if not self.levels else stored(found.filter(F.size("centers") > 1), "centers"), sizes))
            cells = stored(self.placed(rows, 1), "cells")

    def split(self):
        shard, fan = self.shard, self.fan

        def run(sample: pd.DataFrame) -> pd.DataFrame:
            sample = sample.sort_values("id")
            k = max(1, min(fan, -(-int(sample["n"].iloc[0]) // shard), len(sample)))
            x = vectors(sample["vector"])
            centers = fit_centers(x, k)
            # Centers that no vector is nearest to, as for equal vectors, are left out.
            centers = centers[np.unique((unit(x) @ unit(centers).T).argmax(axis=1))]
            return pd.DataFrame({"shard": [sample["shard"].iloc[0]], "centers": [[c.tolist() for c in centers]]})

        return run

    def placed(self, rows: DataFrame, count: int) -> DataFrame:
        """(shard, id, vector): every vector in the shards of its count nearest centers of the whole tree."""
        out = rows.select(F.lit("").alias("shard"), "id", "vector", F.lit(0.0).alias("angle"))
        for depth, split in enumerate(self.levels):
            out = split.routed(out, nearest(count), "shard string, id long, vector array<double>, angle double")
            if depth and count > 1:
                # Each of the cells kept so far has given out as many: the best of all go on.
                out = out.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("angle", "shard"))).filter(F.col("nth") <= count).drop("nth")
        return out.drop("angle")


class Split:
    """The centers of the split cells of one level (shard, centers, more columns), and the cells' sizes (shard, n)."""

    def __init__(self, centers: DataFrame, sizes: DataFrame) -> None:
        self.centers, self.sizes = centers, sizes

    def routed(self, rows: DataFrame, go, schema: str) -> DataFrame:
        """What go(part, centers row) makes of the rows of each split cell; rows of other cells as they are.

        The vectors are sent without the centers: all centers of a level are broadcast where they are few, else each group of up to ROUTED rows of a
        cell meets the one row of its centers.
        """
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        if self.centers.agg(F.coalesce(F.sum(F.size("centers")), F.lit(0))).first()[0] <= BROADCAST_CENTERS:
            known = {r["shard"]: r.asDict() for r in self.centers.collect()}
            for own in known.values():
                own["centers"] = np.array(own["centers"])
            sent = rows.sparkSession.sparkContext.broadcast(known)

            def run(batches):
                known = sent.value
                for batch in batches:
                    for shard, part in batch.groupby("shard", sort=False):
                        out = go(part, known[shard])[names] if shard in known else part[names]
                        if len(out):
                            yield out

            return rows.mapInPandas(run, schema)
        groups = F.ceil(F.col("n") / ROUTED).cast("int").alias("groups")
        own = self.centers.join(self.sizes.select("shard", groups), "shard")
        inside = rows.join(own.select("shard", "groups"), "shard")
        inside = inside.withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).drop("groups")
        each = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

        def met(part: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({n: pd.Series(dtype=object) for n in names})
            if not len(part):
                return none
            row = centers.iloc[0].to_dict()
            out = go(part, row | {"centers": np.stack([np.asarray(c) for c in row["centers"]])})[names]
            return out if len(out) else none

        moved = inside.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInPandas(met, schema)
        return moved.unionByName(rows.join(self.centers.select("shard"), "shard", "left_anti").select(names))


def angles_to(part: pd.DataFrame, centers: np.ndarray) -> np.ndarray:
    """Angles of the vectors of one cell (rows) to its centers (columns)."""
    return np.arccos(np.clip(unit(vectors(part["vector"])) @ unit(centers).T, -1, 1))


def nearest(count: int):
    """Function of vectors and their cell's centers to the cells of the count nearest centers, with the angle."""

    def run(part: pd.DataFrame, row: dict) -> pd.DataFrame:
        far = angles_to(part, row["centers"])
        near = np.argsort(far, axis=1, kind="stable")[:, :count]
        cells = np.array([f"{row['shard']}/{i}" for i in range(far.shape[1])], object)
        return pd.DataFrame({"shard": cells[near.ravel()], "id": np.repeat(part["id"].to_numpy(), near.shape[1]), "vector": part["vector"].repeat(near.shape[1]).to_list(), "angle": np.take_along_axis(far, near, 1).ravel()})

    return run


def audit(rows: DataFrame, pairs: DataFrame, least: float, limit: int = AUDIT) -> float:
    """Recall of pairs for up to limit vectors (the smallest hashes of the id), against all vectors by brute force in blocks.

    The mean over those of them that have a link, so that a large group does not hide small ones; 1 if none has.
    """
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(limit).toPandas()
    ids, asked = picked["id"].to_numpy(np.int64), unit(vectors(picked["vector"]))
    sent = rows.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches):
        ids, asked = sent.value
        for batch in batches:
            if len(batch):
                i, j = np.nonzero(unit(vectors(batch["vector"])) @ asked.T >= least)
                own = batch["id"].to_numpy(np.int64)[i]
                yield pd.DataFrame({"a": ids[j], "b": own})[ids[j] != own]

    true = stored(rows.mapInPandas(run, "a long, b long"), "audit")
    met = true.join(pairs.withColumn("met", F.lit(1)), ["a", "b"], "left").groupBy("a").agg(F.avg(F.coalesce("met", F.lit(0))).alias("share"))
    return met.agg(F.coalesce(F.avg("share"), F.lit(1.0))).first()[0]


def exact_pairs(rows: DataFrame, shards: Shards, least: float) -> DataFrame:
    """All pairs (a, b): each vector lies in one shard, and is asked in every shard that can hold a vector in range.

    At each split a query goes on to the cells whose radius (largest angle of a vector below them to their center) and the range
    together reach it.
    """
    owned = rows.select(F.lit("").alias("shard"), "id", "vector", F.lit(None).cast("double").alias("angle"))
    asked = owned.drop("angle")
    for split in shards.levels:
        owned = stored(split.routed(owned.withColumn("angle", F.lit(None).cast("double")), nearest(1), "shard string, id long, vector array<double>, angle double"), "owned")
        radii = owned.filter("angle IS NOT NULL").groupBy("shard").agg(F.max("angle").alias("radius"))
        parent, place = F.expr("substring_index(shard, '/', size(split(shard, '/')) - 1)"), F.substring_index("shard", "/", -1).cast("int")
        radii = radii.groupBy(parent.alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct(place, "radius"))).alias("radii"))
        known = Split(stored(split.centers.join(radii, "shard"), "radii"), split.sizes)
        asked = known.routed(asked, reached(least), "shard string, id long, vector array<double>")
    return owned.drop("angle").groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(exact_shard(least), "a long, b long")


def reached(least: float):
    """Function of vectors and their cell's centers and radii: each vector in the cells that can hold one in range."""

    def run(part: pd.DataFrame, row: dict) -> pd.DataFrame:
        angles, radii = angles_to(part, row["centers"]), np.full(len(row["centers"]), -10.0)
        for place, radius in dict(row["radii"]).items():
            radii[place] = radius
        i, j = np.nonzero(angles <= radii + np.arccos(least) + 1e-6)
        return pd.DataFrame({"shard": [f"{row['shard']}/{k}" for k in j.tolist()], "id": part["id"].to_numpy()[i], "vector": part["vector"].iloc[i].to_list()})

    return run


def similar_pairs(rows: DataFrame, least: float = 0.9, shard: int = 1200, overlap: int = 2, probes: int = 4, beam: int = 32, recall: float = 0.99, attempts: int = 3, fan: int = SAMPLE // 8) -> DataFrame:
    """Pairs (a, b), both ways, of the vectors of rows (id, vector) with cosine least or more.

    A tree of centers cuts the vectors into shards of about ``shard``, each vector in the ``overlap`` nearest. Each shard
    builds its graph by robust pruning; the neighbours of all shards are united, and of very many the 2 * DEGREE nearest are kept in a shard. A
    query goes to the shards of its ``probes`` nearest centers of the whole tree. Recall is audited on up to AUDIT vectors and logged; below
    ``recall`` probes and beam are doubled and the search repeated; if it is still below after ``attempts``, exact_pairs takes its place.
    """
    shards = Shards(rows, shard, fan)
    nodes = stored(shards.placed(rows, overlap), "shards")
    edges = nodes.groupBy("shard").applyInPandas(build_graph, "node long, next long")
    graph = stored(edges.groupBy("node").agg(F.collect_set("next").alias("links")).withColumnRenamed("node", "id"), "graph")
    nodes = stored(nodes.join(graph, "id", "left").select("shard", "id", "vector", "links"), "nodes")
    both = lambda pairs: stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    for _ in range(attempts):
        asked = shards.placed(rows, probes)
        found = both(nodes.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(search_shard(least, beam), "a long, b long"))
        met = audit(rows, found, least)
        LOG.info("recall %.4f with %d probes and a beam of %d", met, probes, beam)
        if met >= recall:
            return found
        probes, beam = 2 * probes, 2 * beam
    LOG.info("recall stays below %.4f: all pairs are checked that the shards' radii leave", recall)
    return both(exact_pairs(rows, shards, least))


def dedup_embeddings(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, **search) -> DataFrame:
    """Links vectors of cosine least or more: id_col, n_links, component_id, kept for every row.

    Equal vectors are one class, searched once; n_links counts the other vectors (by id) of the class and of the classes
    linked with it. component_id is the smallest id reachable by links; kept says that the id is that one. Vectors that are
    null, empty, zero, or hold a null, NaN or infinite component link with nothing; those of different lengths don't link. A null
    id counts as the largest and comes back as null. Rows of one id are one vector each but count once, and hold together what each
    of them links with. Extra columns are left out.
    """
    vector = F.col(vector_col)
    own = table.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.transform(vector, lambda v: F.when(v == 0, 0.0).otherwise(v.cast("double"))).alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    valid = own.filter(F.coalesce(fine, F.lit(False)))
    # Classes have numbers of their own, since an id may have several vectors.
    classes = valid.groupBy("vector").agg(F.countDistinct("id").alias("size"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    lengths = sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect())
    pairs = None
    for size in lengths:
        part = similar_pairs(classes.filter(F.size("vector") == size).select(F.col("cls").alias("id"), "vector"), least, **search)
        pairs = part if pairs is None else pairs.union(part)
    if pairs is None:
        pairs = table.sparkSession.createDataFrame([], "a long, b long")
    members = stored(valid.join(classes.select("vector", "cls"), "vector").select("id", "cls").distinct(), "members")
    counts = link_counts(members, classes.select("cls", "size"), pairs)
    # Ids of several classes join their components.
    several = members.groupBy("id").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first < last").select("id", "first")
    bridges = members.join(several, "id").select(F.col("cls").alias("a"), F.col("first").alias("b")).filter("a <> b")
    parts = components(pairs.union(bridges)).withColumnRenamed("node", "cls")
    grouped = members.join(parts, "cls", "left").select("id", F.coalesce("component", "cls").alias("part"))
    lowest = grouped.groupBy("part").agg(F.min("id").alias("component"))
    known = grouped.join(lowest, "part").groupBy("id").agg(F.min("component").alias("component")).join(counts, "id")
    out = own.select("id").join(known, "id", "left")
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    component = F.coalesce("component", "id")
    return out.select(back("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(component != LAST, component).alias("component_id"), (F.col("id") == component).alias("kept"))


def link_counts(members: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, n): other ids in the classes of each id and in those linked with them, of members (id, cls), sizes (cls, size), pairs (a, b) both ways.

    For an id of one class that is the sum of the classes' sizes, less itself, worked out once a class. Ids of several classes are in the sums
    of several, and are counted back.
    """
    several = members.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    linked = pairs.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.sum("size").alias("around"))
    sums = sizes.join(linked.withColumnRenamed("a", "cls"), "cls", "left").select("cls", (F.col("size") + F.coalesce("around", F.lit(0)) - 1).alias("n"))
    plain = members.join(sums, "cls")
    if not several.limit(1).count():
        return plain.select("id", "n")
    several = stored(several, "several")
    own = members.join(several, "id")
    near = pairs.union(sizes.select("cls", F.col("cls").alias("b")))
    # How often an id of several classes is met from a class, beyond the first time.
    met = near.join(own.select(F.col("cls").alias("b"), F.col("id").alias("m")), "b")
    again = met.groupBy("a", "m").agg((F.count("*") - 1).alias("extra")).groupBy(F.col("a").alias("cls")).agg(F.sum("extra").alias("extra"))
    single = plain.join(several, "id", "left_anti").join(again, "cls", "left").select("id", (F.col("n") - F.coalesce("extra", F.lit(0))).alias("n"))
    around = own.select("id", F.col("cls").alias("a")).join(near, "a").select("id", F.col("b").alias("cls")).distinct().join(members.withColumnRenamed("id", "other"), "cls")
    return single.union(around.filter("id <> other").groupBy("id").agg(F.countDistinct("other").alias("n")).join(several, "id", "right").select("id", F.coalesce("n", F.lit(0)).alias("n")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN counts USING (vec_id)
"""
