"""Repeated words of an item, and ids with several vectors."""

from __future__ import annotations

import math
import random
from collections import defaultdict

from hushlake.llm.decontaminate import find_leaks
from hushlake.llm.embedding_dedup import dedup_embeddings


def test_a_repeated_part_of_an_item_counts_once(spark):
    item = " ".join(f"alpha{i}" for i in range(30))
    part = " ".join(item.split()[:11])
    docs = [(1, part), (2, f"{part} other words here {part}"), (3, "\n".join([part] * 3)), (4, f"{part} x {' '.join(item.split()[15:26])}"), (5, item)]
    got = {r.doc_id: r for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert set(got) == {4, 5}
    assert (got[4].n_words, got[4].longest) == (22, 11) and got[5].n_words == 30
    # Overlapping runs with other shifts count their union.
    own = item.split()
    both = " ".join(own[:12] + ["gap"] + own[6:20])
    row = find_leaks(spark.createDataFrame([(1, both)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert (row.n_words, row.longest) == (20, 14)


def plain_links(rows, least=0.9):
    fine = [(i, v) for i, v in rows if v and any(v)]
    linked = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) >= least
    near = defaultdict(set)
    for i, a in fine:
        for j, b in fine:
            if i != j and linked(a, b):
                near[i].add(j)
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]), min(seen), i == min(seen))
    return out


def test_ids_with_several_vectors_hold_together_what_each_links(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.98, 0.1]
    table = spark.createDataFrame([(5, a), (6, a), (5, b), (7, c)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in dedup_embeddings(table).collect()}
    assert got == {5: (2, 5), 6: (1, 5), 7: (1, 5)}


def test_links_of_repeated_ids_equal_plain(spark):
    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(4)] for _ in range(5)]
    rows = [(r.randrange(50), [x + r.gauss(0, 0.25) for x in base[k % 5]] if k % 7 else base[k % 5]) for k in range(90)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == plain_links(rows)


def test_merged_lists_find_all_partners_and_touch_few_entries():
    import numpy as np
    import pyarrow as pa

    from hushlake.llm.ngram_jaccard import Inverted, least_overlap

    r = np.random.default_rng(5)
    percent, base = 80, [r.choice(4000, 60, replace=False) for _ in range(40)]
    sets = []
    for k in range(600):
        own = set(base[k % 40].tolist())
        for _ in range(r.integers(0, 9)):
            own.discard(int(r.choice(sorted(own))))
            own.add(int(r.integers(4000)))
        sets.append(np.array(sorted(own)))
    often = np.bincount(np.concatenate(sets), minlength=4000)
    short = []
    for own in sets:
        take = len(own) - least_overlap(len(own), percent) + 1
        short.append(own[np.lexsort((own, often[own]))][:take])
    group = np.arange(600) % 7
    lists = Inverted(np.arange(600), np.array([len(x) for x in sets]), group, pa.array([x.tolist() for x in short], pa.list_(pa.int64())))
    got = {(x, y) for x in range(600) for y, _ in lists.partners(x, len(sets[x]), int(group[x]), short[x], percent)}
    true = {(x, y) for x in range(600) for y in range(600) if group[x] != group[y] and 100 * len(np.intersect1d(sets[x], sets[y])) >= percent * len(np.union1d(sets[x], sets[y]))}
    assert true and true <= got
    assert lists.touched < 600 * 600 / 4


def test_shards_by_shuffled_centers_are_those_by_broadcast(spark, monkeypatch):
    import numpy as np

    from hushlake.llm import embedding_dedup as e

    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=6) + 3 * np.eye(6)[i % 6]).tolist()) for i in range(300)] + [(300 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(60)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<double>")
    few = e.Shards(df, 12, 5)
    assert len(few.levels) > 1
    placed = {(x.shard, x.id) for x in few.placed(df, 3).collect()}
    by = {}
    for shard, i in placed:
        by.setdefault(i, set()).add(shard)
    assert all(1 <= len(v) <= 3 for v in by.values()) and len(by) == 360
    want = {tuple(x) for x in e.exact_pairs(df, few, 0.9).collect()}
    monkeypatch.setattr(e, "BROADCAST_CENTERS", 0)
    monkeypatch.setattr(e, "ROUTED", 50)
    assert {(x.shard, x.id) for x in few.placed(df, 3).collect()} == placed
    assert {tuple(x) for x in e.exact_pairs(df, few, 0.9).collect()} == want
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert want == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a != b}


def test_the_forest_judges_a_corpus_without_findings(spark):
    import hashlib

    from hushlake.llm.secrets import made_findings, scan_secrets

    digest = lambda k, n=40: hashlib.sha256(str(k).encode()).hexdigest()[:n]
    prose = "they went home early that day and the page was read twice"
    good = [f'{prose} token = "{digest(k)}" and {prose}' for k in range(20)] + [f"{prose} key AKIA{digest(k, 16).upper()} {prose}" for k in range(5)] + [f"{prose} password: Zx{digest(k, 12)}QpL9 {prose}" for k in range(5)]
    bad = [f"{prose} commit {digest(k)} {prose}" for k in range(10)] + [f"{prose} see handlerConfigSession{k} {prose}" for k in range(10)] + [f"{prose} uuid {digest(k, 8)}-{digest(k, 4)}-4{digest(k, 3)}-8{digest(k, 3)}-{digest(k, 12)} {prose}" for k in range(10)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = scan_secrets(docs.withColumn("source", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("src1"))).collect()
    assert {r.doc_id for r in got if r.is_secret} == set(range(30)) and {r.doc_id for r in got} >= set(range(55))
    assert len({r.score for r in got}) > 2
    # Only secrets, as in a clean corpus with planted keys: the forest is there all the same.
    only = scan_secrets(docs.filter("doc_id < 20"), path_col=None).collect()
    assert all(r.is_secret for r in only) and {r.score for r in only} - {0.5, 1.0}
    made = made_findings(spark, 400)
    assert made.collect() == made_findings(spark, 400).collect() and made.filter("label = 1").count() == 200
