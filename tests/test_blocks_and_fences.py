"""Ranked search over blocks and order by fences, against plain Python, with what they read."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hushlake.functions.order import ore_encrypt, ore_keys, ore_of_one
from hushlake.operators import blocks, fences
from hushlake.sources import staging
from hushlake.sources.keys import key, with_keys, without_keys

M, N = b"M" * 32, b"N" * 32


def corpus(seed, docs=400):
    r = random.Random(seed)
    rows = []
    for i in range(docs):
        tenant = r.choice(["a", "a", "a", "b"])
        for token, share in (("hot", 0.5), ("warm", 0.45), ("mild", 0.1), ("rare", 0.01), (f"own{i}", 1.0)):
            if r.random() < share:
                rows.append((tenant, token, f"d{i:04d}"))
    return rows


def plain_top(rows, asked, limit):
    docs = defaultdict(set)
    for tenant, token, doc in rows:
        docs[tenant, doc].add(token)
    out = set()
    for q, tenant, words in asked:
        scored = sorted((-len(own & words), doc) for (t, doc), own in docs.items() if t == tenant and own & words)
        out |= {(q, tenant, doc, -s, k + 1) for k, (s, doc) in enumerate(scored[:limit])}
    return out


@pytest.mark.parametrize("size,limit", [(8, 5), (16, 10), (1024, 3)])
def test_block_search_equals_plain(spark, tmp_path, size, limit):
    rows = corpus(size)
    asked = [(q, t, w) for q, w in (("q1", {"hot", "warm"}), ("q2", {"hot", "rare", "mild"}), ("q3", {"rare"}), ("q4", {"none"}), ("q5", {"own7", "hot"})) for t in ("a", "b", "c")]
    path = str(tmp_path / "blocks")
    blocks.write_blocks(blocks.build_blocks(spark.createDataFrame(rows + rows[:3], "tenant_id string, token string, doc_id string").repartition(5), size), path)
    tokens = spark.createDataFrame([(q, t, x, x, len(w)) for q, t, w in asked for x in w], "query_id string, tenant_id string, keyword string, token string, needed int")
    got = blocks.top_by_blocks(spark.read.parquet(path), tokens, limit)
    assert {tuple(r) for r in got.hits.select("query_id", "tenant_id", "doc_id", "score", "rank").collect()} == plain_top(rows, asked, limit)
    made = spark.read.parquet(path)
    assert made.filter(F.col("n") > size).count() == 0 and made.filter((F.col("n") != F.size("docs")) | (F.col("first_doc") > F.col("last_doc"))).count() == 0


def test_frequent_words_read_few_blocks(spark, tmp_path):
    rows = corpus(5, 3000)
    path = str(tmp_path / "blocks")
    blocks.write_blocks(blocks.build_blocks(spark.createDataFrame(rows, "tenant_id string, token string, doc_id string"), 32), path)
    tokens = spark.createDataFrame([("q", "a", x, x, 2) for x in ("hot", "warm")], "query_id string, tenant_id string, keyword string, token string, needed int")
    work = blocks.top_by_blocks(spark.read.parquet(path), tokens, 10).work.first()
    assert work.postings_read < 0.1 * work.postings_held
    assert blocks.top_by_blocks(spark.read.parquet(path), tokens.limit(0), 10).hits.count() == 0


def ciphers(spark, values, secret=M):
    rows = with_keys(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long"), **ore_keys(secret))
    return staging.stored(without_keys(rows.withColumn("ore", ore_encrypt(F.col("v"), key("ore_left"), key("ore_right")))))


def values(seed, n=700):
    r = random.Random(seed)
    return [r.choice([r.randrange(2**32), r.randrange(1000), 255, 256, 2**32 - 1, 0, 65_536 * r.randrange(5)]) for _ in range(n)]


@pytest.mark.parametrize("count", [1, 7, 64])
def test_fences_cut_and_order_as_plain_values(spark, count):
    v = values(count)
    rows = ciphers(spark, v)
    found = fences.fit_fences(rows, fences=count)
    plain = {bytes(r.ore): r.v for r in rows.collect()}
    cut = [plain[f] for f in found]
    assert cut == sorted(set(cut)) and 0 < len(cut) <= count
    for r in rows.select("v", fences.interval(F.col("ore"), found).alias("i")).collect():
        assert r.i == sum(c <= r.v for c in cut)
    got = {r.id: r.place for r in fences.global_order(rows, found, "id").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(len(v)), key=lambda i: (v[i], i))


def test_range_by_fences_reads_few_files(spark, tmp_path):
    r = random.Random(9)
    v = [r.randrange(10**6) for _ in range(3000)] + [77] * 300
    rows = ciphers(spark, v).union(spark.createDataFrame([(9999, None, None)], "id long, v long, ore binary"))
    found = fences.fit_fences(rows, fences=40)
    path = str(tmp_path / "rows")
    fences.write_by_interval(rows, found, path)
    for low, high in ((400_000, 500_000), (None, 77), (77, 77), (999_000, None), (None, None), (600_000, 500_000)):
        got = fences.read_range(spark, path, found, None if low is None else ore_of_one(low, M), None if high is None else ore_of_one(high, M))
        want = sorted(i for i, x in enumerate(v) if (low is None or x >= low) and (high is None or x <= high))
        assert sorted(r.id for r in got.collect()) == want
    got = fences.read_range(spark, path, found, ore_of_one(400_000, M), ore_of_one(500_000, M))
    files = lambda df: df.select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert files(got) < 0.25 * files(spark.read.parquet(path))
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan


def test_fences_refuse_other_keys_and_malformed_ciphertexts(spark):
    rows = ciphers(spark, [1, 2, 3])
    found = fences.fit_fences(rows, fences=2)
    with pytest.raises(ValueError, match="different keys"):
        fences.places([ore_of_one(5, N)], fences.parts(found))
    with pytest.raises(ValueError, match="malformed"):
        fences.parts([b"short"])
    assert fences.fit_fences(rows.limit(0)) == [] and fences.global_order(rows.limit(0), [], "id").count() == 0
    assert Counter(r.i for r in rows.select(fences.interval(F.col("ore"), []).alias("i")).collect()) == {0: 3}


def test_blocks_of_dealt_documents_need_no_shuffle_of_tokens(spark):
    docs = spark.createDataFrame([(f"t{i % 2}", f"{i:03}", f"w{i % 7} w{i % 3} common") for i in range(90)], "tenant_id string, doc_id string, content string")
    tokens = lambda df: df.selectExpr("tenant_id", "explode(split(content, ' ')) AS token", "doc_id")
    dealt = blocks.build_blocks(tokens(blocks.by_document(docs)), 32, dealt=True)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.index("Generate") < plan.index("RepartitionByExpression") and "Aggregate" not in plan
    got = dealt.selectExpr("tenant_id", "token", "explode(docs) AS doc_id").collect()
    assert sorted(map(tuple, got)) == sorted({tuple(r) for r in tokens(docs).collect()})
    assert all(r.n == len(r.docs) <= 32 and list(r.docs) == sorted(r.docs) and (r.first_doc, r.last_doc) == (r.docs[0], r.docs[-1]) for r in dealt.collect())
