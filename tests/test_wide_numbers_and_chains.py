"""FF1 of any length against plain integers, chains walked in parts, streams that go on, nested JSON."""

import hmac
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from hushlake.functions import fpe
from hushlake.functions.helpers import ENTRY, entry_key, redact_json, redacted_json
from hushlake.functions.text import redact_variant
from hushlake.operators import index, rotation
from hushlake.sources import staging
from hushlake.sources.keys import key, with_keys
from hushlake.streaming import jobs

M, S = b"M" * 32, b"S" * 32


# ---- AES and FF1 as published, with plain integers ----


def doubled(x):
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def times(a, b):
    out = 0
    while b:
        out, a, b = out ^ (a if b & 1 else 0), doubled(a), b >> 1
    return out


def substituted():
    box = []
    for x in range(256):
        inverse = next((y for y in range(256) if times(x, y) == 1), 0)
        out = 0x63
        for k in range(5):
            out ^= ((inverse << k) | (inverse >> (8 - k))) & 0xFF
        box.append(out)
    return box


BOX = substituted()


def aes(secret, block):
    n, rounds = len(secret) // 4, len(secret) // 4 + 6
    words, power = [list(secret[i : i + 4]) for i in range(0, len(secret), 4)], 1
    for i in range(n, 4 * (rounds + 1)):
        w = list(words[-1])
        if i % n == 0:
            w = [BOX[x] for x in w[1:] + w[:1]]
            w[0] ^= power
            power = doubled(power)
        elif n > 6 and i % n == 4:
            w = [BOX[x] for x in w]
        words.append([a ^ b for a, b in zip(w, words[i - n], strict=True)])
    keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(rounds + 1)]
    state = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    for r in range(1, rounds + 1):
        state = [BOX[state[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if r < rounds:
            mixed = []
            for c in range(0, 16, 4):
                col = state[c : c + 4]
                mixed += [times(col[i], 2) ^ times(col[(i + 1) % 4], 3) ^ col[(i + 2) % 4] ^ col[(i + 3) % 4] for i in range(4)]
            state = mixed
        state = [a ^ b for a, b in zip(state, keys[r], strict=True)]
    return bytes(state)


def plain_ff1(secret, radix, tweak, x):
    n, u = len(x), len(x) // 2
    v = n - u
    number = lambda digits: sum(d * radix**i for i, d in enumerate(reversed(digits)))
    b = ((radix**v - 1).bit_length() + 7) // 8
    d = 4 * -(-b // 4) + 4
    head = bytes([1, 2, 1]) + radix.to_bytes(3, "big") + bytes([10, u % 256]) + n.to_bytes(4, "big") + len(tweak).to_bytes(4, "big")
    one, two = list(x[:u]), list(x[u:])
    for i in range(10):
        q = head + tweak + bytes((-len(tweak) - b - 1) % 16) + bytes([i]) + number(two).to_bytes(b, "big")
        mac = bytes(16)
        for k in range(0, len(q), 16):
            mac = aes(secret, bytes(p ^ r for p, r in zip(mac, q[k : k + 16], strict=True)))
        s = mac
        for j in range(1, -(-d // 16)):
            s += aes(secret, (int.from_bytes(mac, "big") ^ j).to_bytes(16, "big"))
        m = u if i % 2 == 0 else v
        c = (number(one) + int.from_bytes(s[:d], "big")) % radix**m
        one, two = two, [c // radix**k % radix for k in reversed(range(m))]
    return one + two


def test_the_plain_version_gives_the_published_samples():
    secret = bytes.fromhex("2B7E151628AED2A6ABF7158809CF4F3C")
    told = lambda x: "".join("0123456789abcdefghijklmnopqrstuvwxyz"[d] for d in x)
    assert told(plain_ff1(secret, 10, b"", list(range(10)))) == "2433477484"
    assert told(plain_ff1(secret, 10, bytes.fromhex("39383736353433323130"), list(range(10)))) == "6124200773"
    assert told(plain_ff1(secret, 36, bytes.fromhex("3737373770717273373737"), list(range(19)))) == "a9tv40mll9kdu509eum"


@pytest.mark.parametrize("radix,lengths", [(2, [20, 33, 100]), (10, [6, 7, 37, 57]), (36, [19, 40]), (62, [21, 60]), (256, [3, 17, 30]), (65536, [2, 5, 25])])
def test_numerals_of_any_length_equal_plain_integers(spark, radix, lengths):
    r = random.Random(radix)
    for n in lengths:
        secret, tweak = r.randbytes(r.choice([16, 24, 32])), r.randbytes(r.choice([0, 3, 16]))
        rows = [[r.randrange(radix) for _ in range(n)] for _ in range(3)] + [[0] * n, [radix - 1] * n]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, x array<int>")
        made = df.withColumn("c", fpe.ff1_numerals(F.col("x"), F.lit(secret), n, radix, F.lit(tweak), len(tweak)))
        got = made.withColumn("back", fpe.ff1_numerals(F.col("c"), F.lit(secret), n, radix, F.lit(tweak), len(tweak), back=True)).orderBy("id").collect()
        assert [list(g.c) for g in got] == [plain_ff1(secret, radix, tweak, x) for x in rows]
        assert [list(g.back) for g in got] == rows


def test_texts_of_spark_numbers_equal_plain_integers(spark):
    r = random.Random(1)
    for alphabet, lengths in ((fpe.DIGITS, (6, 9, 16, 19, 36)), (fpe.LOWER, (5, 8, 19)), (fpe.ALNUM, (4, 8, 20))):
        for n in lengths:
            secret, tweak = r.randbytes(r.choice([16, 24, 32])), r.randbytes(r.choice([0, 6]))
            texts = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(4)]
            df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
            got = [x.c for x in df.select("id", fpe.ff1(F.col("t"), F.lit(secret), n, alphabet, F.lit(tweak), len(tweak)).alias("c")).orderBy("id").collect()]
            assert got == ["".join(alphabet[d] for d in plain_ff1(secret, len(alphabet), tweak, [alphabet.index(c) for c in t])) for t in texts]


def test_long_texts_and_odd_numerals(spark):
    secret = bytes(range(16))
    text = "0123456789" * 4
    row = spark.range(1).select(fpe.ff1(F.lit(text), F.lit(secret), 40).alias("c"), fpe.ff1(F.lit(text[:-1]), F.lit(secret), 40).alias("short"), fpe.ff1(F.lit("x" + text[1:]), F.lit(secret), 40).alias("odd")).first()
    assert row.c == "".join(map(str, plain_ff1(secret, 10, b"", list(map(int, text))))) and row.short is None and row.odd is None
    arrays = [F.array(*map(F.lit, x)) for x in ([1, 2], [70_000, 1, 1], [-1, 0, 0])]
    assert spark.range(1).select(*[fpe.ff1_numerals(a, F.lit(secret), 3, 65536) for a in arrays]).first()[:] == (None, None, None)
    for bad in ((2, 1), (5, 70_000), (4, 10)):
        with pytest.raises(ValueError):
            fpe.ff1_numerals(F.col("x"), F.lit(secret), *bad)


# ---- chains ----


def forward(spark, built, docs, steps):
    df = spark.createDataFrame(docs, "doc_id string, content string")
    out = index.forward_add(built, with_keys(df, st=M, s=S), key("st"), key("s"), anchor_steps=steps)
    return index.ForwardIndex(*[staging.stored(t) for t in (out.states, out.secure, out.aux)], out.updates, staging.stored(out.anchors))


def test_a_long_chain_is_walked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(index, "WALK_STEPS", 16)
    one = with_keys(spark.range(1).drop("id"), s=S)
    built = forward(spark, index.empty_forward(spark), [(f"d{i:03d}", "alpha" + (" beta" if i % 9 == 0 else "")) for i in range(50)], 8)
    built = forward(spark, built, [(f"e{i:03d}", "alpha gamma") for i in range(13)], 8)
    walks = index.chain_walks(built.states, built.anchors)
    alpha = sorted((r["first"], r.steps) for r in walks.filter("keyword = 'alpha'").collect())
    assert alpha == [(k, min(8, 63 - k)) for k in range(0, 63, 8)]
    parts = walks.filter("keyword = 'alpha'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    word = spark.createDataFrame([("alpha",)], "keyword string")
    plain = index.ForwardIndex(built.states, built.secure, built.aux, built.updates)
    found = lambda b: sorted(r.doc_id for r in index.forward_open(b, word, one, key("s"))[1].collect())
    assert found(built) == found(plain) == sorted([f"d{i:03d}" for i in range(50)] + [f"e{i:03d}" for i in range(13)])
    after = index.forward_open(built, word, one, key("s"))[0]
    assert {r.keyword for r in after.anchors.collect()} == {"beta", "gamma"}
    again = forward(spark, index.ForwardIndex(*[staging.stored(t) for t in (after.states, after.secure, after.aux)], 0, staging.stored(after.anchors)), [("f1", "alpha"), ("f2", "beta")], 8)
    assert set(found(again)) >= {"f1", "d000", "e000"}
    assert {(r.keyword, r.step) for r in again.anchors.filter("keyword = 'alpha'").collect()} == {("alpha", 0)}


# ---- streams ----


def drain(query_of, spark, name, tmp_path, mode="append"):
    query_of.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_a_chain_stream_goes_on_from_a_batch_index(spark, tmp_path):
    for k, v in jobs.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        docs = [(f"d{i}", "alpha beta" if i % 2 else "alpha") for i in range(8)]
        start = forward(spark, index.empty_forward(spark), docs[:5], 4)
        whole = forward(spark, index.empty_forward(spark), docs, 4)
        words = [(w, d) for d, text in docs[5:] for w in [*text.split(), "fresh"]]
        first = with_keys(spark.createDataFrame(words, "keyword string, doc_id string"), st=M)
        from hushlake.functions.prf import hmac256

        rows = first.withColumn("initial", hmac256(key("st"), F.col("keyword"))).select("keyword", "doc_id", "initial")
        rows.write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        got = {(r.keyword, r.doc_id): (r.step, r.tag) for r in drain(jobs.chain_stream(source, start.states), spark, "chains", tmp_path).collect()}
        assert [got["alpha", f"d{i}"][0] for i in (5, 6, 7)] == [5, 6, 7] and [got["beta", f"d{i}"][0] for i in (5, 7)] == [2, 3] and [got["fresh", f"d{i}"][0] for i in (5, 6, 7)] == [0, 1, 2]
        tags = {r.tag for r in whole.aux.join(start.aux, "tag", "left_anti").collect()}
        assert tags == {tag for (w, _), (_, tag) in got.items() if w != "fresh"}
    finally:
        for k in jobs.STATE_STORE:
            spark.conf.unset(k)


def test_stream_rejects_ids_that_are_stored(spark, tmp_path):
    schema = "tenant_id string, doc_id string, content string, at timestamp"
    folder = tmp_path / "in"
    paths = [str(tmp_path / x) for x in ("documents", "postings", "state")]

    def run(rows, day):
        df = spark.createDataFrame([(t, d, c) for t, d, c in rows], "tenant_id string, doc_id string, content string").withColumn("at", F.lit(f"2024-01-{day:02d}").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
        source = with_keys(spark.readStream.schema(schema).parquet(str(folder)), e=M, s=S)
        jobs.ingest_stream(source, key("e"), key("s"), "e1", "s1", "at", "1 hour", *paths).trigger(availableNow=True).start().awaitTermination()

    run([("a", "1", "alpha beta"), ("a", "2", "gamma"), ("b", "1", "delta")], 1)
    # Days later, far beyond the delay: the state has forgotten the first ids, the table has not.
    run([("a", "1", "changed words"), ("a", "3", "fresh"), ("b", "2", "fresh"), ("b", "2", "fresh")], 9)
    run([("a", "3", "again"), ("b", "3", "new")], 20)
    docs = spark.read.parquet(paths[0])
    got = sorted((r.tenant_id, r.doc_id, r["count"]) for r in docs.groupBy("tenant_id", "doc_id").count().collect())
    assert got == [("a", "1", 1), ("a", "2", 1), ("a", "3", 1), ("b", "1", 1), ("b", "2", 1), ("b", "3", 1)]
    assert docs.filter("tenant_id = 'a' AND doc_id = '1'").first().token_count == 2
    assert spark.read.parquet(paths[1]).filter("tenant_id = 'a' AND doc_id = '1'").count() == 2


# ---- nested JSON ----


def nested(r, depth):
    kind = r.choice(["object", "list", "text", "number", "null", "true"]) if depth else r.choice(["text", "number"])
    if kind == "object":
        return {name: nested(r, depth - 1) for name in r.sample(["token", "Password", "note", "list", "a", "api_key"], r.randrange(4))}
    if kind == "list":
        return [nested(r, depth - 1) for _ in range(r.randrange(4))]
    return {"text": r.choice(["plain", "mail x@y.org", "123-45-6789", "4539 1488 0343 6467", "é \"q\" \\", ""]), "number": r.choice([1, -2.5, 10**12]), "null": None, "true": True}[kind]


def test_json_by_expressions_equals_the_walk(spark):
    r = random.Random(8)
    texts = [json.dumps(nested(r, r.randrange(9))) for _ in range(150)] + ['{"token":"a","token":"b@c.org"}', "no json x@y.org", None, "", "  [1, {\"secret\": 2}]", "{broken x@y.org"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    want = {x.id: x.w for x in df.select("id", redact_json(F.col("t")).alias("w")).collect()}
    got = {x.id: x.t for x in redacted_json(df, "t", 3).collect()}

    def same(a, b):
        try:
            return json.loads(a) == json.loads(b)
        except (TypeError, ValueError):
            return a == b

    assert len(got) == len(texts) and [texts[i] for i in got if not same(got[i], want[i])] == []
    assert "Python" not in df.select(F.to_json(redact_variant(F.try_parse_json("t"))))._jdf.queryExecution().toString()


def test_plan_of_key_chains_does_not_double_with_each_round(spark):
    """Chains of 100 links, one with a gap: the result is read from storage, not joined of all rounds' joins."""
    rows = [("a", f"k{i}", f"k{i - 1}" if i else None) for i in range(100)] + [("b", f"k{i}", f"k{i - 1}") for i in range(3, 6)]
    made = rotation.key_chains(spark.createDataFrame(rows, "tenant_id string, key_id string, predecessor_key_id string"), most=4096)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert {tuple(r) for r in made.collect()} == {("a", f"k{i}", "k0", i) for i in range(100)} | {("b", f"k{i}", "k3", i - 3) for i in range(3, 6)}


# ---- many rows of FF1 ----


def test_rows_of_several_keys_and_tweaks_equal_plain_integers(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(fpe.DIGITS) for _ in range(n)), bytes([i % 3]) * 16, bytes([i % 4]) * 5) for i, n in enumerate([7, 12, 45] * 8)]
    odd = [(100, "1234567", None, b"tweak"), (101, "1234567", b"k" * 16, b"short"[:4]), (102, "1234567", b"k" * 16, None), (103, None, b"k" * 16, b"tweak"), (104, "123456789", b"k" * 16, b"tweak"), (105, "12\U0001f40045678", b"k" * 16, b"tweak")]
    df = spark.createDataFrame(rows + odd, "id int, t string, k binary, w binary").repartition(2)
    made = df.withColumn("c", fpe.ff1_any(F.col("t"), F.col("k"), (7, 12, 45), tweak=F.col("w"), tweak_length=5))
    got = {x.id: x.c for x in made.collect()}
    assert [got[i] for i, *_ in rows] == ["".join(map(str, plain_ff1(k, 10, w, list(map(int, t))))) for _, t, k, w in rows]
    assert [got[i] for i, *_ in odd] == [None] * 6


def test_many_long_texts_take_seconds(spark):
    """One task's work on 20,000 texts of 45 digits, which took it over a minute by array expressions."""
    text = F.lpad(F.col("id").cast("string"), 45, "0")
    rows = spark.range(20_000, numPartitions=1).select(text.alias("t"))
    began = time.time()
    made = rows.withColumn("c", fpe.ff1(F.col("t"), F.lit(bytes(32)), 45)).agg(F.countDistinct("c").alias("n"), F.count_if(F.col("c") == F.col("t")).alias("same")).first()
    assert tuple(made) == (20_000, 0) and time.time() - began < 30


def test_plan_of_a_forward_index_stays_small(spark):
    """What is read again is stored: in strong mode the plan of the statistics held those of the chains many times over."""
    docs = spark.createDataFrame([("d1", "alpha beta gamma"), ("d2", "beta delta"), ("d3", "")], "doc_id string, content string")
    rows, one = with_keys(docs, st=M, s=S), with_keys(spark.range(1).drop("id"), s=S)
    built = index.forward_update(index.empty_forward(spark), rows, key("st"), one, key("s"), "strong", threshold=1)
    told = index.index_statistics(built, docs)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 8 and "explode" not in plan
    assert told.select("secure_entries", "auxiliary_entries", "keywords").first()[:] == (5, 0, 4)


def test_keys_of_entries_are_hmacs(spark):
    r = random.Random(9)
    states = [bytes(32), b"\xff" * 32, b"\x80" + bytes(31), *(r.randbytes(32) for _ in range(50))]
    df = spark.createDataFrame([(i, s, r.randbytes(32)) for i, s in enumerate(states)], "id int, state binary, salt binary")
    for x in df.withColumn("k", entry_key(F.col("state"), F.col("salt"))).collect():
        assert x.k == hmac.new(bytes(x.state), ENTRY + bytes(x.salt), "sha256").digest()
