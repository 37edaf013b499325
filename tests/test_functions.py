"""Expressions against hmac, hashlib, published vectors and plain Python."""

import hashlib
import hmac
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushlake.functions import fpe, order, tokens
from hushlake.functions.helpers import redact_json, spend, throttle, unicode_normalize
from hushlake.functions.prf import hmac256, uniform
from hushlake.functions.text import keywords, query_keywords, redact, redact_fields
from hushlake.sources.keys import derived, key, with_keys, without_keys

K = b"K" * 32


def column(spark, values, kind="string"):
    return with_keys(spark.createDataFrame([(v,) for v in values], f"v {kind}"), k=K)


def test_hmac_equals_python_and_keys_stay_out_of_plans(spark):
    texts = ["", "what do ya want for nothing?", "é" * 100, None]
    df = column(spark, texts).select("v", hmac256(key("k"), F.col("v")).alias("h"))
    for r in df.collect():
        assert r.h is None if r.v is None else bytes(r.h) == hmac.new(K, r.v.encode(), hashlib.sha256).digest()
    plan = df._jdf.queryExecution().toString()
    assert "KKKK" not in plan and K.hex().upper() not in plan.upper()


def test_rfc4231(spark):
    jefe = with_keys(spark.range(1), k=b"Jefe").select(F.hex(hmac256(key("k"), F.lit("what do ya want for nothing?")))).first()[0]
    assert jefe.lower() == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    long = with_keys(spark.range(1), k=b"\xaa" * 131).select(F.hex(hmac256(key("k"), F.lit("Test Using Larger Than Block-Size Key - Hash Key First")))).first()[0]
    assert long.lower() == "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"


def test_uniform_in_range(spark):
    x = with_keys(spark.range(2000), k=K).select(uniform(key("k"), F.col("id")).alias("u")).toPandas().u
    assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.03


def test_keywords_keep_the_rule_before_the_strip(spark):
    rows = [("The risk, the, it, ... a an and fraud!",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(keywords(F.col("t"))).collect()]
    assert set(got[0]) == {"risk", "the", "it", "", "fraud"} and got[1] is None and got[2] == []
    assert spark.range(1).select(query_keywords(F.lit(" The "))).first()[0] == ["the"]


def test_redaction(spark):
    text = "card 4111 1111 1111 1111 ssn 123-45-6789 mail a.b@c.org key " + "Ab1" * 14
    assert spark.range(1).select(redact(F.lit(text))).first()[0] == "card [REDACTED_CARD] ssn [REDACTED_SSN] mail [REDACTED_EMAIL] key [REDACTED_KEY]"
    m = spark.range(1).select(redact_fields(F.create_map(F.lit("Password"), F.lit("x"), F.lit("note"), F.lit("a@b.org")))).first()[0]
    assert m == {"Password": "[REDACTED]", "note": "[REDACTED_EMAIL]"}
    got = spark.createDataFrame([('{"a":{"token":"t","list":[{"secret":1},"x@y.org"]}}',), ("no json a@b.org",), (None,)], "t string").select(redact_json(F.col("t"))).collect()
    assert got[0][0] == '{"a": {"token": "[REDACTED]", "list": [{"secret": "[REDACTED]"}, "[REDACTED_EMAIL]"]}}' and got[1][0] == "no json [REDACTED_EMAIL]" and got[2][0] is None


def test_normal_form(spark):
    got = [r[0] for r in spark.createDataFrame([("ﬁn",), ("abc",), (None,)], "t string").select(unicode_normalize(F.col("t"))).collect()]
    assert got == ["fin", "abc", None]


def test_blind_index(spark):
    config = tokens.BlindIndex("email")
    df = column(spark, [" Alice@Example.com ", "alice@example.com", "bob@example.com", None]).withColumn("i", tokens.blind_index(F.col("v"), key("k"), config))
    got = [r.i for r in df.collect()]
    assert got[0] == got[1] != got[2] and got[3] is None
    import base64

    assert got[1] == base64.b64encode(hmac.new(K, b"alice@example.com", hashlib.sha256).digest()[:16]).decode()
    assert [r[0] for r in df.select(tokens.blind_matches(F.lit("ALICE@example.com"), F.col("i"), key("k"), config)).collect()] == [True, True, False, False]


def test_aes_roundtrip_wrong_key_and_tampering(spark):
    df = with_keys(column(spark, ["secret", "", "ü" * 50]), o=b"O" * 32).withColumn("b", tokens.encrypt(F.col("v"), key("k").raw))
    rows = df.select("v", tokens.decrypt(F.col("b"), key("k").raw).cast("string").alias("p"), tokens.try_decrypt(F.col("b"), key("o").raw).alias("w"), tokens.try_decrypt(F.concat("b", F.lit(b"x")), key("k").raw).alias("t")).collect()
    assert all(r.v == r.p and r.w is None and r.t is None for r in rows)


def test_versioned_blobs(spark):
    df = spark.createDataFrame([("key_1", b"abc"), ("key_2", b"")], "k string, b binary").withColumn("w", tokens.wrap(F.col("b"), F.col("k")))
    for r in df.select("k", "b", "w", tokens.is_versioned(F.col("w")).alias("v"), tokens.unwrap(F.col("w")).alias("u"), tokens.blob_key_hash(F.col("w")).alias("h"), tokens.is_versioned(F.col("b")).alias("n")).collect():
        assert r.v and bytes(r.u) == bytes(r.b) and bytes(r.h) == hashlib.sha256(r.k.encode()).digest()[:4] and not r.n
        assert bytes(r.w[:2]) == b"\xeb\x01"


def plain_ope(x):
    p, most, full = int.from_bytes(hmac.new(K, struct.pack(">Q", x), hashlib.sha256).digest()[:8], "big"), 2**32 - 1, 2**64 - 1
    return min(x * full // most + p % max(1, full // (most * 10)), full)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=20, max_size=20))
def test_order_of_ciphertexts(spark, values):
    df = with_keys(column(spark, values, "long"), **order.ore_keys(K)).withColumn("i", F.monotonically_increasing_id())
    rows = df.select("v", order.ope_encrypt(F.col("v"), key("k")).alias("ope"), order.ore_encrypt(F.col("v"), key("ore_left"), key("ore_right")).alias("ore"), order.ope_decrypt_open(order.ope_encrypt(F.col("v"), key("k"))).alias("back"))
    got = rows.collect()
    assert all(int(r.ope) == plain_ope(r.v) and r.back == r.v and len(r.ore) == 42 for r in got)
    pairs = spark.createDataFrame([(bytes(a.ore), bytes(b.ore), (a.v > b.v) - (a.v < b.v)) for a, b in zip(got, got[1:])], "a binary, b binary, want int")
    assert all(r.got == r.want for r in pairs.select("want", order.ore_compare(F.col("a"), F.col("b")).alias("got")).collect())


def test_ore_of_other_key_or_form_fails(spark):
    one = with_keys(spark.range(1), **order.ore_keys(K)).select(order.ore_encrypt(F.lit(5).cast("long"), key("ore_left"), key("ore_right"))).first()[0]
    two = with_keys(spark.range(1), **order.ore_keys(b"L" * 32)).select(order.ore_encrypt(F.lit(5).cast("long"), key("ore_left"), key("ore_right"))).first()[0]
    for other in (two, one[:-1], b"\x02" + bytes(one[1:])):
        with pytest.raises(Exception):
            spark.createDataFrame([(bytes(one), bytes(other))], "a binary, b binary").select(order.ore_compare(F.col("a"), F.col("b"))).collect()


def test_amounts_are_cut_and_checked(spark):
    df = spark.createDataFrame([(19.99,), (0.0,), (-0.001,), (5e9,), (None,)], "a double")
    assert [r[0] for r in df.select(order.scaled(F.col("a"), on_invalid="null")).collect()] == [1998, 0, None, None, None]
    with pytest.raises(Exception):
        df.select(order.scaled(F.col("a"))).collect()


def test_ff1_published_samples(spark):
    k = bytes.fromhex("2B7E151628AED2A6ABF7158809CF4F3C")
    df = with_keys(spark.range(1), k=k)
    digits, text = F.lit("0123456789"), F.lit("0123456789abcdefghi")
    got = df.select(
        fpe.ff1(digits, key("k").raw, 10),
        fpe.ff1(digits, key("k").raw, 10, tweak=F.lit(bytes.fromhex("39383736353433323130")), tweak_length=10),
        fpe.ff1(text, key("k").raw, 19, fpe.LOWER, tweak=F.lit(bytes.fromhex("3737373770717273373737")), tweak_length=11),
        fpe.ff1(fpe.ff1(digits, key("k").raw, 10), key("k").raw, 10, back=True),
        fpe.ff1(F.lit("12x4567890"), key("k").raw, 10),
    ).first()
    assert list(got) == ["2433477484", "6124200773", "a9tv40mll9kdu509eum", "0123456789", None]
    with pytest.raises(ValueError):
        fpe.ff1(digits, key("k").raw, 5)


def test_folds():
    assert [r[0] for r in spend(iter([(0.5, 1.0), (0.6, 1.0), (0.5, 1.0), (0.1, 1.0)]))] == [True, False, True, False]
    seen = []
    assert list(throttle(iter([0.0, 1.0, 2.0, 10.0, 10.5]), 2, 10, seen)) == [(True, 0), (True, 0), (False, 9), (True, 0), (False, 1)]


def test_derived_key_depends_on_tenant():
    assert derived(K, "a:f") != derived(K, "b:f")


def test_deterministic_cipher(spark):
    df = column(spark, ["x", "x", "y"]).withColumn("c", tokens.encrypt_fixed(F.col("v"), key("k")))
    a, b, c = (bytes(r.c) for r in without_keys(df).collect())
    assert a == b != c


def test_no_unversioned_blob_looks_versioned(spark):
    """Of 2,000,000 random beginnings some 30 would be the mark of versioned blobs."""
    key = F.lit(b"K" * 32)
    made = spark.range(2_000_000, numPartitions=4).select("id", tokens.encrypt(F.col("id").cast("string"), key).alias("b"))
    turned = F.substring("b", 1, 2) == F.lit(bytes([tokens.MAGIC[0] ^ 0x80, tokens.MAGIC[1]]))
    opens = tokens.decrypt(F.col("b"), key).cast("string") == F.col("id").cast("string")
    got = made.agg(F.count_if(tokens.is_versioned(F.col("b"))).alias("marked"), F.count_if(turned).alias("turned"), F.count_if(opens).alias("opened")).first()
    assert (got.marked, got.opened) == (0, 2_000_000) and got.turned > 0
