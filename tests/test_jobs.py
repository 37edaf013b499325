"""Jobs: index upkeep, rotation, tables, private and masked aggregates, limits."""

import math

import pytest
from pyspark.sql import functions as F

from hushlake.functions.tokens import encrypt, keyword_token, wrap
from hushlake.operators import index, masked, observe, privacy, rotation, search
from hushlake.sources import staging, tables
from hushlake.sources.keys import derived, key, with_keys, with_tenant_keys, without_keys, key_rows

S, M, N = b"S" * 32, b"M" * 32, b"N" * 32


def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def docs(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, doc_id string, content string")


def test_search_of_one_tenant_and_after_key_rotation(spark):
    d = docs(spark, [("a", "1", "fraud risk controls"), ("a", "2", "fraud only here"), ("b", "3", "fraud risk controls"), ("a", "4", ""), ("a", "5", None)])
    old = key_rows(spark, {"a": {"s": S}, "b": {"s": derived(S, "b")}})
    new = key_rows(spark, {"a": {"s": N}})
    posted = without_keys(search.build_postings(with_tenant_keys(d.filter("doc_id <> '2'"), old), key("s"))).union(without_keys(search.build_postings(with_tenant_keys(d.filter("doc_id = '2'"), new), key("s"))))
    asked = spark.createDataFrame([("q", "a", "fraud risk"), ("p", "b", "FRAUD")], "query_id string, tenant_id string, query string")
    rows = search.query_tokens(with_tenant_keys(asked, old.union(new)), key("s"))
    got = {(r.query_id, r.doc_id): r.score for r in search.score(posted, rows).collect()}
    assert got == {("q", "1"): 2, ("q", "2"): 1, ("p", "3"): 1}
    assert [(r.query_id, r.doc_id) for r in search.score(posted, rows, "all").filter("query_id = 'q'").collect()] == [("q", "1")]


def test_boolean_needs_two_operands():
    with pytest.raises(ValueError):
        search.Bool("AND", ("a",))
    with pytest.raises(ValueError):
        search.Bool("XOR", ("a", "b"))


def test_boolean_on_arrays(spark):
    d = with_keys(docs(spark, [("a", "1", "alpha beta"), ("a", "2", "gamma delta"), ("a", "3", "alpha delta")]), s=S).withColumn("tokens", search.token_array(F.col("content"), key("s")))
    tree = search.Bool("OR", (search.Bool("AND", ("Alpha", "beta")), search.Bool("AND", ("gamma", "delta"))))
    assert {r.doc_id for r in d.filter(tree.on_array(F.col("tokens"), key("s"))).collect()} == {"1", "2"}


def test_delete_and_soft_delete(spark):
    d = with_keys(docs(spark, [("a", "1", "one two three"), ("a", "2", "four five six")]), e=M, s=S)
    made, posted = index.ingest(d, key("e"), key("s"), "k", "s", as_of())
    made, posted = staging.stored(made), staging.stored(posted)
    gone = spark.createDataFrame([("a", "1"), ("a", "9")], "tenant_id string, doc_id string")
    left, rest, report = index.delete(made, posted, gone)
    assert [r.doc_id for r in left.collect()] == ["2"] and {r.doc_id for r in rest.collect()} == {"2"}
    assert {r.doc_id: r.existed for r in report.collect()} == {"1": True, "9": False}
    assert {r.doc_id: r.deleted for r in index.delete(made, posted, gone, soft=True)[0].collect()} == {"1": True, "2": False}


def test_forward_index_moves_entries_and_renews_states(spark):
    one = with_keys(spark.range(1).drop("id"), s=S)
    d = spark.createDataFrame([("d1", "alpha beta"), ("d2", "alpha gamma"), ("d3", "delta")], "doc_id string, content string")
    built = index.forward_update(index.empty_forward(spark), with_keys(d, st=M, s=S), key("st"), one, key("s"), "balanced")
    assert built.updates == 5
    built = index.ForwardIndex(*[staging.stored(t) for t in (built.states, built.secure, built.aux)], built.updates)
    word = spark.createDataFrame([("Alpha",)], "keyword string")
    after, found = index.forward_open(built, word, one, key("s"))
    after = index.ForwardIndex(*[staging.stored(t) for t in (after.states, after.secure, after.aux)], after.updates)
    assert {r.doc_id for r in found.collect()} == {"d1", "d2"}
    assert after.secure.count() == 2 and after.aux.count() == 3
    states = {r.keyword: r.counter for r in after.states.collect()}
    assert states["alpha"] == 0 and states["beta"] == 1
    more = index.forward_update(after, with_keys(spark.createDataFrame([("d4", "alpha")], "doc_id string, content string"), st=M, s=S), key("st"), one, key("s"), "balanced")
    assert {r.doc_id for r in index.forward_open(more, word, one, key("s"))[1].collect()} == {"d1", "d2", "d4"}
    strong = index.forward_update(after, with_keys(d, st=M, s=S), key("st"), one, key("s"), "strong", threshold=3)
    assert strong.updates == 0 and strong.aux.count() == 0
    off = index.forward_update(index.empty_forward(spark), with_keys(d, st=M, s=S), key("st"), one, key("s"), "off")
    assert off.secure.count() == 5 and off.aux.count() == 0


def key_table(spark):
    rows = [("t", "k1", "data", "retired", False, None, 1), ("t", "k2", "data", "active", True, "k1", 2), ("t", "k3", "data", "active", True, "gone", 1)]
    df = spark.createDataFrame(rows, "tenant_id string, key_id string, key_type string, lifecycle_state string, active boolean, predecessor_key_id string, version int")
    at = F.lit("2024-01-01").cast("timestamp")
    return df.withColumns({"created_at": at, "last_rotated": F.lit(None).cast("timestamp"), "rotation_period_days": F.lit(90), "retention_expires_at": F.lit(None).cast("timestamp"), "compromise_detected_at": F.lit(None).cast("timestamp"), "updated_at": at})


def test_chain_rotation_and_rollback(spark):
    keys = key_table(spark)
    assert {r.key_id: (r.root, r.position) for r in rotation.key_chains(keys).collect()} == {"k1": ("k1", 0), "k2": ("k1", 1), "k3": ("k3", 0)}
    after = rotation.rotated_keys(keys, "k2", "k4", as_of())
    state = {r.key_id: (r.lifecycle_state, r.active, r.version, r.predecessor_key_id) for r in after.collect()}
    assert state["k2"][:2] == ("retired", False) and state["k4"] == ("active", True, 3, "k2")
    bad = {r.key_id: r for r in rotation.rotated_keys(keys, "k2", "k4", as_of(), emergency=True).collect()}
    assert bad["k2"].compromise_detected_at is not None and bad["k4"].compromise_detected_at is None
    back = {r.key_id: (r.lifecycle_state, r.active) for r in rotation.rolled_back(after, "k2", "k4").collect()}
    assert back["k2"] == ("active", True) and back["k4"] == ("retired", False)
    links = lambda table: {r.key_id: (r.predecessor_key_id, r.successor_key_id) for r in table.collect()}
    assert links(after)["k2"] == ("k1", "k4") and links(after)["k4"] == ("k2", None)
    assert links(rotation.rolled_back(after, "k2", "k4"))["k2"] == ("k1", None)
    failed = {r.key_id: (r.lifecycle_state, r.active) for r in rotation.rotated_keys(keys, "k2", "k4", as_of(), failed=True).collect()}
    assert failed["k2"] == ("rotating", True)
    assert rotation.usable(keys, active=True, key_type="data", decryption=True).count() == 2
    newer = keys.filter("key_id = 'k1'").withColumns({"updated_at": as_of(), "version": F.lit(9)})
    assert {r.key_id: r.version for r in rotation.latest_keys(keys, newer).collect()} == {"k1": 9, "k2": 2, "k3": 1}


def test_reencryption_counts_failures(spark):
    keys = spark.createDataFrame([("k1", M), ("k2", N)], "key_id string, key binary")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").withColumn("blob", wrap(encrypt(F.col("v"), F.lit(M)), F.lit("k1")))
    mixed = rows.union(spark.createDataFrame([(3, "c", b"no blob")], "id long, v string, blob binary"))
    done = rotation.progress(rotation.reencrypt(mixed, keys, "k2")).first()
    assert (done.total, done.completed, done.failed, done.percent, done.status) == (3, 2, 1, pytest.approx(200 / 3), "completed")
    nothing = rotation.progress(rotation.reencrypt(mixed.filter("id = 3"), keys, "k2"))
    assert nothing.first().status == "failed"
    assert rotation.progress(rotation.reencrypt(mixed.filter("id = 3"), keys, "k2"), emergency=True).first().status == "completed"
    assert rotation.progress(rotation.reencrypt(mixed.filter("id > 9"), keys, "k2")).first().percent == 100.0


def test_tables_roundtrip(spark, tmp_path):
    posted = spark.createDataFrame([("a", "t1", "1"), ("b", "t2", "2")], tables.POSTINGS)
    tables.write_table(posted, str(tmp_path / "p"))
    assert [r.doc_id for r in tables.read_table(spark, str(tmp_path / "p"), tables.POSTINGS, "a").collect()] == ["1"]
    rows = [(i, "a", f"k{i % 2}", ("key.access", "u", True, "r", {"x": "y"}, "q"), None) for i in range(6)]
    tables.append_audit(spark.createDataFrame(rows, tables.AUDIT), str(tmp_path / "audit"))
    assert [r.id for r in tables.read_audit(spark, str(tmp_path / "audit"), key_id="k1", tenant="a", limit=2).collect()] == [5, 3]
    stored = spark.createDataFrame([("a", "k", b"x", '{"key_type":"data","version":3}', None)], tables.KEYS)
    assert tables.load_keys(stored, "a").first().version == 3


def test_noise_has_the_right_spread(spark):
    rows = with_keys(spark.range(50_000).select(F.col("id").cast("string").alias("g"), F.lit(100).alias("true_count"), F.lit(100.0).alias("true_sum")), n=N)
    x = privacy.private_count(rows, key("n"), "q", ["g"], 0.5).toPandas().noisy_count
    assert abs(x.mean() - 100) < 0.1 and abs(x.var() / privacy.laplace_variance(1, 0.5) - 1) < 0.05
    y = privacy.private_sum(rows, key("n"), "q", ["g"], 1, 0.5, 1e-5).toPandas().noisy_sum
    assert abs(y.mean() - 100) < 0.3 and abs(y.var() / privacy.gaussian_variance(1, 0.5, 1e-5) - 1) < 0.05
    for bad in [(0, 1), (1, 0), (-1, 1)]:
        with pytest.raises(ValueError):
            privacy.laplace(F.lit(0.5), *bad)


def test_selection_prefers_the_useful(spark):
    rows = with_keys(spark.range(3000).select(F.col("id").cast("string").alias("g"), F.explode(F.array(F.struct(F.lit("a").alias("candidate"), F.lit(10.0).alias("utility")), F.struct(F.lit("b").alias("candidate"), F.lit(6.0).alias("utility")))).alias("x")).select("g", "x.*"), n=N)
    share = privacy.private_selection(rows, key("n"), "q", ["g"], 1.0, 1.0).filter("selected = 'a'").count() / 3000
    assert abs(share - math.exp(2) / (math.exp(2) + 1)) < 0.03


def test_budget_state_over_batches(spark):
    rows = spark.createDataFrame([("t", i, 0.5, 10.0) for i in range(21)] + [("u", 0, -1.0, 1.0)], "tenant_id string, seq long, epsilon double, total double")
    got = {(r.tenant_id, r.seq): r for r in privacy.budget_fold(rows, ["seq"]).collect()}
    assert all(got["t", i].accepted for i in range(20)) and not got["t", 20].accepted and not got["u", 0].accepted
    assert got["t", 16].warning and not got["t", 10].warning
    state = {r.tenant_id: r for r in privacy.budget_state(privacy.budget_fold(rows, ["seq"])).collect()}
    assert state["t"].exhausted and not state["u"].exhausted


def test_masked_arithmetic(spark):
    rows = with_keys(spark.createDataFrame([(1, 5, -3), (2, -7, 2)], "id long, a long, b long"), m=M)
    x, y = (masked.masked(F.col(c), F.col("id"), c, key("m")) for c in "ab")
    px, py = (masked.pad(F.col("id"), c, key("m")) for c in "ab")
    got = rows.select("a", "b", masked.unmask(masked.add_masked(x, y), px + py).alias("s"), masked.unmask(masked.add_masked(x, y, minus=True), px - py).alias("d"), masked.unmask(masked.add_plain(x, F.lit(4)), px).alias("p"), masked.unmask(masked.times_plain(x, -3), px * F.lit(-3).cast("decimal(10,0)")).alias("t"), x.alias("x")).collect()
    assert all((int(r.s), int(r.d), int(r.p), int(r.t)) == (r.a + r.b, r.a - r.b, r.a + 4, -3 * r.a) and int(r.x) != r.a for r in got)
    assert spark.range(1).select(masked.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), masked.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).first()[:] == (11.0, None)
    assert spark.range(1).select(masked.credit_score(F.lit(5.0)), masked.credit_score(F.lit(-5.0)), masked.debt_to_income(F.lit(0.0), F.lit(1.0))).first()[:] == (850.0, 300.0, float("inf"))


def test_limits_and_events(spark):
    rows = spark.createDataFrame([("a", "read", i, float(i)) for i in range(5)] + [("a", "other", 9, 1.0)], "tenant_id string, operation string, seq long, at double")
    got = {(r.operation, r.seq): (r.allowed, r.retry_after) for r in observe.rate_limited(rows, {"read": (2, 3)}, ["at"]).collect()}
    assert [got["read", i][0] for i in range(5)] == [True, True, False, True, True] and got["other", 9] == (True, 0)
    assert got["read", 2][1] == 2
    assert spark.range(1).select(observe.search_event(F.lit("range")), observe.search_event(F.lit("odd"))).first()[:] == ("search.range", "search.keyword")


def test_garbage_of_the_backward_index(spark):
    d = with_keys(spark.createDataFrame([("1", "alpha beta"), ("2", "beta gamma")], "doc_id string, content string"), s=S)
    server, client = index.backward_add(d, key("s"))
    server, client = staging.stored(without_keys(server)), staging.stored(client.select("doc_id", "keyword"))
    gone = with_keys(spark.createDataFrame([("1",)], "doc_id string"), d=N)
    left, known, tokens, count, renew = index.backward_delete(server, client, gone, key("d"), 0, 1)
    assert left.count() == 2 and known.count() == 2 and tokens.count() == 2 and count == 1 and renew
    old = {r[0] for r in without_keys(d.select(keyword_token(F.lit("alpha"), key("s")))).collect()}
    assert not old & {r.delete_token for r in tokens.collect()}
    kept, removed = index.collect_garbage(server, known)
    assert kept.count() == 2 and removed.first().removed == 1


def test_reencrypt_needs_one_new_key_and_survives_hash_clashes(spark):
    a, b = derived(M, "a"), derived(M, "b")
    keys = spark.createDataFrame([("t1", "k1", a), ("t2", "k1", b), ("t1", "new", b), ("t2", "new", a)], "tenant_id string, key_id string, key binary")
    made = keys.filter("key_id = 'k1'").select("tenant_id", F.lit("x").alias("id"), wrap(encrypt(F.col("tenant_id"), F.col("key")), F.col("key_id")).alias("blob"))
    made = staging.stored(made)
    with pytest.raises(ValueError):
        rotation.reencrypt(made, keys, "missing")
    out = rotation.reencrypt(made, keys, "new")
    assert out.count() == 2 and out.filter("renewed IS NULL").count() == 0
    # Without tenants both keys have one hash: each blob stays one row, opened by the key that fits.
    flat = keys.filter("key_id = 'k1' OR tenant_id = 't1'").drop("tenant_id")
    again = rotation.reencrypt(made.drop("tenant_id"), flat, "new")
    assert again.count() == 2 and again.filter("renewed IS NULL").count() == 0
    assert rotation.resolve_keys(made.drop("tenant_id"), flat).select("key_id").distinct().collect()[0][0] == "k1"


def test_rotation_of_one_key_and_its_outcome(spark):
    keys = spark.createDataFrame([("k1", derived(M, "1")), ("k2", derived(M, "2")), ("new", derived(M, "3"))], "key_id string, key binary")
    rows = spark.createDataFrame([("1", "k1"), ("2", "k1"), ("3", "k2")], "id string, key_id string").join(keys, "key_id")
    blob = wrap(encrypt(F.col("id"), F.when(F.col("id") < "9", F.col("key"))), F.col("key_id"))
    good = staging.stored(rows.select("id", blob.alias("blob")))
    broken = staging.stored(good.withColumn("blob", F.concat("blob", F.lit(b"!"))))
    table = spark.createDataFrame([("t", "k1", 1)], "tenant_id string, key_id string, version int").selectExpr("*", "'active' lifecycle_state", "true active", "timestamp'2024-01-01' created_at", "cast(null as timestamp) last_rotated", "cast(null as timestamp) compromise_detected_at", "cast(null as timestamp) retention_expires_at", "cast(null as string) predecessor_key_id")
    state = lambda blobs, **o: {r.key_id: r.lifecycle_state for r in rotation.rotate(blobs, keys, table, "k1", "new", as_of(), **o)[2].collect()}
    renewed, outcome, _ = rotation.rotate(good, keys, table, "k1", "new", as_of())
    assert {r.id for r in renewed.collect()} == {"1", "2"} and outcome.first().completed == 2
    assert state(good) == {"k1": "retired", "new": "active"}
    assert state(broken) == {"k1": "rotating", "new": "active"}
    assert state(broken, emergency=True) == {"k1": "retired", "new": "active"}


def test_key_bundle(spark):
    from hushlake.sources.keys import export_bundle, import_bundle

    keys = spark.createDataFrame([("t", "a", M), ("t", "b", S)], "tenant_id string, key_id string, key binary")
    bundle = staging.stored(export_bundle(keys, "password", b"salt" * 4, rounds=1000))
    assert "key" not in bundle.columns and bundle.filter(F.col("sealed_key").contains(M)).count() == 0
    assert {r.key_id: bytes(r.key) for r in import_bundle(bundle, "password").collect()} == {"a": M, "b": S}
    with pytest.raises(Exception, match="."):
        import_bundle(bundle, "other").collect()
    assert import_bundle(bundle.limit(0), "password").count() == 0


def test_budget_reset(spark):
    rows = [("a", 0, 0.6, 1.0, None), ("a", 1, 0.6, 1.0, False), ("a", 2, 0.6, 1.0, True), ("a", 3, 0.6, 1.0, False)]
    df = spark.createDataFrame(rows, "tenant_id string, seq long, epsilon double, total double, reset boolean")
    got = {r.seq: (r.tenant_id, r.accepted) for r in privacy.budget_fold(df, ["seq"]).collect()}
    assert got == {0: ("a", True), 1: ("a", False), 2: ("a", True), 3: ("a", False)}


def test_bounds_equal_encrypted_values(spark):
    from hushlake.functions.order import ope_bound, ope_encrypt, ore_bound, ore_encrypt, ore_keys

    values = [0, 1, 255, 256, 10_000_000, 2**32 - 1]
    rows = with_keys(spark.createDataFrame([(v,) for v in values], "v long"), o=M, **ore_keys(M))
    got = rows.select("v", ope_encrypt(F.col("v"), key("o")).alias("ope"), ore_encrypt(F.col("v"), key("ore_left"), key("ore_right")).alias("ore")).collect()
    for r in got:
        ope, ore = spark.range(1).select(ope_bound(r.v, M), ore_bound(r.v, M)).first()
        assert ope == r.ope and bytes(ore) == bytes(r.ore)


def test_range_reaches_the_scan(spark):
    from hushlake.functions.order import ope_bound

    rows = with_keys(spark.range(100).withColumn("v", F.col("id") * 1000), o=M)
    from hushlake.functions.order import ope_encrypt

    stored = staging.stored(without_keys(rows.withColumn("c", ope_encrypt(F.col("v"), key("o")))))
    plan = stored.filter(F.col("c") >= ope_bound(50_000, M))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(c" in plan


def test_entries_are_the_same_when_read_again(spark):
    """States and entries of the forward index agree however often their tables are computed."""
    one = with_keys(spark.range(1).drop("id"), s=S)
    d = spark.createDataFrame([(f"d{i}", "alpha beta") for i in range(20)], "doc_id string, content string").repartition(3)
    built = index.forward_add(index.empty_forward(spark), with_keys(d, st=M, s=S), key("st"), key("s"))
    first, second = (sorted((r.tag, bytes(r.entry[:32])) for r in built.aux.collect()) for _ in range(2))
    assert first == second and len(first) == 40
    after = index.forward_open(built, spark.createDataFrame([("alpha",)], "keyword string"), one, key("s"))[0]
    states = [sorted((r.keyword, bytes(r.initial), bytes(r.current)) for r in after.states.collect()) for _ in range(2)]
    assert states[0] == states[1]


def test_jdbc_round_trip(spark):
    """Through the database that comes with Spark, in memory."""
    url, driver = "jdbc:derby:memory:hushlake;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([("a", "t1", "d1"), ("a", "t2", "d1"), ("b", "t1", "d2")], tables.POSTINGS)
    tables.write_jdbc(rows, url, "postings", "overwrite", createTableColumnTypes="tenant_id VARCHAR(64), token VARCHAR(64), doc_id VARCHAR(64)", **driver)
    tables.write_jdbc(rows.limit(1), url, "postings", **driver)
    back = tables.read_jdbc(spark, url, "postings", **driver)
    assert back.count() == 4 and {r.doc_id for r in back.filter("tenant_id = 'b'").collect()} == {"d2"}
