"""The privacy ledger, outcomes of rotations, and rate limits, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hushlake.functions.tokens import encrypt, wrap
from hushlake.operators import observe, rotation
from hushlake.operators.ledger import Ledger
from hushlake.sources import staging
from hushlake.sources.keys import derived

M, N = b"M" * 32, b"N" * 32
REQUESTS = "tenant_id string, request_id string, kind string, epsilon double, total double, at long, true_value double, true_count long, sensitivity double, delta double"


def request(tenant, name, kind="count", epsilon=0.4, total=1.0, at=0, value=100.0, count=10, sensitivity=1.0, delta=1e-5):
    return tenant, name, kind, epsilon, total, at, value, count, sensitivity, delta


def told(df):
    return {(r.tenant_id, r.request_id): r for r in df.collect()}


def test_two_jobs_spend_one_budget(spark, tmp_path):
    own = Ledger(spark, f"file://{tmp_path}/ledger")
    ask = lambda *rows: told(own.release(spark.createDataFrame(list(rows), REQUESTS), ["at"], N, "q"))
    first = ask(request("a", "1", at=1), request("a", "2", at=2, epsilon=0.8), request("b", "1", at=1))
    assert [first[k].accepted for k in [("a", "1"), ("a", "2"), ("b", "1")]] == [True, False, True]
    assert first["a", "2"].answer is None and first["a", "2"].reason == "budget exhausted"
    # Changed data: the repeated request has its first answer, the next one pays from what is left, and the third finds nothing.
    second = ask(request("a", "1", at=1, value=117.0), request("a", "3", at=2, value=117.0), request("a", "4", at=3, value=117.0))
    assert second["a", "1"].answer == first["a", "1"].answer
    assert second["a", "3"].accepted and second["a", "3"].remaining == pytest.approx(0.2) and second["a", "3"].warning
    assert not second["a", "4"].accepted
    assert abs(second["a", "3"].answer - first["a", "1"].answer - 17.0) > 1e-9  # noise of its own
    before = own.entries().count()
    assert ask(request("a", "3", at=2), request("a", "3", at=9))["a", "3"].answer == second["a", "3"].answer
    assert own.entries().count() == before == 5 and own.batches() == [1, 2]
    account = {r.tenant_id: r for r in own.accounts().collect()}
    assert account["a"].consumed == pytest.approx(0.8) and account["a"].accepted == 2 and account["a"].requests == 4


def test_bad_parameters_cost_nothing(spark, tmp_path):
    own = Ledger(spark, f"file://{tmp_path}/ledger")
    bad = [request("a", "e", epsilon=-1.0), request("a", "e0", epsilon=0.0), request("a", "s", sensitivity=0.0), request("a", "d", kind="sum", delta=2.0), request("a", "n", kind="average", count=0), request("a", "k", kind="mode"), request("a", "v", value=None), request("a", "t", total=None), request("a", "null", epsilon=None)]
    got = told(own.release(spark.createDataFrame([*bad, request("a", "good", at=1, epsilon=1.0)], REQUESTS), ["at"], N, "q"))
    assert {k[1]: r.reason for k, r in got.items() if not r.accepted} == {"e": "epsilon must be positive", "e0": "epsilon must be positive", "s": "sensitivity must be positive", "d": "delta must be between 0 and 1", "n": "count must be at least 1", "k": "unknown kind", "v": "no value", "t": "budget must be positive", "null": "epsilon must be positive"}
    assert got["a", "good"].accepted and got["a", "good"].remaining == 0
    with pytest.raises(Exception, match="is null"):
        own.release(spark.createDataFrame([request(None, "x")], REQUESTS), ["at"], N, "q").collect()
    assert own.release(spark.createDataFrame([], REQUESTS), ["at"], N, "q").count() == 0


def test_ledger_noise_has_the_right_spread(spark, tmp_path):
    own = Ledger(spark, f"file://{tmp_path}/ledger")
    base = spark.range(20_000).select(F.concat(F.lit("t"), F.col("id") % 50).alias("tenant_id"), F.col("id").cast("string").alias("request_id"), F.element_at(F.array(F.lit("count"), F.lit("sum"), F.lit("average")), (F.col("id") % 3 + 1).cast("int")).alias("kind"), F.lit(0.5).alias("epsilon"), F.lit(1e6).alias("total"), F.col("id").alias("at"), F.lit(100.0).alias("true_value"), F.lit(4).alias("true_count"), F.lit(2.0).alias("sensitivity"))
    got = own.release(base, ["at"], N, "q").groupBy("kind").agg(F.avg("answer").alias("m"), F.var_samp("answer").alias("v")).collect()
    sigma2 = 2 * __import__("math").log(1.25 / 1e-5) * (2 / 0.5) ** 2
    want = {"count": 2 * (2 / 0.5) ** 2, "sum": sigma2, "average": sigma2 / 16}
    for r in got:
        assert abs(r.v / want[r.kind] - 1) < 0.07 and abs(r.m - 100) < 4 * (want[r.kind] / 6600) ** 0.5


def test_selection_is_paid_too(spark, tmp_path):
    own = Ledger(spark, f"file://{tmp_path}/ledger")
    rows = [request(f"t{i}", "s", kind="select", value=None, epsilon=2.0, total=2.0) for i in range(300)] + [request("t0", "again", kind="select", value=None, at=1)]
    candidates = spark.createDataFrame([(f"t{i}", n, c, u) for i in range(300) for n in ("s", "again") for c, u in (("a", 6.0), ("b", 4.0))], "tenant_id string, request_id string, candidate string, utility double")
    got = told(own.release(spark.createDataFrame(rows, REQUESTS), ["at"], N, "q", candidates))
    assert got["t0", "again"].selected is None and not got["t0", "again"].accepted
    share = sum(r.selected == "a" for k, r in got.items() if k[1] == "s") / 300
    assert abs(share - 0.88) < 0.06  # e**2 / (e**2 + 1)


def rotation_rows(spark, n=60, broken=7):
    keys = spark.createDataFrame([("k1", derived(M, "1")), ("k2", derived(M, "2")), ("new", derived(M, "3"))], "key_id string, key binary")
    rows = spark.range(n).withColumn("key_id", F.when(F.col("id") % 3 == 0, "k2").otherwise("k1")).join(keys, "key_id")
    blob = wrap(encrypt(F.col("id").cast("string"), F.col("key")), F.col("key_id"))
    return keys, staging.stored(rows.select("id", F.when(F.col("id") % broken == 0, F.concat(blob, F.lit(b"!"))).otherwise(blob).alias("blob")))


def test_a_stopped_rotation_is_taken_up(spark, tmp_path):
    keys, rows = rotation_rows(spark)
    folder = f"file://{tmp_path}/rotation"
    renewed, outcomes = rotation.rotate_in_parts(rows, "id", keys, "k1", "new", folder, parts=6, at_once=2, waves=1)
    half = rotation.overall(outcomes, 6).first()
    assert outcomes.count() == 2 and half.status == "in_progress"
    first = {r.id: bytes(r.renewed) for r in renewed.filter("renewed IS NOT NULL").collect()}
    assert 0 < len(first) < 40
    # A part that was stopped half-way: its rows are there, but no outcome.
    renewed.filter("part = 99").write.mode("append").partitionBy("part").parquet(f"{folder}/renewed")
    renewed, outcomes = rotation.rotate_in_parts(rows, "id", keys, "k1", "new", folder, parts=6, at_once=2)
    done = rotation.overall(outcomes, 6).first()
    assert (done.total, done.completed, done.failed, done.status) == (40, 34, 6, "completed")
    assert done.percent == pytest.approx(85.0)
    after = {r.id: r.renewed for r in renewed.collect()}
    assert len(after) == renewed.count() == 40 and all(bytes(after[k]) == v for k, v in first.items())
    assert {r.record_id for r in rotation.failures(renewed, "id").collect()} == {str(i) for i in range(60) if i % 3 and i % 7 == 0}
    # A further call finds nothing to do.
    assert rotation.rotate_in_parts(rows, "id", keys, "k1", "new", folder, parts=6)[1].count() == 6


def test_keys_that_cannot_be_rotated(spark):
    table = spark.createDataFrame([("t", "a", "rotating"), ("t", "b", "destroyed"), ("t", "c", "active")], "tenant_id string, key_id string, lifecycle_state string")
    for name in "ab":
        with pytest.raises(ValueError, match="can't be rotated"):
            rotation.rotatable(table, name)
    rotation.rotatable(table, "c")
    rotation.rotatable(table, "a", emergency=True)


def test_only_active_keys_are_due(spark):
    rows = [(s, True, s) for s in rotation.STATES] + [("off", False, "active")]
    keys = spark.createDataFrame(rows, "key_id string, active boolean, lifecycle_state string").selectExpr("'t' tenant_id", "*", "timestamp'2020-01-01' created_at", "cast(null as timestamp) last_rotated", "30 rotation_period_days", "cast(null as timestamp) retention_expires_at", "cast(null as timestamp) compromise_detected_at")
    as_of = F.lit("2024-01-01").cast("timestamp")
    assert [r.key_id for r in rotation.due_keys(keys, as_of).collect()] == ["active"]
    assert rotation.lifecycle_report(keys, as_of).first().needing_rotation == 1
    assert [tuple(r) for r in rotation.keys_needing_attention(keys, as_of).collect()] == [("t", "active", "needing_rotation")]


def plain_limits(rows, limits):
    own = defaultdict(list)
    out = {}
    for tenant, operation, seq, at in sorted(rows, key=lambda r: (r[3], r[2])):
        if operation not in limits:
            out[seq] = (True, 0)
            continue
        most, window = limits[operation]
        accepted = [t for t in own[tenant, operation] if t > at - window]
        if len(accepted) >= most:
            out[seq] = (False, max(int(accepted[0] - (at - window)) + 1, 1))
        else:
            accepted.append(at)
            out[seq] = (True, 0)
        own[tenant, operation] = accepted
    return out


@pytest.mark.parametrize("seed", range(3))
def test_limits_fold_only_busy_stretches(spark, seed):
    r = random.Random(seed)
    rows = []
    for tenant in ("a", "b", None):
        at = 0.0
        for _ in range(250):
            at += r.choice([0.0, 0.5, 1.0, 3.0, 40.0]) if tenant != "b" else 20.0
            rows.append((tenant, r.choice(["read", "write", "free"]), len(rows), at))
    limits = {"read": (2, 5), "write": (3, 10)}
    table = spark.createDataFrame(rows, "tenant_id string, operation string, seq long, at double").repartition(3)
    got = {x.seq: (x.allowed, x.retry_after) for x in observe.rate_limited(table, limits, ["at", "seq"]).collect()}
    assert got == plain_limits(rows, limits)
    _, folded = observe.limited_parts(table, limits)
    reach = {(x.tenant_id, x.operation) for x in folded.collect()}
    assert ("b", "read") not in reach and all(x[1] != "free" for x in reach) and folded.count() < 400


def test_prepared_tables_follow_their_source(spark, tmp_path):
    source, made = tmp_path / "source", []

    def write(path):
        made.append(path)
        spark.read.parquet(f"{source}/t.parquet").write.parquet(path)

    spark.range(3).coalesce(1).write.parquet(f"{source}/t.parquet")
    first = staging.prepared(spark, "copy", str(source), write)
    assert staging.prepared(spark, "copy", str(source), write) == first and len(made) == 1
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(f"{source}/t.parquet")
    assert spark.read.parquet(staging.prepared(spark, "copy", str(source), write)).count() == 5
