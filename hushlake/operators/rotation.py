"""Keys over time: due keys, version chains, states, re-encryption of blobs, re-wrapping of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import blob_key_hash, encrypt, key_hash, try_decrypt, unwrap, wrap
from ..sources.staging import dropped, stored

#: Fixed values.
STATES = ["active", "rotating", "retired", "archived", "destroyed"]
RETENTION_YEARS = 7


def elapsed_days(start: Column, as_of: Column) -> Column:
    """Whole periods of 24 hours, not calendar days."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(start)) / 86400)


def needs_rotation(as_of: Column) -> Column:
    """Whether a key is due: only one that is active, and in no other state, can be."""
    due = elapsed_days(F.coalesce("last_rotated", "created_at"), as_of) >= F.col("rotation_period_days")
    return F.col("active") & (F.col("lifecycle_state") == "active") & due


def due_keys(keys: DataFrame, as_of: Column) -> DataFrame:
    """Keys that are due, with days since the last rotation."""
    days = elapsed_days(F.coalesce("last_rotated", "created_at"), as_of)
    return keys.filter(needs_rotation(as_of)).select("tenant_id", "key_id", days.cast("long").alias("days_since"))


def usable(keys: DataFrame, *, active: bool = False, key_type: str | None = None, decryption: bool = False) -> DataFrame:
    """Keys by state: active ones, of a type, usable for decryption (all but destroyed)."""
    out = keys.filter("active") if active else keys
    out = out.filter(F.col("key_type") == key_type) if key_type else out
    return out.filter(F.col("lifecycle_state") != "destroyed") if decryption else out


def latest_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of keys: the newest row of each (tenant_id, key_id)."""
    w = Window.partitionBy("tenant_id", "key_id").orderBy(F.desc("updated_at"))
    return old.unionByName(new).withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def key_chains(keys: DataFrame, most: int = 64) -> DataFrame:
    """(tenant_id, key_id, root, position): each key's oldest ancestor and its place after it, by predecessor links.

    Ancestors are doubled in each round (a key's ancestor's ancestor), so a chain of n versions takes log2(n) joins. Each round is stored, since
    it is read twice by the next one. Rounds end once all have reached their roots, or after ``most`` links.
    """
    ends = keys.select("tenant_id", "key_id")
    links = keys.select("tenant_id", "key_id", F.col("predecessor_key_id").alias("up"))
    known = links.join(ends.withColumnRenamed("key_id", "up").withColumn("__known", F.lit(True)), ["tenant_id", "up"], "left")
    state = known.select("tenant_id", "key_id", F.when(F.col("__known"), F.col("up")).alias("up"), F.when(F.col("__known"), F.lit(1)).otherwise(0).alias("position"))
    state = stored(state.select("tenant_id", "key_id", F.coalesce("up", "key_id").alias("root"), "position"), "chains")
    span = 1
    while span < most:
        further = state.filter("position > 0").select("tenant_id", F.col("key_id").alias("root"), F.col("root").alias("__root"), F.col("position").alias("__more"))
        before, state = state, stored(state.join(further, ["tenant_id", "root"], "left").select("tenant_id", "key_id", F.coalesce("__root", "root").alias("root"), (F.col("position") + F.coalesce("__more", F.lit(0))).alias("position"), F.col("__more").isNotNull().alias("moved")), "chains")
        moved = state.filter("moved").limit(1).count()
        dropped(before)
        span *= 2
        if not moved:
            break
    return state.select("tenant_id", "key_id", "root", F.col("position").cast("long").alias("position"))


def change_states(keys: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """(tenant_id, key_id, old_state, new_state, retention_expires_at, reason) of requests (tenant_id, key_id, action, force).

    Actions: retire, archive (not while active or rotating; sets the retention), destroy (only retired or archived keys past their
    retention, unless forced). A refused or unknown request keeps the state and says why.
    """
    rows = requests.join(keys.select("tenant_id", "key_id", "lifecycle_state", "retention_expires_at"), ["tenant_id", "key_id"], "left")
    state, action = F.col("lifecycle_state"), F.col("action")
    force = F.coalesce("force", F.lit(False))
    reason = (
        F.when(state.isNull(), "unknown key")
        .when((action == "archive") & state.isin("active", "rotating"), F.lit("retire the key first"))
        .when((action == "destroy") & ~force & ~state.isin("retired", "archived"), F.lit("archive the key first"))
        .when((action == "destroy") & ~force & (F.col("retention_expires_at") > as_of), F.lit("retention has not ended"))
        .when(~action.isin("retire", "archive", "destroy"), F.lit("unknown action"))
    )
    new = F.when(reason.isNotNull(), state).when(action == "retire", "retired").when(action == "archive", "archived").otherwise("destroyed")
    until = F.when(reason.isNull() & (action == "archive"), as_of + F.make_dt_interval(F.lit(RETENTION_YEARS * 365))).otherwise(F.col("retention_expires_at"))
    return rows.select("tenant_id", "key_id", state.alias("old_state"), new.alias("new_state"), until.alias("retention_expires_at"), reason.alias("reason"))


def apply_changes(keys: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """The key table after changes (as change_states reports them): states and retention as decided; retired and destroyed keys are no longer active."""
    new = changes.filter("reason IS NULL").select("tenant_id", "key_id", F.col("new_state").alias("__state"), F.col("retention_expires_at").alias("__until"))
    rows = keys.join(new, ["tenant_id", "key_id"], "left")
    ended = F.coalesce(F.col("__state").isin("retired", "destroyed"), F.lit(False))
    changed = F.col("__state").isNotNull()
    out = {"lifecycle_state": F.coalesce("__state", "lifecycle_state"), "retention_expires_at": F.when(changed, F.col("__until")).otherwise(F.col("retention_expires_at")), "active": F.when(ended, F.lit(False)).otherwise(F.col("active")), "updated_at": F.when(changed, as_of).otherwise(F.col("updated_at"))}
    return rows.withColumns(out).select(keys.columns)


def keys_needing_attention(keys: DataFrame, as_of: Column) -> DataFrame:
    """(tenant_id, key_id, concern): the keys behind the counts of the lifecycle report: needing_rotation, past_retention, compromised; a row for each concern."""
    concerns = [F.when(c, F.lit(n)) for n, c in (("needing_rotation", needs_rotation(as_of)), ("past_retention", past_retention(as_of)), ("compromised", F.col("compromise_detected_at").isNotNull()))]
    return keys.select("tenant_id", "key_id", F.explode(F.array_compact(F.array(*concerns))).alias("concern"))


def past_retention(as_of: Column) -> Column:
    return (F.col("retention_expires_at") < as_of) & (F.col("lifecycle_state") != "destroyed")


def lifecycle_report(keys: DataFrame, as_of: Column) -> DataFrame:
    """Of each tenant: keys by state, due for rotation, past retention, compromised."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    states = [count(F.col("lifecycle_state") == s).alias(s) for s in STATES]
    past = past_retention(as_of)
    return keys.groupBy("tenant_id").agg(F.count("*").alias("total_keys"), *states, count(needs_rotation(as_of)).alias("needing_rotation"), count(past).alias("past_retention"), F.count("compromise_detected_at").alias("compromised"))


def resolve_keys(blobs: DataFrame, keys: DataFrame, blob: str = "blob") -> DataFrame:
    """Adds the key_id of each versioned blob; null for unversioned blobs and unknown keys.

    Keys with the blob's 4-byte hash (and its tenant_id, where both tables have one) are looked up; if several share a hash and keys has a
    column ``key``, the one that opens the blob is taken, else the first by name. Each blob stays one row.
    """
    rows = with_key_choices(blobs, keys, blob)
    first = F.col("__keys")[0]["key_id"]
    if "key" in keys.columns:
        fits = F.filter("__keys", lambda k: try_decrypt(unwrap(F.col(blob)), k["key"]).isNotNull())
        first = F.when(F.size("__keys") > 1, F.coalesce(F.get(fits, F.lit(0))["key_id"], first)).otherwise(first)
    return rows.withColumn("key_id", first).drop("__hash", "__keys")


def with_key_choices(blobs: DataFrame, keys: DataFrame, blob: str) -> DataFrame:
    """Adds __hash and __keys, the keys that a blob may be encrypted with: one row a blob, whatever hashes clash. Keys are few and broadcast."""
    by = [c for c in ("tenant_id",) if c in blobs.columns and c in keys.columns]
    fields = [c for c in ("key_id", "key") if c in keys.columns]
    known = keys.groupBy(*by, key_hash(F.col("key_id")).alias("__hash")).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("__keys"))
    return blobs.withColumn("__hash", blob_key_hash(F.col(blob))).join(F.broadcast(known), [*by, "__hash"], "left")


def reencrypt(blobs: DataFrame, keys: DataFrame, new_key_id: str, blob: str = "blob", only: str | None = None) -> DataFrame:
    """Adds ``renewed``: each blob decrypted with its key and encrypted under new_key_id, null where that fails. keys is (key_id, key), and tenant_id if blobs have one.

    only names the key whose blobs are renewed; those of other keys, or unversioned ones, are left out of the result. A map over the blobs: keys are
    broadcast, nothing is shuffled, and a repeated run gives blobs of the same key. Without exactly one new key (of each tenant) a ValueError is raised.
    """
    by = [c for c in ("tenant_id",) if c in blobs.columns and c in keys.columns]
    new = keys.filter(F.col("key_id") == new_key_id).select(*by, F.col("key").alias("__new")).distinct()
    found = new.groupBy(*by).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("most")).first() if by else new.agg(F.count("*").alias("groups"), F.count("*").alias("most")).first()
    if not found.groups or found.most != 1:
        raise ValueError(f"there must be one key {new_key_id}")
    rows = with_key_choices(blobs, keys, blob)
    if only is not None:
        rows = rows.filter(F.exists("__keys", lambda k: k["key_id"] == only))
    opened = lambda k: F.struct(k["key_id"].alias("key_id"), try_decrypt(unwrap(F.col(blob)), k["key"]).alias("plain"))
    tried = F.get(F.filter(F.transform("__keys", opened), lambda x: x["plain"].isNotNull()), F.lit(0))
    # A hash has one key but for rare clashes, and that key is tried without a list.
    single = opened(F.get("__keys", F.lit(0)))
    rows = rows.withColumn("__plain", F.when(F.size("__keys") == 1, F.when(single["plain"].isNotNull(), single)).otherwise(tried))
    rows = rows.join(F.broadcast(new), by, "left") if by else rows.join(F.broadcast(new))
    if only is not None:
        # A blob that opens with another key of the same hash is not one of this key.
        rows = rows.filter(F.coalesce(F.col("__plain.key_id") == only, F.lit(True)))
    return rows.withColumn("renewed", wrap(encrypt(F.col("__plain.plain"), F.col("__new")), F.lit(new_key_id))).drop("__hash", "__keys", "__plain", "__new")


def rotate(blobs: DataFrame, keys: DataFrame, table: DataFrame, key_id: str, new_key_id: str, as_of: Column, emergency: bool = False, blob: str = "blob") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(renewed blobs of the key, one row of progress, key table after it): the records of key_id move to new_key_id.

    The outcome decides the key table: a rotation in which all failed leaves the old key rotating and active, an emergency retires it at once
    and marks it compromised. The renewed blobs are stored once, so that both read the same ciphertexts. A key that is rotating already or destroyed is refused.
    """
    rotatable(table, key_id, emergency)
    renewed = stored(reencrypt(blobs, keys, new_key_id, blob, only=key_id), "renewed")
    outcome = progress(renewed, emergency=emergency)
    failed = outcome.first().status == "failed"
    return renewed, outcome, rotated_keys(table, key_id, new_key_id, as_of, failed, emergency)


def rotatable(table: DataFrame, key_id: str, emergency: bool = False) -> None:
    """An error for a key that is destroyed, or rotating already and not in an emergency."""
    states = {r[0] for r in table.filter(F.col("key_id") == key_id).select("lifecycle_state").distinct().collect()}
    if states & ({"destroyed"} if emergency else {"destroyed", "rotating"}):
        raise ValueError(f"key {key_id} can't be rotated: it is {', '.join(sorted(states))}")


def rotate_in_parts(blobs: DataFrame, record: str, keys: DataFrame, key_id: str, new_key_id: str, folder: str, parts: int = 64, at_once: int = 16, blob: str = "blob", waves: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(renewed blobs, outcomes): re-encryption of the records of key_id that a later call with the same folder takes up where it was stopped.

    Records are cut by the hash of ``record`` into parts; ``at_once`` parts are one job, which writes them to folder/renewed and then a row (part, total, completed,
    failed) each to folder/outcomes. Parts with a row are done and are not read again. A part that was stopped half-way is written anew in its place.
    ``waves`` ends a call after so many jobs (a time slot). Both tables are read from storage; renewed has the columns of blobs, part and renewed.
    """
    spark = blobs.sparkSession
    schema = "part int, total long, completed long, failed long"
    number = F.pmod(F.xxhash64(F.col(record)), F.lit(parts)).cast("int")
    outcomes = lambda: spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/outcomes")
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/outcomes")
    done = {r[0] for r in outcomes().collect()}  # at most ``parts``
    open_parts = [k for k in range(parts) if k not in done]
    jobs = [open_parts[i : i + at_once] for i in range(0, len(open_parts), at_once)]
    for job in jobs[:waves]:
        rows = reencrypt(blobs.withColumn("part", number).filter(F.col("part").isin(job)), keys, new_key_id, blob, only=key_id)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/renewed")
        written = spark.read.schema(kinds).parquet(f"{folder}/renewed").filter(F.col("part").isin(job))
        counted = written.groupBy("part").agg(F.count("*").alias("total"), F.count("renewed").alias("completed"))
        every = spark.createDataFrame([(k,) for k in job], "part int").join(counted, "part", "left").na.fill(0)
        every.select("part", "total", "completed", (F.col("total") - F.col("completed")).alias("failed")).write.mode("append").parquet(f"{folder}/outcomes")
    kinds = ", ".join(f"`{n}` {t}" for n, t in [*blobs.dtypes, ("renewed", "binary"), ("part", "int")])
    return spark.read.schema(kinds).parquet(f"{folder}/renewed"), outcomes()


def overall(outcomes: DataFrame, parts: int) -> DataFrame:
    """One row of progress over the parts of rotate_in_parts: total, completed, failed, percent, and status in_progress until every part has its outcome."""
    total, done, failed = (F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "completed", "failed"))
    status = F.when(F.count("*") < parts, "in_progress").when((failed > 0) & (done == 0), "failed").otherwise("completed")
    return outcomes.agg(total.alias("total"), done.alias("completed"), failed.alias("failed"), percent_of(done, total).alias("percent"), status.alias("status"))


def percent_of(done: Column, total: Column) -> Column:
    """Share of total that is done, in percent; 100 of nothing."""
    return F.when(total == 0, 100.0).otherwise(100.0 * done / F.greatest(total, F.lit(1)))


def progress(renewed: DataFrame, by: list[str] | None = None, emergency: bool = False) -> DataFrame:
    """Total, completed, failed, percent completed (100 of nothing) and status of a re-encryption. FAILED only if all failed, and never in an emergency."""
    done, total = F.count("renewed"), F.count("*")
    failed = total - done
    status = F.lit("completed") if emergency else F.when((failed > 0) & (done == 0), "failed").otherwise("completed")
    return renewed.groupBy(*(by or [])).agg(total.alias("total"), done.alias("completed"), failed.alias("failed"), percent_of(done, total).alias("percent"), status.alias("status"))


def failures(renewed: DataFrame, record: str, by: list[str] | None = None) -> DataFrame:
    """(by, record_id, detail): every record that a re-encryption failed for. A map over the renewed blobs; the list may be as long as they are."""
    own = F.col(record).cast("string")
    return renewed.filter("renewed IS NULL").select(*(by or []), own.alias("record_id"), F.concat(F.lit("Re-encrypt failed for "), own).alias("detail"))


def rotated_keys(keys: DataFrame, key_id: str, new_key_id: str, as_of: Column, failed: bool = False, emergency: bool = False) -> DataFrame:
    """Key table after the rotation of key_id to new_key_id: links both ways, version, states. An emergency marks the old key compromised and retires it at once; a failed rotation leaves it rotating and active."""
    old, own = F.col("key_id") == key_id, keys
    if "successor_key_id" not in own.columns:
        own = own.withColumn("successor_key_id", F.lit(None).cast("string"))
    ended = emergency or not failed
    renewed = own.filter(old).withColumns(
        {"key_id": F.lit(new_key_id), "predecessor_key_id": F.lit(key_id), "successor_key_id": F.lit(None).cast("string"), "version": F.col("version") + 1, "lifecycle_state": F.lit("active"), "active": F.lit(True), "created_at": as_of, "last_rotated": F.lit(None).cast("timestamp"), "compromise_detected_at": F.lit(None).cast("timestamp"), "retention_expires_at": F.lit(None).cast("timestamp")}
    )
    at = F.when(old, as_of).otherwise(F.col("compromise_detected_at")) if emergency else F.col("compromise_detected_at")
    active = F.when(old, F.lit(False)).otherwise(F.col("active")) if ended else F.col("active")
    before = own.withColumns({"lifecycle_state": F.when(old, "retired" if ended else "rotating").otherwise(F.col("lifecycle_state")), "active": active, "successor_key_id": F.when(old, F.lit(new_key_id)).otherwise(F.col("successor_key_id")), "last_rotated": F.when(old, as_of).otherwise(F.col("last_rotated")), "compromise_detected_at": at})
    return before.unionByName(renewed)


def rolled_back(keys: DataFrame, key_id: str, new_key_id: str) -> DataFrame:
    """The old key active again and without a successor, the new one retired; both still resolve, so renewed blobs stay readable."""
    old, new = F.col("key_id") == key_id, F.col("key_id") == new_key_id
    out = {"lifecycle_state": F.when(old, "active").when(new, "retired").otherwise(F.col("lifecycle_state")), "active": F.when(old, True).when(new, False).otherwise(F.col("active"))}
    if "successor_key_id" in keys.columns:
        out["successor_key_id"] = F.when(~old, F.col("successor_key_id"))
    return keys.withColumns(out)


def wrap_keys(keys: DataFrame, master: Column, column: str = "key") -> DataFrame:
    """encrypted_key: each key encrypted under a master key."""
    return keys.withColumn("encrypted_key", encrypt(F.col(column), master)).drop(column)


def rewrap_keys(keys: DataFrame, old_master: Column, new_master: Column) -> DataFrame:
    """``renewed``: each encrypted_key under the new master key, null where the old one doesn't open it."""
    return keys.withColumn("renewed", encrypt(try_decrypt(F.col("encrypted_key"), old_master), new_master))
