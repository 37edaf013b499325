"""Keys as columns of a small broadcast table, so that none is written into a plan."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "__key_"


@dataclass(frozen=True)
class Key:
    """A key's columns: raw bytes, and its two HMAC-SHA-256 pads."""

    raw: Column
    inner: Column
    outer: Column


def pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def derived(master: bytes, context: str | bytes) -> bytes:
    """HMAC-SHA-256 of a context under a master key: once for each key, on the driver."""
    return hmac.new(master, context.encode() if isinstance(context, str) else context, hashlib.sha256).digest()


def field_key(master: bytes, tenant: str, field: str) -> bytes:
    """Key of one field of one tenant."""
    return derived(master, f"{tenant}:{field}")


def export_key(password: str, salt: bytes, rounds: int = 600_000) -> bytes:
    """Key from a password (PBKDF2), for wrapping an exported key table."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds)


def export_bundle(keys: DataFrame, password: str, salt: bytes, rounds: int = 600_000) -> DataFrame:
    """A key table (key, any other columns) for leaving the system: key encrypted (AES-GCM) under a key from the password, beside salt and rounds.

    The password's key is worked out once, on the driver, and reaches the workers in a broadcast table. salt is 16 random bytes or more.
    """
    own = with_keys(keys, export=export_key(password, salt, rounds))
    sealed = F.aes_encrypt("key", F.col(f"{PREFIX}export.raw"), F.lit("GCM"))
    return without_keys(own.withColumns({"sealed_key": sealed, "salt": F.lit(salt), "rounds": F.lit(rounds)})).drop("key")


def import_bundle(bundle: DataFrame, password: str) -> DataFrame:
    """The key table of an exported bundle; an error for a wrong password or a changed key. An empty bundle gives an empty table."""
    first = bundle.select("salt", "rounds").first()
    if first is None:
        return bundle.withColumn("key", F.lit(None).cast("binary")).drop("sealed_key", "salt", "rounds")
    own = with_keys(bundle, export=export_key(password, bytes(first.salt), first.rounds))
    opened = F.aes_decrypt("sealed_key", F.col(f"{PREFIX}export.raw"), F.lit("GCM"))
    return without_keys(own.withColumn("key", opened)).drop("sealed_key", "salt", "rounds")


def key_rows(spark: SparkSession, keys: dict, id_type: str = "tenant_id string") -> DataFrame:
    """Key table by tenant: {tenant: {name: bytes}}, one struct column for each name."""
    names = sorted({n for own in keys.values() for n in own})
    rows = [(tenant, *[(own[n], *pads(own[n])) if n in own else None for n in names]) for tenant, own in keys.items()]
    return spark.createDataFrame(rows, id_type + "".join(f", {PREFIX}{n} struct<raw:binary,inner:binary,outer:binary>" for n in names))


def with_keys(df: DataFrame, **keys: bytes) -> DataFrame:
    """df with the same keys on every row, from a broadcast table of one row."""
    one = key_rows(df.sparkSession, {"": keys}).drop("tenant_id")
    return df.join(F.broadcast(one))


def with_tenant_keys(df: DataFrame, table: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """df with its tenant's keys; the key table holds a row a tenant and is broadcast. Rows of unknown tenants get null keys."""
    return df.join(F.broadcast(table.withColumnRenamed("tenant_id", "__tenant")), F.col(tenant) == F.col("__tenant"), "left").drop("__tenant")


def key(name: str) -> Key:
    return Key(*[F.col(f"{PREFIX}{name}.{part}") for part in ("raw", "inner", "outer")])


def without_keys(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(PREFIX)])
