"""Tables on storage: documents, postings, keys, audit entries; key bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "tenant_id string, key_id string, encrypted_key binary, metadata string, updated_at timestamp"
AUDIT = "id bigint, tenant_id string, key_id string, entry struct<event_type:string,actor:string,success:boolean,resource:string,details:map<string,string>,request_id:string>, created_at timestamp"
DOCUMENTS = "tenant_id string, doc_id string, encrypted_document binary, algorithm string, encryption_key_id string, search_key_id string, metadata map<string,string>, token_count int, deleted boolean, created_at timestamp, updated_at timestamp"
POSTINGS = "tenant_id string, token string, doc_id string"
KEY_METADATA = "key_type string, created_at timestamp, expires_at timestamp, rotation_period_days int, description string, last_rotated timestamp, access_count bigint, active boolean, version int, lifecycle_state string, successor_key_id string, predecessor_key_id string, retention_expires_at timestamp, compromise_detected_at timestamp, total_records_encrypted bigint"


def by_tenant(df: DataFrame) -> DataFrame:
    """Rows dealt out by tenant; a large tenant is spread over partitions by size, and a small one is in one."""
    return df.hint("rebalance", "tenant_id")


def write_table(df: DataFrame, path: str, mode: str = "append", dealt: bool = False) -> None:
    """Parquet by tenant. Postings are dealt out by tenant and sorted by token in each file; a large tenant, whatever its tokens, is spread over files by size, and a
    small one is one file. dealt: they have been made of documents dealt out by_tenant, which are much smaller than their tokens."""
    if "token" in df.columns:
        df = (df if dealt else by_tenant(df)).sortWithinPartitions("tenant_id", "token")
    df.write.mode(mode).partitionBy("tenant_id").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str, tenant: str | None = None) -> DataFrame:
    """The table, or one tenant's partition of it."""
    df = spark.read.schema(schema).parquet(path)
    return df if tenant is None else df.filter(F.col("tenant_id") == tenant)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def load_keys(keys: DataFrame, tenant: str) -> DataFrame:
    """A tenant's keys with their metadata as columns."""
    return keys.filter(F.col("tenant_id") == tenant).withColumn("m", F.from_json("metadata", KEY_METADATA)).select("tenant_id", "key_id", "encrypted_key", "updated_at", "m.*")


def append_audit(entries: DataFrame, path: str) -> None:
    """Audit entries as JSON lines."""
    entries.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, key_id: str | None = None, tenant: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries, newest first."""
    df = spark.read.schema(AUDIT).json(path)
    df = df if key_id is None else df.filter(F.col("key_id") == key_id)
    df = df if tenant is None else df.filter(F.col("tenant_id") == tenant)
    df = df.orderBy(F.desc("id"))
    return df if limit is None else df.limit(limit)
