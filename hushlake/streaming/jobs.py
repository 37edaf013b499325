"""Structured Streaming forms: ingest, rate limit, budget, metrics, rapid accounts, keyword chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.helpers import ADVANCE, TAG, chain_step, spend, throttle
from ..operators.index import DOC, ingest
from ..sources.keys import Key, without_keys
from ..sources.tables import write_table


def ingest_stream(docs: DataFrame, document_key: Key, search: Key, key_id: str, search_key_id: str, time: str, delay: str, documents_path: str, postings_path: str, checkpoint: str):
    """Continuous ingest of docs (tenant_id, doc_id, content, time, keys): ids that are stored already are rejected; each batch is written to both tables.

    Repeated ids within ``delay`` are dropped by the stream's state; older ones by an anti-join of each batch with the ids of other batches in the documents table, of
    which only the batch's tenants and the ids are read. A batch that is run again after a failure overwrites its own folder, so its rows aren't doubled.
    """
    unique = docs.withWatermark(time, delay).dropDuplicatesWithinWatermark(DOC)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = unstored(batch, documents_path, number).persist()
        documents, postings = ingest(rows, document_key, search, key_id, search_key_id, F.col(time))
        write_table(without_keys(documents), f"{documents_path}/batch={number}", "overwrite")
        write_table(without_keys(postings), f"{postings_path}/batch={number}", "overwrite")
        rows.unpersist()
        batch.unpersist()

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


#: Tenants that are written into the filter of the scan at most.
FILTER_TENANTS = 200


def unstored(batch: DataFrame, documents_path: str, number: int) -> DataFrame:
    """Rows of a batch whose ids no other batch under documents_path holds, one of each id."""
    spark = batch.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(documents_path)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    own = batch.dropDuplicates(DOC)
    others = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    if not [x for x in others if x.startswith("batch=") and x != f"batch={number}"]:
        return own
    stored = spark.read.schema("tenant_id string, doc_id string, batch long").parquet(documents_path).filter(F.col("batch") != number)
    tenants = [r[0] for r in own.select("tenant_id").distinct().limit(FILTER_TENANTS + 1).collect()]
    if len(tenants) <= FILTER_TENANTS:
        stored = stored.filter(F.col("tenant_id").isin(tenants))
    return own.join(stored.select(*DOC), DOC, "left_anti")


def rate_limit_stream(requests: DataFrame, limits: dict[str, tuple[int, int]], delay: str) -> DataFrame:
    """Of requests (tenant_id, operation, seq, ts): allowed and retry_after, as observe.rate_limited does for a table.

    State of a key: the times allowed within the window; it goes when the watermark has passed the window.
    """

    def step(own: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tenant, operation = own
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        if operation in limits:
            most, window = limits[operation]
            said = list(throttle(iter(rows["at"]), most, window, accepted))
            state.update((accepted,))
            state.setTimeoutTimestamp(max(int((rows["at"].max() + window) * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            said = [(True, 0)] * len(rows)
        yield pd.DataFrame({"tenant_id": tenant, "operation": operation, "seq": rows["seq"], "allowed": [r[0] for r in said], "retry_after": [r[1] for r in said]})

    at = requests.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts") / 1e6)
    return at.groupBy("tenant_id", "operation").applyInPandasWithState(step, "tenant_id string, operation string, seq long, allowed boolean, retry_after long", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def budget_stream(requests: DataFrame) -> DataFrame:
    """Of requests (tenant_id, seq, epsilon, total): accepted, remaining and warning. State of a tenant: what it has consumed."""

    def step(own: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        consumed = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("seq")
        said = list(spend(zip(rows["epsilon"], rows["total"], strict=True), consumed))
        for (fits, _, _), epsilon in zip(said, rows["epsilon"], strict=True):
            consumed += epsilon if fits else 0.0
        state.update((consumed,))
        yield pd.DataFrame({"tenant_id": own[0], "seq": rows["seq"], "epsilon": rows["epsilon"], "accepted": [r[0] for r in said], "remaining": [r[1] for r in said], "warning": [r[2] for r in said]})

    return requests.groupBy("tenant_id").applyInPandasWithState(step, "tenant_id string, seq long, epsilon double, accepted boolean, remaining double, warning boolean", "consumed double", "append", GroupStateTimeout.NoTimeout)


class ChainStep(StatefulProcessor):
    """State of a keyword: the chain's current state and its counter."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("chain", "current binary, counter long")

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:  # noqa: N802
        self.state.update((bytes(rows["current"].iloc[0]), int(rows["counter"].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        import base64

        new = pd.concat(list(rows)).sort_values("doc_id")
        current, counter = self.state.get() if self.state.exists() else (bytes(new["initial"].iloc[0]), 0)
        current, out = bytes(current), []
        for doc in new["doc_id"]:
            out.append((key[0], doc, counter, current, base64.b64encode(chain_step(current, TAG)).decode()))
            current, counter = chain_step(current, ADVANCE), counter + 1
        self.state.update((current, counter))
        yield pd.DataFrame(out, columns=["keyword", "doc_id", "step", "state", "tag"])

    def close(self) -> None:
        pass


#: What the session must have set for chain_stream: state with types is kept by this provider only.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def chain_stream(updates: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Of updates (keyword, doc_id, initial): the tag of each entry and the state that its key comes from. State of a keyword: current and counter.

    states (keyword, current, counter) is where chains stand before the stream begins: those of a batch index go on. The session needs the settings of STATE_STORE.
    """
    initial = None if states is None else states.select("keyword", "current", "counter").groupBy("keyword")
    return updates.groupBy("keyword").transformWithStateInPandas(ChainStep(), "keyword string, doc_id string, step long, state binary, tag string", "Append", "None", initial)


def metrics_stream(requests: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Requests (operation, failed, latency_ms, ts) by window and operation: count, errors, mean latency."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = requests.withWatermark("ts", delay).groupBy(at.alias("w"), "operation").agg(F.count("*").alias("requests"), F.count_if("failed").alias("errors"), F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"))
    return out.select(F.col("w.start").alias("start"), "operation", "requests", "errors", "mean_latency_ms")


def rapid_stream(transactions: DataFrame, most: int, window: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour", token: Column | str = "account_token") -> DataFrame:
    """Accounts with more than ``most`` transactions in a sliding window."""
    account = F.col(token) if isinstance(token, str) else token
    out = transactions.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w"), account.alias("account_token")).agg(F.count("*").alias("n"))
    return out.filter(F.col("n") > most).select(F.col("w.start").alias("start"), "account_token", "n")
