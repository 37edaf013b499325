"""Audit rows and roll-ups, request metrics, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import by_key, throttle
from ..functions.text import clean_details, redact

#: Names of audit events, event names by kind of search, bounds of latency buckets in seconds, limits by operation.
EVENTS = ["key.generate", "key.rotate", "key.delete", "key.access", "key.export", "key.import", "key.wrap", "key.unwrap", "auth.login", "auth.logout", "auth.token_refresh", "auth.failure", "authz.denied", "crypto.encrypt", "crypto.decrypt", "search.keyword", "search.boolean", "search.range", "config.change"]
SEARCH_EVENTS = {"keyword": "search.keyword", "boolean": "search.boolean", "range": "search.range"}
BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
LIMITS = {"equality_search": (100, 60), "range_search": (10, 60), "keyword_search": (100, 60), "encrypt": (100, 60), "decrypt": (100, 60), "document_ingest": (60, 60), "document_search": (120, 60), "document_get": (120, 60), "rag_retrieve": (120, 60), "read": (1000, 60), "key_rotate": (5, 60)}


def search_event(kind: Column) -> Column:
    """Event name of a kind of search; unknown kinds count as keyword search."""
    out = F.lit("search.keyword")
    for name, event in SEARCH_EVENTS.items():
        out = F.when(kind == name, event).otherwise(out)
    return out


def audit_entry(event: Column, actor: Column, success: Column, resource: Column, details: Column, request_id: Column) -> Column:
    """One audit entry: resource and details redacted, hidden details left out, the level by outcome."""
    return F.struct(event.alias("event_type"), actor.alias("actor"), success.alias("success"), redact(resource).alias("resource"), clean_details(details).alias("details"), request_id.alias("request_id"), F.when(success, "INFO").otherwise("WARNING").alias("level"))


def event_shape(kind: Column, subject: Column, detail: Column, count: Column) -> Column:
    """Struct (event_type, resource, details, success) of an event by its kind.

    key.generate, key.rotate and key.access name the key and its type, successor or operation; key.delete the key alone; auth.failure the reason,
    without a resource; search.* the kind of search and its number of results; config.change the setting. Other kinds have no details.
    """
    none = F.create_map().cast("map<string,string>")
    named = {"key.generate": "key_type", "key.rotate": "new_key_id", "key.access": "operation", "auth.failure": "reason"}
    details = F.when(F.startswith(kind, F.lit("search.")), F.create_map(F.lit("query_type"), F.substring_index(kind, ".", -1), F.lit("result_count"), F.coalesce(count, F.lit(0)).cast("string")))
    for event, name in named.items():
        details = details.when(kind == event, F.create_map(F.lit(name), detail))
    details = details.when(kind == "config.change", F.create_map(F.lit("setting"), subject)).otherwise(none)
    resource = F.when(kind.isin("key.generate", "key.rotate", "key.access", "key.delete"), subject).otherwise("")
    return F.struct(kind.alias("event_type"), resource.alias("resource"), details.alias("details"), (kind != "auth.failure").alias("success"))


def audit_rollup(entries: DataFrame) -> DataFrame:
    """(tenant_id, event_group, event_type, n, failures, depth): one pass for all levels; what is rolled up is null."""
    rows = entries.withColumn("event_group", F.substring_index("event_type", ".", 1))
    return rows.rollup("tenant_id", "event_group", "event_type").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failures"), F.grouping_id().cast("long").alias("depth"))


def latest(entries: DataFrame, by: str, n: int, order: str = "id") -> DataFrame:
    """The newest n entries of each key or tenant, with rank."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return entries.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def request_metrics(requests: DataFrame) -> DataFrame:
    """By endpoint and in total (null): requests, errors, tenants, mean latency in ms rounded to 2, of rows (tenant_id, operation, failed, latency_ms)."""
    return requests.groupingSets([["operation"], []], "operation").agg(F.count("*").alias("requests"), F.count_if("failed").alias("errors"), F.countDistinct("tenant_id").alias("tenants"), F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"))


def counters(events: DataFrame) -> DataFrame:
    """Counts by (operation, status), (operation, error_type) and search_type in one pass; kind says which."""
    sets = [["operation", "status"], ["operation", "error_type"], ["search_type"]]
    out = events.groupingSets(sets, "operation", "status", "error_type", "search_type").agg(F.count("*").alias("n"), F.grouping_id("operation", "status", "error_type", "search_type").alias("g"))
    kind = F.when(F.col("g") == 3, "operations").when(F.col("g") == 5, "errors").otherwise("searches")
    wanted = (F.col("g") == 3) | ((F.col("g") == 5) & F.col("error_type").isNotNull()) | ((F.col("g") == 14) & F.col("search_type").isNotNull())
    return out.filter(wanted).select(kind.alias("kind"), "operation", "status", "error_type", "search_type", "n")


def latency_histogram(requests: DataFrame, latency: str = "latency_s", by: str = "operation") -> DataFrame:
    """Cumulative buckets of latency by operation: (operation, le, n), le 'Inf' for all, in one aggregation."""
    names = [*map(str, BUCKETS), "Inf"]
    counts = requests.groupBy(by).agg(F.array(*[F.count_if(F.col(latency) <= b) for b in BUCKETS], F.count("*")).alias("c"))
    return counts.select(by, F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("le"), F.col("c").alias("n"))).alias("x")).select(by, "x.le", "x.n")


def hit_ratio(hits: Column, misses: Column) -> Column:
    """Share of hits, 0 without requests."""
    return F.coalesce(hits / F.nullif(hits + misses, F.lit(0)), F.lit(0.0))


def with_limits(requests: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds most, span (seconds) and bucket (time over span) of the request's operation; null where it has no limit."""
    value = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, float(v[i]))]), F.col("operation")) if limits else F.lit(None).cast("double")
    rows = requests.withColumns({"most": value(0).cast("int"), "span": value(1)})
    return rows.withColumn("bucket", F.floor(F.col("at") / F.col("span")))


def busy_stretches(rows: DataFrame) -> DataFrame:
    """(tenant_id, operation, bucket, stretch, busy) of requests with limits: the times in which a limit can be exceeded, and the time before each of them.

    A window lies in two neighbouring buckets, so a bucket is busy if it and the one before it hold more requests than the limit. Busy neighbours
    are one stretch, which begins with a bucket whose requests all pass. One counting aggregation, and windows over its rows.
    """
    counts = rows.filter("most IS NOT NULL").groupBy("tenant_id", "operation", "most", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tenant_id", "operation").orderBy("bucket")
    beside = lambda f, c: F.coalesce(F.when(F.abs(f("bucket").over(w) - F.col("bucket")) == 1, f(c).over(w)), F.lit(0).cast("long"))
    marked = counts.withColumn("busy", F.col("n") + beside(F.lag, "n") > F.col("most")).withColumn("b", F.col("busy").cast("long"))
    marked = marked.withColumns({"starts": F.col("busy") & (beside(F.lag, "b") == 0), "following": beside(F.lead, "b")})
    stretch = F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("stretch", stretch + F.when(F.col("busy"), 0).otherwise(1))
    return marked.filter(F.col("busy") | (F.col("following") == 1)).select("tenant_id", "operation", "bucket", "stretch", "busy")


def limited_parts(requests: DataFrame, limits: dict[str, tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Of rate_limited: the requests that pass by counts alone, and those that have to be folded in order with those just before them."""
    rows = with_limits(requests, limits)
    busy = busy_stretches(rows).select(F.struct("tenant_id").alias("__tenant"), F.col("operation").alias("__operation"), F.col("bucket").alias("__bucket"), "stretch", "busy")
    same = (F.struct("tenant_id") == F.col("__tenant")) & (F.col("operation") == F.col("__operation")) & (F.col("bucket") == F.col("__bucket"))
    rows = rows.join(busy, same, "left").drop("__tenant", "__operation", "__bucket", "bucket")
    return rows.filter("busy IS NULL OR NOT busy"), rows.filter("busy IS NOT NULL")


def rate_limited(requests: DataFrame, limits: dict[str, tuple[int, int]], order: list[str]) -> DataFrame:
    """(tenant_id, operation, seq, allowed, retry_after) of requests (tenant_id, operation, seq, at in seconds), in order for each tenant and operation.

    Allowed while fewer than the operation's limit were allowed in the window before (its older edge excluded); refused
    requests don't count. Operations without a limit pass. Only busy stretches of time are folded in order, in a Python worker and each by itself; all
    other requests pass by counts of theirs.
    """
    calm, busy = limited_parts(requests.select("tenant_id", "operation", "seq", "at", *[c for c in order if c not in ("seq", "at")]), limits)

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        seq, at, most, span, judged = row
        allowed, after = next(throttle(iter([at]), most, span, state.setdefault("accepted", [])))
        if judged:
            yield seq, allowed, after

    folded = by_key(busy, ["tenant_id", "operation", "stretch"], order, ["seq", "at", "most", "span", "busy"], step, "tenant_id string, operation string, stretch long, seq long, allowed boolean, retry_after long")
    passed = calm.select("tenant_id", "operation", "seq", F.lit(True).alias("allowed"), F.lit(0).cast("long").alias("retry_after"))
    return passed.unionByName(folded.drop("stretch"))
