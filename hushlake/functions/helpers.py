"""All code of this library that runs in Python workers."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .text import JSON_DEPTH, REDACTIONS, SENSITIVE_NAMES, deeper_than, redact, redact_variant


def unicode_normalize(text: Column, form: str = "NFKC") -> Column:
    """Normal form of a text; pure ASCII, which has only one form, skips the worker."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.str.normalize(form)

    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(run(text))


def redact_json(text: Column) -> Column:
    """JSON of any depth with values of sensitive names hidden and other texts redacted; what isn't JSON is redacted as text."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        patterns = [(re.compile(p), m) for p, m in REDACTIONS]

        def said(value: str) -> str:
            for p, m in patterns:
                value = p.sub(m, value)
            return value

        def clean(name: str, value: object) -> object:
            if isinstance(value, dict):
                return {k: clean(k, v) for k, v in value.items()}
            if isinstance(value, list):
                return [clean(name, v) for v in value]
            if name.lower() in SENSITIVE_NAMES:
                return "[REDACTED]"
            return said(value) if isinstance(value, str) else value

        def one(value: str | None) -> str | None:
            if value is None:
                return None
            try:
                return json.dumps(clean("", json.loads(value)))
            except ValueError:
                return said(value)

        return values.map(one)

    return run(text)


def redacted_json(rows: DataFrame, column: str, depth: int = JSON_DEPTH) -> DataFrame:
    """rows with JSON texts redacted as redact_json does, in no promised form (order of names, spaces).

    JSON of up to ``depth`` levels is rebuilt by expressions, and what isn't JSON is redacted as text. Only deeper JSON, and what looks like JSON but can't be a
    VARIANT (a name twice in an object), goes through a Python worker.
    """
    value = F.try_parse_json(column)
    odd = value.isNull() & F.coalesce(F.col(column).rlike(r"^\s*[\[{]"), F.lit(False))
    marked = rows.withColumn("__deep", deeper_than(value, depth) | odd)
    near = F.coalesce(F.to_json(redact_variant(value, depth)), redact(F.col(column)))
    return marked.filter("NOT __deep").withColumn(column, near).unionByName(marked.filter("__deep").withColumn(column, redact_json(F.col(column)))).drop("__deep")


def spend(requests: Iterator[tuple[float, float]], consumed: float = 0.0) -> Iterator[tuple[bool, float, bool]]:
    """Of each (epsilon, total) in order: accepted, what is left, and whether at most a fifth is left. Refused requests cost nothing."""
    for epsilon, total in requests:
        fits = epsilon > 0 and not epsilon > total - consumed
        if fits:
            consumed += epsilon
        left = total - consumed
        yield fits, left, fits and left / total <= 0.2


def throttle(times: Iterator[float], most: int, window: float, accepted: list[float]) -> Iterator[tuple[bool, int]]:
    """Of each time in order: allowed, and seconds until a retry. accepted holds the times allowed within the window, and is updated."""
    for now in times:
        cutoff = now - window
        accepted[:] = [t for t in accepted if t > cutoff]
        if len(accepted) >= most:
            yield False, max(int(accepted[0] - cutoff) + 1, 1)
        else:
            accepted.append(now)
            yield True, 0


def by_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable[[dict, tuple], Iterable[tuple]], schema: str) -> DataFrame:
    """Folds the rows of each key in order. Rows are sorted within partitions and stream through: a key of any size needs no more memory than its state.

    step(state, row) gets a mutable dict of the key, empty at its first row, and the row's keys and columns; it gives out tuples of schema. A batch
    is folded in one pass, whatever keys it holds.
    """
    used = list(dict.fromkeys([*keys, *order, *columns]))
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            lists = {c: batch.column(used.index(c)).to_pylist() for c in {*keys, *columns}}
            out = []
            for own, row in zip(zip(*(lists[c] for c in keys), strict=True), zip(*(lists[c] for c in columns), strict=True), strict=True):
                if own != now:
                    now, state = own, {}
                out.extend((*own, *x) for x in step(state, row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    made = to_arrow_schema(T._parse_datatype_string(schema))
    kinds = [f.type for f in made]
    return rows.select(*used).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def chain_step(state: bytes, label: bytes) -> bytes:
    return hmac.new(state, label, hashlib.sha256).digest()


#: Fixed labels of the chain of a keyword.
ADVANCE, TAG, ENTRY = b"fp-chain-advance", b"fp-index-tag", b"fp-entry-key"


def expand_chain(states: DataFrame) -> DataFrame:
    """(keyword, step, state, tag, next_state) of rows (keyword, start, steps) and, if there, first (the step of start, else 0): that many steps of a hash chain.

    next_state stands at the last step only, since before it is the state of the next row.
    Only a row's steps are sequential; a chain of which several states are known is walked from all of them at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for keyword, first, start, steps in zip(batch["keyword"], batch["first"], batch["start"], batch["steps"], strict=True):
                state = bytes(start)
                last = int(first) + int(steps) - 1
                for step in range(int(first), last + 1):
                    after = chain_step(state, ADVANCE)
                    out.append((keyword, step, state, base64.b64encode(chain_step(state, TAG)).decode(), after if step == last else None))
                    state = after
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=["keyword", "step", "state", "tag", "next_state"])
                        out = []
            yield pd.DataFrame(out, columns=["keyword", "step", "state", "tag", "next_state"])

    first = F.col("first") if "first" in states.columns else F.lit(0)
    return states.select("keyword", first.cast("long").alias("first"), "start", "steps").mapInPandas(run, "keyword string, step long, state binary, tag string, next_state binary")


def entry_key(state: Column, salt: Column) -> Column:
    """Key of one entry: HMAC-SHA-256 under the chain's state (32 bytes, another one each row) of a label and a salt."""
    block = F.hex(state)
    # Eight bytes at a time as a signed number.
    part = lambda i, byte: F.lpad(F.hex(F.conv(F.substring(block, 16 * i + 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(int(f"{byte:02x}" * 8, 16)))), 16, "0")
    pad = lambda byte: F.unhex(F.concat(*[part(i, byte) for i in range(4)], F.lit(f"{byte:02x}" * 32)))
    first = F.unhex(F.sha2(F.concat(pad(0x36), F.lit(ENTRY), salt), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), first), 256))


def runs_in_blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over postings (tenant_id, token, doc_id, part) sorted by tenant_id and doc_id: the blocks of each run of ``size`` documents of a tenant. One run's postings are held at a time."""

    def block(table: pa.Table, part: int, run: int) -> pa.RecordBatch:
        found = table.group_by(["token", "doc_id"]).aggregate([]).sort_by([("token", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        token, docs = (found.column(c).combine_chunks() if found.column(c).num_chunks != 1 else found.column(c).chunk(0) for c in ("token", "doc_id"))
        codes = token.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])).astype(np.int32)
        ends = np.append(starts[1:], np.int32(len(codes))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), docs)
        tenant = table.column("tenant_id")[0].as_py()
        columns = [pa.array([tenant] * len(starts), pa.string()), token.take(pa.array(starts)), pa.array(np.full(len(starts), (part << 32) + run)), pa.array(ends - starts), docs.take(pa.array(starts)), docs.take(pa.array(ends - 1)), lists]
        return pa.RecordBatch.from_arrays(columns, names=["tenant_id", "token", "range", "n", "first_doc", "last_doc", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, seen, number, last = None, 0, 0, None  # tenant, documents of the run, number of the run, last document
        for batch in batches:
            part, start = batch.column("part")[0].as_py() if batch.num_rows else 0, 0
            tenants, docs = batch.column("tenant_id").to_pylist(), batch.column("doc_id").to_pylist()
            rows = batch.select(["tenant_id", "token", "doc_id"])
            for i, (tenant, doc) in enumerate(zip(tenants, docs, strict=True)):
                if last is not None and (tenant, doc) == last:
                    continue
                # A new document.
                if last is not None and (tenant != now or seen == size):
                    held.append(rows.slice(start, i - start))
                    yield block(pa.Table.from_batches(held), part, number)
                    held, start, number = [], i, number + 1
                    seen = 0
                number = 0 if tenant != now else number
                now, last, seen = tenant, (tenant, doc), seen + 1
            if batch.num_rows:
                held.append(rows.slice(start))
                own = part
        if last is not None:
            yield block(pa.Table.from_batches(held), own, number)

    return run
