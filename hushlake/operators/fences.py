"""Order-revealing ciphertexts cut into intervals by fences: ranges that read few files, and a global order by one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import BLOCKS, LEFT, MODULUS, ore_between

#: Ciphertexts that fences are taken from at most, and fences.
SAMPLE, FENCES = 20_000, 256
SIZE = 2 + (LEFT + 2) * BLOCKS


def parts(ciphers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix marks and masked blocks of ciphertexts, a row each; an error for another length or version."""
    head = bytes([1, BLOCKS])
    if any(len(c) != SIZE or c[:2] != head for c in ciphers):
        raise ValueError("malformed ciphertext")
    raw = np.frombuffer(b"".join(ciphers), np.uint8).reshape(len(ciphers), SIZE)
    marks = np.ascontiguousarray(raw[:, 2 : 2 + LEFT * BLOCKS]).view(f">u{LEFT}").astype(np.uint64)
    return marks, np.ascontiguousarray(raw[:, 2 + LEFT * BLOCKS :]).view(">u2").astype(np.int64)


def compared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """-1, 0 or 1 of each row of a and b: the first block that differs decides. An error if its marks differ, since the keys do then."""
    diff = (a[1] - b[1]) % MODULUS
    first = (diff != 0).argmax(axis=1)
    rows = np.arange(len(diff))
    value = diff[rows, first]
    if (a[0][rows, first] != b[0][rows, first]).any():
        raise ValueError("ciphertexts of different keys")
    return np.where(value == 0, 0, np.where(value <= MODULUS // 2, 1, -1))


def compare(a: bytes, b: bytes) -> int:
    return int(compared(parts([a]), parts([b]))[0])


def fit_fences(rows: DataFrame, cipher: str = "ore", fences: int = FENCES) -> list[bytes]:
    """Up to ``fences`` ciphertexts in order that cut the rows into about equal intervals, from a sample of SAMPLE rows (by hash) on the driver.

    Equal ciphertexts give one fence. Without rows there is none.
    """
    n = rows.filter(F.col(cipher).isNotNull()).count()
    share = F.pmod(F.xxhash64(cipher, F.monotonically_increasing_id()), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    found = [bytes(r[0]) for r in rows.filter(F.col(cipher).isNotNull()).filter(share).select(cipher).limit(2 * SAMPLE).collect()]
    found = [found[i] for i in order_of(found)] if found else []
    step = max(1, len(found) // (fences + 1))
    return list(dict.fromkeys(found[step::step]))[:fences]


def order_of(ciphers: list[bytes]) -> np.ndarray:
    """Places of ciphertexts in ascending order, stable, worked out without comparing pairs.

    Masked blocks with one mark differ by their plain blocks, so each block becomes its distance from another one with its mark.
    """
    marks, blocks = parts(ciphers)
    keys = []
    for k in range(BLOCKS):
        _, first, group = np.unique(marks[:, k], return_index=True, return_inverse=True)
        keys.append((blocks[:, k] - blocks[first, k][group] + MODULUS // 2) % MODULUS - MODULUS // 2)
    return np.lexsort(keys[::-1])


def places(ciphers: list[bytes], fences: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each ciphertext the number of fences that are not above it, by binary search for all at once."""
    own = parts(ciphers)
    low, high = np.zeros(len(ciphers), np.int64), np.full(len(ciphers), len(fences[0]))
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(fences[0]) - 1)
        above = compared(own, (fences[0][middle], fences[1][middle])) < 0
        high, low = np.where(open_ & above, middle, high), np.where(open_ & ~above, middle + 1, low)
    return low


def interval(cipher: Column, fences: list[bytes]) -> Column:
    """Number of the fences that are not above a ciphertext; null for null."""
    known = parts(fences) if fences else None

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), dtype="Int32")
        some = values.notna().to_numpy()
        if some.any():
            own = [bytes(v) for v in values[some]]
            out[some] = places(own, known) if known is not None else np.zeros(len(own), np.int64)
        return out

    return run(cipher)


def write_by_interval(rows: DataFrame, fences: list[bytes], path: str, cipher: str = "ore") -> None:
    """rows as Parquet in a folder for each interval; a large interval (many equal values) is spread over files."""
    rows.withColumn("interval", interval(F.col(cipher), fences)).hint("rebalance", "interval").write.partitionBy("interval").parquet(path)


def read_range(spark: SparkSession, path: str, fences: list[bytes], low: bytes | None = None, high: bytes | None = None, cipher: str = "ore") -> DataFrame:
    """Rows of write_by_interval from low to high (ciphertexts; either may be open). Only the folders of the bounds' intervals and those between are read, and only the
    bounds' own rows are compared; rows without a ciphertext are left out."""
    if (low is not None and len(low) != SIZE) or (high is not None and len(high) != SIZE):
        raise ValueError("malformed ciphertext")
    known = parts(fences) if fences else None
    place = lambda c: int(places([c], known)[0]) if known is not None else 0
    rows, number = spark.read.parquet(path), F.col("interval")
    first, last = 0 if low is None else place(low), len(fences) if high is None else place(high)
    rows = rows.filter(number.between(first, last))
    inside = F.lit(True)
    if low is not None:
        inside = inside & ((number > first) | ore_between(F.col(cipher), F.lit(low)))
    if high is not None:
        inside = inside & ((number < last) | ore_between(F.col(cipher), None, F.lit(high)))
    return rows.filter(inside)


def global_order(rows: DataFrame, fences: list[bytes], ids: str, cipher: str = "ore") -> DataFrame:
    """(ids, place): every row's place from 0 in the order of the plain values, of equal ones by ids.

    One exchange deals rows out by interval; a task sorts one interval at a time, and the counts of the intervals before are added. Null ciphertexts have no
    place. ids is a column of long numbers; other columns are left out.
    """
    marked = rows.filter(F.col(cipher).isNotNull()).select(F.col(ids).cast("long").alias("id"), F.col(cipher).alias("cipher"))
    marked = marked.withColumn("interval", interval(F.col("cipher"), fences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            number = np.array(table.column(0).to_pylist(), np.int64)
            by_id = np.argsort(number, kind="stable")
            ciphers = table.column(1).to_pylist()
            order = by_id[order_of([ciphers[i] for i in by_id])]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(order), now, np.int32)), pa.array(number[order]), pa.array(np.arange(len(order)))], names=["interval", "id", "nth"])

        for batch in batches:
            numbers = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if now is not None and numbers[a] != now:
                    yield flush()
                    held = []
                now = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    sorted_rows = marked.repartition("interval").sortWithinPartitions("interval").mapInArrow(run, "interval int, id long, nth long")
    counts = marked.groupBy("interval").agg(F.count("*").alias("n"))  # FENCES + 1 rows at most
    before = counts.select("interval", F.expr("coalesce(sum(n) OVER (ORDER BY interval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    return sorted_rows.join(F.broadcast(before), "interval").select(F.col("id").alias(ids), (F.col("nth") + F.col("before")).alias("place"))
