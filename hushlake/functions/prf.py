"""HMAC-SHA-256 from built-in functions, and numbers drawn from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.keys import Key


def hmac256(key: Key, message: Column) -> Column:
    """32 bytes of HMAC-SHA-256; a text message counts as UTF-8."""
    first = F.unhex(F.sha2(F.concat(key.inner, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(key.outer, first), 256))


def first_bytes(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def unsigned(value: Column) -> Column:
    """Up to 8 bytes as an unsigned number, DECIMAL(20,0)."""
    return F.conv(F.hex(value), 16, 10).cast("decimal(20,0)")


def uniform(key: Key, *parts: Column) -> Column:
    """A number in [0, 1) fixed by key and parts: the first 53 bits of their HMAC."""
    text = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    bits = F.conv(F.hex(first_bytes(hmac256(key, text), 7)), 16, 10).cast("long")
    return F.shiftright(bits, 3) * F.lit(2.0**-53)


def big_endian(value: Column, n: int) -> Column:
    """The n low bytes of a non-negative integer."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 2 * n, "0"), F.lit(2 * n)))
