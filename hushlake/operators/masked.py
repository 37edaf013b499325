"""Sums over masked columns, where only the total is unmasked, and scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prf import first_bytes, hmac256, unsigned
from ..sources.keys import Key

MODULUS = 2**64


def dec(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def pad(row_id: Column, column: str, mask: Key) -> Column:
    """The row's mask for one column: never used for a second value."""
    return unsigned(first_bytes(hmac256(mask, F.concat(F.lit(f"{column}|"), row_id.cast("string"))), 8)).cast("decimal(38,0)")


def fixed(value: Column, digits: int) -> Column:
    """Value as an integer of 10**-digits units."""
    return F.round(value.cast("double") * 10**digits).cast("long")


def masked(units: Column, row_id: Column, column: str, mask: Key) -> Column:
    """Units plus the row's mask modulo 2**64, DECIMAL(20,0)."""
    return F.pmod(units.cast("decimal(38,0)") + pad(row_id, column, mask), dec(MODULUS)).cast("decimal(20,0)")


def centred(number: Column) -> Column:
    """A number modulo 2**64 as one around 0."""
    number = F.pmod(number.cast("decimal(38,0)"), dec(MODULUS))
    return F.when(number >= dec(MODULUS // 2), number - dec(MODULUS)).otherwise(number)


def masked_total(rows: DataFrame, group: list[str], cipher: str) -> DataFrame:
    """(group, total, n): sum of the masked values modulo 2**64: the server's part, without keys."""
    return rows.groupBy(*group).agg(F.pmod(F.sum(F.col(cipher).cast("decimal(28,0)")), dec(MODULUS)).alias("total"), F.count("*").alias("n"))


def pad_total(ids: DataFrame, group: list[str], row_id: str, columns: dict[str, int], mask: Key) -> DataFrame:
    """(group, pads): sum of the rows' masks, each column's times its integer weight: the client's part, from ids alone."""
    term = None
    for column, weight in columns.items():
        own = F.pmod(pad(F.col(row_id), column, mask) * F.lit(weight).cast("decimal(10,0)"), dec(MODULUS))
        term = own if term is None else term + own
    return ids.groupBy(*group).agg(F.sum(term.cast("decimal(28,0)")).alias("pads"))


def unmasked(totals: DataFrame, pads: DataFrame, group: list[str], digits: int) -> DataFrame:
    """(group, value, mean)."""
    both = totals.join(pads, group) if group else totals.join(pads)
    value = centred(F.col("total") - F.pmod(F.col("pads"), dec(MODULUS))).cast("double") / 10**digits
    return both.select(*group, value.alias("value"), (value / F.col("n")).alias("mean"))


def weighted_cipher(ciphers: dict[str, int]) -> Column:
    """Weighted sum of masked columns of one row, integer weights, modulo 2**64."""
    out = dec(0)
    for column, weight in ciphers.items():
        out = out + F.pmod(F.col(column).cast("decimal(28,0)") * F.lit(weight).cast("decimal(10,0)"), dec(MODULUS))
    return F.pmod(out, dec(MODULUS)).cast("decimal(20,0)")


def add_masked(a: Column, b: Column, minus: bool = False) -> Column:
    """Masked plus or minus masked: the masks combine the same way."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return F.pmod(a - b if minus else a + b, dec(MODULUS)).cast("decimal(20,0)")


def add_plain(a: Column, units: Column) -> Column:
    return F.pmod(a.cast("decimal(38,0)") + units.cast("decimal(38,0)"), dec(MODULUS)).cast("decimal(20,0)")


def times_plain(a: Column, factor: int) -> Column:
    """Masked times a plain integer; the mask is multiplied too."""
    return F.pmod(a.cast("decimal(28,0)") * F.lit(factor).cast("decimal(10,0)"), dec(MODULUS)).cast("decimal(20,0)")


def unmask(a: Column, pads: Column) -> Column:
    """Units of one masked number whose masks add up to pads."""
    return centred(a.cast("decimal(38,0)") - F.pmod(pads, dec(MODULUS)))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; null for different lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


#: Caps and weights of the score.
CAPS = {"income": 100_000.0, "debt": 50_000.0, "history": 120.0}
WEIGHTS = {"income": 0.3, "debt": -0.2, "history": 0.5}


def scaled_weights(weights: dict[str, float] | None = None, scale: int = 10**9) -> dict[str, int]:
    """Weights over caps as integers: what masked columns are multiplied by."""
    weights = weights or WEIGHTS
    return {k: round(weights[k] / CAPS[k] * scale) for k in CAPS}


def credit_score(raw: Column) -> Column:
    """300 + 550 * raw within 300 to 850."""
    return F.greatest(F.lit(300.0), F.least(F.lit(850.0), 300 + 550 * raw))


def debt_to_income(income: Column, debt: Column) -> Column:
    """Infinite at zero income."""
    return F.when(income == 0, F.lit(float("inf"))).otherwise(debt / F.when(income != 0, income))
