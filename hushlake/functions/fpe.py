"""FF1 format-preserving encryption over an alphabet."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numerals as worker

DIGITS, LOWER, ALNUM = "0123456789", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_DOMAIN, ROUNDS = 1_000_000, 10


def ff1(text: Column, key: Column, n: int, alphabet: str = DIGITS, tweak: Column | None = None, tweak_length: int = 0, back: bool = False) -> Column:
    """FF1 of texts of n characters of alphabet, of any n; the AES key may be 16, 24 or 32 bytes; back decrypts.

    tweak is a binary column of tweak_length bytes. Texts of another length or with other characters give null. The
    domain must have LEAST_DOMAIN values at least. Runs in Python workers, on the numerals of a batch of rows at once.
    """
    return ff1_any(text, key, range(n, n + 1), alphabet, tweak=tweak, tweak_length=tweak_length, back=back)


def frame(n: int, radix: int, tweak_length: int) -> tuple[int, int, bytes, bytes]:
    """Bytes of a half as a number, bytes of a round's number, the first block, and the zeros that fill up the tweak."""
    u = n // 2
    b = ((radix ** (n - u) - 1).bit_length() + 7) // 8
    fixed = bytes([1, 2, 1]) + radix.to_bytes(3, "big") + bytes([10, u % 256]) + n.to_bytes(4, "big") + tweak_length.to_bytes(4, "big")
    return b, 4 * math.ceil(b / 4) + 4, fixed, bytes((-tweak_length - b - 1) % 16)


def ff1_numerals(numerals: Column, key: Column, n: int, radix: int, tweak: Column | None = None, tweak_length: int = 0, back: bool = False) -> Column:
    """FF1 of arrays of n numerals below radix (2 to 65536), of any n; back decrypts. Arrays of another length or with other numerals give null."""
    if not 2 <= radix <= 65536 or n < 2 or n > (1 << 31) or radix**n < LEAST_DOMAIN:
        raise ValueError("radix must be 2 to 65536 and the domain large enough")
    made = F.arrow_udf(worker.of_arrays(n, radix, frame(n, radix, tweak_length), tweak_length, ROUNDS, back), "array<int>")
    return made(numerals.cast("array<int>"), key, F.lit(b"") if tweak is None else tweak)


def ff1_any(text: Column, key: Column, lengths: range, alphabet: str = DIGITS, tweak: Column | None = None, tweak_length: int = 0, back: bool = False) -> Column:
    """ff1 for texts of several lengths."""
    radix = len(alphabet)
    if any(n < 2 or radix**n < LEAST_DOMAIN for n in lengths):
        raise ValueError("the domain is too small")
    frames = {n: frame(n, radix, tweak_length) for n in lengths}
    made = F.arrow_udf(worker.of_texts(frames, alphabet, tweak_length, ROUNDS, back), "string")
    return made(text, key, F.lit(b"") if tweak is None else tweak)


def in_shape(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in turn by those of digits; separators keep their places."""
    return F.arrow_udf(worker.shaped, "string")(shape, digits)


def fpe_digits(text: Column, key: Column, lengths: range, **options) -> Column:
    """Digits of card, social security or account numbers encrypted, separators kept: 12 to 19, 9, 6 to 20 digits."""
    return in_shape(text, ff1_any(F.regexp_replace(text, "[^0-9]", ""), key, lengths, **options))
