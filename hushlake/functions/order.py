"""Order-preserving and order-revealing encryption of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.keys import Key, derived
from .prf import big_endian, first_bytes, hmac256, unsigned

PLAIN_MAX, CIPHER_MAX = 2**32 - 1, 2**64 - 1
BLOCKS, LEFT, MODULUS = 4, 8, 1 << 16
#: Fixed labels of the two subkeys of order-revealing encryption.
LEFT_LABEL, RIGHT_LABEL = b"ore-lewi-wu-left", b"ore-lewi-wu-right"


def checked(value: Column, most: int, on_invalid: str) -> Column:
    """value where it is 0 to most; else an error, or null with on_invalid='null'."""
    fits = value.between(0, most)
    bad = F.raise_error(F.lit(f"value must be between 0 and {most}")).cast("long") if on_invalid == "error" else F.lit(None).cast("long")
    return F.when(value.isNull(), F.lit(None).cast("long")).when(fits, value.cast("long")).otherwise(bad)


def scaled(amount: Column, precision: int = 2, on_invalid: str = "error") -> Column:
    """Amount as an integer of 10**-precision units, cut like a float (19.99 gives 1998); negative amounts are refused."""
    units = (amount.cast("double") * float(10**precision)).cast("long")
    return checked(F.when(amount < 0, F.lit(-1)).otherwise(units), PLAIN_MAX, on_invalid)


def ope_encrypt(value: Column, key: Key, plain_bits: int = 32, cipher_bits: int = 64, on_invalid: str = "error") -> Column:
    """DECIMAL(20,0) whose order is that of value: a linear map plus noise from the key.

    For 32 to 64 bits the value can be read off without the key (see ope_decrypt_open): for migration only.
    """
    plain_max, cipher_max = 2**plain_bits - 1, 2**cipher_bits - 1
    value = checked(value, plain_max, on_invalid)
    noise_range = max(1, cipher_max // (plain_max * 10))
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    if cipher_max % plain_max == 0:
        base = (value.cast("decimal(10,0)") * F.lit(str(cipher_max // plain_max)).cast("decimal(20,0)")).cast("decimal(38,0)")
    else:
        whole = value.cast("decimal(20,0)") * F.lit(str(cipher_max)).cast("decimal(18,0)")
        base = ((whole - whole % big(plain_max)) / big(plain_max)).cast("decimal(38,0)")
    noise = unsigned(first_bytes(hmac256(key, big_endian(value, 8)), 8)) % F.lit(str(noise_range)).cast("decimal(20,0)")
    return F.least(base + noise, big(cipher_max)).cast("decimal(20,0)")


def ope_bound(value: int, key: bytes, plain_bits: int = 32, cipher_bits: int = 64) -> Column:
    """The ciphertext of one number as a literal, worked out once on the driver: filters with it reach the scan, and it holds no key."""
    plain_max, cipher_max = 2**plain_bits - 1, 2**cipher_bits - 1
    if not 0 <= value <= plain_max:
        raise ValueError(f"value must be between 0 and {plain_max}")
    noise = int.from_bytes(derived(key, value.to_bytes(8, "big"))[:8], "big") % max(1, cipher_max // (plain_max * 10))
    return F.lit(str(min(value * cipher_max // plain_max + noise, cipher_max))).cast("decimal(20,0)")


def ope_decrypt_open(cipher: Column) -> Column:
    """The value of a 32 to 64 bit order-preserving ciphertext, without any key."""
    return F.floor(cipher / F.lit(str(2**32 + 1)).cast("decimal(20,0)")).cast("long")


def ope_bytes(cipher: Column) -> Column:
    """8 bytes, most significant first."""
    return F.unhex(F.lpad(F.conv(cipher.cast("string"), 10, 16), 16, "0"))


def ope_base64(cipher: Column) -> Column:
    """The 8 bytes as text."""
    return F.base64(ope_bytes(cipher))


def ope_from_bytes(raw: Column) -> Column:
    """The ciphertext of 8 bytes, most significant first."""
    return unsigned(raw)


def ope_compare(a: Column, b: Column) -> Column:
    return F.when(a > b, 1).when(a < b, -1).when(a == b, 0)


def ore_keys(key: bytes) -> dict[str, bytes]:
    """Subkeys for with_keys: names ore_left and ore_right."""
    return {"ore_left": derived(key, LEFT_LABEL), "ore_right": derived(key, RIGHT_LABEL)}


def ore_encrypt(value: Column, left: Key, right: Key, on_invalid: str = "error") -> Column:
    """42 bytes: version, block count, 4 prefix marks of 8 bytes, 4 masked blocks of 2 bytes."""
    value = checked(value, PLAIN_MAX, on_invalid)
    lefts, rights = [], []
    for i in range(BLOCKS):
        prefix = F.concat(F.lit(bytes([i])), big_endian(F.shiftright(value, 32 - 8 * i), i)) if i else F.when(value.isNotNull(), F.lit(bytes([0])))
        lefts.append(first_bytes(hmac256(left, prefix), LEFT))
        block = F.shiftright(value, 24 - 8 * i).bitwiseAND(255)
        mask = unsigned(first_bytes(hmac256(right, prefix), 4)).cast("long")
        rights.append(big_endian((block + mask) % MODULUS, 2))
    return F.concat(F.lit(bytes([1, BLOCKS])), *lefts, *rights)


def ore_bound(value: int, key: bytes) -> Column:
    """The ciphertext of one number as a literal, worked out once on the driver."""
    return F.lit(ore_of_one(value, key))


def ore_of_one(value: int, key: bytes) -> bytes:
    """The ciphertext of one number, on the driver."""
    if not 0 <= value <= PLAIN_MAX:
        raise ValueError(f"value must be between 0 and {PLAIN_MAX}")
    keys, marks, blocks = ore_keys(key), b"", b""
    for i in range(BLOCKS):
        prefix = bytes([i]) + value.to_bytes(BLOCKS, "big")[:i]
        marks += derived(keys["ore_left"], prefix)[:LEFT]
        mask = int.from_bytes(derived(keys["ore_right"], prefix)[:4], "big")
        blocks += (((value >> 24 - 8 * i & 255) + mask) % MODULUS).to_bytes(2, "big")
    return bytes([1, BLOCKS]) + marks + blocks


def ore_left(cipher: Column, i: int) -> Column:
    return F.substring(cipher, 3 + LEFT * i, LEFT)


def ore_right(cipher: Column, i: int) -> Column:
    return unsigned(F.substring(cipher, 3 + LEFT * BLOCKS + 2 * i, 2)).cast("int")


def ore_compare(a: Column, b: Column) -> Column:
    """-1, 0, 1; an error for another version or length, or for ciphertexts of different keys; null for null."""
    size = 2 + (LEFT + 2) * BLOCKS
    fits = lambda c: (F.length(c) == size) & (F.substring(c, 1, 2) == F.lit(bytes([1, BLOCKS])))
    fail = lambda text: F.raise_error(F.lit(text)).cast("int")

    def judged(s: Column) -> Column:
        a, b, out = s["a"], s["b"], F.lit(0)
        for i in reversed(range(BLOCKS)):
            diff = F.pmod(ore_right(a, i) - ore_right(b, i), F.lit(MODULUS))
            own = F.when(diff == 0, out).when(diff <= MODULUS // 2, F.lit(1)).otherwise(F.lit(-1))
            out = F.when(ore_left(a, i) != ore_left(b, i), fail("ciphertexts of different keys")).otherwise(own)
        return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(~fits(a) | ~fits(b), fail("malformed ciphertext")).otherwise(out)

    # One lambda over both, so that a ciphertext that is computed in the plan is computed once.
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), judged)[0]


def ore_between(cipher: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Inclusive range; either bound may be open."""
    out = F.lit(True)
    if low is not None:
        out = out & (ore_compare(cipher, low) >= 0)
    if high is not None:
        out = out & (ore_compare(cipher, high) <= 0)
    return out


def ore_ranks(df: DataFrame, cipher: str = "ore") -> DataFrame:
    """Adds step_0 to step_3, by which rows sort as their plain values do: for a global sort without pairwise comparison.

    Within rows of equal prefix marks, masked blocks differ by plain blocks; step_i is the distance from the group's smallest.
    Each step is an aggregation by mark and a join back, never a window over all rows.
    """
    for i in range(BLOCKS):
        mark, block = ore_left(F.col(cipher), i), ore_right(F.col(cipher), i)
        df = df.withColumns({"__mark": mark, "__block": block})
        some = df.groupBy("__mark").agg(F.min("__block").alias("__ref"))
        off = lambda b, r: F.pmod(b - r + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2
        # All rows have one mark in the first step, so its one row must not be met by a shuffle on it.
        df = df.join(F.broadcast(some) if i == 0 else some, "__mark", "left")
        low = df.groupBy("__mark").agg(F.min(off(F.col("__block"), F.col("__ref"))).alias("__low"))
        df = df.join(F.broadcast(low) if i == 0 else low, "__mark", "left").withColumn(f"step_{i}", (off(F.col("__block"), F.col("__ref")) - F.col("__low")).cast("int")).drop("__mark", "__block", "__ref", "__low")
    return df
