"""Tokens and ciphertexts of values: blind index, deterministic and randomised AES, versioned blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.keys import Key
from .helpers import unicode_normalize
from .prf import first_bytes, hmac256

#: Fixed value: what a versioned blob begins with.
MAGIC = bytes([0xEB, 0x01])


@dataclass(frozen=True)
class BlindIndex:
    """How a field is indexed. length is cut to 32; form is a Unicode normal form, or None for none (or for ASCII data)."""

    field: str
    length: int = 16
    case_sensitive: bool = False
    form: str | None = "NFKC"


#: Presets by kind of field.
SSN, EMAIL, ACCOUNT = BlindIndex("ssn"), BlindIndex("email"), BlindIndex("account_number", case_sensitive=True)


def blind_bytes(value: Column, key: Key, config: BlindIndex) -> Column:
    """First bytes of the HMAC of the stripped, normalised and lower-cased value under the field's key."""
    value = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    value = unicode_normalize(value, config.form) if config.form else value
    value = value if config.case_sensitive else F.lower(value)
    return first_bytes(hmac256(key, value), min(config.length, 32))


def blind_index(value: Column, key: Key, config: BlindIndex) -> Column:
    return F.base64(blind_bytes(value, key, config))


def blind_matches(value: Column, index: Column, key: Key, config: BlindIndex) -> Column:
    """Whether index is that of value."""
    return F.coalesce(blind_index(value, key, config) == index, F.lit(False))


def keyword_token(keyword: Column, key: Key) -> Column:
    return F.base64(hmac256(key, F.lower(keyword)))


def encrypt(plain: Column, key: Column) -> Column:
    """AES-GCM with a random IV, laid out as IV, tag, ciphertext. No blob begins with MAGIC: one that would, one of 65,536, is made again with the first bit of its IV turned."""
    text = plain.cast("binary")

    def unmarked(drawn: Column) -> Column:
        iv = F.concat(F.lit(bytes([MAGIC[0] ^ 0x80])), F.substring(drawn, 2, 11))
        return laid_out(F.when(F.substring(drawn, 1, 2) == F.lit(MAGIC), F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), iv)).otherwise(drawn))

    # The lambda sees one drawing, however often it names it.
    return F.transform(F.array(F.aes_encrypt(text, key, F.lit("GCM"))), unmarked)[0]


def laid_out(out: Column) -> Column:
    """IV, ciphertext, tag (Spark) as IV, tag, ciphertext."""
    n = F.length(out)
    return F.concat(F.substr(out, F.lit(1), F.lit(12)), F.substr(out, n - 15, F.lit(16)), F.substr(out, F.lit(13), n - 28))


def back_in_order(blob: Column) -> Column:
    n = F.length(blob)
    return F.concat(F.substr(blob, F.lit(1), F.lit(12)), F.substr(blob, F.lit(29), n - 28), F.substr(blob, F.lit(13), F.lit(16)))


def decrypt(blob: Column, key: Column) -> Column:
    """Plain bytes; fails on a wrong key or a changed blob."""
    return F.aes_decrypt(back_in_order(blob), key, F.lit("GCM"))


def try_decrypt(blob: Column, key: Column) -> Column:
    """Plain bytes, null on a wrong key or a changed blob."""
    return F.try_aes_decrypt(back_in_order(blob), key, F.lit("GCM"))


def encrypt_fixed(plain: Column, key: Key, aad: Column | None = None, mac: Key | None = None) -> Column:
    """Deterministic authenticated encryption: the IV is the HMAC of the text, so equal texts give equal bytes.

    The HMAC has the key mac, which should be another one than key; without it key serves both. The first 12 bytes make the IV: keep below some
    2**48 values a key.
    """
    aad = F.lit("") if aad is None else aad
    iv = first_bytes(hmac256(mac or key, F.concat(F.lit("siv\0"), F.length(aad).cast("string"), F.lit("\0"), aad, plain.cast("string"))), 12)
    return F.aes_encrypt(plain.cast("binary"), key.raw, F.lit("GCM"), F.lit("DEFAULT"), iv, aad.cast("binary"))


def decrypt_fixed(blob: Column, key: Key, aad: Column | None = None) -> Column:
    """Text, null on a wrong key, other associated data or a changed blob."""
    return F.try_aes_decrypt(blob, key.raw, F.lit("GCM"), F.lit("DEFAULT"), (F.lit("") if aad is None else aad).cast("binary")).cast("string")


def key_hash(key_id: Column) -> Column:
    return first_bytes(F.unhex(F.sha2(key_id, 256)), 4)


def wrap(blob: Column, key_id: Column) -> Column:
    """blob behind the mark and the hash of the key that it is encrypted with."""
    return F.concat(F.lit(MAGIC), key_hash(key_id), blob)


def is_versioned(blob: Column) -> Column:
    return F.coalesce((F.length(blob) >= 6) & (F.substring(blob, 1, 2) == F.lit(MAGIC)), F.lit(False))


def blob_key_hash(blob: Column) -> Column:
    return F.when(is_versioned(blob), F.substring(blob, 3, 4))


def unwrap(blob: Column) -> Column:
    return F.when(is_versioned(blob), F.substr(blob, F.lit(7), F.length(blob) - 6)).otherwise(blob)
