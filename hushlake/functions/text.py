"""Keywords, redaction, clean-up of details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords, and what is stripped from both ends of a word.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]
PUNCTUATION = '.,!?;:"()[]{}'
#: Patterns of sensitive text in the order in which they are replaced, and their markers.
REDACTIONS = [
    (r"\b[A-Za-z0-9+/]{40,}={0,2}\b", "[REDACTED_KEY]"),
    (r"\b(?:\d[ -]*?){13,19}\b", "[REDACTED_CARD]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[REDACTED_EMAIL]"),
]
#: Names whose values are always redacted, and details that are left out of audit rows.
SENSITIVE_NAMES = ["key", "keys", "secret", "password", "token", "plaintext", "master_key", "encryption_key", "search_key", "private_key", "secret_key", "credentials", "api_key"]
HIDDEN_DETAILS = ["plaintext", "content", "token", "tokens", "query"]


def keywords(text: Column) -> Column:
    """Distinct keywords: lower-cased words longer than 2 that are no stop words, then stripped of punctuation.

    Length and stop words are judged before the strip, so 'the,' gives 'the' and '...' the empty keyword.
    """
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION))))


def query_keywords(query: Column) -> Column:
    """Keywords of a query; where none are left, the whole query, trimmed and lower-cased."""
    found, whole = keywords(query), F.lower(F.trim(query))
    return F.when(F.size(found) > 0, found).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def redact(text: Column) -> Column:
    """Long keys, card numbers, social security numbers and e-mail addresses replaced by markers, in this order."""
    for pattern, marker in REDACTIONS:
        text = F.regexp_replace(text, pattern, marker)
    return text


def redact_fields(fields: Column) -> Column:
    """A map of texts with values of sensitive names hidden and others redacted."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(SENSITIVE_NAMES), F.lit("[REDACTED]")).otherwise(redact(v)))


def clean_details(details: Column) -> Column:
    """A map of texts without the details that must not be stored, redacted."""
    return redact_fields(F.map_filter(details, lambda k, v: ~k.isin(HIDDEN_DETAILS)))

#: Levels of nested JSON that are rebuilt by expressions.
JSON_DEPTH = 5


def is_kind(value: Column, kind: str) -> Column:
    """Whether a VARIANT is an OBJECT or ARRAY (of anything), or of a plain kind."""
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


def redact_variant(value: Column, depth: int = JSON_DEPTH, name: Column | None = None) -> Column:
    """A VARIANT with the values of sensitive names hidden and other texts redacted, objects and arrays of any kind down to ``depth`` levels.

    An object or array under a sensitive name is gone through like any other, and plain values in it are hidden by their own or the array's name. What lies deeper than depth
    becomes the text "[REDACTED]" as a whole.
    """
    hidden = F.lit("[REDACTED]").cast("variant")
    sensitive = F.lit(False) if name is None else F.lower(name).isin(SENSITIVE_NAMES)
    plain = F.when(sensitive, hidden).when(is_kind(value, "STRING"), redact(value.cast("string")).cast("variant")).otherwise(value)
    if depth == 0:
        return F.when(is_kind(value, "OBJECT") | is_kind(value, "ARRAY"), hidden).otherwise(plain)
    inner = F.to_variant_object(F.transform_values(F.when(is_kind(value, "OBJECT"), value).cast("map<string,variant>"), lambda k, v: redact_variant(v, depth - 1, k)))
    items = F.to_variant_object(F.transform(F.when(is_kind(value, "ARRAY"), value).cast("array<variant>"), lambda v: redact_variant(v, depth - 1, name)))
    return F.when(is_kind(value, "OBJECT"), inner).when(is_kind(value, "ARRAY"), items).otherwise(plain)


def deeper_than(value: Column, depth: int = JSON_DEPTH) -> Column:
    """Whether a VARIANT has objects or arrays below ``depth`` levels."""
    nested = is_kind(value, "OBJECT") | is_kind(value, "ARRAY")
    if depth == 0:
        return F.coalesce(nested, F.lit(False))
    inner = F.exists(F.map_values(F.when(is_kind(value, "OBJECT"), value).cast("map<string,variant>")), lambda v: deeper_than(v, depth - 1))
    items = F.exists(F.when(is_kind(value, "ARRAY"), value).cast("array<variant>"), lambda v: deeper_than(v, depth - 1))
    return F.coalesce(F.when(is_kind(value, "OBJECT"), inner).when(is_kind(value, "ARRAY"), items), F.lit(False))
