"""Words and word shingles of a batch of texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are turned into words at a time.
PART_CHARS = 2_500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_of(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about PART_CHARS bytes (one text at least) with their starts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + PART_CHARS, "right")))
        yield start, texts.slice(start, end - start)
        start = end


def hash_strings(strings: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(strings.to_pylist(), dtype=object), categorize=False) if len(strings) else np.empty(0, np.uint64)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts in order, A-Z lower-cased, and offsets by text; null has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and offsets by text."""
    flat, offsets = split_words(texts)
    coded = flat.dictionary_encode()
    hashes = hash_strings(coded.dictionary)
    return (hashes[coded.indices.to_numpy()] if len(hashes) else hashes), offsets


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's runs of k words; of fewer words the whole sequence is one."""
    for _, part in parts_of(texts):
        words, offsets = word_hashes(part)
        runs = run_hashes(words, k)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= k:
                own = runs[a : b - k + 1].copy()
                own.sort()
                if len(own) > 1:
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                yield own
            elif b > a:
                yield run_hashes(words[a:b], b - a)
            else:
                yield words[a:a]


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (also across texts: the caller knows the borders)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * factor + words[j : j + n]
        return mixed(out)
