"""AES and FF1 over many rows at once in numpy, for Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Rows that are worked on together: their words stay in the processor's cache.
ROWS = 4096


def _boxes() -> tuple[np.ndarray, np.ndarray]:
    """The S-box, and the four tables of a round (substitution and mixing of columns in one), by their definitions."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    inverse = [0, *(power[-log[a] % 255] for a in range(1, 256))]
    box = [0] * 256
    for a, q in enumerate(inverse):
        box[a] = 0x63
        for k in range(5):
            box[a] ^= ((q << k) | (q >> (8 - k))) & 0xFF
    s = np.array(box, np.uint32)
    two = ((s << 1) ^ np.where(s & 0x80, 0x11B, 0)).astype(np.uint32)
    first = two << 24 | s << 16 | s << 8 | (two ^ s)
    return s, np.stack([first >> r | first << (32 - r) if r else first for r in (0, 8, 16, 24)]).astype(np.uint32)


BOX, TABLES = _boxes()


@lru_cache(16)
def round_keys(key: bytes) -> np.ndarray:
    """Words of the round keys of an AES key of 16, 24 or 32 bytes."""
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    n, box = len(key) // 4, BOX.tolist()
    words, constant = [int.from_bytes(key[i : i + 4], "big") for i in range(0, len(key), 4)], 1
    spread = lambda w: box[w >> 24] << 24 | box[w >> 16 & 255] << 16 | box[w >> 8 & 255] << 8 | box[w & 255]
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = spread((w << 8 | w >> 24) & 0xFFFFFFFF) ^ constant << 24
            constant = constant << 1 ^ (0x11B if constant & 0x80 else 0)
        elif n > 6 and i % n == 4:
            w = spread(w)
        words.append(words[i - n] ^ w)
    return np.array(words, np.uint32).reshape(-1, 4)


def aes(keys: np.ndarray, state: list[np.ndarray]) -> list[np.ndarray]:
    """One block of each row, encrypted: a block is four words, each an array over the rows."""
    state = [s ^ k for s, k in zip(state, keys[0], strict=True)]
    places = ((24, 0), (16, 1), (8, 2), (0, 3))
    for own in keys[1:-1]:
        state = [TABLES[0].take(state[c] >> 24) ^ TABLES[1].take(state[(c + 1) % 4] >> 16 & 255) ^ TABLES[2].take(state[(c + 2) % 4] >> 8 & 255) ^ TABLES[3].take(state[(c + 3) % 4] & 255) ^ own[c] for c in range(4)]
    last = [[BOX.take(state[(c + k) % 4] >> shift & 255) << shift for shift, k in places] for c in range(4)]
    return [(w[0] | w[1] | w[2] | w[3]) ^ own for w, own in zip(last, keys[-1], strict=True)]


def ff1(numerals: np.ndarray, key: bytes, tweak: np.ndarray, radix: int, frame: tuple[int, int, bytes, bytes], rounds: int, back: bool) -> np.ndarray:
    """FF1 of numerals (rows, n) below radix under one key; tweak is (rows, bytes). frame is that of fpe.frame.

    Halves are held in limbs of as many numerals as fit 31 bits, the lowest first, so all products stay within 64 bits.
    """
    return np.concatenate([_ff1(numerals[i : i + ROWS], round_keys(key), tweak[i : i + ROWS], radix, frame, rounds, back) for i in range(0, len(numerals), ROWS)]) if len(numerals) else numerals


def _ff1(numerals: np.ndarray, keys: np.ndarray, tweak: np.ndarray, radix: int, frame: tuple[int, int, bytes, bytes], rounds: int, back: bool) -> np.ndarray:
    rows, n = numerals.shape
    b, d, fixed, fill = frame
    u, width = n // 2, 1
    while radix ** (width + 1) < 1 << 31:
        width += 1
    sizes = {m: [*[width] * (m // width), *([m % width] if m % width else [])] for m in (u, n - u)}

    def limbs(part: np.ndarray) -> list[np.ndarray]:
        out, end = [], part.shape[1]
        for size in sizes[end]:
            limb = np.zeros(rows, np.uint64)
            for c in range(end - size, end):
                limb = limb * np.uint64(radix) + part[:, c].astype(np.uint64)
            out.append(limb)
            end -= size
        return out

    def blocks(parts: np.ndarray) -> list[list[np.ndarray]]:
        words = np.ascontiguousarray(parts).view(">u4").astype(np.uint32).T
        return [list(words[i : i + 4]) for i in range(0, len(words), 4)]

    def chained(state: list[np.ndarray], parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        for p in parts:
            state = aes(keys, [s ^ w for s, w in zip(state, p, strict=True)])
        return state

    # What comes before the last blocks is the same in all rounds.
    lead = np.concatenate([np.broadcast_to(np.frombuffer(x, np.uint8), (rows, len(x))) if isinstance(x, bytes) else x for x in (fixed, tweak, fill)], axis=1)
    whole = lead.shape[1] // 16 * 16
    before = chained([np.zeros(rows, np.uint32)] * 4, blocks(lead[:, :whole]))
    rest = np.zeros((rows, lead.shape[1] - whole + 1 + b), np.uint8)
    rest[:, : lead.shape[1] - whole] = lead[:, whole:]

    def number(half: list[np.ndarray], m: int) -> list[np.ndarray]:
        """32-bit words of a half, the lowest first."""
        words = [np.zeros(rows, np.uint64) for _ in range(-(-b // 4))]
        for limb, size in reversed(list(zip(half, sizes[m], strict=True))):
            carry = limb
            for j in range(len(words)):
                t = words[j] * np.uint64(radix**size) + carry
                words[j], carry = t & np.uint64(0xFFFFFFFF), t >> np.uint64(32)
        return words

    def said(i: int, half: list[np.ndarray], m: int, modulus: int) -> list[np.ndarray]:
        """The round's number modulo radix ** modulus, as limbs."""
        rest[:, -b - 1] = i
        text = np.stack(number(half, m)[::-1], axis=1).astype(">u4").view(np.uint8)
        rest[:, -b:] = text[:, text.shape[1] - b :]
        first = chained(before, blocks(rest))
        words = list(first)
        for j in range(1, -(-d // 16)):
            words += aes(keys, [*first[:3], first[3] ^ np.uint32(j)])
        words, out = [w.astype(np.uint64) for w in words[: d // 4]], []
        for size in sizes[modulus]:
            base, left = np.uint64(radix**size), np.zeros(rows, np.uint64)
            for k, w in enumerate(words):
                t = left << np.uint64(32) | w
                words[k] = t // base
                left = t - words[k] * base
            out.append(left)
        return out

    def added(half: list[np.ndarray], more: list[np.ndarray], m: int) -> list[np.ndarray]:
        out, carry = [], np.zeros(rows, np.uint64)
        for x, y, size in zip(half, more, sizes[m], strict=True):
            base = np.uint64(radix**size)
            t = x + base - y - carry if back else x + y + carry
            over = t >= base
            out.append(np.where(over, t - base, t))
            carry = (~over if back else over).astype(np.uint64)
        return out

    # a has u numerals before even rounds, and b the others; before odd rounds it is the other way round.
    one, two = limbs(numerals[:, :u]), limbs(numerals[:, u:])
    for i in reversed(range(rounds)) if back else range(rounds):
        m = u if i % 2 == 0 else n - u
        if back:
            one, two = added(two, said(i, one, n - m, m), m), one
        else:
            one, two = two, added(one, said(i, two, n - m, m), m)
    out, end = np.empty((rows, n), np.int32), n
    for half, m in ((two, n - u), (one, u)):
        for limb, size in zip(half, sizes[m], strict=True):
            for c in range(end - 1, end - 1 - size, -1):
                after = limb // np.uint64(radix)
                out[:, c] = limb - after * np.uint64(radix)
                limb = after
            end -= size
    return out


def ciphered(numerals: np.ndarray, at: np.ndarray, keys: pa.Array, tweaks: pa.Array, radix: int, frame: tuple[int, int, bytes, bytes], tweak_length: int, rounds: int, back: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, FF1 of them) of numerals of the rows at, by key; rows without a key or without a tweak of tweak_length bytes, and numerals out of range, are left out."""
    keys, tweaks = keys.dictionary_encode(), tweaks.dictionary_encode()
    known = [x if x is not None and len(x) == tweak_length else None for x in tweaks.dictionary.to_pylist()]
    bytes_of = np.array([list(x or bytes(tweak_length)) for x in known], np.uint8).reshape(len(known), tweak_length)
    own, told = (x.indices.fill_null(-1).to_numpy(zero_copy_only=False)[at] for x in (keys, tweaks))
    fits = (told >= 0) & ((numerals >= 0) & (numerals < radix)).all(axis=1)
    fits[fits] &= np.array([x is not None for x in known], bool)[told[fits]]
    for k, key in enumerate(keys.dictionary.to_pylist()):
        rows = np.flatnonzero(fits & (own == k))
        if len(rows):
            yield at[rows], ff1(numerals[rows], key, bytes_of[told[rows]], radix, frame, rounds, back)


def of_texts(frames: dict[int, tuple[int, int, bytes, bytes]], alphabet: str, tweak_length: int, rounds: int, back: bool) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """FF1 of texts over an alphabet, of the lengths that frames has; null for others."""

    def run(text: pa.Array, keys: pa.Array, tweaks: pa.Array) -> pa.Array:
        letters = np.array([ord(c) for c in alphabet], "<u4")
        place = np.full(int(letters.max()) + 2, -1, np.int32)
        place[letters] = np.arange(len(letters))
        texts = text.to_pylist()
        out: list[str | None] = [None] * len(texts)
        for n, frame in frames.items():
            at = [i for i, t in enumerate(texts) if t is not None and len(t) == n]
            codes = np.frombuffer("".join([texts[i] for i in at]).encode("utf-32-le"), "<u4").reshape(-1, n)
            numerals = place[np.minimum(codes, len(place) - 1)]
            for rows, made in ciphered(numerals, np.array(at, np.int64), keys, tweaks, len(alphabet), frame, tweak_length, rounds, back):
                whole = letters[made].tobytes().decode("utf-32-le")
                for j, i in enumerate(rows.tolist()):
                    out[i] = whole[j * n : j * n + n]
        return pa.array(out, pa.string())

    return run


def of_arrays(n: int, radix: int, frame: tuple[int, int, bytes, bytes], tweak_length: int, rounds: int, back: bool) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """FF1 of arrays of n numerals below radix; null for others."""

    def run(column: pa.Array, keys: pa.Array, tweaks: pa.Array) -> pa.Array:
        lists = column.to_pylist()
        at = [i for i, x in enumerate(lists) if x is not None and len(x) == n and None not in x]
        numerals = np.array([lists[i] for i in at], np.int64).reshape(-1, n)
        out: list[list[int] | None] = [None] * len(lists)
        for rows, made in ciphered(numerals, np.array(at, np.int64), keys, tweaks, radix, frame, tweak_length, rounds, back):
            for i, x in zip(rows.tolist(), made.tolist(), strict=True):
                out[i] = x
        return pa.array(out, pa.list_(pa.int32()))

    return run


def shaped(shapes: pa.Array, digits: pa.Array) -> pa.Array:
    """Shapes with their digits replaced in turn by those of digits; null where a shape has digits and there are none for it."""
    out: list[str | None] = []
    for shape, own in zip(shapes.to_pylist(), digits.to_pylist(), strict=True):
        if shape is None or own is None:
            out.append(shape if shape is not None and not any(c in "0123456789" for c in shape) else None)
        else:
            left = iter(own)
            out.append("".join([next(left, "") if c in "0123456789" else c for c in shape]))
    return pa.array(out, pa.string())
