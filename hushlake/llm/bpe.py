"""Byte-level BPE encoding by depth-first traversal of a trie of distinct words, and decoding."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import thrifty

#: Cuts text into words before merging; fixed by the vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space; and, at either end or next to more of it, or rare controls, or no text: such texts are cut as a whole, others at each space.
BLANK = r"[\x09-\x0D\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = rf"{BLANK}{BLANK}|^{BLANK}|{BLANK}$|^$|[\x1c-\x1f\x{{85}}]"
#: Bounds on what a worker keeps between batches and gives out at a time; results don't depend on them.
MAX_WORDS, MAX_PAIRS, PART_CHARS, ROWS = 250_000, 500_000, 4_000_000, 256
#: Tokens decoded at a time.
PART_TOKENS = 65_536


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, the two parts and the rank of each token's merge, and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in self.special}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.merge: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(self.bytes, -1)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
            self.merge[left << 32 | right] = rank
        self.reached = {i: len(b) == 1 for i, b in self.bytes.items()}
        for whole, (left, right) in sorted(self.parts.items(), key=lambda x: self.rank[x[0]]):
            self.reached[whole] = self.reached[left] and self.reached[right] and self.apart(left, right, self.rank[whole])
        self.begun, self.shorter = self.suffixes()
        self.bytes |= {i: s.encode() for s, i in self.special.items()}

    def suffixes(self) -> tuple[dict[bytes, int], dict[int, int]]:
        """Of each beginning of a token the longest reached token that it ends with, and of each of these the next shorter one (-1: none)."""
        tokens = {b: i for b, i in self.ids.items() if self.reached[i]}
        begun, shorter = {}, {}
        for b in sorted({b[:k] for b in tokens for k in range(1, len(b) + 1)}, key=len):
            below = next((begun[b[k:]] for k in range(1, len(b)) if b[k:] in begun), -1)
            begun[b] = tokens.get(b, below)
            if b in tokens:
                shorter[tokens[b]] = below
        return begun, shorter

    def apart(self, left: int, right: int, limit: int = 1 << 40) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that made them (or before limit).

        Takes the tokens apart again, latest merge first; of equal merges the left one was first.
        """
        rank, parts, merge = self.rank, self.parts, self.merge
        while True:
            if merge.get(left << 32 | right, limit) < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]


class TrieEncoder:
    """Encodes sorted distinct words: a walk through their trie that keeps, for each prefix, its last token.

    A prefix's encoding is its last token after the encoding of what precedes that token. So each
    node needs one token: the longest that ends there, is apart from the last token before it, and
    fits. What words share as a prefix is worked out once. The tokens that end at a node are not searched for: the longest
    beginning of a token that ends there goes on from node to node, and names them by links, longest first.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.pairs = vocabulary, {}
        self.size = {i: len(vocabulary.bytes[i]) for i in vocabulary.shorter}

    def encode(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        begun, shorter, size, apart, pairs = self.v.begun, self.v.shorter, self.size, self.v.apart, self.pairs
        # Of each prefix: its last token, and where the longest beginning of a token at its end starts.
        last, open_at, before = [-1], [0], b""
        for word in words:
            shared, n = 0, len(word)
            top = min(n, len(before))
            if word[:top] == before[:top]:
                shared = top
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], open_at[shared + 1 :]
            begin = open_at[shared]
            for end in range(shared + 1, n + 1):
                while (token := begun.get(word[begin:end])) is None:
                    begin += 1
                while start := end - size[token]:
                    key = last[start] << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = apart(last[start], token)
                        if len(pairs) >= MAX_PAIRS:
                            pairs.clear()
                        pairs[key] = fits
                    if fits:
                        break
                    token = shorter[token]
                last.append(token)
                open_at.append(begin)
            before, out, at = word, [], n
            while at:
                token = last[at]
                out.append(token)
                at -= size[token]
            out.reverse()
            yield out


class TextEncoder:
    """Encodes texts: distinct words of a batch go through the trie once, texts are put together from the ids of their distinct pieces."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.trie = TrieEncoder(self.v)
        self.most = MAX_WORDS
        self.forget()
        # All tokens' bytes one after another, and where each id's begin.
        self.flat = np.frombuffer(b"".join(self.v.bytes.values()), np.uint8)
        self.size = np.zeros(max(self.v.bytes) + 1, np.int32)
        self.start = np.zeros(max(self.v.bytes) + 1, np.int32)
        ids = np.fromiter(self.v.bytes, np.int64)
        self.size[ids] = [len(b) for b in self.v.bytes.values()]
        self.start[ids] = np.cumsum(self.size[ids]) - self.size[ids]
        self.special = regex.compile("|".join(map(regex.escape, self.v.special))) if self.v.special else None
        self.uneven = "|".join([UNEVEN, *map(re.escape, self.v.special)])

    def forget(self) -> None:
        """Empties the caches: ids as 32-bit numbers, of words, of pieces without a space before them, and of pieces after one space."""
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.packed: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Encodes the new words in one walk."""
        fresh = sorted(w for w in words if w not in self.known)  # by code point, which is also the order of UTF-8
        for word, ids in zip(fresh, self.trie.encode([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True):
            self.known[word] = array("i", ids).tobytes()

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces that begin a text, distinct pieces of all texts, each piece's place among both, and where each text's pieces begin."""
        cut = pc.split_pattern(texts, " ")
        flat, starts = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        rest = flat.dictionary_encode()
        first = flat.take(pa.array(starts[:-1])).dictionary_encode()
        at = rest.indices.to_numpy() + np.int32(len(first.dictionary))
        at[starts[:-1]] = first.indices.to_numpy()
        return first.dictionary, rest.dictionary, at, starts

    def whole(self, text: str) -> list[str | int]:
        """Words and ids of special tokens of a text that can't be cut at spaces."""
        if not self.special:
            return WORDS.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += WORDS.findall(text[at : m.start()])
            out.append(self.v.special[m[0]])
            at = m.end()
        return out + WORDS.findall(text[at:])

    def encode(self, texts: list[str] | pa.Array, say: bool = True) -> Iterator[tuple[str, bytes, str]]:
        """Of each text: ids as decimal numbers joined by commas ('' unless say) and as 32-bit numbers, and the text decoded from them.

        Texts that can be cut at spaces are put together by Arrow from the ids of their distinct pieces. Null is like an empty text.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if max(len(self.known), len(self.packed)) > self.most:
            self.forget()
        uneven = pc.match_substring_regex(texts, self.uneven)
        whole = [self.whole(t) for t in texts.filter(uneven).to_pylist()]
        first, rest, at, starts = self.pieces(texts.filter(pc.invert(uneven)))
        first, rest = first.to_pylist(), rest.to_pylist()
        first_words = {x: WORDS.findall(x) for x in first if x not in self.first}
        fresh = [x for x in rest if x not in self.packed]
        mixed = {x: WORDS.findall(f" {x}") for x in fresh if not x.isalpha()}
        plain = [x for x in fresh if x not in mixed]
        new = {f" {x}" for x in plain}
        for own in (*first_words.values(), *mixed.values()):
            new.update(own)
        new.update(w for own in whole for w in own if isinstance(w, str))
        self.learn(new)
        known = self.known
        self.first.update((x, b"".join([known[w] for w in own])) for x, own in first_words.items())
        self.packed.update((x, b"".join([known[w] for w in own])) for x, own in mixed.items())
        self.packed.update((x, known[f" {x}"]) for x in plain)
        parts = [*map(self.first.__getitem__, first), *map(self.packed.__getitem__, rest)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(parts), np.int32))
        ids = lists.take(pa.array(at)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[starts]
        if say:
            comma = pa.scalar(",", pa.large_string())
            numbers = pa.LargeListArray.from_arrays(lists.offsets, lists.flatten().cast(pa.large_string()))
            said = iter(pc.binary_join(pa.LargeListArray.from_arrays(starts, pc.binary_join(numbers, comma).take(pa.array(at))), comma))
        cut, odd = iter(range(len(starts) - 1)), iter(whole)
        for is_odd in uneven.to_pylist():
            if is_odd:
                packed = b"".join([known[w] if isinstance(w, str) else array("i", [w]).tobytes() for w in next(odd)])
                text = ",".join(map(str, np.frombuffer(packed, np.int32).tolist())) if say else ""
            else:
                k = next(cut)
                packed = ids[ends[k] : ends[k + 1]].tobytes()
                text = next(said).as_py() if say else ""
            yield text, packed, self.decoded(packed)

    def decoded(self, packed: bytes) -> str:
        """The text of ids (32-bit numbers); bytes that aren't UTF-8 become U+FFFD."""
        ids, out = np.frombuffer(packed, np.int32), []
        for k in range(0, len(ids), PART_TOKENS):
            part = ids[k : k + PART_TOKENS]
            size = self.size[part]
            ends = np.cumsum(size, dtype=np.int32)
            at = np.repeat(self.start[part] - ends + size, size)
            at += np.arange(len(at), dtype=np.int32)
            out.append(self.flat[at].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One for each worker; Spark keeps the workers between tasks."""
    return TextEncoder(path)


def parts_of(texts: pa.Array, most: int = PART_CHARS) -> Iterator[pa.Array]:
    """Runs of texts of most bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(start, end - start)
        start = end


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, cache_words: int = MAX_WORDS, part_chars: int = PART_CHARS, tidy: bool = False) -> DataFrame:
    """Encodes and decodes every text: id_col, n_tokens, then token_ids and decoded, then digests of both.

    ids adds token_ids (array of int) and decoded (text); digests adds ids_sha256 (of the
    decimal ids joined by commas) and decoded_sha256 (of the decoded UTF-8). Encoding equals that of the vocabulary's
    library without added tokens; strings of special tokens in the text become those tokens.
    cache_words and part_chars bound what a worker keeps and takes up at a time; smaller ones take less memory and more time, and
    change no result; with tidy a worker keeps not even the vocabulary after a task, and loads it anew in the next. Each task works on its own rows, in batches of bounded size, and shuffles nothing. Null is like an empty text:
    0 tokens, ids [], text ''. Repeated rows are all returned; other columns are left out.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])
    if ids:
        schema.add("token_ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    if digests:
        schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    kinds = [pa.int64(), *[pa.list_(pa.int32()), pa.string()] * ids, *[pa.string(), pa.string()] * digests]

    def row_of(said: str, packed: bytes, text: str) -> list:
        row = [len(packed) // 4]
        if ids:
            row += [np.frombuffer(packed, np.int32), text]
        if digests:
            row += [hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()]
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        own.most = cache_words
        gc.disable()  # these dictionaries hold no cycles, and walking them again and again is slow
        try:
            for batch in batches:
                at = 0
                for part in parts_of(batch.column(1), part_chars):
                    encoded = own.encode(part, say=digests)
                    while rows := [row_of(*x) for x in islice(encoded, ROWS)]:
                        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *columns], names=schema.names)
                        at += len(rows)
        finally:
            own.forget()  # the worker may go on to other tasks
            if tidy:
                del own
                encoder.cache_clear()
            gc.enable()

    return docs.select(id_col, text_col).mapInArrow(thrifty(run), schema).withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids (null: ''); bytes that aren't UTF-8 become U+FFFD, unknown ids nothing. A column named out_col is replaced."""
    rows = rows.drop(out_col) if out_col != ids_col else rows
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path).v.bytes
        for batch in batches:
            texts = [b"".join([known.get(i, b"") for i in own or []]).decode("utf-8", "replace") for own in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(thrifty(run), schema)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public vocabularies has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, vocabulary_path(), ids=False, digests=True)
