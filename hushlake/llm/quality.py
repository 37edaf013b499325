"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of the words of trusted text, unseen words spelled by a model of byte classes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, freed, stored, thrifty
from .words import mixed, parts_of, split_words

#: Symbols are CLASSES classes of bytes, so a model has CLASSES ** 3 three-symbol sequences at most.
CLASSES, BITS = 128, 7
#: Name of the model of all languages together, for texts of none or of one without trusted text.
ALL = "*"
#: Ids of trusted documents broadcast at most; beyond that the join shuffles.
BROADCAST_IDS = 2_000_000
#: Bytes of text that are packed at a time.
PART_TEXT = 8_000_000
#: Runs of a bucket, about. Texts beyond SLICED bytes go in SLICES slices of buckets one after another, so that only one slice lies on disk.
RUNS, SLICED, SLICES = 1_500_000, 50_000_000, 2
#: Single words of a language sent to the workers, about; the others are looked up in their slots. Results do not depend on it.
FREQUENT = 200_000
#: Bits of a language's filter of counted words at most, and bits a word below that. Words let through wrongly are looked up in their slots.
FILTER_BITS, WORD_BITS = 1 << 27, 12
#: Columns of packed runs.
PACKED = ["bucket", "lang", "n_words", "n_runs", "n_docs", "n_middles", "words", "spelled", "runs", "middles", "middle", "docs", "keys", "roles", "unknown"]
PACKED_TYPES = [pa.int32(), pa.string(), *[pa.int32()] * 4, *[pa.binary()] * 9]
#: Keys and their columns, dealt out to slots.
DEALT_SQL = "slot int, lang string, order int, size int, keys binary, columns array<binary>"
DEALT = pa.schema([("slot", pa.int32()), ("lang", pa.string()), ("order", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("columns", pa.list_(pa.binary()))])


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 the border, 1 blanks and controls, 2 digits, then punctuation, letters, and 42 for bytes from 128 on."""
    out = np.ones(256, np.int64)
    symbols = [b for b in range(33, 127) if not 48 <= b <= 57]
    out[48:58] = 2
    out[symbols] = 3 + np.arange(len(symbols))
    out[128:] = 86 + np.arange(128) % 42
    return out


def symbols_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Three-symbol codes of all texts, each text behind two borders, and offsets by text."""
    raws = [b"\0\0" + (t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    table = byte_classes()
    table[0] = 0
    c = table[np.frombuffer(b"".join(raws), np.uint8)]
    codes = (c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:] if len(c) > 2 else np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(codes), bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - 2) : e] = False
    return codes[inside], np.concatenate([[0], np.cumsum(sizes - 2)])


def count_sequences(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole texts of docs (lang, text), for each language and for ALL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                langs, texts = (batch.column(i).slice(start, 1000).to_pylist() for i in range(2))
                for lang in set(langs):
                    codes, _ = symbols_of([t for t, own in zip(texts, langs, strict=True) if own == lang])
                    own = total.setdefault(lang, np.zeros(CLASSES**3, np.int64))
                    own += np.bincount(codes, minlength=CLASSES**3)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(counts[at])], names=["lang", "gram", "n"])

    counts = docs.select("lang", "text").mapInArrow(thrifty(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counts.union(counts.groupBy(F.lit(ALL).alias("lang"), "gram").agg(F.sum("n").alias("n")))


def discounted(counts: DataFrame) -> DataFrame:
    """Adds cut, the discount of each count; the counts of counts are those of each language."""
    of = counts.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in range(1, 5)])
    # Where a language has too little text for a discount, 0.5 is taken.
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    discounts = of.select("lang", *[F.coalesce(F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))))), F.lit(0.5)).alias(f"d{i}") for i in range(1, 4)])
    return counts.join(discounts, "lang").withColumn("cut", F.least(F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")), F.col("n").cast("double")))


def interpolated(counts: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """(lang, gram, p, left): probability of each counted sequence, and weight ``left`` of its context's unseen rest.

    counts (lang, gram, n) are raw for the highest order and continuation counts below. The discounts of
    n = 1, 2, 3+ come from the counts of counts of each language; contexts and shorter sequences are joined by
    (lang, code), so that every step is spread over all of them.
    """
    rows = discounted(counts).withColumn("context", F.shiftright("gram", BITS))
    contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
    rows = rows.join(contexts, ["lang", "context"])
    own = (F.col("n") - F.col("cut")) / F.col("total")
    left = F.col("cuts") / F.col("total")
    if lower is None:
        return rows.select("lang", "gram", (own + left / CLASSES).alias("p"), left.alias("left"))
    shorter = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1)).join(shorter, ["lang", "suffix"])
    return rows.select("lang", "gram", (own + left * F.col("below")).alias("p"), left.alias("left"))


def train_model(docs: DataFrame) -> dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each language, orders 1 to 3 as (codes, probabilities, left): bounded by CLASSES ** 3 a language."""
    counts, levels = {3: stored(count_sequences(docs), "counts")}, []
    for order in (2, 1):
        longer = counts[order + 1]
        counts[order] = longer.groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * order) - 1).alias("gram")).agg(F.count("*").alias("n"))
    tables, lower = [], None
    for order in (1, 2, 3):
        lower = stored(interpolated(counts[order], lower, order), f"order{order}")
        levels.append(lower)
        tables.append(lower.orderBy("lang", "gram").toPandas())
    dropped(counts[3], *levels)
    langs = sorted(set(tables[0]["lang"]))
    pick = lambda t: (t["gram"].to_numpy(np.int64), t["p"].to_numpy(np.float64), t["left"].to_numpy(np.float64))
    return {lang: [pick(t[t["lang"] == lang]) for t in tables] for lang in langs}


def surprise(model: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """-ln p of every three-symbol code: unseen ones fall back to the shorter sequence."""
    (g1, p1, l1), (g2, p2, l2), (g3, p3, l3) = model
    one = np.full(CLASSES, (l1[0] if len(l1) else 1.0) / CLASSES)
    one[g1] = p1
    left = np.ones(CLASSES)
    left[g2 >> BITS] = l2
    two = (left[:, None] * one[None, :]).reshape(-1)
    two[g2] = p2
    left = np.ones(CLASSES**2)
    left[g3 >> BITS] = l3
    three = (left.reshape(CLASSES, CLASSES)[:, :, None] * two.reshape(CLASSES, CLASSES)[None, :, :]).reshape(-1)
    three[g3] = p3
    return -np.log(np.maximum(three, 1e-12)).astype(np.float32)


def bytes_read(words: pa.Array, spelling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (the sum of a random number for each byte at its place), and -ln p of its letters and the blank behind."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0)
    words = words.cast(pa.string())
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    bounds, n = bounds - bounds[0], len(words)
    sizes = np.diff(bounds)
    word = np.repeat(np.arange(n), sizes)
    place = np.arange(len(raw)) - bounds[word]
    table = mixed(np.arange(1, 256 * 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    drawn = table[((place & 63) << 8) | raw]
    if len(sizes) and sizes.max() > 64:  # places beyond 64 have numbers of their own
        far = place > 63
        drawn[far] = mixed(drawn[far] + mixed(place[far].astype(np.uint64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(drawn, dtype=np.uint64)])
    hashes = mixed(sums[bounds[1:]] - sums[bounds[:-1]])
    # Each word behind the border and a blank, and before a blank.
    classes = byte_classes()
    classes[0] = 0
    seq = np.ones(len(raw) + 3 * n, np.int32)
    start = bounds[:-1] + 3 * np.arange(n)
    seq[start] = 0
    seq[np.arange(len(raw)) + 3 * word + 2] = classes[raw]
    codes = (seq[:-2] << 2 * BITS) | (seq[1:-1] << BITS) | seq[2:]
    sums = np.concatenate([[0.0], np.cumsum(spelling[codes], dtype=np.float64)])
    return hashes, sums[start + sizes + 1] - sums[start]


def read_words(part: pa.Array, spelling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a part in the order of their 64-bit hashes (0 the border before a text), -ln p of their letters and the blank behind; all texts as places there, each behind two borders; place and row of each word in them."""
    flat, offsets = split_words(part, lower=False)
    coded = flat.dictionary_encode()
    own, costs = bytes_read(coded.dictionary, spelling)
    words, spelled = np.concatenate([np.zeros(1, np.uint64), np.maximum(own, 1)]), np.concatenate([[0.0], costs]).astype(np.float32)
    order = np.argsort(words)
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    row = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(offsets))
    seq = np.zeros(len(flat) + 2 * len(part), np.int32)
    place = np.arange(2, len(flat) + 2, dtype=np.int32) + 2 * row
    seq[place] = rank[1:][coded.indices.to_numpy()]
    return words[order], spelled[order], seq, place, row


def parts_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of one language each, of about PART_TEXT bytes; lang and text are the columns 1 and 2."""
    for batch in batches:
        for lang in pc.unique(batch.column(1)).to_pylist():
            own = batch.filter(pc.equal(batch.column(1), lang))
            start, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(own.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while start < own.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PART_TEXT, "right")))
                yield lang, own.slice(start, end - start)
                start = end


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(n)


def dealt_by(words: np.ndarray, lang: str, buckets: int) -> np.ndarray:
    """Bucket of each word of a language."""
    with np.errstate(over="ignore"):
        return (mixed(words + np.uint64(zlib.crc32(lang.encode())) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)


def word_filter(words: np.ndarray, most: int) -> np.ndarray:
    """Bits set for words of a slot, of ``most`` bits at most: a power of two."""
    size = 1 << max(3, min(int(np.ceil(np.log2(WORD_BITS * max(len(words), 1)))), int(np.log2(max(most, 8)))))
    bits = np.zeros(size, bool)
    for shift in (0, 21, 42):
        bits[(mixed(~words) >> np.uint64(shift)) & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little")


def maybe_counted(words: np.ndarray, slot: np.ndarray, starts: np.ndarray, masks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False for words that were surely not counted."""
    drawn, out = mixed(~words), np.ones(len(words), bool)
    for shift in (0, 21, 42):
        at = starts[slot] + ((drawn >> np.uint64(shift)) & masks[slot]).astype(np.int64)
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out & (masks[slot] > 0)


def coded_words(words: np.ndarray, slot: np.ndarray, known: tuple | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Code of each word, which words are rare, and the code of words that were not counted.

    0 is the border, then come the frequent words of ``known``; rare words are numbered from behind the code of uncounted ones.
    """
    code, rare, unknown = np.zeros(len(words), np.int32), words > 0, 1
    if known:
        table, codes, _, filters = known
        unknown = len(table) + 1
        at, there = looked_up(table, words)
        code[there] = codes[at[there]]
        rare &= ~there
        found = maybe_counted(words[rare], slot[rare], *filters)
        code[np.flatnonzero(rare)[~found]] = unknown
        rare[rare] = found
    code[rare] = unknown + 1 + np.arange(int(rare.sum()), dtype=np.int32)
    return code, rare, unknown


def packed_runs(docs: DataFrame, spelling, buckets: int, low: int, high: int, known=None) -> DataFrame:
    """Runs of three words of docs (key, lang, text, role), packed: a row for each part of the texts, language and bucket from low to high - 1.

    The bucket is that of the middle word, so a run, its context, the shorter run and its context lie in one bucket. role is
    1 for texts that are counted, 2 for those judged, 3 for both. Words are sent as hashes, but frequent words of ``known`` as their
    codes, and words that were not counted as one code, since nothing can be found for them: ``unknown`` has what their letters cost a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in parts_by_language(batches):
            words, spelled, seq, place, row = read_words(own.column(2), spelling.value)
            keys, roles = own.column(0).to_numpy(), own.column(3).to_numpy().astype(np.uint8)
            of_word = dealt_by(words, lang, buckets)
            code, rare, unknown = coded_words(words, of_word, known.value.get(lang) if known else None)
            rare_words, rare_spelled = words[rare], spelled[rare]
            of_word = of_word.astype(np.int16) if buckets < 2**15 else of_word
            bucket = of_word[seq[place - 1]]
            inside = np.flatnonzero((bucket >= low) & (bucket < high))
            bucket = bucket[inside]
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(low, high + 1))
            inside = inside[order]
            at, rows = place[inside], row[inside]
            coded = code[seq]
            runs = np.stack([coded[at - 2], coded[at - 1], coded[at]])
            costs = np.zeros(len(at), np.float32)
            missing = np.flatnonzero(runs[2] == unknown)
            costs[missing] = spelled[seq[at[missing]]]
            for b, i, j in zip(range(low, high), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i == j:
                    continue
                ids = runs[:, i:j].reshape(-1)
                among = np.flatnonzero(ids > unknown)
                used = np.zeros(len(rare_words), bool)
                used[ids[among] - unknown - 1] = True
                ids[among] = (np.cumsum(used, dtype=np.int32) + unknown)[ids[among] - unknown - 1]
                outer, (middles, middle) = ids.reshape(3, -1)[::2].reshape(-1), np.unique(ids.reshape(3, -1)[1], return_inverse=True)
                step = np.diff(rows[i:j], prepend=rows[i]) > 0
                held = rows[i:j][np.concatenate([[True], step[1:]])]
                gaps = np.diff(rare_words[used], prepend=np.uint64(0))
                letters = np.bincount(np.cumsum(step), costs[i:j], len(held)).astype(np.float32)
                data = [packed(gaps), packed(rare_spelled[used]), packed(outer), packed(np.diff(middles, prepend=np.int32(0))), packed(middle.astype(np.int32)), packed(step.view(np.uint8)), packed(keys[held]), packed(roles[held]), packed(letters)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([b, lang, len(gaps), j - i, len(held), len(middles), *data], PACKED_TYPES, strict=True)], names=PACKED)

    return docs.select("key", "lang", "text", "role").mapInArrow(thrifty(run), "bucket int, lang string, n_words int, n_runs int, n_docs int, n_middles int, words binary, spelled binary, runs binary, middles binary, middle binary, docs binary, keys binary, roles binary, unknown binary")


class Bucket:
    """Runs of one language in one bucket, counted: rare words and keys by place, n of each distinct run of three and two words, and who alone holds a row.

    Words are codes as in coded_words, ``unknown`` that of uncounted ones. Runs are sorted by their middle words, and those are numbered:
    keys of tables begin with that number, so that look-ups go through them from front to back.
    """

    def __init__(self, rows: list[dict], unknown: int) -> None:
        own_words = [np.cumsum(unpacked(r["words"], r["n_words"], np.uint64), dtype=np.uint64) for r in rows]
        own_keys = [unpacked(r["keys"], r["n_docs"], np.int64) for r in rows]
        self.first = unknown + 1
        self.words, self.keys = np.unique(np.concatenate(own_words)), np.unique(np.concatenate(own_keys))
        self.spelled, self.letters = np.empty(len(self.words), np.float32), np.zeros(len(self.keys))
        size = sum(r["n_runs"] for r in rows)
        a, b, c, doc, role = (np.empty(size, t) for t in (np.int32, np.int32, np.int32, np.int32, np.uint8))
        start = 0
        for r, words, keys in zip(rows, own_words, own_keys, strict=True):
            at, end = np.searchsorted(self.words, words).astype(np.int32), start + r["n_runs"]
            self.spelled[at] = unpacked(r["spelled"], r["n_words"], np.float32)
            outer = unpacked(r["runs"], 2 * r["n_runs"], np.int32).reshape(2, -1)
            middles = np.cumsum(unpacked(r["middles"], r["n_middles"], np.int32), dtype=np.int32)
            ids = np.concatenate([outer[0], middles[unpacked(r["middle"], r["n_runs"], np.int32)], outer[1]])
            rare = np.flatnonzero(ids >= self.first)
            ids[rare] = self.first + at[ids[rare] - self.first]
            a[start:end], b[start:end], c[start:end] = ids.reshape(3, -1)
            near, of = np.cumsum(unpacked(r["docs"], r["n_runs"], np.uint8), dtype=np.int32), np.searchsorted(self.keys, keys).astype(np.int32)
            doc[start:end], roles = of[near], unpacked(r["roles"], r["n_docs"], np.uint8)
            role[start:end] = roles[near]
            np.add.at(self.letters, of, np.where(roles & 2, unpacked(r["unknown"], r["n_docs"], np.float32), 0))
            start = end
        order = np.argsort(b)
        a, b, c, doc, role = a[order], b[order], c[order], doc[order], role[order]
        middle = np.cumsum(np.diff(b, prepend=b[:1]) > 0)
        self.v, self.middles = self.first + len(self.words), int(middle[-1]) + 1 if size else 0
        # Only what is counted is sorted; runs that are judged look it up.
        own = np.flatnonzero(role & 1)
        self.trained = own, middle[own], c[own], doc[own]
        self.contexts, self.context = np.unique(middle[own] * self.v + a[own], return_inverse=True)
        self.runs3, self.run, self.n3 = np.unique(self.context * self.v + c[own], return_inverse=True, return_counts=True)
        self.runs2, self.shorter = np.unique(middle[own] * self.v + c[own], return_inverse=True)
        self.pair = np.empty(len(self.runs3), np.int64)
        self.pair[self.run] = self.shorter
        self.n2 = np.bincount(self.pair, minlength=len(self.runs2))
        self.context_of, self.b_of, self.c_of = self.runs3 // self.v, self.runs2 // self.v, self.runs2 % self.v
        own = np.flatnonzero(role & 2)
        self.b, self.c, self.doc = middle[own], c[own], doc[own]
        self.at_context, self.b_c = self.b * self.v + a[own], self.b * self.v + self.c

    @staticmethod
    def sole(at: np.ndarray, size: int, doc: np.ndarray) -> np.ndarray:
        """The document that alone holds a row, -1 where several do, -2 where none does."""
        out = np.full(size, -2, np.int32)
        out[at] = doc
        out[at[out[at] != doc]] = -1
        return out


def cut_of(n: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.minimum(np.array([0.0, *discounts])[np.minimum(n, 3)], n)


def looked_up(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def thrifty_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run over one group, with its memory given back at its end."""

    def wrapped(table: pa.Table) -> pa.Table:
        return next(thrifty(lambda tables: map(run, tables))(iter([table])))

    return wrapped


def languages_of(table: pa.Table, known: dict) -> Iterator[tuple[str, Bucket]]:
    rows: dict[str, list[dict]] = {}
    for batch in table.to_batches():
        for r in batch.to_pylist():
            rows.setdefault(r["lang"], []).append(r)
    for lang in list(rows):
        yield lang, Bucket(rows.pop(lang), len(known[lang][0]) + 1 if lang in known else 1)


def message(slot: int, lang: str, order: int, keys: np.ndarray, columns: list[np.ndarray]) -> dict:
    """A row of ascending keys (64 bits) and their columns, packed."""
    return {"slot": slot, "lang": lang, "order": order, "size": len(keys), "keys": packed(np.diff(keys, prepend=keys.dtype.type(0))), "columns": [packed(c) for c in columns]}


def opened(row: dict, key: type, kinds: list[type]) -> list[np.ndarray]:
    return [np.cumsum(unpacked(row["keys"], row["size"], key), dtype=key), *[unpacked(c, row["size"], kind) for c, kind in zip(row["columns"], kinds, strict=True)]]


def messages(lang: str, order: int, slots: int, keys: np.ndarray, columns: list[np.ndarray]) -> list[dict]:
    """Ascending keys dealt out to slots."""
    slot = dealt_by(keys.view(np.uint64), lang, slots)
    at = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[at], np.arange(slots + 1)).tolist()
    return [message(i, lang, order, keys[at[a:b]], [c[at[a:b]] for c in columns]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def merged(keys: np.ndarray, n: np.ndarray, spelled: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words once each: n summed, and the key of the document that alone holds one, else 0."""
    every, at = np.unique(keys, return_inverse=True)
    sums, sole, out = np.bincount(at, n, len(every)).astype(np.int64), np.zeros(len(every), np.int64), np.empty(len(every), np.float32)
    sole[at], out[at] = alone, spelled
    sole[at[sole[at] != alone]] = 0
    return every, sums, out, sole


def count_bucket(slots: int) -> Callable[[pa.Table], pa.Table]:
    """Function of a bucket that deals out the continuations of its last words (order 1), and gives the counts of counts of orders 3 and 2."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for lang, b in languages_of(table, {}):
            n, sole = np.bincount(b.c_of, minlength=b.v)[b.first :], b.sole(b.trained[2], b.v, b.trained[3])[b.first :]
            at = np.flatnonzero(n)
            alone = np.where(sole[at] >= 0, b.keys[np.maximum(sole[at], 0)], 0)
            out += messages(lang, 1, slots, b.words[at], [n[at].astype(np.int64), b.spelled[at], alone])
            for order, n in ((3, b.n3), (2, b.n2)):
                out.append(message(-1, lang, order, np.arange(1, 5, dtype=np.uint64), [np.bincount(n[n < 5], minlength=5)[1:5].astype(np.int64), np.zeros(4, np.float32), np.zeros(4, np.int64)]))
        return pa.Table.from_pylist(out, schema=DEALT)

    return run


def merge_words(table: pa.Table) -> pa.Table:
    """The messages of a slot as one for each language and order."""
    rows: dict[tuple[str, int], list[dict]] = {}
    for r in table.to_pylist():
        rows.setdefault((r["lang"], r["order"]), []).append(r)
    out = []
    for (lang, order), own in rows.items():
        parts = [opened(r, np.uint64, [np.int64, np.float32, np.int64]) for r in own]
        words, *columns = merged(*[np.concatenate(c) for c in zip(*parts, strict=True)])
        out.append(message(table["slot"][0].as_py(), lang, order, words, columns))
    return pa.Table.from_pylist(out, schema=DEALT)


def frequent_of(slots_of: DataFrame, slots: int) -> DataFrame:
    """By language and slot: counts of counts (n1 to n4), words from 3 on, all continuations, the holder where there is one, its share of the most frequent words, and a filter of all its words."""
    share = -(-FREQUENT // slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words, n, spelled, alone = opened(r, np.uint64, [np.int64, np.float32, np.int64])
                of = np.bincount(n[n < 5], minlength=5)
                lone = int(alone[0]) if r["order"] == 1 and (alone == alone[0]).all() else 0
                best = np.sort(np.argsort(np.where(alone == 0, -n, 0), kind="stable")[:share]) if r["order"] == 1 else np.empty(0, np.int64)
                best = best[alone[best] == 0]
                n4 = n.tolist() if r["order"] > 1 else of[1:5].tolist()
                bits = word_filter(words, FILTER_BITS // slots) if r["order"] == 1 else np.empty(0, np.uint8)
                out.append({"lang": r["lang"], "slot": r["slot"], "order": r["order"], "bits": bits.tobytes(), "counts": [*n4, int((n > 2).sum()), int(n.sum()), lone], "words": words[best].tobytes(), "n": n[best].tobytes(), "spelled": spelled[best].tobytes()})
            yield from pa.Table.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("order", pa.int32()), ("bits", pa.binary()), ("counts", pa.list_(pa.int64())), ("words", pa.binary()), ("n", pa.binary()), ("spelled", pa.binary())])).to_batches()

    return slots_of.mapInArrow(run, "lang string, slot int, order int, bits binary, counts array<bigint>, words binary, n binary, spelled binary")


def judge_bucket(model: dict, frequent, slots: int) -> Callable[[pa.Table], pa.Table]:
    """Function of a bucket that deals out -ln p by document (order 0), and the runs whose last word is not among the frequent ones by that word (order 1)."""

    def run(table: pa.Table) -> pa.Table:
        out, costs = [], []
        for lang, b in languages_of(table, frequent.value):
            cut3, cut2 = (cut_of(n, model["discounts"].get((lang, o), (0.5, 0.5, 0.5))) for o, n in ((3, b.n3), (2, b.n2)))
            total3 = np.bincount(b.context_of, b.n3, len(b.contexts))
            left3 = np.bincount(b.context_of, cut3, len(b.contexts)) / np.maximum(total3, 1)
            total2 = np.bincount(b.b_of, b.n2, b.middles)
            left2 = np.bincount(b.b_of, cut2, b.middles) / np.maximum(total2, 1)
            own2 = (b.n2 - cut2) / np.maximum(total2[b.b_of], 1)
            own3 = (b.n3 - cut3) / np.maximum(total3[b.context_of], 1)
            _, middle, _, doc = b.trained
            sole3, sole2, sole_context, sole_b = b.sole(b.run, len(b.runs3), doc), b.sole(b.shorter, len(b.runs2), doc), b.sole(b.context, len(b.contexts), doc), b.sole(middle, b.middles, doc)
            # -ln p of a run is base - ln(one + more * p of its last word), or base and what the last word costs.
            size = len(b.c)
            base, one, more, met = np.zeros(size), np.zeros(size), np.ones(size), np.zeros(size, bool)
            at, there = looked_up(b.contexts, b.at_context)
            held = np.flatnonzero(there)
            place, found = looked_up(b.runs3, at[held] * b.v + b.c[held])
            place, held = place[found], held[found]
            other = sole3[place] != b.doc[held]
            three, held = place[other], held[other]
            shorter = b.pair[three]
            one[held] = own3[three] + left3[b.context_of[three]] * own2[shorter]
            more[held] = left3[b.context_of[three]] * left2[b.b_of[shorter]]
            met[held] = True
            there &= ~met
            there[there] = sole_context[at[there]] != b.doc[there]
            base[there] -= np.log(np.maximum(left3, 1e-12))[at[there]]
            held = np.flatnonzero(~met)
            place, found = looked_up(b.runs2, b.b_c[held])
            place, held = place[found], held[found]
            other = sole2[place] != b.doc[held]
            two, held = place[other], held[other]
            one[held], more[held] = own2[two], left2[b.b_of[two]]
            met[held] = True
            held = np.flatnonzero(~met)
            held = held[(sole_b[b.b[held]] != -2) & (sole_b[b.b[held]] != b.doc[held])]
            base[held] -= np.log(np.maximum(left2, 1e-12))[b.b[held]]
            p = frequent.value[lang][2] if lang in frequent.value else np.ones(1)
            rest = b.c >= b.first
            cost = base - np.log(one + more * p[np.minimum(b.c, len(p) - 1)])
            # Uncounted words: nothing longer is found either, and ``letters`` has the sum of their letters.
            none = np.flatnonzero(b.c == b.first - 1)
            cost[none] = base[none]
            if lang in model["rest"]:
                left, lone = model["rest"][lang][0], model["lone"].get(lang, 0)
                cost[none] -= np.where((b.keys[b.doc[none]] == lone) & (lone != 0), 0.0, np.log(max(left, 1e-12)))
            cost[rest] = 0.0
            sums = np.bincount(b.doc, cost, len(b.keys)) + b.letters
            held = np.flatnonzero(np.bincount(b.doc[~rest], minlength=len(b.keys)))
            costs.append((b.keys[held], sums[held]))
            at = np.flatnonzero(rest)
            at = at[np.argsort(b.c[at], kind="stable")]
            place = b.c[at] - b.first
            single = np.where(met[at], one[at], -1.0)
            out += messages(lang, 1, slots, b.words[place], [b.keys[b.doc[at]], *(x.astype(np.float32) for x in (base[at], single, more[at])), b.spelled[place]])
        out += summed(costs, slots)
        return pa.Table.from_pylist(out, schema=DEALT)

    return run


def summed(costs: list[tuple[np.ndarray, np.ndarray]], slots: int) -> list[dict]:
    """-ln p by document of all that a group has judged: a message a slot, however many the group got."""
    if not costs:
        return []
    keys, at = np.unique(np.concatenate([k for k, _ in costs]), return_inverse=True)
    return messages("", 0, slots, keys, [np.bincount(at, np.concatenate([c for _, c in costs]), len(keys)).astype(np.float32)])


def judge_rest(model: dict, slots: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of a slot's runs and its table of single words: -ln p by document, dealt out."""

    def run(runs: pa.Table, words: pa.Table) -> pa.Table:
        of, costs = {r["lang"]: r for r in words.to_pylist()}, []
        for r in runs.to_pylist():
            word, key, cost, one, more, spelled = opened(r, np.uint64, [np.int64, *[np.float32] * 4])
            cost, one, more = (x.astype(np.float64) for x in (cost, one, more))
            p, alone, there = np.zeros(len(word)), np.zeros(len(word), np.int64), np.zeros(len(word), bool)
            left, lone = model["rest"].get(r["lang"], (0.0, (0.5, 0.5, 0.5), 1))[0], model["lone"].get(r["lang"], 0)
            if r["lang"] in of:
                table, n, letters, sole = opened(of[r["lang"]], np.uint64, [np.int64, np.float32, np.int64])
                at, there = looked_up(table, word)
                p, alone = np.where(there, single_words(model, r["lang"], n, letters)[at], 0.0), sole[at]
            met = one >= 0
            known = ~met & there & ((alone == 0) | (alone != key))
            cost[met] -= np.log(one[met] + more[met] * p[met])
            cost[known] -= np.log(p[known])
            none = ~met & ~known
            cost[none] += spelled[none]
            if r["lang"] in model["rest"]:
                cost[none] -= np.where((key[none] == lone) & (lone != 0), 0.0, np.log(max(left, 1e-12)))
            costs.append((key, cost))
        return pa.Table.from_pylist(summed(costs, slots), schema=DEALT)

    return run


def single_words(model: dict, lang: str, n: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """p of single words by their continuations."""
    left, discounts, total = model["rest"][lang]
    return (n - cut_of(n, discounts)) / total + left * np.exp(-spelled.astype(np.float64))


def sum_costs(table: pa.Table) -> pa.Table:
    """-ln p of each document of a slot."""
    parts = [opened(r, np.int64, [np.float32]) for r in table.to_pylist()]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return pa.table([pa.array(keys), pa.array(np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)))], names=["key", "cost"])


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Discounts of n = 1, 2, 3+ from the counts of counts 1 to 4; where there is too little text, 0.5."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return tuple(max(0.1, min(i - 0.1, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[0] else 0.5 for i in (1, 2, 3))


def train_words(rows: DataFrame, sent, buckets: int, slices: int) -> tuple[DataFrame, dict, dict]:
    """Packed table of single words of all counted texts of rows by slot, what each language needs (bounded by the number of languages), and its most frequent words.

    Words are counted by their continuations, and a word's row has the key of the document that alone holds it.
    """
    counted, parts = rows.filter("role in (1, 3)"), []
    for low in range(0, buckets, buckets // slices):
        runs = packed_runs(counted, sent, buckets, low, low + buckets // slices)
        tally = runs.groupBy("bucket").applyInArrow(thrifty_group(count_bucket(buckets)), DEALT_SQL)
        parts.append(stored(tally.groupBy("slot").applyInArrow(merge_words, DEALT_SQL), "tally"))
    words = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            words = words.union(part)
        words = stored(words.groupBy("slot").applyInArrow(merge_words, DEALT_SQL), "words")
        dropped(*parts)
    sums: dict[tuple[str, int], list] = {}
    best: dict[str, list] = {}
    filters: dict[str, dict[int, bytes]] = {}
    for r in frequent_of(words, buckets).toLocalIterator():
        old = sums.setdefault((r.lang, r.order), [0] * 6 + [r.counts[6]])
        sums[r.lang, r.order] = [a + b for a, b in zip(old[:6], r.counts[:6], strict=True)] + [r.counts[6] if r.counts[6] == old[6] else 0]
        if r.order == 1:
            filters.setdefault(r.lang, {})[r.slot] = bytes(r.bits)
            best.setdefault(r.lang, []).append([np.frombuffer(bytes(v), t) for v, t in ((r.words, np.uint64), (r.n, np.int64), (r.spelled, np.float32))])
    model: dict = {"discounts": {at: discounts_of(n[:4]) for at, n in sums.items()}, "rest": {}, "lone": {}}
    for (lang, order), n in sums.items():
        if order == 1:
            d = model["discounts"][lang, 1]
            cuts = n[0] * min(1.0, d[0]) + n[1] * min(2.0, d[1]) + n[4] * min(3.0, d[2])
            model["rest"][lang], model["lone"][lang] = (cuts / n[5], d, n[5]), n[6]
    table = {}
    for lang, parts in best.items():
        word, n, spelled = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.argsort(-n, kind="stable")  # frequent words have small codes, which pack well
        order = np.argsort(word[by])
        p = single_words(model, lang, n[by], spelled[by])
        bits = [filters[lang].get(i, b"") for i in range(buckets)]
        sizes = np.array([8 * len(x) for x in bits], np.int64)
        filled = np.cumsum(sizes) - sizes, np.maximum(sizes - 1, 0).astype(np.uint64), np.frombuffer(b"".join(bits) + b"\0", np.uint8)
        table[lang] = word[by][order], (order + 1).astype(np.int32), np.concatenate([[1.0], p]), filled
    return words.filter("slot >= 0"), model, table


def score_words(rows: DataFrame, sent, buckets: int, slices: int, words: DataFrame, model: dict, table: dict) -> DataFrame:
    """(key, cost): -ln p of all words of each judged document of rows.

    A run is looked up among the counted ones; where it is not among them, its context's unseen rest and the shorter run are.
    What only the document itself has put into a table does not count for it, so a trusted text is judged like others.
    The most frequent words are sent to the workers, about FREQUENT a language, and a filter of all counted ones; runs that end in others
    which may be counted go to the slots of the table of words.
    """
    frequent = rows.sparkSession.sparkContext.broadcast(table)
    parts = []
    for low in range(0, buckets, buckets // slices):
        runs = packed_runs(rows, sent, buckets, low, low + buckets // slices, frequent)
        judged = stored(runs.groupBy("bucket").applyInArrow(thrifty_group(judge_bucket(model, frequent, buckets)), DEALT_SQL), "judged")
        rest = judged.filter("order = 1").groupBy("slot").cogroup(words.groupBy("slot")).applyInArrow(judge_rest(model, buckets), DEALT_SQL)
        parts.append(stored(judged.filter("order = 0").union(rest).groupBy("slot").applyInArrow(sum_costs, "key long, cost double"), "costs"))
        dropped(judged)
    frequent.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy("key").agg(F.sum("cost").alias("cost"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc, lang, key, symbols) of docs with text: the bytes of each text's words with one blank behind each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in parts_of(batch.column(3)):
                flat, offsets = split_words(part, lower=False)
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
                own = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(np.diff(ends[offsets]))], names=["doc", "lang", "key", "symbols"])

    return docs.select("doc", "lang", "key", "text").mapInArrow(thrifty(run), "doc long, lang string, key long, symbols long")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, slack: float = 1.1, short: int = 200) -> DataFrame:
    """Perplexity of every document under the model of its language, and whether it is kept.

    Returns id_col, lang, symbols, perplexity, threshold, kept for every row. Trusted text is that of the documents
    labelled quality 1 and not toxic: all of it is counted. A language's threshold is ``slack`` times the
    ``quantile`` of its trusted documents' perplexities; a document is kept at or below it. A short
    text varies more, so its threshold is raised by (1 + short / symbols) ** 0.5.

    Words are counted in runs of three, in tables that grow with the text and are joined with each document's runs. symbols are the
    bytes of its words with one blank behind each, and perplexity is by symbol. A document is judged without what it alone
    has put into the tables. Only the model that spells unseen words (CLASSES ** 3 sequences at most) is sent to the workers.
    Null, empty or blank texts have no perplexity and are not kept. A null language, or one without trusted text, is judged by the
    model and threshold of all languages. Repeated rows are judged alike. Without trusted text no document has a perplexity
    or threshold, and none is kept; an empty table gives an empty one. Extra columns are left out, so none clashes.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    trusted = stored(labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc")).filter("doc IS NOT NULL").distinct(), "trusted")
    n = trusted.count()
    ids = F.broadcast(trusted) if n <= BROADCAST_IDS else trusted
    own = own.withColumn("key", F.xxhash64("doc", "lang", "text"))
    good = own.join(ids, "doc", "left_semi").withColumn("lang", F.coalesce("lang", F.lit(ALL + ALL)))
    model = train_model(good.select(F.lit("").alias("lang"), "text"))
    if ALL not in model:
        none = F.lit(None).cast("double")
        return own.select(F.col("doc").alias(id_col), "lang", F.lit(0).cast("long").alias("symbols"), none.alias("perplexity"), none.alias("threshold"), F.lit(False).alias("kept"))
    langs = stored(good.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("lang", F.col("lang").alias("name")).distinct(), "langs")
    few = langs.count() <= 1000
    named = own.join(F.broadcast(langs) if few else langs, "lang", "left").withColumn("name", F.coalesce("name", F.lit(ALL)))
    marked = named.join(ids.withColumn("good", F.lit(True)), "doc", "left").withColumn("lang", F.coalesce("lang", F.lit(ALL + ALL)))
    rows = marked.select("key", F.col("name").alias("lang"), "text", F.when(F.col("good") & F.col("name").isin(ALL, F.col("lang")), 3).otherwise(2).alias("role"))
    if named.filter(F.col("name") == ALL).limit(1).count():  # else no document needs the model of all languages
        other = marked.filter("good").withColumn("role", F.lit(1))
        rows = rows.union(other.filter("lang <> name").select("key", "lang", "text", "role"))
        rows = rows.union(other.filter(F.col("name") != ALL).select("key", F.lit(ALL).alias("lang"), "text", "role"))
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 if length < SLICED else SLICES
    buckets = 2 * slices * max(own.sparkSession.sparkContext.defaultParallelism // 2, -(-length // (12 * slices * RUNS)))
    sent = own.sparkSession.sparkContext.broadcast(surprise(model[ALL]))
    with freed(own.sparkSession):
        costs = score_words(rows, sent, buckets, slices, *train_words(rows, sent, buckets, min(slices, 2)))
        costs = stored(costs, "cost")
    sent.destroy()
    rows = stored(sized(own), "sizes")
    copies = rows.groupBy("key").agg(F.sum("symbols").alias("all_symbols"))
    scored = rows.join(copies, "key").join(costs, "key", "left").select("doc", "lang", "symbols", F.exp(F.try_divide("cost", F.col("all_symbols"))).alias("perplexity"))
    scored = stored(scored, "scored")
    level = lambda: F.percentile_approx("perplexity", quantile, 10_000) * slack
    good = scored.join(ids, "doc", "left_semi").filter("perplexity IS NOT NULL").groupBy("lang").agg(level().alias("level"))
    every = scored.join(ids, "doc", "left_semi").agg(level().alias("common"))
    out = scored.join(F.broadcast(good), "lang", "left") if few else scored.join(good, "lang", "left")
    common = every.first()[0]
    limit = F.coalesce("level", F.lit(common)) * F.sqrt(1 + F.try_divide(F.lit(float(short)), F.col("symbols")))
    return out.select(F.col("doc").alias(id_col), "lang", "symbols", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
