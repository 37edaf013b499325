"""Benchmark decontamination on canonical templates: numbers, names and units become typed slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, thrifty
from .words import hash_strings, parts_of, run_hashes, split_words

#: Words that are a unit after a number. Fixed values.
UNITS = ["%", "percent", "mm", "cm", "m", "km", "in", "ft", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "g", "kg", "mg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "km/h", "m/s", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "a", "j", "kj", "kb", "mb", "gb", "tb", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "gbp", "c", "f", "k", "degree", "degrees"]
NUMBER = r"^[+\-]?[$€£]?[+\-]?\d[\d.,:/]*(st|nd|rd|th)?$"
#: Number words, alone or joined by hyphens, in lower case. Fixed values.
NUMBER_WORD = r"^(?:WORD)(?:-(?:WORD))*$".replace("WORD", "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion")
#: Readings of a text, compared each with its like: 0 as documented, 1 with every capitalised word a name, 2 all words literal.
VIEWS = (0, 1, 2)
#: Hashes of the slots; a slot also is a word's kind: 0 literal, 1 number, 2 name, 3 unit.
SLOTS = np.array([0, 0xA5A5A5A51, 0xA5A5A5A52, 0xA5A5A5A53], np.uint64)
HINT_BITS = 22
#: Windows broadcast at most; beyond that the join shuffles.
BROADCAST_WINDOWS = 1_000_000


class Templates:
    """Canonical words of a batch of texts in one of VIEWS: core words, template and literal hashes, kinds, offsets."""

    def __init__(self, literal: np.ndarray, kind: np.ndarray, offsets: np.ndarray, core: pa.Array, at: np.ndarray, spans: np.ndarray) -> None:
        self.literal, self.kind, self.offsets, self.core, self.at, self.spans = literal, kind, offsets, core, at, spans
        self.template = np.where(kind > 0, SLOTS[kind], literal)

    @classmethod
    def of(cls, texts: pa.Array) -> list[Templates]:
        """All views of the texts."""
        flat, offsets = split_words(texts, lower=False)
        coded = flat.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        core = pc.replace_substring_regex(distinct, r"^[^\pL\pN$€£%+\-]+|[^\pL\pN%]+$", "")
        lower = pc.utf8_lower(core)
        flags = [pc.match_substring_regex(core, NUMBER), pc.match_substring_regex(core, r"^\p{Lu}.*\p{Ll}"), pc.is_in(lower, pa.array(UNITS)), pc.match_substring_regex(distinct, r"[.!?:][^\pL\pN]*$"), pc.equal(pc.binary_length(core), 0), pc.match_substring_regex(lower, NUMBER_WORD), pc.match_substring_regex(core, r"^\p{Lu}.*\p{L}")]
        number, cased, unit, ends, empty, said, capital = (x.to_numpy(zero_copy_only=False).astype(bool)[at] if len(distinct) else np.empty(0, bool) for x in flags)
        starts = np.concatenate([[True], ends[:-1]]) if len(ends) else ends
        starts[offsets[:-1][offsets[:-1] < len(at)]] = True
        after = lambda x: np.concatenate([[False], x[:-1]]) if len(at) else x
        keep = ~empty
        hashes = hash_strings(lower)
        literal, own = (hashes[at] if len(hashes) else hashes)[keep], at[keep]
        bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
        kinds = [np.where(n, 1, np.where(unit & after(n), 3, np.where(names, 2, 0)))[keep] for n, names in ((number, cased & ~starts), (number | said, capital))]
        each = np.arange(len(own) + 1)
        views = [cls(literal, kinds[0], bounds, lower, own, each)]
        # A name or number of several words is one slot, but a sentence's first word stands alone.
        kind, first = kinds[1], starts[keep]
        follows = np.concatenate([[False], (kind[1:] == kind[:-1]) & np.isin(kind[1:], (1, 2)) & ~first[1:] & ~first[:-1]]) if len(own) else first
        heads = np.flatnonzero(~follows)
        views.append(cls(literal[heads], kind[heads], np.concatenate([[0], np.cumsum(~follows)])[bounds], lower, own, np.concatenate([heads, [len(own)]])))
        joined = np.flatnonzero(np.diff(views[1].spans) > 1)
        for i in joined.tolist():
            with np.errstate(over="ignore"):
                views[1].literal[i] = run_hashes(literal[views[1].spans[i] : views[1].spans[i + 1]], int(views[1].spans[i + 1] - views[1].spans[i]))[0]
        return [*views, cls(literal, np.zeros(len(own), np.int64), bounds, lower, own, each)]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of size words, and whether it lies within one text.

        A window that is mostly slots says little as a template: it counts with its literal words.
        """
        n = len(self.literal) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        slots = np.concatenate([[0], np.cumsum(self.kind > 0)])
        few = slots[size:] - slots[:-size] > size // 2
        with np.errstate(over="ignore"):
            out = np.where(few, run_hashes(self.literal, size) + np.uint64(1), run_hashes(self.template, size))
        inside = np.zeros(n, bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            inside[a : max(a, b - size + 1)] = True
        return out, inside

    def slots(self, start: int, size: int) -> list[str]:
        """The window's slot values, each after its kind."""
        return [str(self.kind[i]) + " ".join(self.core[int(k)].as_py() for k in self.at[self.spans[i] : self.spans[i + 1]]) for i in range(start, start + size) if self.kind[i]]


def item_windows(items: DataFrame, size: int, shortest: int) -> DataFrame:
    """(item, words, at, size, hash, slots, view): all windows of the items; an item under size words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for view, t in zip(VIEWS, Templates.of(batch.column(1)), strict=True):
                bounds = list(zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True))
                for own in {min(size, b - a) for a, b in bounds if b - a >= shortest}:
                    hashes, _ = t.windows(own)
                    for item, (a, b) in zip(batch.column(0).to_pylist(), bounds, strict=True):
                        if min(size, b - a) == own:
                            rows += [(item, b - a, i - a, own, int(hashes[i].astype(np.int64)), t.slots(i, own), view) for i in range(a, b - own + 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item", "words", "item_at", "size", "hash", "item_slots", "view"])

    return items.mapInArrow(thrifty(run), "item long, words int, item_at int, size int, hash long, item_slots array<string>, view int")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 8, min_words: int = 13, min_share: float = 0.6, shortest: int = 4) -> DataFrame:
    """Documents that hold benchmark items, word for word or with other numbers, names or units.

    Returns one row for each document and item: id_col, item_col, n_words (words of the item found),
    longest (longest run), share (of the item's words), exact (all slots as in the item).
    Words are cleaned of punctuation and lower-cased; numbers, capitalised words within a sentence and
    units after numbers become typed slots. Windows of ``size`` words are hash-joined with those of the items; matches with
    the same shift form runs. A run counts if its slots are consistent: a value of the item always stands
    for one value in the document, and different values for different ones. An item is reported if a run has min_words words (the whole
    item, if shorter), or all runs together cover min_share of the item; a word of the item that the document repeats counts once.

    Each text is read in three ways, and an item is reported if one of them finds it: as above; with number words as numbers,
    every capitalised word (also a sentence's first, or one in capitals) as a name, and neighbouring words of a name or number as one
    slot and one word; and with all words literal, which finds copies in another case. A changed name in a copy that
    also lost its capitals is not seen, nor a changed count of words in a name that begins a sentence.

    The items' windows are broadcast up to BROADCAST_WINDOWS rows, else the join shuffles. Documents send
    only windows whose hash may be among the items'. Null or empty texts hold nothing; items under ``shortest``
    words are too common to look for; rows with the same id are one document; a null id is an id of its
    own. Extra columns are left out.
    """
    windows = stored(item_windows(items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).distinct(), size, shortest), "windows")
    count = windows.count()
    bit = F.col("hash").bitwiseAND((1 << HINT_BITS) - 1) + 1
    bits = windows.groupBy(F.bitmap_bucket_number(bit).alias("place")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    hint = np.zeros(1 << HINT_BITS - 3, np.uint8)
    for r in bits:  # 128 rows of 4 KB at most
        hint[(r.place - 1) << 12 : r.place << 12] = np.frombuffer(r.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(hint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = np.unpackbits(sent.value, bitorder="little").astype(bool)
        for batch in batches:
            for first, part in parts_of(batch.column(1)):
                for view, t in zip(VIEWS, Templates.of(part), strict=True):
                    for own in sizes:
                        hashes, inside = t.windows(own)
                        at = np.flatnonzero(inside & hint[(hashes & np.uint64((1 << HINT_BITS) - 1)).astype(np.intp)])
                        if len(at):
                            doc = np.searchsorted(t.offsets, at, "right") - 1
                            slots = pa.array([t.slots(i, own) for i in at.tolist()], pa.list_(pa.string()))
                            numbers = [pa.array(np.full(len(at), x, np.int32)) for x in (own, view)]
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + doc)), pa.array((at - t.offsets[doc]).astype(np.int32)), pa.array(hashes[at].view(np.int64)), *numbers, slots], names=["doc", "at", "hash", "size", "view", "slots"])

    hits = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(thrifty(run), "doc long, at int, hash long, size int, view int, slots array<string>")
    # One row a hash, so that a phrase of many items is no hot key on both sides.
    known = windows.groupBy("hash", "size", "view").agg(F.collect_list(F.struct("item", "words", "item_at", "item_slots")).alias("where"))
    known = F.broadcast(known) if count <= BROADCAST_WINDOWS else known
    met = hits.join(known, ["hash", "size", "view"]).withColumn("w", F.explode("where")).drop("where").select("*", "w.*").filter(F.size("slots") == F.size("item_slots")).select("doc", "item", "view", "words", "size", "at", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d"))).alias("pairs")).dropDuplicates(["doc", "item", "view", "at", "item_at"])
    order = Window.partitionBy("doc", "item", "view", "words", "size", "shift").orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(order)).groupBy("doc", "item", "view", "words", "size", "shift", "run").agg(F.count("*").alias("n"), F.min("item_at").alias("start"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    alone = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side]))) == F.size("pairs")
    same = alone("i") & alone("d")
    length = (F.col("n") + F.col("size") - 1).cast("long")
    runs = runs.filter(same).select("doc", "item", "view", "words", "start", length.alias("length"), F.forall("pairs", lambda p: p["i"] == p["d"]).alias("exact"))
    # A word of the item counts once, however often the document repeats it: of each start the longest run, then the union of these.
    runs = runs.groupBy("doc", "item", "view", "words", "start").agg(F.max("length").alias("length"), F.min("exact").alias("exact"))
    spans = F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "length")))  # at most one a word of the item
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(spans, zero, lambda s, x: F.struct(F.greatest(s["end"], x["start"] + x["length"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(s["end"], x["start"]))).alias("n")))
    found = runs.groupBy("doc", "item", "view", "words").agg(covered["n"].alias("n_words"), F.max("length").alias("longest"), F.min("exact").alias("exact"))
    share = F.col("n_words") / F.col("words")
    found = found.filter((F.col("longest") >= F.least(F.lit(min_words), F.col("words"))) | (share >= min_share))
    # The view that finds the largest share speaks, of equal ones the one with exact slots.
    best = F.max(F.struct(share.alias("share"), "exact", "n_words", "longest")).alias("best")
    return found.groupBy("doc", "item").agg(best).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "best.n_words", "best.longest", "best.share", "best.exact")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
