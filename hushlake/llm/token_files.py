"""Token ids in files of independent zstandard frames with a trailing seek table, written and read by tasks."""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .shared import shared_folder, thrifty
from .words import parts_of, split_words

#: Fixed values of the published seekable format of zstandard: magic numbers of a skippable frame, of the seek table's frame and of its
#: last bytes, and the descriptor that says that entries hold checksums.
SKIPPABLE, TABLE_FRAME, TABLE_END, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids of a frame at most; a longer document takes several frames.
FRAME_IDS = 65_536
#: Bounds on the words whose ids a worker remembers (their number and characters), and on rows and bytes given out at a time. Results don't depend on them.
MAX_WORDS, MAX_CHARS, ROWS, PART_BYTES = 800_000, 16_000_000, 256, 4_000_000
#: What a row of the manifest says of one file.
MANIFEST = "part int, path string, docs long, ids long, first_id long, last_id long, bytes long"


def checksum(data: bytes) -> int:
    """Low 32 bits of XXH64, as the seekable format has it."""
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them, for a vocabulary that drops white space, lower-cases, and cuts punctuation off words.

    The library encodes each distinct word once, without capitals A-Z and a last punctuation mark after a letter; a text's ids are those of its words in
    order. Words of letters only go to the library as one text: each ends with a token that has the end suffix, and with nothing else.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(1 + max(self.library.get_vocab().values()), bool)
        self.ends[[i for token, i in spec["model"]["vocab"].items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.used = 0, 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def encoded(self, words: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        if letters:
            ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(words) and len(ids) == last[-1] + 1:  # every word has one end at least
                return ids, np.diff(last, prepend=-1)
        each = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(size.sum())), size

    def learn(self, words: list[str]) -> None:
        alpha = [w for w in words if w.isalpha()]
        for own, letters in ((alpha, True), ([w for w in words if not w.isalpha()], False)):
            for k in range(0, len(own), 4096):
                part = own[k : k + 4096]
                ids, size = self.encoded(part, letters)
                n = len(self.known)
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
                while n + len(part) > len(self.starts):
                    self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
                self.flat[self.used : self.used + len(ids)] = ids
                self.sizes[n : n + len(part)] = size
                self.starts[n : n + len(part)] = self.used + np.cumsum(size) - size
                self.used += len(ids)
                self.known.update(zip(part, range(n, n + len(part)), strict=True))
                self.chars += sum(map(len, part))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Places of words among those known."""
        distinct = words.to_pylist()
        self.learn([w for w in dict.fromkeys(distinct) if w not in self.known])
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is like an empty one."""
        for _, part in parts_of(texts):
            words, offsets = split_words(part, lower=False)
            coded = words.dictionary_encode()
            # A special token's text keeps its capitals.
            own = pc.if_else(pc.match_substring(coded.dictionary, "<|"), coded.dictionary, pc.ascii_lower(coded.dictionary))
            marked = pc.match_substring_regex(own, r"[a-z][.,;:!?]$")
            stems = pc.if_else(marked, pc.utf8_slice_codeunits(own, 0, -1), own).dictionary_encode()
            marks = pc.utf8_slice_codeunits(own.filter(marked), -1).dictionary_encode()
            if len(self.known) + len(stems.dictionary) + 8 > MAX_WORDS or self.chars > MAX_CHARS:
                self.forget()
            stem, mark = self.numbers(stems.dictionary), self.numbers(marks.dictionary)
            # Of each word its stem's and its mark's number, -1 where there is none.
            number = np.full((len(own), 2), -1, np.int64)
            if len(own):
                number[:, 0] = stem[stems.indices.to_numpy()]
                number[np.flatnonzero(marked.to_numpy(zero_copy_only=False)), 1] = mark[marks.indices.to_numpy()] if len(mark) else -1
            said = number[coded.indices.to_numpy()].ravel() if len(own) else number.ravel()
            size = np.where(said >= 0, self.sizes[said], 0)
            ends = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(self.starts[said] - ends[:-1], size) + np.arange(ends[-1])]
            cuts = ends[2 * offsets]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield ids[a:b]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each worker; Spark keeps the workers between tasks."""
    return LibraryEncoder(path)


class FrameWriter:
    """Writes one file: each document's frames, then a table of documents, then the seek table."""

    def __init__(self, out, frame_ids: int) -> None:
        self.out, self.frame_ids, self.size = out, frame_ids, 0
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.entries: list[bytes] = []
        self.docs: list[tuple[int | None, int]] = []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def frame(self, stored: bytes, size: int, mark: int) -> None:
        self.write(stored)
        self.entries.append(struct.pack("<III", len(stored), size, mark))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        for k in range(0, max(1, len(ids)), self.frame_ids):
            raw = ids[k : k + self.frame_ids].astype("<u4").tobytes()
            self.frame(self.compress(raw), len(raw), checksum(raw))
        self.docs.append((doc, len(ids)))

    def finish(self) -> None:
        names = np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes()
        table = self.compress(struct.pack("<QQ", len(self.docs), self.frame_ids) + names + np.array([d is not None for d, _ in self.docs], np.uint8).tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes())
        self.frame(struct.pack("<II", SKIPPABLE, len(table)) + table, 0, checksum(table))
        body = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, TABLE_END)
        self.write(struct.pack("<II", TABLE_FRAME, len(body)) + body)


class FrameReader:
    """Reads one file by its seek table; only the frames of documents that are asked for are read and decompressed."""

    def __init__(self, source, size: int) -> None:
        self.source, self.decompress = source, zstandard.ZstdDecompressor().decompress
        frames, descriptor, end = struct.unpack("<IBI", source.read_at(9, size - 9))
        if end != TABLE_END or descriptor != WITH_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        entries = np.frombuffer(source.read_at(12 * frames, size - 9 - 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.marks = entries.T
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        table = source.read_at(int(self.sizes[-1]) - 8, int(self.offsets[-2]) + 8)
        if checksum(table) != self.marks[-1]:
            raise ValueError("the table of documents does not fit its checksum")
        body = self.decompress(table)
        n, frame_ids = struct.unpack_from("<QQ", body)
        self.known = np.frombuffer(body, np.uint8, n, 16 + 8 * n).astype(bool)
        self.docs = np.frombuffer(body, "<i8", n, 16)
        self.counts = np.frombuffer(body, "<i8", n, 16 + 9 * n)
        self.starts = np.cumsum(self.counts) - self.counts
        self.frames = np.concatenate([[0], np.cumsum(np.maximum(1, -(-self.counts // frame_ids)))])

    def ids(self, place: int) -> bytes:
        """Ids of the document at a place, as little-endian 32-bit numbers."""
        first, last = int(self.frames[place]), int(self.frames[place + 1])
        data = self.source.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for k in range(first, last):
            at = int(self.offsets[k] - self.offsets[first])
            raw = self.decompress(data[at : at + int(self.sizes[k])], max_output_size=int(self.raw_sizes[k]))
            if checksum(raw) != self.marks[k]:
                raise ValueError(f"frame {k} does not fit its checksum")
            out.append(raw)
        return out[0] if len(out) == 1 else b"".join(out)

    def places(self, doc: int) -> range:
        """Places of the documents of an id, which stand in ascending order after those without one."""
        nulls = len(self.known) - int(self.known.sum())
        return range(nulls + int(np.searchsorted(self.docs[nulls:], doc, "left")), nulls + int(np.searchsorted(self.docs[nulls:], doc, "right")))


def library_ids(vocabulary: str, end_id: int | None = None) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """Function of texts to the library's ids of each, with end_id after them."""

    def run(texts: pa.Array) -> Iterator[np.ndarray]:
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for ids in library_encoder(vocabulary).encode(texts):
            yield np.concatenate([ids, end])

    return run


def write_tokens(docs: DataFrame, folder: str, encode: Callable[[pa.Array], Iterator[np.ndarray]], id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS) -> DataFrame:
    """Writes the ids of every text to files under folder in ascending id order; returns the manifest, which is stored beside them.

    ``encode`` gives the ids of each text of an Arrow array. Documents are dealt out by ranges of (id, hash of the text), so the files, by part,
    hold them in order; each task streams its own into one file. Every document begins a frame; ``frame_ids`` ids at most are in one. A task that
    is run again writes a file of another name, and only files that the manifest names count; others are removed at the end. ``folder`` must be
    reached by pyarrow's file systems (a mounted path, hdfs, s3, gcs) from driver and executors alike, and must not exist.

    Null ids come first; ids are stored as 64-bit integers. Rows of one id are documents of their own, in the order of their texts' hashes, and
    those without distinct texts are dealt out by their place in the input. A null text is like an empty one; an empty table gives an empty
    manifest. Other columns are left out.
    """
    spark = docs.sparkSession
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, stream, path = TaskContext.get().partitionId(), None, None, f"{folder}/part-{uuid.uuid4().hex}.zst"
        gc.disable()  # the encoder's table of words holds no cycles, and walking it again and again is slow
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                own, place = fs.FileSystem.from_uri(path)
                stream = own.open_output_stream(place, compression=None, buffer_size=1 << 20)
                writer = FrameWriter(stream, frame_ids)
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                writer.add(doc, ids)
        gc.enable()
        if writer is not None:
            writer.finish()
            stream.close()
            row = [part, path, len(writer.docs), sum(n for _, n in writer.docs), writer.docs[0][0], writer.docs[-1][0], writer.size]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "path", "docs", "ids", "first_id", "last_id", "bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("doc", "text", order[1].alias("mark"), order[2].alias("row"))
    dealt = rows.repartitionByRange(order[0], "mark", "row").sortWithinPartitions(order[0], "mark", "row").select("doc", "text")
    dealt.mapInArrow(thrifty(run), MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = read_manifest(spark, folder)
    # As many rows as there were tasks.
    named = {r[0].rsplit("/", 1)[-1] for r in manifest.select("path").collect()}
    for info in files.get_file_info(fs.FileSelector(base)):
        if info.base_name.endswith(".zst") and info.base_name not in named:
            files.delete_file(info.path)
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents of a folder of token files: id_col, start (ids of all documents before it), n_tokens, token_bytes (little-endian 32-bit ids).

    Without ``wanted`` each task goes through one file, frame by frame; with it (a table with id_col; nulls and unknown ids find nothing,
    repeated ones count once) only the frames of those documents are read. A frame that doesn't fit its checksum is an error.
    """
    # One row a file.
    manifest = read_manifest(spark, folder)
    files = manifest.count()
    offset = F.coalesce(F.expr("sum(ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    rows = manifest.select("path", "bytes", offset.alias("offset"), "first_id", "last_id")
    if wanted is None:
        rows = rows.select("path", "bytes", "offset", F.lit(None).cast("long").alias("doc")).repartition(max(1, files), "path")
    else:
        asked = wanted.select(F.col(id_col).cast("long").alias("doc")).filter("doc IS NOT NULL").distinct()
        inside = (F.col("doc") >= F.coalesce("first_id", F.lit(-(2**63)))) & (F.col("doc") <= F.col("last_id"))
        rows = asked.join(F.broadcast(rows), inside).select("path", "bytes", "offset", "doc")
        rows = rows.repartition("path").sortWithinPartitions("path", "doc")
    everything = wanted is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != now:
                    own, place = fs.FileSystem.from_uri(row["path"])
                    now, reader = row["path"], FrameReader(own.open_input_file(place), row["bytes"])
                for k in range(len(reader.docs)) if everything else reader.places(row["doc"]):
                    data = reader.ids(k)
                    out.append((int(reader.docs[k]) if reader.known[k] else None, row["offset"] + int(reader.starts[k]), int(reader.counts[k]), data))
                    size += len(data)
                    if len(out) >= ROWS or size >= PART_BYTES:
                        yield as_batch(out)
                        out, size = [], 0
        if out:
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["doc", "start", "n_tokens", "token_bytes"])

    return rows.mapInArrow(thrifty(run), "doc long, start long, n_tokens long, token_bytes binary").withColumnRenamed("doc", id_col)


#: The id that ends each document in the registered query.
END_ID = 2


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token_files-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_tokens(docs, folder, library_ids(vocabulary_path("word_bpe_49k.json"), END_ID))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("token_bytes").alias("ids_crc32"))
