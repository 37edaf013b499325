"""Conversation trie, hard negatives and token files against plain Python over odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from hushlake.llm import hard_negatives, token_files
from hushlake.llm.bpe import vocabulary_path
from hushlake.llm.conversation_trie import conversation_trie, ids_digest, numbered, prefix_trie, rebuilt
from hushlake.llm.hard_negatives import mine_hard_negatives
from hushlake.llm.token_files import library_ids, read_manifest, read_tokens, write_tokens

TURNS = "conv_id long, turn int, role string, text string, id string, depth int"


def mark(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def sequences(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    """Turns of each conversation in order."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, mark(role or "", text or ""), role or "", text or ""))
    return {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}


def plain_trie(seqs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = set()
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y != x and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if len(seqs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns_table(seed: int, n: int = 60) -> list[tuple]:
    r, rows = random.Random(seed), []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 3, 9, 14])):
            rows.append((c * 7 - 100, None if r.random() < 0.1 else t, r.choice(["user", "bot", None]) if r.random() < 0.2 else "user", r.choice(["a", "bb", "", None, "é😀", "x" * 5000]) if r.random() < 0.3 else "hello", "other", 5))
    rows += [(None, 1, "user", "lost", "", 0), (5000, 1, "user", "same", "", 0), (5000, 1, "user", "same", "", 0), (5001, 1, "user", "tie b", "", 0), (5001, 1, "user", "tie a", "", 0)]
    return rows


@pytest.mark.parametrize("band", [2, 3, 32])
def test_trie_equals_plain(spark, band):
    rows = turns_table(band)
    table = spark.createDataFrame(rows, TURNS).repartition(5)
    got = conversation_trie(table, band=band).drop("node_a", "node_b").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_trie(sequences(rows))


def test_trie_of_rebuilt_conversations(spark):
    rows = [(c, t, "u", f"{c % 3} {t}", "", 0) for c in [*range(0, 12), *range(100, 110), 205, 300] for t in range(c % 9)]
    own = sequences(rows)
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    assert any(not s for s in seqs.values())  # a turnless one
    table = spark.createDataFrame(rows, TURNS)
    got = prefix_trie(*rebuilt(numbered(table)), band=4).drop("node_a", "node_b").collect()
    assert sorted(tuple(r) for r in got if r[2] is not None) == sorted(x for x in plain_trie(seqs) if x[2] is not None)
    assert {tuple(r) for r in got} == plain_trie(seqs)


def test_trie_of_nothing(spark):
    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_digest_of_many_ids_comes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("hushlake.llm.conversation_trie.PIECE_IDS", 7)
    rows = spark.range(2000).select(F.expr("struct(id % 3 * (id % 2) as a, 1L as b)").alias("id"), F.col("id").alias("conv"))
    own = defaultdict(list)
    for i in range(2000):
        own[i % 3 * (i % 2)].append(i)
    got = {r["id"]["a"]: r["ends_sha256"] for r in ids_digest(rows.repartition(6)).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in own.items()}


def plain_negatives(rows: list[tuple], levels: int = 256, most: int = 5) -> list[tuple]:
    fine = {(i, label, tuple(np.floor(np.array(v, float) * levels).astype(int).tolist())) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a in fine:
        if a[0] % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b) for b in fine if b != a and len(b[2]) == len(a[2]))
        for p in [x for x in scored if x[2][1] == a[1]][:most]:
            near = [x for x in scored if x[2][1] != a[1] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:most]
            out += [(a[0], p[1], k + 1, x[1], -p[0], -x[0]) for k, x in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_plain(spark, monkeypatch, seed):
    # Many small cells and clusters.
    for name, value in (("CELL", 16), ("CLUSTER", 3), ("STEP", 4), ("MEMBERS", 2), ("VISITORS", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, 5))
    vectors = [(base[k % 6] + r.normal(size=5) * 0.3).tolist() for k in range(220)]
    vectors[40:60] = [vectors[40]] * 20  # copies
    vectors[100:104] = [[0.0] * 5] * 4
    rows = [(k, v, "even" if k % 2 else str(k % 3), "x", 1.0) for k, v in enumerate(vectors)]
    rows += [(300, None, "a", "x", 1.0), (310, [1.0, None, 0.0, 0.0, 0.0], "a", "x", 1.0), (320, [1.0, float("nan"), 0.0, 0.0, 0.0], "a", "x", 1.0), (330, vectors[0], None, "x", 1.0), (None, vectors[0], "a", "x", 1.0), (340, [1.0, 2.0], "even", "x", 1.0), (341, [1.0, 2.0], "even", "x", 1.0), (342, [1.0, 1.9], "a", "x", 1.0), (350, [], "a", "x", 1.0), (351, [], "a", "x", 1.0), (352, [], "b", "x", 1.0)]
    rows += [rows[10], rows[10]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, cls string, score double").repartition(4)
    got = mine_hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(x) for x in got.collect()) == plain_negatives(rows)


def test_negatives_of_nothing_and_of_large_values(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mine_hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e7, 1e7], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="exact"):
        mine_hard_negatives(huge, F.lit(True))


TEXTS = ["", "Hello  world", " leading\tand trailing \n", "É combining é ﬁ İSTANBUL ΣΑΣ", "it's 2024, don't <|endoftext|> stop<|startoftext|>now", "non breaking space\x1c\x85 here", "word " * 3000, "Abc, ABC. abc; x.y. 'S It'S. !? a! é. É, <|ENDOFTEXT|> <|endoftext|>. Don'T", "İ. ŉ ǰ ﬀ a\u0301 \u0301b K. Å,", "x" * 5000, None, "汉字 かな 한국어 😀🏽"]


def library(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_files_hold_the_librarys_ids(spark, tmp_path):
    rows = [(k * 3 % 31, t, "x", 1) for k, t in enumerate(TEXTS * 3)] + [(None, "no id", "x", 1), (None, "none", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, part int").repartition(4)
    folder = f"file://{tmp_path}/tokens"
    manifest = write_tokens(docs, folder, library_ids(vocabulary_path("word_bpe_49k.json"), 2), frame_ids=1000)
    assert manifest.agg(F.sum("docs")).first()[0] == len(rows)
    got = sorted(read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    start = 0
    wanted = defaultdict(list)
    for i, t, *_ in rows:
        wanted[i].append(library(t))
    for r in got:
        own = np.frombuffer(r["token_bytes"], "<u4").tolist()
        assert (r["start"], r["n_tokens"]) == (start, len(own))
        wanted[r["doc_id"]].remove(own)
        start += len(own)
    assert not any(wanted.values())
    # Only some of them, unknown and repeated ids among those asked for.
    some = spark.createDataFrame([(3,), (3,), (9,), (1000,), (None,)], "doc_id long")
    part = read_tokens(spark, folder, some).collect()
    assert sorted(map(tuple, part)) == sorted(tuple(r) for r in got if r["doc_id"] in (3, 9))


def test_seek_table_reads_single_frames(tmp_path):
    out = open(tmp_path / "one.zst", "wb")  # noqa: SIM115
    writer = token_files.FrameWriter(out, 10)
    docs = {5: np.arange(25, dtype=np.uint32), 6: np.arange(3, dtype=np.uint32), 9: np.arange(1, dtype=np.uint32)}
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.finish()
    out.close()
    data = (tmp_path / "one.zst").read_bytes()
    assert len(data) == writer.size and len(writer.entries) == 6  # three, one and one frames, and the table of documents
    # Any reader of zstandard sees the ids one after another.
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(x.astype("<u4").tobytes() for x in docs.values())

    class Source:
        read: list[tuple[int, int]] = []

        def __init__(self, data: bytes) -> None:
            self.data = data

        def read_at(self, n: int, at: int) -> bytes:
            self.read.append((at, n))
            return self.data[at : at + n]

    reader = token_files.FrameReader(Source(data), len(data))
    Source.read.clear()
    assert [reader.ids(k) for k in reader.places(6)] == [docs[6].tobytes()]
    assert len(Source.read) == 1 and Source.read[0][1] < 40
    assert list(reader.places(7)) == []
    broken = bytearray(data)
    broken[int(reader.offsets[3]) + 10] ^= 1
    reader = token_files.FrameReader(Source(bytes(broken)), len(data))
    reader.ids(0)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.ids(1)


def test_files_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, library_ids(vocabulary_path("word_bpe_49k.json")))
    assert read_manifest(spark, folder).count() == 0
    assert read_tokens(spark, folder).count() == 0
