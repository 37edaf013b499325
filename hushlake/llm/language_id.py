"""Language identification by a small convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import thrifty

#: Bytes of a window; filters see WIDTHS bytes; each window begins OVERLAP bytes before the last one's end.
WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
OVERLAP = max(WIDTHS) - 1
STEP = WINDOW - OVERLAP
#: Windows judged at a time.
BLOCK = 2048


@dataclass
class ByteNetwork:
    """Embedding, filters by width with biases, and the softmax layer; labels in sorted order."""

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """Filter responses by pair of bytes (65536 x FILTERS) or byte, so that prediction only adds rows.

        A filter of width 2 is one pair, of 3 a pair and a byte, of 4 two pairs.
        """
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            single = [self.embed @ f[j] for j in range(w)]
            own = []
            for j in range(0, w - 1, 2):
                own.append((single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32))
            if w % 2:
                own.append(single[w - 1].astype(np.float32))
            out.append(own)
        return out


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one filled with zeros."""
    n = max(1, -(-max(0, len(raw) - OVERLAP) // STEP))
    padded = np.zeros(n * STEP + OVERLAP, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_network(texts: list[str], langs: list[str], rounds: int = 1200, batch: int = 96, per_text: int = 4, seed: int = 7) -> ByteNetwork:
    """Fits the network with Adam on up to per_text windows of each text; the same input gives the same network.

    Without texts the network has no labels, and identify gives 'und' to all.
    """
    if not texts:
        none = np.zeros(0, np.float32)
        return ByteNetwork([], none, [], [], none, none)
    rng, labels = np.random.default_rng(seed), sorted(set(langs))
    xs, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        own = windows_of(text.encode("utf-8", "replace"))
        pick = own if len(own) <= per_text else own[np.sort(rng.choice(len(own), per_text, replace=False))]
        xs.append(pick)
        ys += [labels.index(lang)] * len(pick)
    x, y, k = np.concatenate(xs), np.array(ys), len(labels)
    weight = (len(y) / (k * np.bincount(y, minlength=k).clip(1))).astype(np.float32)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = ByteNetwork(labels, normal(256, DIM, scale=0.5), [normal(w, DIM, FILTERS, scale=(w * DIM) ** -0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), k, scale=0.1), np.zeros(k, np.float32))
    params = net.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        at = rng.integers(0, len(x), batch)
        b = x[at]
        # A text shorter than its window trains like long ones cut at a random place.
        cut = rng.random(batch) < 0.3
        b = np.where(cut[:, None] & (np.arange(WINDOW)[None, :] >= rng.integers(20, WINDOW, batch)[:, None]), 0, b)
        grads = gradients(net, b, y[at], weight)
        rate = 0.01 * min(1, 2 * (1 - step / (rounds + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def gradients(net: ByteNetwork, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted cross-entropy, in the order of params()."""
    n = len(b)
    e = net.embed[b]
    pooled, where, wide = [], [], []
    for w, f, bias in zip(WIDTHS, net.filters, net.bias, strict=True):
        seen = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
        response = seen @ f.reshape(w * DIM, FILTERS)
        at = response.argmax(axis=1)
        where.append(at)
        wide.append(seen)
        pooled.append(np.maximum(np.take_along_axis(response, at[:, None, :], 1)[:, 0] + bias, 0))
    h = np.concatenate(pooled, axis=1)
    d = softmax(h @ net.out + net.out_bias)
    d[np.arange(n), y] -= 1
    d *= weight[y][:, None] / n
    back = (d @ net.out.T) * (h > 0)
    g_embed, g_filters, g_bias = np.zeros_like(net.embed), [], []
    rows = np.arange(n)[:, None]
    for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        seen = wide[i][rows, where[i]]  # n x FILTERS x (w * DIM)
        g_filters.append(np.einsum("nf,nfk->kf", part, seen).reshape(f.shape))
        g_bias.append(part.sum(axis=0))
        for j in range(w):
            np.add.at(g_embed, b[rows, where[i] + j], part[:, :, None] * f[j].T[None])
    return [g_embed, *g_filters, *g_bias, h.T @ d, d.sum(axis=0)]


def judge(net: ByteNetwork, tables: list[list[np.ndarray]], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Label index and score of each text: the mean over all windows, weighted by their bytes."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    total, weights = np.zeros((len(raws), len(net.labels))), np.zeros(len(raws))
    parts, owners, sizes, held = [], [], [], 0

    def flush() -> None:
        nonlocal parts, owners, sizes, held
        b = np.concatenate(parts).astype(np.intp)
        pair = b[:, :-1] * 256 + b[:, 1:]
        pooled = []
        for w, own, bias in zip(WIDTHS, tables, net.bias, strict=True):
            n = WINDOW - w + 1
            response = own[0][pair[:, :n]]
            if w > 2:
                response += own[1][b[:, 2 : 2 + n]] if w == 3 else own[1][pair[:, 2 : 2 + n]]
            pooled.append(np.maximum(response.max(axis=1) + bias, 0))
        said = softmax(np.concatenate(pooled, axis=1) @ net.out + net.out_bias)
        size = np.concatenate(sizes)
        owner = np.concatenate(owners)
        np.add.at(total, owner, said * size[:, None])
        np.add.at(weights, owner, size)
        parts, owners, sizes, held = [], [], [], 0

    for i, raw in enumerate(raws):
        own = windows_of(raw)
        size = np.minimum(WINDOW, len(raw) - STEP * np.arange(len(own))).clip(1).astype(np.float64)
        for k in range(0, len(own), BLOCK):
            parts.append(own[k : k + BLOCK])
            owners.append(np.full(len(parts[-1]), i))
            sizes.append(size[k : k + BLOCK])
            held += len(parts[-1])
            if held >= BLOCK // 8:
                flush()
    if parts:
        flush()
    mean = total / np.maximum(weights, 1e-9)[:, None]
    return mean.argmax(axis=1), mean.max(axis=1)


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 800, max_chars: int = 4000, max_langs: int = 200) -> ByteNetwork:
    """Trains on a bounded sample of labelled texts: per_lang of each language, their first max_chars characters.

    Bounds, of training alone (prediction reads whole texts): per_lang texts a language, max_chars characters of each, and
    the max_langs languages with the most labelled rows (of equal ones the first by name), so that at most
    per_lang * max_langs * max_chars characters come to the driver. The sample is rows with the smallest hashes of the id and text, so
    it is the same for the same rows in any partitioning. Rows with null text or language are left out. Without
    any labelled row the network has no labels.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    most = rows.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).limit(max_langs).select(F.col(lang_col).alias("lang"))
    # 64 slices of each language give their first few rows, so that no language is gathered whole.
    ids = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("order")).join(F.broadcast(most), "lang")
    in_slice = Window.partitionBy("lang", F.pmod("order", F.lit(64))).orderBy("order", "id")
    ids = ids.withColumn("place", F.row_number().over(in_slice)).filter(F.col("place") <= max(1, per_lang // 16))
    first = Window.partitionBy("lang").orderBy("order", "id")
    picked = ids.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_lang).select("order", "lang").distinct()
    sample = rows.select(F.xxhash64(id_col, text_col).alias("order"), F.substring(text_col, 1, max_chars).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(picked), ["order", "lang"])
    found = sorted(sample.distinct().collect(), key=lambda r: (r.order, r.lang, r.text))
    return train_network([r.text for r in found], [r.lang for r in found])


def identify(docs: DataFrame, net: ByteNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row, from all windows of its whole text.

    A text that is null or has no letter gets 'und' and score 0, as does every text under a network without labels. The network is
    sent to the workers once (a few hundred KB, whatever the input). Repeated rows are judged alike; an empty table gives an
    empty one. All columns pass through, but those named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    if not net.labels:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    sent = spark.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables()
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(start, 256)
                texts = part.column(at).to_pylist()
                best, score = judge(own, tables, [t or "" for t in texts]) if texts else ([], [])
                lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                langs = [own.labels[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                scores = [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(thrifty(run), schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = learn_languages(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
