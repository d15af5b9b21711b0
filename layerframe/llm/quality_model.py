"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Tokens are runs of letters and digits, and runs of other marks. Each token has a sparse random index vector (NONZERO entries of
+-1 in DIM places, from its hash). A word vector is the sum of the index vectors of its neighbours up to WINDOW tokens away, over the
whole corpus; words share VOCAB hashed rows. Tasks sum their own part, rows of the table are summed in streams, and the bounded
table (VOCAB x DIM) goes to the driver. A document is pooled to the mean and the spread of its word vectors and to the mean
product of neighbours. A two-layer network is
fitted on at most SAMPLE labelled documents, and a held-back fifth sets the temperature.

Defined results: a null or empty text pools to zeros and gets the score of such a vector; labels other than 0 and 1 and null labels are not
learned from; without labels every score is 0.5; equal texts get equal scores; texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, wordhash
from .language_id import held_out, temperature_of

VOCAB, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: Labelled documents that the network is fitted on, at most (those with the smallest hashes).
SAMPLE = 8000
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 5e-3, 1e-4
PREDICTED_FROM = 0.7
SLAB = 256

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit token hashes, text index of each) of many texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    kind = _CLASS[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    full = kind[edge] > 0
    starts, stops = edge[full], np.append(edge[1:], len(buf))[full]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = stops - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = wordhash._BYTE[buf[kind > 0]] * wordhash._powers(int(size.max()))[place]
    h = wordhash.mix(np.add.reduceat(value, first) + size.astype(np.uint64) * wordhash._STEP)
    return h, np.searchsorted(ends, starts)


def rows_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(VOCAB - 1)).astype(np.int64)


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), NONZERO of each for every token."""
    x = wordhash.mix(h ^ np.uint64(0x5DEECE66D))
    place = np.stack([(x >> np.uint64(8 * k)) & np.uint64(DIM - 1) for k in range(NONZERO)], 1).astype(np.int64)
    sign = np.stack([(x >> np.uint64(48 + k)) & np.uint64(1) for k in range(NONZERO)], 1).astype(np.float64) * 2 - 1
    return place, sign


def _contexts(texts: list[str], out: np.ndarray) -> None:
    """Adds the neighbours' index vectors, and in the last column the count, of every token."""
    h, doc = tokens(texts)
    if not len(h):
        return
    row, (place, sign) = rows_of(h), index_vectors(h)
    out[:, DIM] += np.bincount(row, minlength=VOCAB)
    for d in range(1, WINDOW + 1):
        same = doc[d:] == doc[:-d]
        for me, other in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            r = row[me][same]
            for k in range(NONZERO):
                flat = r * DIM + place[other, k][same]
                out[:, :DIM] += np.bincount(flat, sign[other, k][same], VOCAB * DIM).astype(np.int64).reshape(VOCAB, DIM)


def word_vectors(df: DataFrame, text: str) -> np.ndarray:
    """VOCAB x (DIM + 1) sums over every row of df."""
    width = DIM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((VOCAB, width), np.int64)
        for batch in batches:
            for part in bpe.parts(batch.column(0).to_pylist(), 1 << 22):
                _contexts(part, total)
        if total[:, DIM].any():
            blobs = [total[i : i + SLAB].astype("<i8").tobytes() for i in range(0, VOCAB, SLAB)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["slab", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(blob.as_buffer(), "<i8")
                held[slab] = held[slab] + x if slab in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slab", "sums"])

    kind = "slab int, sums binary"
    sums = df.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(run, kind).repartition("slab").mapInArrow(add, kind).toArrow()
    out = np.zeros((VOCAB // SLAB, SLAB, width))
    for slab, blob in zip(sums["slab"].to_pylist(), sums["sums"], strict=True):
        out[slab] += np.frombuffer(blob.as_buffer(), "<i8").reshape(SLAB, width)
    return out.reshape(VOCAB, width)


def scaled(sums: np.ndarray) -> np.ndarray:
    """Unit word vectors; frequent words weigh less."""
    count = sums[:, DIM]
    p = count / max(1.0, count.sum())
    mean = sums[:, :DIM].sum(0) / max(1.0, count.sum())
    v = sums[:, :DIM] - count[:, None] * mean
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    return (v * (1e-3 / (1e-3 + p))[:, None] ** 0.5).astype(np.float32)


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the mean product of neighbours, which is large where a text repeats itself."""
    h, doc = tokens(texts)
    out = np.zeros((len(texts), 3 * DIM))
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        v = vectors[rows_of(h)]
        n = np.diff(np.append(first, len(h)))[:, None]
        mean = np.add.reduceat(v, first, dtype=np.float64) / n
        square = np.add.reduceat(v * v, first, dtype=np.float64) / n
        pair = np.zeros_like(v)
        pair[1:] = v[1:] * v[:-1]
        pair[first] = 0
        at = doc[first]
        out[at, :DIM] = mean
        out[at, DIM : 2 * DIM] = np.sqrt(np.maximum(0, square - mean * mean))
        out[at, 2 * DIM :] = np.add.reduceat(pair, first, dtype=np.float64) / n
    return out


@dataclass
class Network:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh(((x - self.shift) / self.scale) @ w1 + b1) @ w2 + b2).ravel()

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _fit(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Adam on the log loss, in small batches of a seeded order."""
    rng = np.random.Generator(np.random.PCG64(3))
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            at = order[i : i + 64]
            h = np.tanh(x[at] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip((h @ w[2] + w[3]).ravel(), -60, 60)))
            d = ((p - y[at]) / len(at))[:, None]
            dh = (d @ w[2].T) * (1 - h * h)
            grads = [x[at].T @ dh + DECAY * w[0], dh.sum(0), h.T @ d + DECAY * w[2], d.sum(0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def _pooled(df: DataFrame, vectors: np.ndarray, more: list[str]) -> DataFrame:
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool([t or "" for t in batch.column("t").to_pylist()], vectors)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(list(x), pa.list_(pa.float64()))], names=[*more, "x"])

    return df.mapInArrow(run, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network | None:
    """Word vectors from all of docs; the network from labels (key, label), a bounded sample of which meets the documents."""
    vectors = scaled(word_vectors(docs, text))
    few = (
        labels.select(F.col(key).alias("lk"), F.col(label).cast("double").alias("y")).where("lk IS NOT NULL AND y IN (0, 1)").distinct()
        .orderBy(F.xxhash64(F.col("lk").cast("string")), "y").limit(SAMPLE)
    )
    # at most SAMPLE narrow rows are broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few), F.col("k") == F.col("lk")).select("t", "y", F.xxhash64("k").alias("h"))
    got = _pooled(rows, vectors, ["y", "h"]).toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    if got.num_rows == 0:
        return None
    x = np.array(got["x"].to_pylist())
    y = got["y"].to_numpy()
    shift, scale = x.mean(0), np.maximum(1e-6, x.std(0))
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    net = Network(vectors, shift, scale, _fit((x[~held] - shift) / scale, y[~held]), 1.0)
    if held.any():
        z = net.logits(x[held])
        net.temperature = temperature_of(np.stack([np.zeros_like(z), z], 1), y[held].astype(int))
    return net


def score(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted of every row."""
    if net is None:
        return docs.select(key, F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in bpe.parts([t or "" for t in batch.column(1).to_pylist()]):
                s = net.score(pool(part, net.vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(s, pa.float64()), pa.array((s >= PREDICTED_FROM).astype(np.int32))], names=["k", "score", "predicted"])
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double, predicted int").withColumnRenamed("k", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    net = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
