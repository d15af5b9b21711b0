"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: the lower-cased letters of a whole text, everything else squeezed to one space and a space added at both ends, as 1- to 3-grams hashed into
BUCKETS buckets, (1 + log tf) * idf, scaled to length 1. The idf comes from all learning documents. The weights are fitted on a
bounded sample, SAMPLE_PER_CLASS documents of each language with the smallest hashes, by follow-the-regularised-leader
with an elastic-net penalty; a held-back fifth of the sample sets the temperature of the probabilities.

Defined results: `und` with score 0 for a null text, a text without a letter, and where nothing could be learned; equal
texts get equal predictions; texts of any length are read whole; rows with a null language are never learned from; an empty
table gives an empty table. Ties between classes go to the first in code-point order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Documents of each class that the weights are fitted on, at most.
SAMPLE_PER_CLASS = 800
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def buckets(text: str) -> np.ndarray | None:
    """Buckets of all n-grams of a text; None if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ok = _letters()[c]
    if not ok.any():
        return None
    c = np.where(ok, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = ok[1:] | ok[:-1]
    c = np.concatenate([np.array([32], np.uint32), c[keep], np.array([32], np.uint32)])
    out, h = [], c * np.uint32(0x9E3779B1)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            out.append((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


def _tfidf(cnt: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(cnt)) * idf
    return x / max(1e-12, float(np.sqrt(x @ x)))


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # BUCKETS x classes, mostly zero
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def probabilities(self, idx: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        z = (_tfidf(cnt, self.idf[idx]) @ self.weights[idx] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def document_frequency(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents per bucket over all rows, and their number. Tasks add up first; BUCKETS sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total[BUCKETS] += 1
                b = buckets(t.as_py())
                if b is not None:
                    total[np.flatnonzero(np.bincount(b, minlength=BUCKETS))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["b", "n"])

    sums = df.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[sums["b"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out[:BUCKETS], int(out[BUCKETS])


def _sample(df: DataFrame, key: str, text: str, label: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(class, buckets, counts) of the SAMPLE_PER_CLASS rows of each class with the smallest hashes.

    A class's size gives a bound under which about twice as many hashes lie; only rows below it are put in order.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y")).where("t IS NOT NULL AND y IS NOT NULL")
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("k").cast("string"), F.length("t")), 1))
    share = F.least(F.lit(1.0), 2.0 * SAMPLE_PER_CLASS / F.count("*"))
    bound = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("y2")).agg((share * float(2**63 - 1024)).cast("long").alias("bound"))
    # one row per class, of which the model holds BUCKETS weights each
    near = rows.join(F.broadcast(bound), (F.col("y") == F.col("y2")) & (F.col("h") <= F.col("bound"))).select("y", "h", "t")
    order = Window.partitionBy("y").orderBy("h", "t")
    few = near.withColumn("r", F.row_number().over(order)).where(f"r <= {SAMPLE_PER_CLASS}").select("y", "h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = buckets(t)
                if b is not None:
                    c = np.bincount(b, minlength=BUCKETS)
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_pydict({"y": [y], "h": [h], "at": [at.astype(np.int32)], "n": [c[at].astype(np.int32)]})

    got = few.mapInArrow(run, "y string, h long, at array<int>, n array<int>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    return [(y, at.values.to_numpy(), n.values.to_numpy()) for y, at, n in zip(got["y"].to_pylist(), got["at"], got["n"], strict=True)]


def _ftrl(rows: list, classes: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by FTRL-proximal: per coordinate steps, an L1 term that keeps most weights at zero, and an L2 term."""
    k = len(classes)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    data = [(classes.index(y), np.append(at, BUCKETS), np.append(_tfidf(c, idf[at]), 1.0)) for y, at, c in rows]
    for epoch in range(EPOCHS):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(data)):
            y, at, x = data[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS].astype(np.float32).astype(np.float64), w[BUCKETS]


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    """Learns from all rows of df with a text and a label; None if there are none."""
    learn = df.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    freq, n = document_frequency(learn, text)
    rows = _sample(learn, key, text, label) if n else []
    classes = sorted({y for y, _, _ in rows})
    if not classes:
        return None
    idf = np.log((1 + n) / (1 + freq)) + 1
    held = rows[::5] if len(rows) >= 50 else []
    fit = [r for i, r in enumerate(rows) if i % 5] if held else rows
    w, bias = _ftrl(fit, classes, idf)
    t = 1.0
    if held:
        logits = np.array([_tfidf(c, idf[at]) @ w[at] + bias for _, at, c in held])
        t = temperature_of(logits, np.array([classes.index(y) for y, _, _ in held]))
    return Model(classes, w, bias, idf, t)


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row."""
    if model is None:
        return df.select(key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for t in batch.column(1):
                b = buckets(t.as_py() or "")
                if b is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                c = np.bincount(b, minlength=BUCKETS)
                at = np.flatnonzero(c)
                p = model.probabilities(at, c[at])
                i = int(p.argmax())
                names.append(model.classes[i])
                scores.append(float(p[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["k", "lang_pred", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
