"""The two learned operators against plain versions of their features, steps and calibration, and held out on generated tables."""

import math
import os
import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from layerframe.llm import language_id as li  # noqa: E402
from layerframe.llm import quality_model as qm  # noqa: E402

from .test_text_ops import ODD, prose  # noqa: E402

SF = "/root/testdata/sf0.01"
TEXTS = [*ODD, "Ünï cödé 12 ab--cd!!", "a", "a b a b a b", *(prose(random.Random(i), 40) for i in range(8))]


def plain_buckets(text):
    """1- to 3-grams of the letters between spaces, one hash after the other."""
    kept = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())) + " "
    if not kept.strip():
        return None
    out, u = [], 0xFFFFFFFF
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            h = ord(kept[i]) * 0x9E3779B1 & u
            for c in kept[i + 1 : i + n]:
                h = (h * 0x85EBCA6B & u) ^ (ord(c) * 0x9E3779B1 & u)
            x = ((h ^ (h >> 15)) * 0x2C1B3C6D + n) & u
            out.append((x ^ (x >> 13)) & (li.BUCKETS - 1))
    return sorted(out)


def test_language_features():
    for t in TEXTS:
        got = li.buckets(t)
        assert plain_buckets(t) == (None if got is None else sorted(got.tolist()))


def plain_ftrl(rows, classes, idf):
    z, n = {}, {}

    def weight(key):
        v = z.get(key, 0.0)
        return 0.0 if abs(v) <= li.L1 else -(v - math.copysign(li.L1, v)) / ((li.BETA + math.sqrt(n.get(key, 0.0))) / li.ALPHA + li.L2)

    def features(at, cnt):
        x = {int(b): (1 + math.log(c)) * idf[b] for b, c in zip(at, cnt, strict=True)}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / size for b, v in x.items()} | {li.BUCKETS: 1.0}

    data = [(classes.index(y), features(at, c)) for y, at, c in rows]
    for epoch in range(li.EPOCHS):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(data)):
            y, x = data[i]
            w = {(b, k): weight((b, k)) for b in x for k in range(len(classes))}
            s = [sum(v * w[b, k] for b, v in x.items()) for k in range(len(classes))]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(len(classes)):
                err = e[k] / sum(e) - (k == y)
                for b, v in x.items():
                    g, old = v * err, n.get((b, k), 0.0)
                    z[b, k] = z.get((b, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / li.ALPHA * w[b, k]
                    n[b, k] = old + g * g
    return {key: weight(key) for key in z}


def test_follow_the_regularised_leader():
    rng = random.Random(5)
    rows = []
    for i in range(24):
        y = "ab"[i % 2]
        b = li.buckets(" ".join("".join(rng.choice("abcd" if y == "a" else "cdef") for _ in range(4)) for _ in range(6)))
        at, cnt = np.unique(b, return_counts=True)
        rows.append((y, at, cnt))
    idf = np.random.default_rng(1).uniform(1, 3, li.BUCKETS)
    w, bias = li._ftrl(rows, ["a", "b"], idf)
    want = plain_ftrl(rows, ["a", "b"], idf)
    full = np.zeros((li.BUCKETS + 1, 2))
    for (b, k), v in want.items():
        full[b, k] = v
    assert np.allclose(w, full[:-1], atol=1e-6) and np.allclose(bias, full[-1], atol=1e-9)
    assert 0 < np.count_nonzero(w) < w.size / 10


def test_temperature():
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 4, (300, 3))
    y = (logits / 2.5 + rng.gumbel(size=logits.shape)).argmax(1)

    def loss(t):
        return np.mean([math.log(sum(math.exp(v / t) for v in row)) - row[k] / t for row, k in zip(logits, y, strict=True)])

    t = li.temperature_of(logits, y)
    assert loss(t) <= min(loss(x) for x in np.geomspace(0.05, 20, 400)) + 1e-9


def plain_tokens(text):
    return [m.group().decode("utf-8", "surrogateescape") for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^\x09-\x0d\x200-9A-Za-z\x80-\xff]+", text.encode("utf-8", "surrogatepass"))]


def hashes(tokens):
    return [int(qm.tokens([t])[0][0]) for t in tokens]


def test_quality_tokens_and_contexts():
    got, doc = qm.tokens(TEXTS)
    want = [(h, i) for i, t in enumerate(TEXTS) for h in hashes(plain_tokens(t))]
    assert list(zip(got.tolist(), doc.tolist(), strict=True)) == want
    some = TEXTS[-6:]
    sums = np.zeros((qm.VOCAB, qm.DIM + 1), np.int64)
    qm._contexts(some, sums)
    plain = np.zeros_like(sums)
    for t in some:
        h = np.array(hashes(plain_tokens(t)), np.uint64)
        row, (place, sign) = qm.rows_of(h), qm.index_vectors(h)
        for i in range(len(h)):
            plain[row[i], qm.DIM] += 1
            for j in range(max(0, i - qm.WINDOW), min(len(h), i + qm.WINDOW + 1)):
                if j != i:
                    for p, s in zip(place[j], sign[j], strict=True):
                        plain[row[i], p] += int(s)
    assert (sums == plain).all()


def test_quality_pooling():
    vectors = np.random.default_rng(3).normal(size=(qm.VOCAB, qm.DIM)).astype(np.float32)
    for x, t in zip(qm.pool(TEXTS, vectors), TEXTS, strict=True):
        v = [vectors[int(qm.rows_of(np.array([h], np.uint64))[0])].astype(np.float64) for h in hashes(plain_tokens(t))]
        if not v:
            assert not x.any()
            continue
        pairs = sum((a * b for a, b in zip(v, v[1:], strict=False)), np.zeros(qm.DIM)) / len(v)
        assert np.allclose(x, np.concatenate([np.mean(v, 0), np.std(v, 0), pairs]), atol=2e-3)


def test_network_gradient():
    """The fitted network separates what a line separates, and its scores are the plain forward pass."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    layers = qm._fit(x, y)
    net = qm.Network(np.empty(0), np.zeros(6), np.ones(6), layers, 1.7)
    w1, b1, w2, b2 = layers
    want = [1 / (1 + math.exp(-(sum(math.tanh(sum(r[i] * w1[i, j] for i in range(6)) + b1[j]) * w2[j, 0] for j in range(qm.HIDDEN)) + b2[0]) / 1.7)) for r in x[:20]]
    assert np.allclose(net.score(x[:20]), want) and ((net.score(x) > 0.5) == (y > 0)).mean() > 0.97


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_held_out_on_generated_tables(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in li.query(spark, SF).collect() if r["held_out"] and langs[r["doc_id"]] is not None]
    assert len(rows) > 100 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in qm.query(spark, SF).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(rows) > 50 and sum((r["score"] >= 0.5) == (labels[r["doc_id"]] == 1) for r in rows) >= 0.9 * len(rows)
