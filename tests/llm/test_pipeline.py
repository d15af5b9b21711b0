"""The pipeline against its stages done by hand, and on an empty table."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from layerframe.llm import bpe, token_file  # noqa: E402

from .test_text_ops import DOC, brute_lines, corpus, grams, words_of  # noqa: E402


def write(spark, rows, folder):
    spark.createDataFrame(rows, DOC).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return f"{folder}"


def test_pipeline(spark, tmp_path):
    sf = write(spark, corpus(n=80), str(tmp_path / "sf"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = []
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        steps.append(docs.collect())
        if i < 4:
            assert docs.columns == cp.COLUMNS
    rules, lines, near, mixed, out = steps
    assert all(len(words_of(r["text"])) >= 50 for r in rules)
    want = brute_lines([tuple(r) for r in rules], 50)
    texts = {r["doc_id"]: r["text"] for r in rules}
    assert {r["doc_id"]: r["text"] for r in lines} == {i: want[i, t] for i, t in texts.items() if want[i, t] == t or words_of(want[i, t])}
    left = {r["doc_id"]: grams(r["text"]) for r in lines}
    kept = {r["doc_id"] for r in near}
    assert len(kept) == len(near)
    similar = lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)
    assert not any(a < b and similar(left[a], left[b]) for a in kept for b in kept)
    assert all(any(similar(left[i], left[j]) for j in left if j != i) for i in left if i not in kept)
    copies = [r["doc_id"] for r in mixed]
    assert set(copies) <= kept and max(copies.count(i) for i in copies) <= 3
    assert abs(sum(len(words_of(r["text"])) for r in mixed) - sum(len(words_of(r["text"])) for r in near)) <= 6 * max(len(words_of(r["text"])) for r in near)
    t = bpe.load(token_file.tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert sorted(r["doc_id"] for r in out) == sorted(copies)
    for r in out:
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted(tuple(r) for r in cp.run(spark, sf).collect()) == sorted(tuple(r) for r in out)


def test_empty(spark, tmp_path):
    assert cp.run(spark, write(spark, [], str(tmp_path / "e"))).count() == 0
