"""The operators on texts against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from layerframe.llm import bpe, codec, language_id, line_dedup, mixing, ngram_join, quality_model, quality_rules, search, token_file, url_filter, wordhash  # noqa: E402
from layerframe.llm.common import Scratch, connected_components, global_rank  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "a", "<|endoftext|>x <|ENDOFTEXT|> don't I'LL ...'s", "Á́é ́ Σ ΑΣ ΣΑΣ. İ ß µ ª", "x" * 3000, " " * 500 + "a b", "naïve café!!! 12345 ½ ²  \x85 \x1c q\x0bz",
       "日本語 テキスト。" * 50, "'s 't 're a's a'S", "\r\n\t a,b.c;d--e..f ,., ?! 1a2b <3 <|end", "🙂🙂 ok 👨‍👩‍👧 " * 30]


def words_of(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=200):
    def word(k):
        return rng.choice(["%s", "%s", "%s", "W%s,", "é%s."]) % (chr(97 + k % 26) + "ou" + chr(97 + k // 26))

    return " ".join(word(rng.randrange(vocabulary)) for _ in range(n))


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    texts = ["\n".join(prose(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    texts += texts[:6] + [None, "", "   ", "one", prose(rng, 6000)]
    block = "\n".join(prose(rng, 30) for _ in range(3))
    texts += [f"{prose(rng, 20)}\n{block}\n{prose(rng, 9)}" for _ in range(5)]
    near = prose(rng, 120).split()
    for i in range(6):
        other = list(near)
        other[i * 15] = f"changed{i}"
        texts.append(" ".join(other))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "a", "b", "", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).cache()


def test_encoders_agree_with_the_library():
    t = bpe.load(PATH)
    rng = random.Random(1)
    letters = " \n\tab'sStT.<|>é́Σ1²"
    texts = [x or "" for _, x, *_ in corpus()] + ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(500)]
    want = t.encode_batch(texts, add_special_tokens=False)
    assert bpe.PieceEncoder(PATH, most=50).encode(texts) == [np.array(e.ids, "<u2").tobytes() for e in want]
    got = bpe.ChunkEncoder(PATH, most=20).encode(texts)
    assert got == [(len(e.ids), " ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False)) for e in want]


def test_other_tokenizer_goes_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = bpe.PieceEncoder(path)
    assert e.whole
    assert e.encode(ODD) == [np.array(x.ids, "<u2").tobytes() for x in e.tok.encode_batch(ODD, add_special_tokens=False)]
    ids = e.tok.encode(ODD[3], add_special_tokens=False).ids
    assert bpe.ChunkEncoder(path).encode([ODD[3]])[0] == (len(ids), " ".join(map(str, ids)), e.tok.decode(ids, skip_special_tokens=False))


def test_chunks_are_encoded_once():
    rng = random.Random(8)
    distinct = [prose(rng, 400) for _ in range(40)]
    texts = [rng.choice(distinct) for _ in range(1000)]
    e = bpe.ChunkEncoder(PATH)
    got = e.encode(texts)
    want = {t: x.ids for t, x in zip(distinct, e.tok.encode_batch(distinct, add_special_tokens=False), strict=True)}
    assert [x[1] for x in got] == [" ".join(map(str, want[t])) for t in texts]
    assert e.encoded <= sum(map(len, distinct)) and e.grown == 0
    before = e.encoded
    e.encode([f"{t} and something else" for t in distinct])  # all but the last chunk of each is known
    assert e.encoded - before < 0.5 * sum(map(len, distinct))
    e.forget()
    assert not e.chunks.map and not e.joins.map and e.words.cache.held <= bpe.REST_BYTES


def test_joins_are_repaired_by_growing_windows(tmp_path):
    """Plain merges, in which a run of one letter is cut by its length: chunks get its start wrong."""
    from tokenizers import Tokenizer, models

    rng = random.Random(4)
    merges = [("a", "a"), ("aa", "aa"), ("aaaa", "aaaa"), ("b", "c"), ("bc", "bc"), ("c", "b"), ("a", "b"), ("ab", "cb"), ("c", " "), ("d", "aa")]
    names = ["a", "b", "c", "d", " ", "é", *("".join(m) for m in merges)]
    path = str(tmp_path / "plain.json")
    Tokenizer(models.BPE(vocab={t: i for i, t in enumerate(dict.fromkeys(names))}, merges=merges)).save(path)
    e = bpe.ChunkEncoder(path, mean=16)
    texts = ["".join(rng.choice(["a" * rng.randrange(1, 40), "bc", "cb", "b", "c", " ", "d", "é"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", "a" * 1000, "unknown letters: xyz" * 9]
    assert e.kind == "pure"
    assert [x[1] for x in e.encode(texts)] == [" ".join(map(str, e.tok.encode(t, add_special_tokens=False).ids)) for t in texts]
    assert e.grown > 0


def test_codec(spark, docs):
    t = bpe.load(PATH)
    for r in codec.encode(docs, PATH).join(docs.dropDuplicates(), "doc_id").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert codec.encode(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    raw = token_file.pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8) and (token_file.unpack(raw, bits, 1001) == ids).all()


def test_shard(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 2000, n).astype("<u2") for n in (0, 5, 300, 1, 0, 700)]
    w = token_file.ShardWriter(str(tmp_path), "s", 11, block=64)
    for i, d in enumerate(docs):
        w.add(i * 10, d)
    w.close()
    s = token_file.Shard(str(tmp_path), "s")
    assert s.docs.tolist() == [0, 10, 20, 30, 40, 50]
    assert all((s.document(i) == d).all() for i, d in enumerate(docs))
    flat = np.concatenate(docs)
    for lo, hi in ((0, 1), (63, 65), (100, 900), (1005, 1006)):
        assert (s.ids(lo, hi) == flat[lo:hi]).all()


def test_token_files(spark, docs, tmp_path):
    t = bpe.load(PATH)
    folder = "file://" + str(tmp_path / "t")
    odd = spark.createDataFrame([(None, "no id"), (None, "none either"), (3, "another text with id 3"), (-(1 << 63), "the smallest long"), (-5, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text", F.lit("x").alias("ids"), F.lit(1).alias("k")).unionByName(odd, allowMissingColumns=True)
    got = token_file.read_tokens(token_file.write_tokens(rows, folder, PATH), folder).orderBy("start").collect()
    want = [(r["doc_id"], np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows.collect()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    keys = [r["doc_id"] for r in got]
    assert keys == [None, None, *sorted(k for k in keys if k is not None)]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    empty = token_file.write_tokens(docs.limit(0), folder + "-e", PATH)
    assert token_file.read_tokens(empty, folder + "-e").count() == 0


def test_mixing(spark, docs):
    sized = docs.select("doc_id", "source", "text").withColumn("size", F.lit(0)).withColumn("size", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long"))
    rows = mixing.mix(sized, "size").collect()
    assert len(rows) == docs.count()
    again = {(r["doc_id"], r["repeats"]) for r in mixing.mix(sized.repartition(7), "size").collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in rows}
    size, target, taken, biggest = collections.Counter(), {}, collections.Counter(), collections.Counter()
    for r in rows:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["size"] * r["repeats"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
        assert 0 <= r["repeats"] <= 3 or r["size"] == 0
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free = {}, set(names)
    while True:
        left = sum(size.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        free -= over
    want |= share
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= biggest[s]
    assert mixing.mix(sized.limit(0), "size").count() == 0


def brute_rules(text):
    """(base counts, base_failed, kept) of a text."""
    text = text or ""
    w = words_of(text)
    wins = collections.defaultdict(list)
    for i in range(len(w) - 2):
        wins[tuple(w[i : i + 3])].append(i)
    rep = len({i + d for p in wins.values() if len(p) > 1 for i in p for d in range(3)})
    lines = [x for x in text.split("\n") if words_of(x)]
    dup, chars, symbols = len(lines) - len(set(lines)), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text)
    base = len(w) < 50 or 100 * rep > 50 * len(w)
    letters, upper = sum(unicodedata.category(c)[0] == "L" for c in text), sum(unicodedata.category(c) == "Lu" for c in text)
    bad = chars < 2 * len(w) or chars > 15 * len(w) or 10 * symbols > len(w) or (dup >= 3 and 10 * dup > 3 * len(text.split("\n"))) or 10 * upper > 4 * letters or 2 * letters < chars
    return (len(w), chars, symbols, dup, rep), base, not base and not bad


def test_quality_rules(spark, docs):
    rng = random.Random(6)
    odd = ["A B c " * 40, "LOUD TEXT " * 30 + prose(rng, 60).upper(), "12 34 " + " ".join(str(rng.random()) for _ in range(80)), "#$ " * 9 + prose(rng, 70), "\n".join(["same line"] * 6 + [prose(rng, 90)]),
           " ".join("x" * 20 + str(i) for i in range(60)), *ODD]
    rows = docs.withColumn("value", F.lit(1)).withColumn("n_words", F.lit("clash")).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    kept = []
    for r in quality_rules.judge(rows, sample_rows=20).collect():
        assert (tuple(r[c] for c in quality_rules.BASE), r["base_failed"], r["kept"]) == brute_rules(r["text"])
        kept += [(r["doc_id"], r["text"])] if r["kept"] else []
    got = quality_rules.keep(rows, sample_rows=50)
    assert got.columns == rows.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(kept)
    assert quality_rules.judge(docs.limit(0)).count() == 0 and quality_rules.keep(docs.limit(0)).count() == 0


def test_rule_order(spark):
    df = spark.range(1000).withColumn("text", F.lit("x" * 100)).withColumn("n_words", F.col("id"))
    rule = lambda name, rejects, work: quality_rules.Rule(name, lambda f: rejects, lambda f, done: F.lit(work))
    rules = [
        rule("dear, rejects little", F.col("id") == 999, 900.0), rule("cheap, rejects little", F.col("id") == 998, 1.0), rule("same as half", F.col("id") < 490, 1.5),
        rule("half", F.col("id") < 500, 1.0), rule("dear", F.col("id").between(500, 899), 50.0)]
    names = [[r.name for r in quality_rules.order_rules(df.repartition(n), rules)] for n in (1, 3, 3)]
    assert names[0] == ["half", "dear", "cheap, rejects little", "dear, rejects little", "same as half"] and names[0] == names[1] == names[2]
    assert df.where(quality_rules.cascade(rules, quality_rules.finished(df))).count() == 98
    assert df.where(quality_rules.cascade(rules[1:4], quality_rules.finished(df))).count() == 499
    # rules on finished counts are asked before those that go through the text
    feats = quality_rules.base_features(spark.createDataFrame([("abc def " * 50,)], "text string"))
    order = [r.name for r in quality_rules.order_rules(feats, quality_rules.default_rules())]
    assert order == ["repeated_lines", "symbols", "word_length", "few_letters", "shouting"]


def brute_lines(rows, least):
    """doc_id -> text after deleting later copies, run by run."""
    docs = sorted({(i, t or "") for i, t, *_ in rows})
    seen, gone = {}, collections.defaultdict(set)
    for i, t in docs:
        lines = t.split("\n")
        use = [k for k, x in enumerate(lines) if words_of(x)]
        for a in range(len(use)):
            n = 0
            for b in range(a, len(use)):
                n += len(words_of(lines[use[b]]))
                if n >= least:
                    run = tuple(lines[k] for k in use[a : b + 1])
                    if run in seen:
                        gone[i, t].update(range(use[a], use[b] + 1))
                    seen.setdefault(run, (i, a))
                    break
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) for i, t in docs}


@pytest.mark.parametrize("least", [8, 50])
def test_line_dedup(spark, docs, least):
    rows = corpus()
    rng = random.Random(8)
    pool = [prose(rng, 3) for _ in range(4)]
    rows += [(1000 + i, "\n".join([rng.choice([*pool, ""]) for _ in range(rng.randrange(1, 30))]), None, None, 0) for i in range(25)]
    want = brute_lines(rows, least)
    got = line_dedup.dedup(spark.createDataFrame(rows, DOC), min_words=least).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if text[r["doc_id"]] is None:
            assert r["text"] is None
        else:
            assert r["text"] == want[r["doc_id"], text[r["doc_id"]]]
    assert any(r["n_deleted"] for r in got)
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_line_suffix_array(spark):
    rng = random.Random(18)
    pool = [prose(rng, n) for n in (1, 1, 2, 3, 5)]
    # runs that part at their end, inside a doubling step, and texts that go on behind a common run
    run = [rng.choice(pool) for _ in range(12)]
    rows = [(i, "\n".join([*run[: rng.randrange(5, 13)], *rng.choices([*pool, f"only {i}"], k=rng.randrange(6))])) for i in range(30)]
    rows += [(100 + i, "\n".join(rng.choices([*pool, "", f"only {i}"], k=rng.randrange(25)))) for i in range(30)]
    least = 13
    # the strings: lines with a word that occur again; any other line ends one
    texts = {i: [x for x in t.split("\n") if words_of(x)] for i, t in rows}
    count = collections.Counter(x for lines in texts.values() for x in lines)
    need, heads = {}, collections.defaultdict(list)
    for i, lines in texts.items():
        for q in range(len(lines)):
            end = next((b for b in range(q + 1, len(lines) + 1) if sum(len(words_of(x)) for x in lines[q:b]) >= least), None)
            if end and all(count[x] > 1 for x in lines[q:end]):
                need[i, q] = end - q
                heads[tuple(lines[q:end])].append((i, q))
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame(rows, "_ld_id long, _ld_text string").withColumn("_ld_th", F.xxhash64("_ld_text")).repartition(3)
    places = line_dedup.suffix_array(scratch, docs, least)
    got = sorted(places.collect(), key=lambda p: p["r"])
    at = {(p["_ld_id"], p["q"]): p for p in got}
    assert len(at) == len(got) and all(need[k] == p["m"] == len(p["ids"]) for k, p in at.items())
    assert all(k in at for ks in heads.values() if len(ks) > 1 for k in ks)
    assert len({p["m"] for p in got}) > 3 and any(p["m"] > 4 and p["m"] not in (8, 16) for p in got)
    # one id to a line, and the array in the order of ids
    line = {}
    for (i, q), p in at.items():
        for x, y in zip(texts[i][q:], p["ids"]):
            assert line.setdefault(y, x) == x
    assert len(set(line.values())) == len(line)
    assert [p["ids"] for p in got] == sorted(p["ids"] for p in got)
    # LCP of neighbours, spelled out
    entries = sorted({p["r"]: p for p in got}.items())
    lcp = line_dedup.lcp_array(scratch, places)
    want = [0]
    for (_, x), (_, y) in zip(entries, entries[1:]):
        want.append(next((n for n, (u, v) in enumerate(zip(x["ids"], y["ids"])) if u != v), min(x["m"], y["m"])))
    found = sorted(lcp.collect(), key=lambda e: e["r"])
    assert [e["r"] for e in found] == [r for r, _ in entries] and [e["lcp"] for e in found] == want
    assert any(0 < e["lcp"] < e["m"] for e in found) and any(e["lcp"] >= e["m"] for e in found)
    # intervals hold all places of a run, also where their suffixes differ behind it
    first = {e["r"]: (e["first"]["_ld_id"], e["first"]["q"]) for e in line_dedup.lcp_intervals(scratch, lcp).collect()}
    groups = collections.defaultdict(set)
    for k, p in at.items():
        if p["r"] in first:
            groups[first[p["r"]]].add(k)
    by_id = lambda k: (k[0], at[k]["_ld_th"], k[1])
    assert groups == {min(ks, key=by_id): set(ks) for ks in heads.values() if len(ks) > 1}


def grams(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_join(rows):
    """Sorted (id, class_id, n_links) of (id, text) rows."""
    sets = [(i, grams(t)) for i, t in rows]
    n = len(sets)
    linked = [[i != j and bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b) for j, (_, b) in enumerate(sets)] for i, (_, a) in enumerate(sets)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in range(n) if linked[i][j])]) for i in range(n)]
    names = {r: min([sets[i][0] for i in range(n) if root[i] == r and sets[i][0] is not None], default=None) for r in set(root)}
    return sorted(((i, names[root[k]], sum(linked[k])) for k, (i, _) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("block", "grams_a_block"), [(128, 1 << 18), (3, 1 << 18), (128, 150)])
def test_ngram_join(spark, docs, block, grams_a_block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams_a_block)
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(docs).collect()]
    assert sorted(got, key=str) == brute_join([(r[0], r[1]) for r in corpus()])
    if block == 128 and grams_a_block > 150:
        assert ngram_join.join(docs.limit(0)).count() == 0


def test_ngram_join_shared_and_null_ids(spark, monkeypatch):
    """Ids shared by different texts, and texts with null ids only, lose no link; columns whose names clash do not matter."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 2)
    word = [[f"g{g}w{k:03}" for k in range(100)] for g in range(4)]
    text = lambda g, *at: " ".join("changed" if k in at else w for k, w in enumerate(word[g]))
    rows = [(1, text(0)), (1, text(1)), (2, text(0, 50)), (3, text(1, 50)), (4, text(1, 9)), (None, text(2)), (7, text(2, 3)), (None, text(2, 90)), (None, text(3)), (None, text(3, 5)), (None, text(3)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("id", "cid", "n", "s1", "tag", "group", "class_id")})
    out = ngram_join.join(df).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out), key=str) == brute_join(rows)
    assert sorted((r["class_id"], r["n_links"]) for r in out if r["doc_id"] == 1) == [(1, 1), (1, 2)]
    assert len({r["group"] for r in out if r["class_id"] == 1}) == 2
    assert len({r["group"] for r in out}) == 5


def test_bands():
    for s in (0.5, 0.7, 0.8, 0.95):
        b, r = ngram_join.choose_bands(s, 0.999, 512)
        assert 1 - (1 - s**r) ** b >= 0.999 and b * r <= 512


def test_word_hashes():
    texts = [t or "" for _, t, *_ in corpus()] + ODD
    h, off = wordhash.words(texts)
    back = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        assert off[i + 1] - off[i] == len(w)
        for x, y in zip(w, h[off[i] : off[i + 1]].tolist(), strict=True):
            assert back.setdefault(x, y) == y
    assert len(set(back.values())) == len(back)
    g, goff = wordhash.shingles(texts)
    assert np.diff(goff).tolist() == [len(grams(t)) for t in texts]


def test_components_and_ranks(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, rng.randrange(101, 180)) for _ in range(60)] + [(200, 200), (7, None)]
    scratch = Scratch(spark, "test")
    got = {r["node"]: r["component"] for r in connected_components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for e in edges[40:100] for x in e}
    df = spark.range(500).selectExpr("id * 7 % 500 AS k", "id % 3 AS w")
    rank, at = {r["k"]: r["r"] for r in global_rank(scratch, df, ["k"], "w", "r").collect()}, 0
    for r in sorted(df.collect()):
        assert rank[r["k"]] == at
        at += r["w"]


PAGES = [
    (1, "https://A.example.org/es/x", "<link rel='canonical' href='http://free.net/1'>"), (2, "http://free.net/1#top", None), (3, "http://other.net/2", '<meta http-equiv="refresh" content="0; url=http://free.net/1">'),
    (4, "https://x.org/en/1", '<link href="//free.net/1" rel="canonical">'), (5, None, "canonical"), (6, "no url", '<link rel=canonical href="http://free.net/1">'), (7, "http://lone.net", ""),
    (8, "https://example.org/en/12?q=1", ""), (9, "https://badexample.org/en/1", ""), (10, "https://de.com/de/", ""), (11, "http://rel.net/a", '<link rel="canonical" href="/b">'), (12, "http://rel.net/b", ""), (1, "https://A.example.org/es/x", ""),
]


def test_url_filter(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("free.net", "/1", None, "block"), 3: ("other.net", "/2", None, "block"), 4: ("x.org", "/en/1", "org/", "allow"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("lone.net", "", None, "allow"), 8: ("example.org", "/en/12", "example.org/en/1", "block"),
        9: ("badexample.org", "/en/1", "org/", "allow"), 10: ("de.com", "/de/", "com/de/", "block"), 11: ("rel.net", "/a", None, "allow"), 12: ("rel.net", "/b", None, "allow")}
    moved = spark.createDataFrame([("http://rel.net/b", "https://www.example.org/es/1"), (None, "x")], "source_url string, target_url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, redirects=moved).collect()}
    assert got[11] == got[12] == "block" and got[4] == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_roots_and_hubs(spark):
    """http://h and http://h/ are one page; many aliases of one blocked page are blocked, but for those that a rule allows."""
    rows = [(1, "http://free.net", ""), (2, "http://alias.net/x", "<link rel=canonical href='http://free.net/'>"), (3, "http://free.net/?q", ""),
            (4, "http://free.net/", "<link rel='canonical' href='https://example.org/es/hub'>")]
    rows += [(100 + i, f"http://a{i}.net/p", "<link rel='canonical' href='https://example.org/es/hub'>") for i in range(300)]
    rows += [(900, "http://x.org/p", "<link rel='canonical' href='https://example.org/es/hub'>"), (None, "http://a5.net/p#x", None)]
    got = collections.Counter((r["page_id"] if r["page_id"] in (1, 2, 3, 4, 900) else 0, r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(1, "block"): 1, (2, "block"): 1, (3, "allow"): 1, (4, "block"): 1, (0, "block"): 301, (900, "allow"): 1}


def test_url_filter_relative(spark):
    """Relative targets and encoded ones reach their pages, as urljoin and html.unescape have them."""
    import html
    from urllib.parse import urljoin

    base = "http://rel.net/a/b/page?x=1"
    refs = ["next.html", "../up", "./same/", "../../../root", "?id=2", "/abs/../c", "/q?a=1&amp;b=2", "d?a=1&#38;b=&#x32;", "sub/.", "..", "x?u=http://y/", "//other.net/z", "HTTP://far.net/1&copy;&nope", "/n&#233;", "#top", "e&#0128;&#x110000;&amp;"]
    one = spark.createDataFrame([(r,) for r in refs], "r string").select("r", url_filter.node_of(url_filter.resolved(url_filter.decoded(F.col("r")), F.lit(base))).alias("n"))
    want = {r: re.sub("(?i)^http://|#.*$", "", urljoin(base, html.unescape(r))) for r in refs}
    assert len(want) == len(refs)
    assert {r["r"]: r["n"] for r in one.collect()} == want
    blocked = "https://example.org/es/dir/"
    pages = [(1, blocked + "start?n=1", "<link rel='canonical' href='../x?a=1&amp;b=2'>"), (2, "http://free.net/d/one", '<meta http-equiv="refresh" content="0; url=next.html?a=1&amp;b=2">'),
             (3, "http://free.net/d/next.html?a=1&b=2", f'<link rel="canonical" href="{blocked}start?n=1">'), (4, "http://free.net/d/next.html?a=1", ""),
             (5, "http://free.net/q", '<link rel="canonical" href="?id=2">'), (6, "http://free.net/q?id=2", f'<meta http-equiv=refresh content="0;url={blocked}">'), (7, "http://free.net/moved/here", "")]
    moved = spark.createDataFrame([("http://free.net/moved/here", "../d/./one")], "source_url string, target_url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects=moved).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block"}


def test_url_filter_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES[:-1], columns=["page_id", "url", "html"]))
    pages = spark.createDataFrame(PAGES[:-1], "page_id long, url string, html string")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()) == sorted(want)


def brute_search(rows, queries, k):
    """[(doc_id, score)] for each query id. rows: (doc_id, text); queries: the same, one text an id."""
    counts = [(i, collections.Counter(words_of((t or "").lower()))) for i, t in rows if i is not None]
    n = len(counts)
    mean = max(1.0, sum(sum(c.values()) for _, c in counts) / max(1, n))
    df = collections.Counter(t for _, c in counts for t in c)
    out = {}
    for q, text in queries:
        asked = collections.Counter(words_of((text or "").lower()))
        scores = []
        for d, c in counts:
            s = sum(qtf * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, qtf in asked.items() if t in c)
            if s > 0:
                scores.append((d, s))
        out[q] = sorted(scores, key=lambda x: (-round(x[1], 6), x[0]))[:k]
    return out


@pytest.mark.parametrize(("postings", "per_file", "shards"), [(10**6, 2048, 2048), (1500, 8, 3)])
def test_search(spark, docs, postings, per_file, shards, monkeypatch):
    monkeypatch.setattr(search, "MOST_POSTINGS", postings)
    monkeypatch.setattr(search, "QUERIES_PER_FILE", per_file)
    monkeypatch.setattr(search, "SHARDS", shards)
    odd = spark.createDataFrame([(None, "nou aou"), (700, "Aou aou bou"), (701, "aou AOU bou"), (701, "aou bou aou")], "doc_id long, text string")  # ties, a repeated id, a null id
    some = docs.unionByName(odd, allowMissingColumns=True).withColumns({"score": F.lit(1), "rank": F.lit("x"), "terms": F.lit(2), "q": F.lit(3)})
    got = collections.defaultdict(list)
    for r in search.search(some.repartition(5), some.where("doc_id % 5 = 0 OR doc_id = 701"), k=7).orderBy("rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    want = brute_search(rows, {i: t for i, t in rows if i is not None and (i % 5 == 0 or i == 701)}.items(), 7)
    for q, hits in want.items():
        assert [d for d, _ in got[q]] == [d for d, _ in hits]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in hits], abs=2e-6)
    assert set(got) == {q for q, hits in want.items() if hits}
    assert search.search(docs.limit(0), docs).count() == 0
    assert search.search(docs, docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 4")
    again = search.search(docs, twice.union(twice), k=3).orderBy("rank").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in search.search(docs, twice, k=3).orderBy("rank").collect()]


@pytest.mark.parametrize(("heavy", "block", "window"), [(512, 16, 256), (8, 2, 4), (0, 4, 8)])
def test_shards_are_pruned_exactly(heavy, block, window, monkeypatch):
    """Several shards, one after the other, with thresholds carried along; copies, ties and texts without words."""
    for name, value in (("HEAVY", heavy), ("BLOCK", block), ("WINDOW", window)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(11)
    topics = [[f"t{j}w{i}" for i in range(40)] + [f"c{i}" for i in range(12)] for j in range(4)]
    texts = [" ".join(rng.choice(topics[i % 4]) for _ in range(rng.randrange(1, 60))) for i in range(400)]
    texts += ["", " "] + texts[:9] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    asked = [(i, t) for i, t in rows if i % 7 == 0 and t.strip()]
    want = brute_search(rows, asked, 5)
    mean = sum(len(words_of(t)) for t in texts) / len(texts)
    df = collections.Counter(t for _, x in rows for t in set(words_of(x)))
    idf = {int(wordhash.words([t])[0][0]): np.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    queries = []
    for _, t in asked:
        terms, _, tf, _ = search.term_counts([t])
        queries.append((terms, tf * np.array([idf[int(x)] for x in terms])))
    best, kept, scored, seen = np.zeros((len(asked), 5)), [[] for _ in asked], 0, 0
    for lo in range(0, len(rows), 150):
        part = rows[lo : lo + 150]
        arrays, terms, n = search.shard_of(*search.term_counts([t for _, t in part]), np.array([i for i, _ in part]))
        assert n.tolist() == [sum(int(x) in map(int, search.term_counts([t])[0]) for _, t in part) for x in terms]
        index = search.ShardIndex(arrays, mean)
        for a, b in index.batches(queries):
            for q, (ids, scores) in enumerate(index.top(queries[a:b], best[a:b], 5), a):
                kept[q] = sorted([*kept[q], *zip(ids.tolist(), scores.tolist(), strict=True)], key=lambda x: (-x[1], x[0]))[:5]
                best[q, : len(kept[q])] = [s for _, s in kept[q]]
        scored, seen = scored + index.scored, seen + index.seen
    for (q, _), hits in zip(asked, kept, strict=True):
        assert [d for d, _ in hits] == [d for d, _ in want[q]]
        assert [s for _, s in hits] == pytest.approx([s for _, s in want[q]], abs=2e-6)
    assert scored <= seen and (window != 4 or scored < 0.9 * seen)


def test_search_windows_hold_their_own_terms(monkeypatch):
    """A window of documents of one language multiplies with that language's heavy terms only, and batches are as large for long lists."""
    monkeypatch.setattr(search, "WINDOW", 32)
    rng = random.Random(5)
    texts = [f"{'ab'[i % 2]}0 " * 30 + " ".join(f"{'ab'[i % 2]}{rng.randrange(20)}" for _ in range(40)) for i in range(256)]
    arrays, terms, _ = search.shard_of(*search.term_counts(texts), np.arange(256))
    index = search.ShardIndex(arrays, 70.0)
    assert len(index.heavy) == 40 and sum(len(w[2]) == 20 for w in index.windows) >= 6
    queries = [(terms[i % 40 : i % 40 + 1], np.ones(1)) for i in range(300)]
    assert [b - a for a, b in index.batches(queries)] == [128, 128, 44]
    whole = [index.top(queries[i : i + 1], np.zeros((1, 3)), 3)[0] for i in range(300)]
    for a, b in index.batches(queries):
        for i, (ids, scores) in enumerate(index.top(queries[a:b], np.zeros((b - a, 3)), 3), a):
            assert ids.tolist() == whole[i][0].tolist() and scores.tolist() == whole[i][1].tolist()


def test_language_id(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdé", "bb": "vwxyz", "cc": "mnopq"}
    word = lambda c: "".join(rng.choice(letters[c]) for _ in range(5))
    rows = [(i, " ".join(word(c) for _ in range(30)), c) for i, c in enumerate(rng.choice(list(letters)) for _ in range(300))] + [(900, None, "aa"), (901, "12 !!", "aa"), (902, "", None), (903, "abc " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == c and 0 <= got[i]["score"] <= 1 for i, _, c in rows[:300])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert language_id.train(df.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_quality_model(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" + ("" if i % 3 else "###") for _ in range(60))) for i in range(240)] + [(900, None), (901, ""), (902, "w1 " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(5, None), (None, 1)], "doc_id long, quality int")
    net = quality_model.train(df, labels)
    got = {r["doc_id"]: r for r in quality_model.score(df, net).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in range(1, 240, 2)) >= 117
    assert quality_model.train(df, labels.limit(0)) is None
    assert {r["score"] for r in quality_model.score(df, None).collect()} == {0.5}
    assert quality_model.score(df.limit(0), net).count() == 0


CLASH = "source_size target repeats size n_words kept base_failed host path rule verdict n_lines n_deleted class_id n_links k t id rep component a b u v q raw lo hi m r s1 s2 n bands h value node".split()


def test_clashing_columns(spark, docs):
    wide = docs.select("doc_id", "text", "lang", "source", *[F.lit("x").alias(c) for c in CLASH])
    n = docs.count()
    sized = wide.withColumn("size", F.lit(3).cast("long"))
    assert mixing.mix(sized, "size").where("repeats >= 0 AND source_size > 0 AND m = 'x'").count() == n
    assert quality_rules.judge(wide).where("n_words >= 0 AND rule = 'x'").count() == n
    assert line_dedup.dedup(wide).where("n_deleted >= 0 AND raw = 'x'").count() == n
    pages = wide.select("*", F.col("text").alias("url"), F.lit("").alias("html"))
    assert url_filter.judge(pages).where("verdict = 'allow' AND m = 'x'").count() == n
    assert ngram_join.join(wide).count() == n and codec.encode(wide, PATH).count() == n
    assert language_id.predict(wide, language_id.train(wide)).count() == n
