"""N-gram Jaccard join: MinHash banding for candidates, exact verification on full n-gram sets.

1. Every whole text gives its set of 5-word n-grams and a MinHash signature in bands. Texts with the same set form one
   class, which has a number of its own; copies are never compared with each other.
2. Band hashes are shuffled. A class is at home with the smallest class of all its buckets, and homes that meet in buckets take the
   smallest label that they see there, a few times over. Classes are put in order by label and home, so that texts that share many
   bands are neighbours, and runs of one label, of bounded size, are blocks. Ranks are summed over ranges; no label meets one task.
3. Two blocks are compared if some bucket has members of both; a block is compared with itself. Such a pair is a task's unit: it
   counts intersections of whole sets exactly, by a product of incidence matrices. Blocks are a partition of the classes, so each pair
   of classes lies in one unit and is counted once, and every pair that shares a band lies in one. A unit returns one row per
   class (its number of links there and the smallest class it hangs together with), not pairs.
4. Link counts are summed; components over the verified links give the class id.

A group of m classes that are all alike has m**2 / 2 links to count; its blocks meet in (m / BLOCK_DOCS)**2 / 2 units, which any
number of tasks share. Classes that hang together through a chain of buckets only meet those that they share a bucket with.

Defined results: words are runs of non-white characters, as written; a text of one to four words has itself as its one n-gram; a text
without words (null too) has no n-gram, no links and its own id as class; rows with one id and different texts are different
texts, linked each by itself (their classes are named by the smallest id, so two classes can have one name; `group` tells them apart); rows
with null ids take part like all others, but name no class: a class of nothing else has a null id; other columns are left out;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, wordhash
from .common import Scratch, connected_components, global_rank

N = 5
#: similarity >= THRESHOLD[0] / THRESHOLD[1], compared in whole numbers
THRESHOLD = (4, 5)
RECALL = 0.9999
MAX_HASHES = 320
#: Classes and n-grams of a block, at most (of n-grams, one text more); a block's size is counted in so many parts.
BLOCK_DOCS, BLOCK_GRAMS, PARTS = 128, 1 << 18, 1 << 20
#: Rounds in which labels spread; they only decide which texts are neighbours.
SPREAD = 2


def choose_bands(threshold: float, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, whose recall at the threshold is reached with at most `hashes` hashes."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("recall cannot be reached with so few hashes")
    return best


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(grams: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Signed 64-bit band keys, one row a text; texts without n-grams get zeros."""
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, bands), np.uint64)
    if len(full):
        starts, mult = off[full], _multipliers(bands * rows)
        mixers = _multipliers(rows + 1)
        for b in range(bands):
            key = np.full(len(full), b + 1, np.uint64) * mixers[rows]
            for r in range(rows):
                key += np.minimum.reduceat(grams * mult[b * rows + r], starts) * mixers[r]
                key = wordhash.mix(key)
            out[full, b] = key
    return out.view(np.int64)


def _set_keys(grams: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each sorted set."""
    n = len(off) - 1
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        a[full] = np.add.reduceat(wordhash.mix(grams), off[full])
        b[full] = np.add.reduceat(wordhash.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), off[full])
    return a.view(np.int64), b.view(np.int64)


def signatures(df: DataFrame, key: str, text: str, bands: int, rows: int, n: int = N, tag: str | None = None) -> DataFrame:
    """id, tag (a long that is carried along), th (hash of the text), s1, s2 (name of the set), n (its size) and bands for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in bpe.slices(batch.column(1)):
                grams, off = wordhash.shingles(part, n)
                s1, s2 = _set_keys(grams, off)
                keys = band_hashes(grams, off, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), batch.column(3).slice(at, len(part)), pa.array(s1), pa.array(s2),
                     pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel())],
                    names=["id", "tag", "th", "s1", "s2", "n", "bands"])

    return _texts(df, key, text, tag).mapInArrow(run, "id long, tag long, th long, s1 long, s2 long, n long, bands array<long>")


def _texts(df: DataFrame, key: str, text: str, tag: str | None = None) -> DataFrame:
    """(id, t, tag, th)"""
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), (F.col(tag) if tag else F.lit(0)).cast("long").alias("tag"))
    return rows.withColumn("th", F.xxhash64("t"))


def gram_sets(rows: DataFrame, n: int) -> DataFrame:
    """(cid, s1, s2, t) to (cid, g): the sorted n-gram hashes, 8 bytes each, of the rows whose text has the set that it was taken for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2 = (batch.column(i).to_numpy() for i in (1, 2))
            for at, part in bpe.slices(batch.column(3)):
                grams, off = wordhash.shingles(part, n)
                a, b = _set_keys(grams, off)
                same = np.flatnonzero((a == s1[at : at + len(part)]) & (b == s2[at : at + len(part)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)).take(pa.array(same)), pa.array([grams[off[i] : off[i + 1]].tobytes() for i in same], pa.binary())], names=["cid", "g"])

    return rows.select("cid", "s1", "s2", "t").mapInArrow(run, "cid long, g binary")


def _intersections(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections, by incidence matrices over slices of the n-grams that two texts or more share."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    column = np.cumsum(count > 1) - 1
    doc, col = doc[shared], column[inverse[shared]]
    out = np.zeros((n, n), np.float32 if len(col) < 1 << 24 else np.float64)
    width = max(256, (4 << 20) // max(1, n))
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((n, min(width, int(col[-1]) + 1 - lo)), out.dtype)
        m[doc[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def _verify(unit: list[dict], threshold: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
    """(class, links, root) of the classes of one unit that have a link in it. unit: far (whether it has two blocks), side (of them), cid, mult, g."""
    far = unit[0]["far"]
    sets = [np.frombuffer(m["g"], np.uint64) for m in unit]
    size = np.array([len(x) for x in sets])
    both = _intersections(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    p, q = threshold
    linked = (p + q) * both >= p * (size[:, None] + size[None, :])  # p / q <= both / union
    np.fill_diagonal(linked, False)
    if far:
        side = np.array([m["side"] for m in unit])
        linked &= side[:, None] != side[None, :]
    links = linked @ np.array([m["mult"] for m in unit], np.int64)
    ids = np.array([m["cid"] for m in unit], np.int64)
    root = ids.copy()
    while True:  # smallest class that is reachable
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            break
        root = low
    for i in np.flatnonzero(links):
        yield int(ids[i]), int(links[i]), int(root[i])


def near_links(scratch: Scratch, sig: DataFrame, df: DataFrame, key: str, text: str, n: int, threshold) -> tuple[DataFrame, DataFrame]:
    """(classes: cid, s1, s2, n, rep, mult), (cid, links, root) per unit for the classes with links to others."""
    # numbers are fixed once the table is written
    classes = scratch.save(
        sig.where("n > 0").groupBy("s1", "s2", "n")
        .agg(F.min("id").alias("rep"), F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("one"), F.count("*").alias("mult"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    keys = classes.select("cid", F.explode("bands").alias("k"))
    buckets = keys.groupBy("k").agg(F.min("cid").alias("c"), F.count("*").alias("m")).where("m > 1").select("k", "c")
    met = scratch.save(keys.join(buckets, "k"))
    homes = met.groupBy("cid").agg(F.min("c").alias("home"))
    near = homes.withColumn("label", F.col("home"))
    for _ in range(SPREAD):  # the smallest label that a class sees through its buckets
        seen = met.select("cid", "k").join(near.select("cid", "label"), "cid")
        low = seen.groupBy("k").agg(F.min("label").alias("label"))
        near = scratch.save(met.select("cid", "k", "c").join(low, "k").groupBy("cid").agg(F.min("c").alias("home"), F.min("label").alias("label")))
    homes = near.join(classes.select("cid", "n"), "cid")
    weight = F.greatest(F.lit(-(-PARTS // BLOCK_DOCS)), F.ceil(F.col("n") * PARTS / BLOCK_GRAMS)).cast("bigint")
    ranked = global_rank(scratch, homes.select("cid", "label", "home", weight.alias("w")), ["label", "home", "cid"], "w", "r")
    placed = scratch.save(ranked.select("cid", F.struct("label", F.floor(F.col("r") / PARTS).alias("blk")).alias("at")))
    touched = met.select("k", "cid").join(placed, "cid").select("k", "at").distinct()
    several = touched.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
    touched = scratch.save(touched.join(several, "k"))
    pairs = touched.withColumnRenamed("at", "a").join(touched.withColumnRenamed("at", "b"), "k").where("a < b").select("a", "b").distinct()
    pairs = scratch.save(pairs)
    far = F.lit(True).alias("far")
    units = (
        placed.select(F.col("at").alias("a"), F.col("at").alias("b"), F.lit(False).alias("far"), F.lit(0).alias("side"), "cid")
        .unionByName(pairs.join(placed, F.col("a") == F.col("at")).select("a", "b", far, F.lit(0).alias("side"), "cid"))
        .unionByName(pairs.join(placed, F.col("b") == F.col("at")).select("a", "b", far, F.lit(1).alias("side"), "cid"))
    )
    # texts meet their classes once, before blocks repeat them; by sort-merge at every size, so that plans scale alike
    held = classes.join(placed.select("cid"), "cid").select("cid", "s1", "s2", "mult", F.col("one.id").alias("id"), F.col("one.th").alias("th"))
    held = scratch.save(held)
    texts = _texts(df, key, text).alias("x").join(
        held.alias("h").hint("merge"), F.col("x.id").eqNullSafe(F.col("h.id")) & (F.col("x.th") == F.col("h.th"))).select("cid", "s1", "s2", "t")
    sets = scratch.save(gram_sets(texts.dropDuplicates(["cid"]), n))
    rows = units.join(sets, "cid").join(held.select("cid", "mult"), "cid").repartition("a", "b").sortWithinPartitions("a", "b").select(
        F.col("a.label").alias("al"), F.col("a.blk").alias("ab"), F.col("b.label").alias("bl"), F.col("b.blk").alias("bb"), "far", "side", "cid", "mult", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit, out = None, [], []

        def flush() -> None:
            if len(unit) > 1:
                out.extend(_verify(unit, threshold))
            unit.clear()

        def table() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["cid", "links", "root"])
            out.clear()
            return got

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for row in batch.slice(lo, 256).to_pylist():
                    at = (row["al"], row["ab"], row["bl"], row["bb"])
                    if at != now:
                        flush()
                        now = at
                    unit.append(row)
            if len(out) > 10_000:
                yield table()
        flush()
        yield table()

    found = scratch.save(rows.mapInArrow(run, "cid long, links long, root long"))
    scratch.drop(met, near, touched, pairs, held, sets)
    return classes, found


def join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, tag: str | None = None) -> DataFrame:
    """key, tag (if one is named), class_id (the smallest id of its connected component), n_links (texts with similarity >= threshold, copies
    counted) and group (a number of the component that is its own in this run; null for a text without words), for each row."""
    scratch = Scratch(df.sparkSession, "ngram-join")
    bands, rows = choose_bands(threshold[0] / threshold[1], recall)
    sig = scratch.save(signatures(df, key, text, bands, rows, n, tag))
    classes, found = near_links(scratch, sig, df, key, text, n, threshold)
    comps = connected_components(scratch, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    own = classes.select("cid", "s1", "s2", "n", "rep", "mult").join(comps, F.col("cid") == F.col("node"), "left").join(links, "cid", "left")
    own = scratch.save(own.select("s1", "s2", "n", "rep", F.coalesce("component", "cid").alias("group"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    names = own.groupBy("group").agg(F.min("rep").alias("class_id"))
    near = scratch.save(own.drop("rep").join(names, "group"))
    out = sig.select("id", "tag", "s1", "s2", "n").join(near, ["s1", "s2", "n"], "left")
    return out.select(
        F.col("id").alias(key), *([F.col("tag").alias(tag)] if tag else []), F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "group")


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("group")


def join_sql(docs: str = "documents") -> str:
    return rf"""
nj_w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
nj_g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM nj_w),
nj_x AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM nj_g),
nj_p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM nj_x a JOIN nj_x b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
nj_r(n, m) AS (SELECT a, b FROM nj_p UNION SELECT nj_r.n, nj_p.b FROM nj_r JOIN nj_p ON nj_r.m = nj_p.a),
nj_c AS (SELECT n, min(m) AS m FROM nj_r GROUP BY n),
nj_l AS (SELECT a, count(*) AS n FROM nj_p GROUP BY a),
nj_o AS (SELECT g.doc_id, least(g.doc_id, coalesce(c.m, g.doc_id)) AS class_id, coalesce(l.n, 0)::BIGINT AS n_links
  FROM nj_g g LEFT JOIN nj_c c ON g.doc_id = c.n LEFT JOIN nj_l l ON g.doc_id = l.a)"""


ORACLE = f"WITH RECURSIVE {join_sql()} SELECT doc_id, class_id, n_links FROM nj_o"
