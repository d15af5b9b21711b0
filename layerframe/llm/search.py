"""Exact top-k search by BM25: an inverted index per shard, block-max WAND pruning, an exact merge.

Every input partition becomes a shard, or several of at most MOST_POSTINGS postings and MOST_DOCS documents: files in the
shared folder. Global statistics (number of documents, mean length, document frequency of the queries' terms) are summed
over the shards first, so scores of different shards compare. Queries are written in files; a task takes a file of
queries through a group of shards, one after the other, carries each query's threshold along, and returns its best k.

A shard's lists are split as WAND's pivot splits them, once for all queries: the HEAVY most frequent terms have long lists and low
impacts (non-essential lists), all others are light (essential lists). Documents lie in blocks of BLOCK neighbours that are
alike, and every heavy list has its largest impact per block. For a batch of queries

1. cursors run over the light lists and add up the light part of each document's score;
2. a block is live for a query if the best light part in it plus the summed block maxima of the query's heavy terms reaches the
   query's threshold, its k-th best score so far, here or in shards before;
3. windows of blocks are visited in the order of documents. A window without a live block is skipped, and no heavy list is read
   there. In the others the heavy parts are added, and the threshold rises before the next window is looked at.

Bounds and heavy parts are 32-bit products with a proven margin; whatever can still be among the best k is scored again in
64 bits, so results are exact. Documents of a shard with the same words and counts are held once, with their ids: they tie.
Impacts need the mean length of the whole table, so a shard's impacts and maxima are computed when a task loads it, once for a
file of up to QUERIES_PER_FILE queries. A term is a 64-bit hash of a lower-cased word.

Defined results: score = sum over the query's distinct terms of qtf * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len / mean)),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), rounded to 6 places; ties go to the smaller id; only documents that share a term are
returned, the query itself among them; queries without words and null texts return nothing; repeated rows are each a document; rows of queries with
one id make one query, with each term as often as in the row that has it most; a null id is neither query nor result (it counts in no statistic);
other columns are left out, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, token_file, wordhash
from .common import Scratch, shared_dir

K1, B, K = 1.2, 0.75, 10
HEAVY, BLOCK, WINDOW = 512, 16, 256
MOST_POSTINGS, MOST_DOCS = 4_000_000, 32_768
#: Most queries, about, of a file, and terms of their texts.
QUERIES_PER_FILE, TERMS_PER_FILE = 2048, 2_000_000
#: Queries of a batch; a batch holds 12 bytes for each of its queries and documents of a shard.
BATCH = 128
#: Light postings that are added up at once, of one query or several.
AT_ONCE = 1 << 15
#: Most shards, about, of a unit of work, and units that are tasks of their own.
SHARDS, TASKS = 2048, 100_000
EVERY = 50
#: Of a heavy part: above the error of a 32-bit sum of HEAVY products, HEAVY * 2**-24 in the worst order.
ERROR = 4e-5
#: Above 0, and of 32 bits.
TINY = 1e-30


def _put(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Written under a name of the attempt, then renamed: whoever runs again replaces an equal file."""
    fs, base = token_file._open(folder)
    fs.create_dir(base, recursive=True)
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    temp = f"{base}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(buf.getbuffer())
    fs.move(temp, f"{base}/{name}")


def _get(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, base = token_file._open(folder)
    with fs.open_input_file(f"{base}/{name}") as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers from 0 on in the narrowest type."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Places at which runs of equal keys start."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of the ranges [lo, hi)."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text index, tf) sorted by text and term, and the length of each text."""
    h, off = wordhash.words(texts, lower=True)
    n = np.diff(off)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    at = _firsts(h, doc)
    return h[at], doc[at], np.diff(np.append(at, len(h))), n


def copies(t: np.ndarray, d: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each document the first one with the same words and counts (two sums of 64 bits and the length); postings sorted by document."""
    sums = []
    start = _firsts(d)
    for salt in (0, 0xA5A5A5A5A5A5A5A5):
        s = np.zeros(len(size), np.uint64)
        if len(start):
            s[d[start]] = np.add.reduceat(wordhash.mix(t ^ np.uint64(salt)) * tf.astype(np.uint64), start)
        sums.append(s)
    order = np.lexsort((np.arange(len(size)), size, *sums))
    start = _firsts(sums[0][order], sums[1][order], size[order])
    first = np.empty(len(size), np.int64)
    first[order] = np.repeat(order[start], np.diff(np.append(start, len(order))))
    return first


def alike(t: np.ndarray, d: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An order in which neighbours are alike, so that blocks have tight bounds: by the most frequent common term, then by length.
    Postings are sorted by term."""
    start = _firsts(t)
    n = np.diff(np.append(start, len(t)))
    common = np.repeat(n > 0.02 * len(size), n)
    c, w, term = d[common], tf[common], np.repeat(np.arange(len(n)), n)[common]
    order = np.lexsort((w, c))
    last = np.append(c[order][1:] != c[order][:-1], True)[: len(order)]
    top = np.full(len(size), -1)
    top[c[order][last]] = term[order][last]
    return np.lexsort((size, top))


def shard_of(t: np.ndarray, d: np.ndarray, tf: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The arrays of a shard, its terms and their document frequencies. Postings are sorted by document; documents without words are left out."""
    first = copies(t, d, tf, size)
    rep = np.flatnonzero((first == np.arange(len(size))) & (size > 0))
    number = np.full(len(size), -1)
    number[rep] = np.arange(len(rep))
    times = np.bincount(number[first[size > 0]], minlength=len(rep))
    keep = number[d] >= 0
    t, d, tf, lens = t[keep], number[d[keep]], tf[keep], size[rep]
    order = np.argsort(t, kind="stable").astype(np.int32)
    t, d, tf = t[order], d[order], tf[order]
    place = alike(t, d, tf, lens)
    back = np.empty(len(rep), np.int64)
    back[place] = np.arange(len(rep))
    d, lens = back[d], lens[place]
    order = np.lexsort((d, t)).astype(np.int32)
    t, d, tf = t[order], d[order], tf[order]
    start = _firsts(t)
    ptr = np.append(start, len(t))
    n = np.diff(ptr)
    df = np.add.reduceat(times[place][d], start) if len(start) else n
    # the HEAVY longest lists, as far as they meet one block of documents in four
    heavy = np.zeros(len(n), bool)
    heavy[np.argsort(-n, kind="stable")[:HEAVY]] = True
    heavy &= n >= max(2, len(rep) // (4 * BLOCK))
    of = np.repeat(heavy, n)
    whole = size > 0  # ids, group by group in the order of the documents, smallest first
    group = back[number[first[whole]]]
    order = np.lexsort((ids[whole], group))
    arrays = {
        "terms": t[start[~heavy]], "ptr": small(np.append(0, np.cumsum(n[~heavy]))), "docs": small(d[~of]), "tf": small(tf[~of]),
        "heavy": t[start[heavy]], "hterm": small(np.repeat(np.arange(int(heavy.sum())), n[heavy])), "hdocs": small(d[of]), "htf": small(tf[of]),
        "lens": small(lens), "ids": ids[whole][order], "iptr": small(np.append(0, np.cumsum(np.bincount(group, minlength=len(rep)))))}
    return arrays, t[start], df


def build(df: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """Writes the shards of each partition, one or more; returns (name, number, docs, words, terms array<long>, df array<long>), a row per shard and slice of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, postings, part, task = [], 0, 0, 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n, postings, part
            columns = [np.concatenate([h[i] for h in held]) for i in range(5)]
            held.clear()
            name, words = f"shard-{task:08d}-{part:04d}.npz", int(columns[3].sum())
            arrays, terms, df = shard_of(*columns)
            _put(folder, name, arrays)
            own = terms.view(np.int64)
            for i in range(0, max(1, len(own)), 100_000):
                yield pa.RecordBatch.from_pydict({
                    "name": [name], "number": [task + part], "docs": [n if i == 0 else 0], "words": [words if i == 0 else 0],
                    "terms": [own[i : i + 100_000]], "df": [df[i : i + 100_000].astype(np.int64)]})
            n, postings, part = 0, 0, part + 1

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, texts in bpe.slices(batch.column(1)):
                for lo in range(0, len(texts), 4096):
                    some = texts[lo : lo + 4096]
                    t, d, tf, size = term_counts(some)
                    held.append((t, d + n, tf.astype(np.int32), size, keys[at + lo : at + lo + len(some)]))
                    n += len(some)
                    postings += len(t)
                    if postings >= MOST_POSTINGS or n > MOST_DOCS - 4096:  # a partition of any size becomes shards that fit into memory
                        yield from flush()
        if n:
            yield from flush()

    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("k IS NOT NULL")
    return rows.mapInArrow(run, "name string, number long, docs long, words long, terms array<long>, df array<long>")


def query_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(q, term, qtf)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in bpe.slices(batch.column(1)):
                t, d, tf, _ = term_counts(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at + d], pa.int64()), pa.array(t.view(np.int64)), pa.array(tf, pa.int64())], names=["q", "term", "qtf"])

    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("k IS NOT NULL")
    return rows.mapInArrow(run, "q long, term long, qtf long")


def _place(table: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which terms are in the sorted table, their places)."""
    at = np.searchsorted(table, terms)
    hit = np.flatnonzero(table[np.minimum(at, len(table) - 1)] == terms) if len(table) else np.empty(0, np.int64)
    return hit, at[hit]


class ShardIndex:
    """A shard in memory, with impacts from the global statistics and the largest impact per heavy term and block."""

    def __init__(self, arrays: dict[str, np.ndarray], mean: float):
        z = arrays
        self.terms, self.heavy, self.ids = z["terms"], z["heavy"], z["ids"]
        self.ptr, self.iptr = z["ptr"].astype(np.int64), z["iptr"].astype(np.int64)
        self.n = len(z["lens"])
        self.blocks = -(-self.n // BLOCK)
        self.norm = K1 * (1 - B + B * z["lens"] / mean)
        self.docs = z["docs"].astype(np.int64)
        self.impact = self._impact(z["tf"].astype(np.float64), self.norm[self.docs])
        self.htf = np.zeros((self.n, len(self.heavy)), z["htf"].dtype)
        self.htf[z["hdocs"], z["hterm"]] = z["htf"]
        himpact = np.zeros((self.blocks * BLOCK, len(self.heavy)), np.float32)
        himpact[z["hdocs"], z["hterm"]] = self._impact(z["htf"].astype(np.float64), self.norm[z["hdocs"]])
        self.hmax = himpact.reshape(self.blocks, BLOCK, len(self.heavy)).max(1) if self.n else himpact
        self.windows = []  # (blocks, documents, heavy terms that occur, their impacts by document)
        for b in range(0, self.blocks, max(1, WINDOW // BLOCK)):
            of = slice(b, b + max(1, WINDOW // BLOCK))
            docs = slice(b * BLOCK, min(self.n, of.stop * BLOCK))
            cols = np.flatnonzero(self.hmax[of].any(0))
            self.windows.append((of, docs, cols, np.ascontiguousarray(himpact[docs][:, cols])))
        self.scored = self.seen = 0  # documents whose heavy lists were read, and all, over the queries

    @staticmethod
    def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + norm)

    def batches(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        """Runs of BATCH queries, whatever they meet: top() adds up a few queries' light postings at once."""
        for lo in range(0, len(queries), BATCH):
            yield lo, min(lo + BATCH, len(queries))

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], best: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, rounded scores) of documents that can be among the best k, for each query (terms, weights), at most k of them.

        best: the k best scores of each query so far (0: none yet), sorted in any way; what is found here is not added to it.
        """
        if not self.n:
            return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        nq, width = len(queries), self.blocks * BLOCK
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        of = np.repeat(np.arange(nq), [len(t) for t, _ in queries])
        w = np.zeros((nq, len(self.heavy)))
        hit, at = _place(self.heavy, terms)
        w[of[hit], at] = weights[hit]
        own, which = np.unique(terms, return_inverse=True)  # in order, so that the search through the table goes forward
        hit, at = _place(self.terms, own)
        place = np.full(len(own), -1)
        place[hit] = at
        at = place[which]
        hit = np.flatnonzero(at >= 0)
        at = at[hit]
        # bounds and heavy parts are 32-bit; a few queries at a time, so that their lists and sums stay in the cores' caches
        light, light32, cut = np.zeros((nq, width)), np.zeros((nq, width), np.float32), np.searchsorted(of[hit], np.arange(nq + 1))
        lo, n = self.ptr[at], self.ptr[at + 1] - self.ptr[at]
        met = np.append(0, np.cumsum(n))[cut]
        i = 0
        while i < nq:
            j = max(i + 1, int(np.searchsorted(met, met[i] + AT_ONCE, "right")) - 1)
            x = slice(cut[i], cut[j])
            p = _spread(lo[x], lo[x] + n[x])
            place = self.docs[p] + np.repeat((of[hit[x]] - i) * width, n[x])
            part = np.bincount(place, self.impact[p] * np.repeat(weights[hit[x]], n[x]), (j - i) * width).reshape(j - i, width)
            light[i:j] = light32[i:j] = part
            i = j
        w32 = w.astype(np.float32)
        slack = ERROR * (K1 + 1) * np.bincount(of, weights, nq) + 1e-5
        bound = light32.reshape(nq, self.blocks, BLOCK)
        while bound.shape[2] > 1:  # the largest of a block, by halves: whole rows at a time
            half = bound.shape[2] // 2
            odd = bound[:, :, 2 * half :]
            bound = np.maximum(bound[:, :, :half], bound[:, :, half : 2 * half])
            bound = np.concatenate([bound, odd], 2) if odd.shape[2] else bound
        bound = bound[:, :, 0] + w32 @ self.hmax.T + slack[:, None].astype(np.float32)
        best = best.copy()
        floor = best.min(1)
        # a score that is not below this can be among the best; one of 0 never is
        least = np.maximum(floor - slack, TINY).astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        times = np.minimum(np.diff(self.iptr), k)
        for blocks, docs, cols, impacts in self.windows:
            rows = np.flatnonzero((bound[:, blocks] >= floor[:, None]).any(1))
            if not len(rows):
                continue
            score = light32[rows, docs] + w32[rows[:, None], cols] @ impacts.T
            self.scored += score.size
            hit = np.flatnonzero(score >= least[rows, None])
            if not len(hit):
                continue
            (r, c), s = np.divmod(hit, score.shape[1]), score.ravel()[hit].astype(np.float64)
            found.append((rows[r], c + docs.start, s))
            at = _firsts(r)
            for i, j in zip(at.tolist(), np.append(at[1:], len(r)).tolist(), strict=True):
                q = rows[r[i]]
                new = np.concatenate([best[q], np.repeat(s[i:j] - slack[q], times[c[i:j] + docs.start])])
                best[q] = np.partition(new, len(new) - k)[len(new) - k :]
                floor[q] = best[q].min()
                least[q] = max(floor[q] - slack[q], TINY)
        self.seen += nq * self.n
        out = [(np.empty(0, np.int64), np.empty(0))] * nq
        if not found:
            return out
        q, d, s = (np.concatenate([x[i] for x in found]) for i in range(3))
        keep = s + slack[q] >= floor[q]
        order = np.argsort(q[keep], kind="stable")
        q, d = q[keep][order], d[keep][order]
        exact = light[q, d]
        for i in range(0, len(q), 4096):
            j = slice(i, i + 4096)
            exact[j] += np.einsum("ij,ij->i", self._impact(self.htf[d[j]].astype(np.float64), self.norm[d[j]][:, None]), w[q[j]])
        exact = np.round(exact, 6)
        at = _firsts(q)
        for i, j in zip(at.tolist(), np.append(at[1:], len(q)).tolist(), strict=True):
            n = times[d[i:j]]  # of documents that tie with all their copies, the k smallest ids
            ids, scores = self.ids[_spread(self.iptr[d[i:j]], self.iptr[d[i:j]] + n)], np.repeat(exact[i:j], n)
            top = np.lexsort((ids, -scores))[:k]
            out[q[i]] = ids[top], scores[top]
        return out


def search(df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k rows of df for each row of queries (same columns key and text)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "search")
    folder = f"{shared_dir(spark)}/search-{uuid.uuid4().hex[:12]}"
    shards = scratch.save(build(df, folder, key, text))
    total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.countDistinct("name")).first()
    n, mean, n_shards = int(total[0]), max(1.0, int(total[1]) / max(1, int(total[0]))), int(total[2])
    freq = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = query_terms(queries, key, text)
    weighted = scratch.save(
        terms.join(freq, "term").select("q", "term", (F.col("qtf") * idf).alias("w"))
        .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x"))
        .select("q", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))
    )

    # A unit of work is a file of queries and a group of shards, both known by their numbers: files as large as memory allows, since every
    # unit reads its shards once, and as many groups as keep the cluster busy.
    asked = weighted.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_files = max(1, -(-asked[0] // QUERIES_PER_FILE), -(-asked[1] // TERMS_PER_FILE))
    groups = max(1, min(n_shards, max(-(-2 * spark.sparkContext.defaultParallelism // n_files), -(-n_shards // SHARDS))))

    def put(kind: str, arrays):
        """Writes a file per number n of the rows (n, ...), which lie side by side; returns the numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, now, done = [], None, []

            def write() -> None:
                if rows:
                    _put(folder, f"{kind}-{now:08d}.npz", arrays(rows))
                    done.append(now)
                rows.clear()

            for batch in batches:
                for row in batch.to_pylist():
                    if row["n"] != now:
                        write()
                        now = row["n"]
                    rows.append(row)
            write()
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["n"])

        return run

    def query_file(rows: list[dict]) -> dict[str, np.ndarray]:
        terms, weights = [np.array(r["terms"], np.int64) for r in rows], [np.array(r["weights"]) for r in rows]
        last = [np.append(t[1:] != t[:-1], True) for t in terms]  # of equal terms the one with the largest weight
        terms, weights = [t[x].view(np.uint64) for t, x in zip(terms, last, strict=True)], [w[x] for w, x in zip(weights, last, strict=True)]
        return {"q": np.array([r["q"] for r in rows]), "ptr": np.cumsum([0, *map(len, terms)]), "terms": np.concatenate(terms), "weights": np.concatenate(weights)}

    dealt = weighted.withColumn("n", F.pmod(F.xxhash64("q"), F.lit(n_files)))
    scratch.save(dealt.repartition(n_files, "n").sortWithinPartitions("n").mapInArrow(put("queries", query_file), "n long"))
    named = shards.select("name", (F.col("number") % groups).alias("n")).distinct()
    scratch.save(named.repartition(groups, "n").sortWithinPartitions("n", "name").mapInArrow(put("group", lambda rows: {"names": np.array([r["name"] for r in rows])}), "n long"))

    def held(name: str) -> dict[str, np.ndarray]:
        try:
            return _get(folder, name)
        except FileNotFoundError:  # no row had this number
            return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for batch in batches for u in batch.column(0).to_pylist()):
            z, names = held(f"queries-{unit // groups:08d}.npz"), held(f"group-{unit % groups:08d}.npz")
            if not z or not names:
                continue
            queries = [(z["terms"][a:b], z["weights"][a:b]) for a, b in zip(z["ptr"][:-1].tolist(), z["ptr"][1:].tolist(), strict=True)]
            best, kept = np.zeros((len(queries), k)), [(np.empty(0, np.int64), np.empty(0))] * len(queries)
            for name in names["names"].tolist():
                index = None  # one shard in memory at a time
                index = ShardIndex(_get(folder, name), mean)
                for lo, hi in index.batches(queries):
                    for i, (ids, scores) in enumerate(index.top(queries[lo:hi], best[lo:hi], k), lo):
                        if len(ids):
                            ids, scores = np.concatenate([kept[i][0], ids]), np.concatenate([kept[i][1], scores])
                            top = np.lexsort((ids, -scores))[:k]
                            kept[i] = ids[top], scores[top]
                            best[i, : len(top)] = scores[top]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(z["q"], [len(x) for x, _ in kept]), pa.int64()), pa.array(np.concatenate([x for x, _ in kept])), pa.array(np.concatenate([x for _, x in kept]))],
                names=["query_id", "doc_id", "score"])

    units = spark.range(0, n_files * groups, 1, min(n_files * groups, TASKS))
    hits = units.mapInArrow(run, "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")  # at most k rows for each group of shards
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % EVERY == 0))


ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents) AS n, greatest(1.0, (SELECT sum(len) FROM dl)::DOUBLE / (SELECT count(*) FROM documents)) AS mean),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, g GROUP BY term, n),
s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * (d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len / mean)))), 6) AS score
  FROM tf q JOIN df USING (term) JOIN tf d USING (term) JOIN dl ON dl.doc_id = d.doc_id, g WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""
