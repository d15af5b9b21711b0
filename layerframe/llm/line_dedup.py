"""Deletes later copies of repeated runs of lines, by a suffix array over line ids with its LCP array, in native expressions.

Lines become ids: the lines with a word that occur twice or more are ranked. A line that no other equals is in no repeated run, so it ends
a string as the end of the text does. A run counts from MIN_WORDS words on: at each place the shortest run that reaches them is
looked up, m lines.

1. suffix_array: suffixes are ranked by prefix doubling. The rank of a suffix by its first 2k ids is the rank of the pair
   (rank by k here, rank by k at k lines further), a string that has ended being the smallest. A rank is a place in the suffix array: the number of
   suffixes of the texts still in work that sort before. A place whose first 2k of m lines no other shares is no candidate any more, and a
   text without candidates drops out, so rounds work on repeated text alone. Doubling ends when the order holds to m lines everywhere: a run of MIN_WORDS
   words has at most MIN_WORDS lines, so log2(MIN_WORDS) rounds decide about texts of any length.
2. lcp_array: the lines that a suffix shares from its start with the one before it in the suffix array, counted on the ids of both.
   Counts end at m lines, as nothing longer is asked for. Suffixes of equal rank are one entry.
3. lcp_intervals: an entry with an LCP of m or more lies in the interval of the entry before it, any other opens one. The members of an interval are
   all places of one run of m lines.

Where an interval has an earlier member (by document id, text hash and line), the run is a later copy and is deleted. A longer repeated run goes
as the runs inside it. Lines at its end that none of these needs to reach MIN_WORDS stay, as in the SQL below.

Defined results: lines without a word belong to no run (inside a deleted run they go with it); a null text stays null; a
document whose lines all go keeps its row with an empty text; rows with equal id and equal text are one document and both keep
what it keeps; a null id is an id like others, first in order; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, global_rank, let, split_words

MIN_WORDS = 50
KEY = ["_ld_id", "_ld_th"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: q counts such lines, raw counts all lines of the text."""
    lines = F.filter(
        F.transform(_lines(F.col("_ld_text")), lambda x, i: F.struct(i.alias("raw"), x.alias("line"))),
        lambda s: s["line"].rlike("[^\\x20\\x09-\\x0D]"),
    )
    return docs.select(*KEY, F.posexplode(lines).alias("q", "s")).select(
        *KEY, "q", F.col("s.raw").alias("raw"), F.size(split_words(F.col("s.line"))).alias("wc"),
        F.xxhash64("s.line").alias("h1"), F.xxhash64(F.lit(7), F.col("s.line")).alias("h2"),
    )


def _shortest(arr: Column, min_words: int) -> Column:
    """Lines from each place to min_words words, over consecutive repeated lines; 0 where they do not reach it."""
    zero = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("m"), F.lit(True).alias("on"))

    def one(x: Column, j: Column) -> Column:
        def step(s: Column, y: Column) -> Column:
            on = s["on"] & (s["w"] < min_words) & (y["q"] == x["q"] + s["m"])
            return F.struct(
                F.when(on, s["w"] + y["wc"]).otherwise(s["w"]).alias("w"),
                F.when(on, s["m"] + 1).otherwise(s["m"]).alias("m"),
                (s["on"] & (on | (s["w"] >= min_words))).alias("on"),
            )

        return F.aggregate(F.slice(arr, j + 1, F.lit(min_words)), zero, step, lambda s: F.when(s["w"] >= min_words, s["m"]).otherwise(0))

    return F.transform(arr, lambda x, j: F.struct(x["q"].alias("q"), x["raw"].alias("raw"), x["r"].alias("r"), one(x, j).alias("m")))


def _ahead(arr: Column, j: Column, k: Column, q: Column, field: str) -> Column:
    """field of the line k lines after place j, null where the lines between are not all repeated."""
    y = F.get(arr, j + k)
    return F.when(y["q"] == q + k, y[field])


def suffix_array(scratch: Scratch, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """KEY, q, lo, hi (raw lines, both included), m, ids (the line ids from lo to hi) and r, the rank in the suffix array, of each shortest run that may have copies."""
    occ = scratch.save(occurrences(docs))
    ids = occ.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    ids = scratch.save(global_rank(scratch, ids, ["h1", "h2"], "n", "r").select("h1", "h2", "r"))
    # equal rows of a document meet in the set, so later rounds see each place once
    arrays = (
        occ.join(ids, ["h1", "h2"]).groupBy(*KEY)
        .agg(F.sort_array(F.collect_set(F.struct("q", "raw", "wc", "r"))).alias("a"))
        .select(*KEY, let(F.col("a"), lambda a: _shortest(a, min_words)).alias("a"))
        .select(*KEY, F.transform("a", lambda x: F.struct(x["q"].alias("q"), x["raw"].alias("raw"), x["m"].alias("m"), x["r"].alias("id"), x["r"].alias("r"))).alias("a"))
    )
    state = scratch.save(arrays.where(F.exists("a", lambda x: x["m"] > 0)))
    scratch.drop(occ, ids)
    k = 1
    while k < (state.agg(F.max(F.array_max(F.transform("a", lambda x: x["m"])))).first()[0] or 0):
        pairs = let(F.col("a"), lambda a: F.transform(a, lambda x, j: F.struct(  # noqa: B023
            x["q"].alias("q"), x["raw"].alias("raw"), x["m"].alias("m"), x["id"].alias("id"), x["r"].alias("r"),
            F.coalesce(_ahead(a, j, F.lit(k), x["q"], "r"), F.lit(-1)).alias("r2"))))  # noqa: B023
        flat = scratch.save(state.select(*KEY, F.explode(pairs).alias("s")).select(*KEY, "s.*"))
        named = flat.groupBy("r", "r2").agg(F.count("*").alias("n"))
        named = scratch.save(global_rank(scratch, named, ["r", "r2"], "n", "nr").select("r", "r2", "nr", "n"))
        k *= 2
        still = F.when((F.col("m") >= k) & (F.col("n") == 1), 0).otherwise(F.col("m")).alias("m")
        after = flat.join(named, ["r", "r2"]).groupBy(*KEY).agg(
            F.sort_array(F.collect_list(F.struct("q", "raw", still, "id", F.col("nr").alias("r")))).alias("a"))
        old, state = state, scratch.save(after.where(F.exists("a", lambda x: x["m"] > 0)))
        scratch.drop(old, flat, named)
    place = let(F.col("a"), lambda a: F.filter(F.transform(a, lambda x, j: F.struct(
        x["q"].alias("q"), x["raw"].alias("lo"), _ahead(a, j, x["m"] - 1, x["q"], "raw").alias("hi"), x["m"].alias("m"),
        F.transform(F.slice(a, j + 1, x["m"]), lambda y: y["id"]).alias("ids"), x["r"].alias("r"),
    )), lambda s: s["m"] > 0))
    out = scratch.save(state.select(*KEY, F.explode(place).alias("s")).select(*KEY, "s.*"))
    scratch.drop(state)
    return out


def _common(x: Column, y: Column) -> Column:
    """Equal values at the start of two arrays; 0 where one is null."""
    first = let(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), lambda same: F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)))
    return F.when(x.isNull() | y.isNull(), 0).otherwise(first).cast("int")


def lcp_array(scratch: Scratch, places: DataFrame) -> DataFrame:
    """r, m, n (suffixes of this rank), first (the earliest of them) and lcp: lines in common with the entry before it, 0 for the first."""
    entries = places.groupBy("r").agg(
        F.max("m").alias("m"), F.count("*").alias("n"), F.min(F.struct(*KEY, "q")).alias("first"), F.any_value("ids").alias("ids"))
    dealt = scratch.save(entries.repartitionByRange("r").withColumn("_pid", F.spark_partition_id()))
    # the entry before a range's first is the last of the range before: one row per range
    ends = dealt.groupBy("_pid").agg(F.max_by("ids", "r").alias("_end"))
    ends = ends.select("_pid", F.lag("_end").over(Window.orderBy("_pid")).alias("_end"))
    prev = F.coalesce(F.lag("ids").over(Window.partitionBy("_pid").orderBy("r")), F.col("_end"))
    out = dealt.join(F.broadcast(ends), "_pid").withColumn("_prev", prev)
    out = scratch.save(out.select("r", "m", "n", "first", _common(F.col("ids"), F.col("_prev")).alias("lcp")))
    scratch.drop(dealt)
    return out


def lcp_intervals(scratch: Scratch, lcp: DataFrame) -> DataFrame:
    """r and first, the earliest member of its interval, for intervals of two or more members."""
    opens = lcp.withColumn("opens", (F.col("lcp") < F.col("m")).cast("int"))
    entries = scratch.save(global_rank(scratch, opens, ["r"], "opens", "before").select("r", "n", "first", (F.col("before") + F.col("opens")).alias("interval")))
    whole = entries.groupBy("interval").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n").hint("rebalance")
    return entries.select("r", "interval").join(whole, "interval").select("r", "first")


def repeated_runs(scratch: Scratch, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """KEY, lo, hi (raw lines, both included) of each shortest run that is a later copy."""
    places = suffix_array(scratch, docs, min_words)
    lcp = lcp_array(scratch, places)
    firsts = lcp_intervals(scratch, lcp).hint("rebalance")
    scratch.drop(lcp)
    return places.drop("m", "ids").join(firsts, "r").where(~F.col("first").eqNullSafe(F.struct(*KEY, "q"))).select(*KEY, "lo", "hi")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with text without later copies, n_lines and n_deleted (long). Columns named as a result are replaced; names that start with _ld_ are reserved."""
    scratch = Scratch(df.sparkSession, "line-dedup")
    keyed = lambda d: d.withColumn("_ld_id", F.col(key)).withColumn("_ld_th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    docs = keyed(df.select(key, text)).select(*KEY, F.col(text).alias("_ld_text"))
    runs = repeated_runs(scratch, docs, min_words)
    # starts and ends of a document's runs rise together, so gaps between neighbours are what stays
    gone = scratch.save(runs.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("_ld_gone"))
                        .withColumnsRenamed({"_ld_id": "_ld_gid", "_ld_th": "_ld_gth"}))
    kept = lambda x: F.filter(F.transform(
        F.concat(F.col("_ld_gone"), F.array(F.struct(F.size(x).alias("lo"), F.size(x).alias("hi")))),
        lambda g, i: F.struct(g["lo"].alias("lo"), F.coalesce(F.get(F.col("_ld_gone"), i - 1)["hi"] + 1, F.lit(0)).alias("from")),
    ), lambda s: s["lo"] > s["from"])
    # a run is gone where nothing of it is left between two neighbours
    lines = _lines(F.col(text))
    left = let(lines, lambda x: F.flatten(F.transform(kept(x), lambda s: F.slice(x, s["from"] + 1, s["lo"] - s["from"]))))
    rows = keyed(df)
    # sort-merge at every size: AQE splits a hot key, and no run of few copies turns into a broadcast that a larger one would not get
    out = rows.join(gone.hint("merge"), rows["_ld_id"].eqNullSafe(gone["_ld_gid"]) & (rows["_ld_th"] == gone["_ld_gth"]), "left")
    out = out.withColumn("_ld_left", F.when(F.col("_ld_gone").isNotNull(), left))
    out = out.withColumn("n_lines", F.size(lines).cast("long")).withColumn(
        "n_deleted", F.coalesce(F.col("n_lines") - F.size("_ld_left"), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.col("_ld_left").isNotNull(), F.array_join("_ld_left", "\n")).otherwise(F.col(text))).drop(
        *KEY, "_ld_gid", "_ld_gth", "_ld_gone", "_ld_left")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_deleted", "text")


def dedup_sql(docs: str = "documents", min_words: int = MIN_WORDS) -> str:
    """Plain SQL for the same texts: every shortest run spelled out, the first copy by window, lines taken out by place."""
    return rf"""
ld_d AS (SELECT doc_id, coalesce(text, '') AS t, text IS NULL AS was_null FROM {docs}),
ld_l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS raw FROM ld_d),
ld_w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY raw) AS q, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS wc
  FROM ld_l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ld_c AS (SELECT *, sum(wc) OVER (PARTITION BY doc_id, t ORDER BY raw) AS cum FROM ld_w),
ld_e AS (SELECT a.doc_id, a.t, a.q, a.raw AS lo, min(b.q) AS eq FROM ld_c a JOIN ld_c b ON a.doc_id = b.doc_id AND a.t = b.t AND b.q >= a.q
  AND b.cum - a.cum + a.wc >= {min_words} GROUP BY ALL),
ld_r AS (SELECT e.doc_id, e.t, e.q, e.lo, max(c.raw) AS hi, string_agg(c.line, chr(10) ORDER BY c.q) AS run
  FROM ld_e e JOIN ld_c c ON c.doc_id = e.doc_id AND c.t = e.t AND c.q BETWEEN e.q AND e.eq GROUP BY ALL),
ld_k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, q) AS copy FROM ld_r),
ld_g AS (SELECT DISTINCT l.doc_id, l.t, l.raw FROM ld_l l JOIN ld_k k ON l.doc_id = k.doc_id AND l.t = k.t AND k.copy > 1 AND l.raw BETWEEN k.lo AND k.hi),
ld_o AS (SELECT l.doc_id, l.t, count(*) AS n_lines, count(g.raw) AS n_deleted, coalesce(string_agg(l.line, chr(10) ORDER BY l.raw) FILTER (WHERE g.raw IS NULL), '') AS text
  FROM ld_l l LEFT JOIN ld_g g ON l.doc_id = g.doc_id AND l.t = g.t AND l.raw = g.raw GROUP BY l.doc_id, l.t)"""


ORACLE = rf"""
WITH {dedup_sql()}
SELECT o.doc_id, o.n_lines::BIGINT AS n_lines, o.n_deleted::BIGINT AS n_deleted, CASE WHEN d.was_null THEN NULL ELSE o.text END AS text
FROM ld_o o JOIN ld_d d ON o.doc_id = d.doc_id AND o.t = d.t
"""
