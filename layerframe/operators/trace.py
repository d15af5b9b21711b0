"""Traces of reads, prefetch lists, metrics, and lookup tables of the service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.functions.scalars import blob_segments, segment_prefixes
from layerframe.plans.ordered import running_sum

MAX_IO = 1 << 20


def record(reads: DataFrame) -> DataFrame:
    """Trace rows of successful full reads (layer_index, offset, count, ret)."""
    return reads.where("ret = count").select(F.lit("R").alias("op"), "layer_index", "count", "offset")


def replayable(trace: DataFrame, layers: DataFrame, workers: int | None = None) -> DataFrame:
    """Reads of known layers, dealt to workers; others are skipped."""
    got = trace.where("op = 'R'").join(layers.select("layer_index").distinct(), "layer_index", "left_semi")
    return got.repartition(workers) if workers else got


def slices(extents: DataFrame, size: str = "size", most: int = MAX_IO, width: int = 1 << 32) -> DataFrame:
    """Extents (file, lo, len) of files with a size as reads of at most `most` bytes; a file's extents end at its size in whole sectors."""
    room = F.greatest(F.lit(0).cast("long"), F.ceil(F.col(size) / 512) * 512 - F.col("_before"))
    cut = running_sum(extents, ["file"], "lo", F.col("len"), width, "_before").withColumn("n", F.least(F.col("len"), room).cast("long")).where("n > 0")
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))))
    return cut.select("file", (F.col("lo") + F.col("at")).alias("offset"), F.least(F.lit(most), F.col("n") - F.col("at")).alias("count"))


def metrics(log: DataFrame, by: list[str], ts: str = "ts", window: str = "1 second") -> DataFrame:
    """qps, bytes and the slowest call per window; failed calls count as calls but move no bytes."""
    got = log.groupBy(F.window(ts, window).alias("w"), *by).agg(
        F.count("*").alias("qps"), F.coalesce(F.sum(F.when(F.col("ret") > 0, F.col("ret"))), F.lit(0)).cast("long").alias("throughput"), F.max("latency").alias("max_latency"))
    return got.select(F.col("w.start").alias("window_start"), *by, "qps", "throughput", "max_latency")


def exposition(rows: DataFrame, name: Column, labels: dict[str, Column], value: Column) -> DataFrame:
    """Lines of a text exposition: name{label="value",...} value."""
    text = F.concat_ws(",", *[F.format_string(f'{k}="%s"', v) for k, v in labels.items()])
    return rows.select(F.format_string("%s{%s} %s", name, text, value.cast("string")).alias("line"))


def credentials_for(urls: DataFrame, auths: DataFrame) -> DataFrame:
    """(url, addr) for each address of auths that is a prefix, by whole segments, of a blob url."""
    prefixes = urls.select("url", F.explode(segment_prefixes(blob_segments(F.col("url")))).alias("addr"))
    return prefixes.join(auths.select("addr").distinct(), "addr").select("url", "addr")


def ttl_hits(log: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """(key, ts, hit): whether an access finds a value not older than the ttl; a miss stores one. A fold over each key's accesses."""
    rows = log.groupBy(key).agg(F.array_sort(F.collect_list(F.col(ts).cast("timestamp"))).alias("a"))
    kind = "array<struct<ts:timestamp,hit:boolean>>"

    def step(s: Column, t: Column) -> Column:
        hit = s["at"].isNotNull() & (F.unix_micros(t) - F.unix_micros(s["at"]) < ttl_seconds * 1_000_000)
        return F.struct(F.when(hit, s["at"]).otherwise(t).alias("at"), F.array_append(s["out"], F.struct(t.alias("ts"), hit.alias("hit"))).cast(kind).alias("out"))

    zero = F.struct(F.lit(None).cast("timestamp").alias("at"), F.array().cast(kind).alias("out"))
    return rows.select(key, F.explode(F.aggregate("a", zero, step, lambda s: s["out"])).alias("x")).select(key, F.col("x.ts").alias(ts), "x.hit")


def first_candidate(found: DataFrame, order: dict[str, int]) -> DataFrame:
    """Per layer the local file that is tried first, else remote."""
    rank = F.lit(len(order))
    for k, v in order.items():
        rank = F.when(F.col("kind") == k, F.lit(v)).otherwise(rank)
    got = found.groupBy("layer").agg(F.min_by(F.when(F.col("present"), F.col("kind")), F.when(F.col("present"), rank)).alias("kind"))
    return got.withColumn("kind", F.coalesce("kind", F.lit("remote")))
