"""Streams of writes, traces and accesses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from layerframe.operators import overlay

COLUMNS = ["dev", "layer", "write_seq", "lo", "hi", "moff", "zeroed"]
KIND = "dev long, layer int, write_seq long, lo long, hi long, moff long, zeroed boolean"


def apply_batch(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The mappings after one more batch of writes."""
    rows = batch.select(COLUMNS)
    return overlay.insert_all(rows if state is None else state.select(COLUMNS).unionByName(rows)).select(COLUMNS)


def replay_in_batches(writes: DataFrame, n: int) -> DataFrame:
    """What a stream of n batches leaves behind; writes of one number come in one batch."""
    state = None
    for i in range(n):
        state = apply_batch(state, writes.where(F.col("write_seq") % n == i))
    return state


def stream_lww(writes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps a snapshot folder per batch under `table`; the newest one is the state, so a batch that runs again writes the same."""
    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{table}/v{epoch - 1}") if epoch else None
        apply_batch(old, batch).write.mode("overwrite").parquet(f"{table}/v{epoch}")

    return writes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A stripe of sectors is one piece of the bucketed state; writes are cut at stripes.
STRIPE = 1 << 16


def _versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """Batches that wrote each bucket, ascending: folder names, at most three a bucket."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/bucket=*/v=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    out: dict[int, list[int]] = {}
    for f in found:
        out.setdefault(int(f.getPath().getParent().getName().split("=")[1]), []).append(int(f.getPath().getName().split("=")[1]))
    return {b: sorted(v) for b, v in out.items()}


def _read(spark: SparkSession, newest: dict[int, int], table: str) -> DataFrame | None:
    paths = [f"{table}/bucket={b}/v={v}" for b, v in newest.items()]
    return spark.read.schema(KIND).parquet(*paths) if paths else None


def stream_lww_bucketed(writes: DataFrame, table: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """As stream_lww, but the state lies in buckets of (dev, stripe) and a batch rewrites only the buckets that its writes touch.

    A bucket keeps the version before its newest, which a batch that runs again starts from; older ones are deleted. bucketed_state reads it.
    """
    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        a, b = F.greatest("lo", F.col("bin") * STRIPE), F.least("hi", (F.col("bin") + 1) * STRIPE)
        cut = overlay.into_bins(batch.select(COLUMNS), width=STRIPE)
        cut = cut.select("dev", "layer", "write_seq", a.alias("lo"), b.alias("hi"), overlay.trimmed(F.col("moff"), a - F.col("lo"), F.col("zeroed")).alias("moff"), "zeroed")
        bucket = F.pmod(F.xxhash64("dev", F.floor(F.col("lo") / STRIPE)), F.lit(buckets)).cast("int")
        touched = [r[0] for r in cut.select(bucket).distinct().collect()]  # at most `buckets`
        held = {n: [v for v in vs if v < epoch] for n, vs in _versions(spark, table).items() if n in touched}
        old = _read(spark, {n: vs[-1] for n, vs in held.items() if vs}, table)
        new = apply_batch(old, cut).withColumns({"bucket": bucket, "v": F.lit(epoch)})
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(table)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for n, vs in held.items():
            for v in vs[:-1]:
                p = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/bucket={n}/v={v}")
                p.getFileSystem(conf).delete(p, True)

    return writes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucketed_state(spark: SparkSession, table: str) -> DataFrame:
    """The mappings after the last batch: the newest version of each bucket."""
    got = _read(spark, {n: vs[-1] for n, vs in _versions(spark, table).items()}, table)
    return spark.createDataFrame([], KIND) if got is None else got


def record_trace(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends successful full reads to a trace table."""
    from layerframe.operators.trace import record

    return record(reads).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics(reads: DataFrame, late: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """qps, bytes and slowest call per window of a stream; rows later than `late` are left out."""
    return reads.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(
        F.count("*").alias("qps"), F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0)).alias("throughput"), F.max("latency").alias("max_latency"))


def ttl_cache(accesses: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """(key, ts, hit) per access of a stream: a value lives ttl_seconds from the miss that stored it."""
    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else None
        for pdf in parts:
            rows = []
            for ts in sorted(pdf["ts"]):
                us = int(ts.value // 1000)
                hit = at is not None and us - at < ttl_seconds * 1_000_000
                at = at if hit else us
                rows.append((k[0], ts, hit))
            yield pd.DataFrame(rows, columns=[key, "ts", "hit"])
        state.update((at,))

    kind = accesses.schema[key].dataType.simpleString()
    return accesses.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, hit boolean", "at long", "append", GroupStateTimeout.NoTimeout)


def convert_files(spark: SparkSession, folder: str, out: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Converts binary files as they arrive in a folder; each batch is a Parquet folder batch=n of its own, so one that runs again writes the same. Spark's stream leaves out empty files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.writeStream.foreachBatch(lambda df, n: convert(df).write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
