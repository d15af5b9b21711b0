"""Cache operators: what a read misses, what is evicted, where files lie in a cache's address space."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from layerframe.functions.scalars import align_down, align_up, basename
from layerframe.plans.ordered import islands, running_sum

from .overlay import into_bins

PAGE = 4096
REFILL = 1 << 20
#: Evictions that a task gathers into a batch.
EVICTIONS = 10_000


def merged_extents(extents: DataFrame, width: int = 1 << 22) -> DataFrame:
    """Touching cached extents (file, lo, hi) of a file as one."""
    got = islands(extents, ["file"], "lo", ["lo", "hi"], F.col("prev.hi") < F.col("lo"), width, ["hi"])
    return got.groupBy("file", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def miss_range(reads: DataFrame, extents: DataFrame, unit: int = REFILL, width: int = 1 << 20) -> DataFrame:
    """One range to fetch per read (file, req_id, offset, count): from the first to the last missing page, out to refill units; none on a hit.

    Only the extents that cover the read's two ends matter, so a read looks in two bins, however long it is.
    """
    r = reads.where("count > 0").withColumn("a", align_down(F.col("offset"), PAGE)).withColumn("b", align_up(F.col("offset") + F.col("count"), PAGE))
    ext = into_bins(merged_extents(extents), width=width).select("file", "bin", F.col("lo").alias("elo"), F.col("hi").alias("ehi"))
    left = r.withColumn("bin", F.floor(F.col("a") / width).cast("long")).join(ext, ["file", "bin"]).where("elo <= a AND a < ehi").select("file", "req_id", F.col("ehi").alias("_start"))
    right = r.withColumn("bin", F.floor((F.col("b") - 1) / width).cast("long")).join(ext, ["file", "bin"]).where("elo < b AND b <= ehi").select("file", "req_id", F.col("elo").alias("_stop"))
    out = r.join(left, ["file", "req_id"], "left").join(right, ["file", "req_id"], "left")
    out = out.withColumn("start", F.coalesce("_start", "a")).withColumn("stop", F.coalesce("_stop", "b"))
    lo, hi = align_down(F.col("start"), unit), align_up(F.col("stop"), unit)
    miss = F.col("start") < F.col("stop")
    return out.select("file", "req_id", F.when(miss, lo).otherwise(0).cast("long").alias("refill_offset"), F.when(miss, hi - lo).otherwise(0).cast("long").alias("refill_count"))


def evict_range(extents: DataFrame, holes: DataFrame) -> DataFrame:
    """Extents (file, lo, hi) without one evicted range per file (file, hole_lo, hole_hi)."""
    j = extents.join(holes, "file", "left")
    cut = F.filter(F.array(
        F.struct(F.col("lo").alias("lo"), F.least("hi", F.coalesce("hole_lo", "hi")).alias("hi")),
        F.struct(F.greatest("lo", F.coalesce("hole_hi", "hi")).alias("lo"), F.col("hi").alias("hi"))), lambda s: s["lo"] < s["hi"])
    return j.select("file", F.explode(cut).alias("s")).select("file", "s.*")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def evict_lru(log: DataFrame, pool: list[str], watermark: int) -> DataFrame:
    """Evictions of least recently used files, pool by pool, over an access log (pool, seq, file, len, open_count, and disk_short if it has one).

    An access moves its file to the front and sets its size to len; used bytes grow with a file and fall only when one is truncated. When they
    reach the watermark, or the disk lacks disk_short bytes, files go from the longest unused on (the file just written may be among them) until
    as many bytes are freed as the larger of the two asks for, at most all. A closed file is removed. An open one is truncated, moves to the front and
    stays. A pool is simulated in order: that is what LRU means; pools are independent, and a step costs what it evicts.
    """
    fields = [log.schema[p] for p in pool]
    kind = StructType([*fields, *StructType.fromDDL("seq long, victim string, freed long, kept_open boolean").fields])
    schema = to_arrow_schema(kind)
    if "disk_short" not in log.columns:
        log = log.withColumn("disk_short", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, out = None, 0, []
        size: OrderedDict[str, int] = OrderedDict()  # the longest unused first
        opened: dict[str, int] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here, (seq, file, now, count, short) = row[: len(pool)], row[len(pool) :]
                if here != key:
                    key, used = here, 0
                    size.clear()
                    opened.clear()
                used += max(0, int(now) - size.get(file, 0))
                size[file], opened[file] = int(now), int(count)
                size.move_to_end(file)
                left = min(max(used - watermark, int(short)), used)
                empty = 0  # open files without bytes that were passed since the last one with some
                while left > 0 and size and empty < len(size):
                    victim, held = next(iter(size.items()))
                    kept = opened[victim] > 0
                    if kept:
                        size.move_to_end(victim)
                        size[victim] = 0
                    else:
                        del size[victim], opened[victim]
                    empty = empty + 1 if kept and not held else 0
                    if held:
                        out.append((*here, seq, victim, held, kept))
                        used -= held
                        left -= held
                        if len(out) >= EVICTIONS:
                            yield _rows(out, schema)
                            out = []
        if out:
            yield _rows(out, schema)

    # in the order of accesses, batch by batch: no task holds a pool's log
    rows = log.select(*pool, "seq", "file", "len", "open_count", "disk_short").repartition(*pool).sortWithinPartitions(*pool, "seq", "file")
    return rows.mapInArrow(run, kind)


def prefetch_steps(ranges: DataFrame, step: int = 32 << 20) -> DataFrame:
    """Ranges (file, offset, count) in steps of at most `step` bytes."""
    at = F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("count") - 1, F.lit(step).cast("long")))
    return ranges.where("count > 0").withColumn("at", at).select("file", F.col("at").alias("offset"), F.least(F.lit(step), F.col("offset") + F.col("count") - F.col("at")).alias("count"))


def content_keys(files: DataFrame) -> DataFrame:
    """Files by content key, their last path element: equal digests share a store."""
    return files.withColumn("key", basename(F.col("path"))).groupBy("key").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))


def block_addresses(files: DataFrame, block: int, width: int = 4096) -> DataFrame:
    """blk_idx of each file (file, file_size): files lie one after the other in whole blocks."""
    return running_sum(files, [], "file", F.ceil(F.col("file_size") / block), width, "blk_idx")
