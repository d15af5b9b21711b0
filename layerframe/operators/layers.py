"""Operators on whole layers: compaction, stacking, provenance, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerframe.plans.ordered import running_sum

from . import overlay

HEADER_SECTORS = 8
SECTOR = 512


def compact(index: DataFrame) -> DataFrame:
    """Live extents copied densely behind the header; zeroed ones take the place reached. Offsets only."""
    return overlay.running_offsets(index, ~F.col("zeroed"), HEADER_SECTORS)


def compact_warp(index: DataFrame, remote: Column) -> DataFrame:
    """As compact, but mappings of remote data keep where they point; only the rest is repacked."""
    out = overlay.running_offsets(index, ~F.col("zeroed") & ~remote, HEADER_SECTORS)
    return out.withColumn("new_moff", F.when(remote, F.col("moff")).otherwise(F.col("new_moff")))


def discard(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Appends discards (dev, layer, write_seq, lo, hi) to a write log as zeroed rows, split at the longest segment."""
    holes = ranges.withColumn("moff", F.lit(0).cast("long")).withColumn("zeroed", F.lit(True))
    return log.unionByName(overlay.split_long(holes).select(log.columns))


def append_writes(log: DataFrame, writes: DataFrame, width: int = 1 << 12) -> DataFrame:
    """Appends writes behind the data that their layer already holds: moff follows arrival order, write_seq."""
    held = log.groupBy(F.col("dev").alias("_dev"), F.col("layer").alias("_layer")).agg(F.max(F.col("moff") + F.col("hi") - F.col("lo")).alias("_end"))
    put = running_sum(writes, ["dev", "layer"], "write_seq", F.col("hi") - F.col("lo"), width, "_before")
    put = put.join(held, (F.col("dev") == F.col("_dev")) & (F.col("layer") == F.col("_layer")), "left")
    put = put.withColumn("moff", F.coalesce("_end", F.lit(HEADER_SECTORS)) + F.col("_before"))
    return log.unionByName(put.select(log.columns))


def sparse_mappings(ranges: DataFrame) -> DataFrame:
    """A sparse layer file stores each range at its own place, behind the header."""
    return ranges.withColumn("moff", F.col("lo") + HEADER_SECTORS)


def remote_mappings(remote: DataFrame) -> DataFrame:
    """Byte ranges (dev, offset, count, roffset) of remote data as segments of at most the longest length."""
    seg = remote.select("dev", (F.col("offset") / SECTOR).cast("long").alias("lo"), ((F.col("offset") + F.col("count")) / SECTOR).cast("long").alias("hi"), (F.col("roffset") / SECTOR).cast("long").alias("moff"), F.lit(False).alias("zeroed"))
    return overlay.split_long(seg).withColumn("source", F.lit("remoteData"))


def open_stack(layers: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged index, dev and virtual size): the size is that of the topmost layer that states one."""
    size = manifest.where("virtual_size > 0").groupBy("dev").agg(F.max_by("virtual_size", "layer").alias("virtual_size"))
    return overlay.flatten(layers), size


def restack(stack: DataFrame, top: DataFrame) -> DataFrame:
    """Seals the top and lays a fresh one over it: layers of the stack stay, the new top gets the next number."""
    return stack.unionByName(top.withColumn("layer", (F.col("layer") + 1).cast("int")).select(stack.columns))


def freeze(index: DataFrame, folder: str) -> DataFrame:
    """The index as it is now, read-only: written under `folder`, in the order of lookups inside each file, and read from there."""
    from layerframe.sources.layer_files import written

    return written(index.sortWithinPartitions("dev", "lo"), folder)


def merge(layers: DataFrame) -> DataFrame:
    """Many layers as one: flattened, coalesced offsets compacted, one layer number."""
    return compact(overlay.flatten(layers)).withColumn("moff", F.col("new_moff")).withColumn("layer", F.lit(0)).drop("new_moff")


def data_ranges(index: DataFrame, begin: int, end: int) -> DataFrame:
    """Ranges with a mapping inside [begin, end), zeroed ones included, with their kind."""
    got = index.where((F.col("lo") < end) & (F.col("hi") > begin))
    return got.select("dev", F.greatest("lo", F.lit(begin)).cast("long").alias("lo"), F.least("hi", F.lit(end)).cast("long").alias("hi"), F.when(F.col("zeroed"), "zero").otherwise("data").alias("kind"))


def live_statistics(log: DataFrame) -> DataFrame:
    """Bytes written, bytes still seen, and the share that is garbage."""
    total = log.groupBy("dev").agg(F.coalesce(F.sum(F.when(~F.col("zeroed"), F.col("hi") - F.col("lo"))), F.lit(0)).alias("_t"))
    live = overlay.allocated(overlay.flatten(log)).select("dev", F.col("sectors").alias("_v"))
    got = total.join(live, "dev", "left").select("dev", (F.col("_t") * SECTOR).cast("long").alias("total_bytes"), (F.coalesce("_v", F.lit(0)) * SECTOR).cast("long").alias("valid_bytes"))
    return got.withColumn("garbage_ratio", F.when(F.col("total_bytes") > 0, 1 - F.col("valid_bytes") / F.col("total_bytes")).otherwise(F.lit(0.0)))


def provenance(manifest: DataFrame) -> DataFrame:
    """Layers whose parent_uuid is not the uuid of the layer below."""
    w = Window.partitionBy("dev").orderBy("layer")  # at most MAX_LAYERS rows a device
    seen = manifest.withColumn("below_uuid", F.lag("uuid").over(w))
    return seen.where("below_uuid IS NOT NULL AND NOT (parent_uuid <=> below_uuid)").select("dev", "layer", "parent_uuid", "below_uuid")


def resize(index: DataFrame, sectors: int) -> DataFrame:
    """A smaller device: mappings end at its size, those behind it go."""
    return index.where(F.col("lo") < sectors).withColumn("hi", F.least("hi", F.lit(sectors).cast("long")))


def read_image(index: DataFrame, requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bytes of each request (dev, req_id, lo, hi): holes and zeroes as zeros, data by (dev, layer, sector) from blocks.

    blocks: dev, layer, sector, data (a sector of bytes); a short or missing sector is filled with zeros.
    """
    zero = F.unhex(F.repeat(F.lit("00"), SECTOR))
    seen = overlay.lookup(index, requests).where("NOT zeroed").select("dev", "req_id", "layer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi") - F.col("lo") - 1)).alias("_i"), "lo", "moff")
    data = seen.join(blocks, (seen["dev"] == blocks["dev"]) & (seen["layer"] == blocks["layer"]) & (seen["moff"] + seen["_i"] == blocks["sector"])).select(seen["dev"], "req_id", (F.col("lo") + F.col("_i")).alias("_s"), "data")
    every = requests.select("dev", "req_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("_s"))
    full = every.join(data, ["dev", "req_id", "_s"], "left").withColumn("data", F.substring(F.concat(F.coalesce("data", zero), zero), 1, SECTOR))
    got = full.groupBy("dev", "req_id").agg(F.array_sort(F.collect_list(F.struct("_s", F.hex("data").alias("h")))).alias("a"))
    return got.select("dev", "req_id", F.unhex(F.array_join(F.transform("a", lambda x: x["h"]), "")).alias("data"))
