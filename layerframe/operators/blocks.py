"""Fixed-block compression with an index of block lengths, and checkpoints into streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from layerframe.functions import checksums, codecs
from layerframe.plans.ordered import floor_join, running_sum, with_previous

HEADER = 512
CRC = 4
MOST_DELTA = 65535


def split_blocks(files: DataFrame, data: str = "data", block_size: int = 4096) -> DataFrame:
    """(file_id, block_id, data): whole blocks and a last short one; an empty file has none."""
    n = F.ceil(F.octet_length(data) / block_size).cast("int")
    ids = F.explode(F.sequence(F.lit(0), n - 1))
    rows = files.where(F.octet_length(data) > 0).withColumn("block_id", ids)
    return rows.select("file_id", F.col("block_id").cast("long").alias("block_id"), F.substring(F.col(data).cast("binary"), F.col("block_id") * block_size + 1, F.lit(block_size)).alias("data"))


def compress(blocks: DataFrame, algo: str = "lz4", verify: bool = True) -> DataFrame:
    """Adds raw_len, comp_len (with the sum, where there is one) and crc; data become compressed bytes."""
    kind = StructType.fromDDL("file_id long, block_id long, raw_len int, comp_len int, crc long, data binary")
    return blocks.mapInArrow(codecs.by_parts(lambda pdf: codecs.compress_frame(pdf, algo, verify), kind), kind)


def decompress(blocks: DataFrame, algo: str = "lz4", verify: bool = True) -> DataFrame:
    """Raw blocks; a block whose sum is wrong has ok = false and no data."""
    kind = StructType.fromDDL("file_id long, block_id long, ok boolean, data binary")
    return blocks.mapInArrow(codecs.by_parts(lambda pdf: codecs.decompress_frame(pdf, algo, verify), kind, room=4096), kind)


def validate(blocks: DataFrame) -> DataFrame:
    """Blocks whose stored sum differs from that of their bytes. A block without a sum is an error too."""
    kind = StructType([*blocks.schema.fields, StructField("actual", LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in codecs.parts(batch):
                data = part.column("data").to_pylist()
                found = pa.array(checksums.extend_many([b or b"" for b in data], checksums.SALT).astype("int64"), mask=np.array([b is None for b in data], bool))
                wrong = pc.fill_null(pc.not_equal(part.column("crc"), found), False)
                yield part.append_column("actual", found).filter(pc.or_(pc.is_null(part.column("crc")), wrong))

    return blocks.mapInArrow(sums, kind)


def join_blocks(blocks: DataFrame) -> DataFrame:
    got = blocks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("block_id", F.hex("data").alias("h")))).alias("a"))
    return got.select("file_id", F.unhex(F.array_join(F.transform("a", lambda x: x["h"]), "")).alias("data"))


def jump_table(lengths: DataFrame, begin: int = HEADER, width: int = 4096, block_size: int = 4096, least: int = CRC) -> DataFrame:
    """Adds offset, part_offset (of the block's group) and delta to (file_id, block_id, comp_len), and valid.

    A group has 65536 / block_size blocks. A block that is no longer than its sum, or a delta that does not fit 16 bits, is not valid.
    """
    group = 65536 // block_size
    out = running_sum(lengths, ["file_id"], "block_id", F.col("comp_len"), width, "offset").withColumn("offset", F.col("offset") + begin)
    w = Window.partitionBy("file_id", F.floor(F.col("block_id") / group))  # at most `group` blocks
    out = out.withColumn("part_offset", F.min("offset").over(w)).withColumn("delta", F.col("offset") - F.col("part_offset"))
    return out.withColumn("valid", (F.col("comp_len") > least) & (F.col("delta") < MOST_DELTA))


def touched_blocks(reads: DataFrame, sizes: DataFrame, block_size: int) -> DataFrame:
    """Blocks of each read (file_id, req_id, offset, count), and the part of each that is asked for; reads end at the file's end."""
    r = reads.join(sizes, "file_id").withColumn("stop", F.least(F.col("offset") + F.col("count"), "size")).where("offset >= 0 AND offset < stop")
    first, last = F.floor(F.col("offset") / block_size), F.floor((F.col("stop") - 1) / block_size)
    r = r.withColumn("block_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    lo = F.greatest("offset", F.col("block_id") * block_size)
    hi = F.least("stop", (F.col("block_id") + 1) * block_size)
    return r.select("file_id", "req_id", "block_id", (lo - F.col("block_id") * block_size).alias("skip"), (hi - lo).alias("take"))


def checkpoint_floor(reads: DataFrame, points: DataFrame, keys: list[str], width: int) -> DataFrame:
    """For each read the last checkpoint at or before its offset, or the first one."""
    return floor_join(reads, points, keys, "offset", "de_pos", ["en_pos"], width)


def thin(candidates: DataFrame, span: int, width: int) -> DataFrame:
    """Checkpoints that are kept, at most about one a span: candidates on a multiple of span, and the last candidate before a
    multiple that is passed without being hit. What follows the last passed multiple is not kept."""
    rows = candidates.withColumn("_neg", -F.col("de_pos"))
    nxt = with_previous(rows, ["file_id"], "_neg", ["de_pos"], width, name="nxt").withColumn("nxt", F.col("nxt.de_pos"))
    here, there = F.floor(F.col("de_pos") / span), F.floor(F.col("nxt") / span)
    passed = (there > here) & ~((F.col("nxt") == (here + 1) * span))
    return nxt.where((F.col("de_pos") % span == 0) | F.coalesce(passed, F.lit(False))).drop("_neg", "nxt")


def payload_offset(size: Column) -> Column:
    """Bytes in front of a tar-wrapped blob: one header, or three where its size needs an extended header."""
    return F.when(size >= 8 << 30, F.lit(3 * 512)).otherwise(F.lit(512))
