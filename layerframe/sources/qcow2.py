"""Cluster maps of disk images, partition tables, and the remap of clusters to the chosen partitions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of the format.
MAGIC = b"QFI\xfb"
COPIED, COMPRESSED, ZERO = 1 << 63, 1 << 62, 1
OFFSET_MASK = 0x00FFFFFFFFFFFE00


def clusters(data: bytes) -> Iterator[dict]:
    """One row per guest cluster, from the two table levels. Images with a backing file or unknown features are refused."""
    magic, version, backing, _, bits, size, crypt, l1_size, l1_at = struct.unpack_from(">4sIQIIQIIQ", data)
    if magic != MAGIC or version not in (2, 3):
        raise ValueError("not a supported image")
    incompatible = struct.unpack_from(">Q", data, 72)[0] if version == 3 else 0
    if backing or crypt or incompatible & ~3:
        raise ValueError("unsupported feature")
    cluster = 1 << bits
    per_table = cluster // 8
    for n in range(-(-size // cluster)):
        row = {"logical_offset": n * cluster, "physical_offset": 0, "cluster_size": cluster, "is_zero": False, "is_unallocated": True, "is_compressed": False, "compressed_size": 0}
        i, j = divmod(n, per_table)
        table = struct.unpack_from(">Q", data, l1_at + 8 * i)[0] & OFFSET_MASK if i < l1_size else 0
        entry = struct.unpack_from(">Q", data, table + 8 * j)[0] if table else 0
        if entry & COMPRESSED:
            shift = 62 - (bits - 8)
            at = entry & ((1 << shift) - 1)
            sectors = ((entry & (COMPRESSED - 1)) >> shift) + 1
            row |= {"physical_offset": at, "is_unallocated": False, "is_compressed": True, "compressed_size": sectors * 512 - at % 512}
        elif version == 3 and entry & ZERO:
            row |= {"is_zero": True, "is_unallocated": False}
        elif entry & OFFSET_MASK:
            row |= {"physical_offset": entry & OFFSET_MASK, "is_unallocated": False}
        yield row


def read_clusters(images: DataFrame) -> DataFrame:
    """(file_id, status, clusters' fields) of disk images (file_id, data), a row per guest cluster; an image that is refused gives one row with nulls."""
    names = ["logical_offset", "physical_offset", "cluster_size", "is_zero", "is_unallocated", "is_compressed", "compressed_size"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for file_id, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                status, rows = _checked(data)
                for at in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_pylist([{"file_id": file_id, "status": status, **r} for r in rows[at : at + (1 << 16)]], schema=to_arrow_schema(schema))

    schema = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("status", T.StringType())])
    for c in names:
        schema = schema.add(c, T.BooleanType() if c.startswith("is_") else T.LongType())
    return images.select("file_id", "data").mapInArrow(run, schema)


def _checked(data: bytes | None) -> tuple[str, list[dict]]:
    if data is None:
        return "no data", [{}]
    try:
        return "ok", list(clusters(bytes(data)))
    except (ValueError, struct.error) as e:
        return str(e) if isinstance(e, ValueError) else "not a whole image", [{}]


def cluster_data(data: bytes, row: dict) -> bytes:
    """Bytes of a cluster; unallocated and zero ones are zeros."""
    if row["is_unallocated"] or row["is_zero"]:
        return bytes(row["cluster_size"])
    at = row["physical_offset"]
    if row["is_compressed"]:
        return zlib.decompressobj(-15).decompress(data[at : at + row["compressed_size"]], row["cluster_size"]).ljust(row["cluster_size"], b"\0")
    return data[at : at + row["cluster_size"]]


def pack(raw: bytes, bits: int = 9) -> bytes:
    """An image of version 3: clusters of zeros are marked or (every other one) left out, others are deflated where that is shorter."""
    size = 1 << bits
    per, n = size // 8, -(-len(raw) // size)
    n_tables = -(-n // per)
    l2_at = size * (1 + -(-8 * n_tables // size))
    body, entries = bytearray(l2_at + n_tables * size), [0] * (n_tables * per)
    for i in range(n):
        part = raw[i * size : (i + 1) * size].ljust(size, b"\0")
        if not any(part):
            entries[i] = ZERO if i % 2 else 0
            continue
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        packed = c.compress(part) + c.flush()
        if len(packed) < size:
            sectors = (len(body) % 512 + len(packed) - 1) // 512
            entries[i] = COMPRESSED | sectors << (62 - (bits - 8)) | len(body)
            body += packed
        else:
            body += bytes(-len(body) % size)
            entries[i] = COPIED | len(body)
            body += part
    body += bytes(-len(body) % size)
    struct.pack_into(">4sIQIIQIIQ", body, 0, MAGIC, 3, 0, 0, bits, len(raw), 0, n_tables, size)
    struct.pack_into(">I", body, 100, 104)
    struct.pack_into(f">{n_tables}Q", body, size, *[COPIED | l2_at + i * size for i in range(n_tables)])
    struct.pack_into(f">{len(entries)}Q", body, l2_at, *entries)
    return bytes(body)


def read_images(images: DataFrame) -> DataFrame:
    """(file_id, status, data) with the guest's bytes of disk images (file_id, data), whole clusters; null where an image is refused."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, files = (c.to_pylist() for c in batch.columns)
            got = [_checked(b) for b in files]
            data = [b"".join(cluster_data(b, r) for r in rows) if status == "ok" else None for b, (status, rows) in zip(files, got, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s for s, _ in got], pa.string()), pa.array(data, pa.binary())], ["file_id", "status", "data"])

    return images.select("file_id", "data").mapInArrow(run, "file_id long, status string, data binary")


def partitions(disk: bytes) -> list[dict]:
    """Primary partitions of an MBR, or the entries of a GPT behind a protective one, in sectors."""
    if disk[510:512] != b"\x55\xaa":
        return []
    out = []
    for i in range(4):
        kind, lo, n = struct.unpack_from("<4xB3xII", disk, 446 + 16 * i)
        if kind == 0xEE and disk[512:520] == b"EFI PART":
            at, count, size = struct.unpack_from("<QII", disk, 512 + 72)
            for k in range(count):
                e = disk[at * 512 + k * size : at * 512 + (k + 1) * size]
                if len(e) >= 48 and e[:16] != bytes(16):
                    a, b = struct.unpack_from("<QQ", e, 32)
                    out.append({"number": k + 1, "lo": a, "hi": b + 1})
            return out
        if kind and n:
            out.append({"number": i + 1, "lo": lo, "hi": lo + n})
    return out


def filesystem(part: bytes) -> str:
    """Kind of a file system by its magic."""
    if part[1080:1082] == b"\x53\xef":
        return "ext"
    if part[:4] == b"XFSB":
        return "xfs"
    if part[65600:65608] == b"_BHRfS_M":
        return "btrfs"
    if part[1024:1028] == b"\x10\x20\xf5\xf2":
        return "f2fs"
    return "unknown"


def kind_counts(rows: DataFrame) -> DataFrame:
    """Clusters and bytes by what a copy does with them."""
    kind = F.when(F.col("is_unallocated"), "unallocated").when(F.col("is_zero"), "zero").otherwise("data")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("cluster_size").cast("long").alias("bytes"))


def remap(ranges: DataFrame, parts: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Ranges (id, lo, hi) inside partitions (part, lo, hi, no overlaps), clipped, with their place when partitions lie densely."""
    from layerframe.operators.overlay import into_bins

    before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # a partition table has at most 128 entries
    base = parts.withColumn("base", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(before), F.lit(0)))
    p = into_bins(base, width=width).select("part", "bin", "base", F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    r = into_bins(ranges, width=width)
    a, b = F.greatest("lo", "plo"), F.least("hi", "phi")
    hit = r.join(p, "bin").where((a < b) & (F.floor(a / width) == F.col("bin")))
    return hit.select("id", "part", a.alias("lo"), b.alias("hi"), (F.col("base") + a - F.col("plo")).cast("long").alias("target"), ((F.col("lo") < F.col("plo")) | (F.col("hi") > F.col("phi"))).alias("clipped"))
