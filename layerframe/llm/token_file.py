"""Token files: ids packed into the minimum bits of the vocabulary, with block offsets for random access.

Layout of a shard (little-endian)::

    "LFTOK01\\n"                               8 bytes
    payload: blocks of BLOCK ids, each packed by itself at `bits` bits an id, low bits first, padded to a byte
    footer:  block offsets   u64 x (blocks + 1)   byte places in the file; the last is the end of the payload
             document ids    i64 x documents       0 where the id is null
             null ids        u8 x documents        1 where the id is null
             token starts    u64 x (documents + 1)  within the shard
    trailer: u64 x 6: bits, block size, ids, documents, blocks, byte place of the footer

Every block but the last has the same size, so id i lies in block i // BLOCK, at a known place. A block is unpacked by
numpy without a loop. Shards are written to a name of the attempt and renamed: a task that is run again replaces
an equal file, and readers never see part of one. Paths are opened through pyarrow.fs, so any store that it knows will do.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, shared_dir

MAGIC = b"LFTOK01\n"
BLOCK = 1 << 16
#: The id that ends each document in the query.
END = 1


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """n ids (u32) of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    at = np.arange(n, dtype=np.int64) * bits
    held = np.frombuffer(raw + bytes(8), np.uint8)
    byte = at >> 3
    word = np.zeros(n, np.uint64)
    for k in range((bits + 7 + 7) // 8):  # the bytes that an id can touch
        word |= held[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


@functools.lru_cache(maxsize=8)
def _store(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else "file://" + uri)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return _store(folder)


class ShardWriter:
    def __init__(self, folder: str, name: str, bits: int, block: int = BLOCK):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temp = f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.bits, self.block, self.place = bits, block, len(MAGIC)
        self.offsets, self.docs, self.starts, self.wait, self.waiting, self.n = [], [], [0], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            held = np.concatenate(self.wait)
            whole = len(held) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(held[i : i + self.block])
            self.wait, self.waiting = [held[whole:]], len(held) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.place)
        self.place += len(raw)
        self.out.write(raw)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.wait))
        footer = np.array([*self.offsets, self.place], "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array([d is None for d in self.docs], "u1").tobytes() + np.array(self.starts, "<u8").tobytes()
        trailer = np.array([self.bits, self.block, self.n, len(self.docs), len(self.offsets), self.place], "<u8").tobytes()
        self.out.write(footer + trailer)
        self.out.close()
        self.fs.move(self.temp, self.final)


class Shard:
    """Random access to a shard: reads the footer, and then only the blocks that a range of ids touches."""

    def __init__(self, folder: str, name: str):
        fs, base = _open(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        end = np.frombuffer(self.file.read_at(48, size - 48), "<u8").astype(int).tolist()
        self.bits, self.block, self.n, docs, blocks, foot = end
        raw = self.file.read_at(size - 48 - foot, foot)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{name} is not a token file")
        a = 8 * (blocks + 1)
        self.offsets = np.frombuffer(raw[:a], "<u8").astype(np.int64)
        self.docs = np.frombuffer(raw[a : a + 8 * docs], "<i8")
        self.null = np.frombuffer(raw[a + 8 * docs : a + 9 * docs], "u1").astype(bool)
        self.starts = np.frombuffer(raw[a + 9 * docs :], "<u8").astype(np.int64)
        self._at, self._ids = -1, np.empty(0, "<u4")

    def _load(self, k: int) -> np.ndarray:
        if k != self._at:
            a, b = self.offsets[k], self.offsets[k + 1]
            self._ids = unpack(self.file.read_at(int(b - a), int(a)), self.bits, min(self.block, self.n - k * self.block))
            self._at = k
        return self._ids

    def runs(self, lo: int, hi: int) -> Iterator[np.ndarray]:
        """The ids of [lo, hi), block by block."""
        while lo < hi:
            k = lo // self.block
            stop = min(hi, (k + 1) * self.block)
            yield self._load(k)[lo - k * self.block : stop - k * self.block]
            lo = stop

    def ids(self, lo: int, hi: int) -> np.ndarray:
        return np.concatenate([np.empty(0, "<u4"), *self.runs(lo, hi)])

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.file.close()


MANIFEST = "shard long, name string, n_docs long, n_tokens long"


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end: int | None = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text and writes shards in ascending order of key. Returns the manifest, one row per shard.

    A null text is empty. Null keys come first and stay null. Equal keys lie side by side in an order that their texts fix; a key
    with many rows (or none with many) is dealt out by the texts' hashes. An empty table has no shards. Texts of any length are
    encoded whole; a shard's writer holds one block at a time. Other columns are left out. What is shuffled are texts:
    compressed, ids of two bytes came to 0.96 x input on the check tables and texts to 1.10, and ids would have to be written first.
    """
    vocabulary = max(bpe.vocabulary(tokenizer), (end or 0) + 1)
    bits = bits_for(vocabulary)
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = TaskContext.get().partitionId(), None
        name = f"shard-{shard:08d}.tok"
        with bpe.at_rest(bpe.piece_encoder(tokenizer)) as encoder:
            tail = np.array([] if end is None else [end], encoder.dtype if vocabulary <= 1 << 16 else "<u4")
            for batch in batches:
                if batch.num_rows:
                    out = out or ShardWriter(folder, name, bits)
                keys = batch.column(0).to_pylist()
                for at, part in bpe.slices(batch.column(1)):
                    for i, raw in enumerate(encoder.encode(part), at):
                        out.add(keys[i], np.concatenate([np.frombuffer(raw, encoder.dtype), tail]))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [len(out.docs)], "n_tokens": [out.n]})

    return Scratch(df.sparkSession, "token-manifest").save(rows.mapInArrow(write, MANIFEST))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id (null as written), start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["name"])
                crcs = []
                for lo, hi in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True):
                    crc = 0
                    for run in shard.runs(lo, hi):
                        crc = zlib.crc32(np.ascontiguousarray(run, "<u4"), crc)
                    crcs.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.docs, pa.int64(), mask=shard.null), pa.array(shard.starts[:-1] + row["base"], pa.int64()),
                     pa.array(np.diff(shard.starts), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    return read_tokens(write_tokens(docs, folder, tokenizer_path()), folder)
