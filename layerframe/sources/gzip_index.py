"""Indexes into gzip streams as they are given: checkpoints at the ends of deflate blocks, kept in index files, and reads from them.

A checkpoint lies at any bit. A read puts blocks without output in front of it, so many bits long that the checkpoint keeps its place
inside a byte (stored blocks are aligned to bytes), and sets the 32 KiB before it as the decoder's dictionary. An index covers the
stream's first member; a file and its index are one value each.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from layerframe.functions import codecs
from layerframe.functions.checksums import extend

#: Fixed values of the index format: magic, the header's fields in their order, an entry's fields.
MAGIC = b"ddgzidx\0"
HEADER = struct.Struct("<8sBBBbBiiiqqqq256sqqI")
FIELDS = ("magic", "major", "minor", "algo", "level", "flag", "span", "window", "entry_size", "n", "gzip_size", "index_size", "raw_size", "reserved", "start", "area", "crc")
ENTRY = np.dtype([("de_pos", "<i8"), ("en_pos", "<i8"), ("win_pos", "<i8"), ("bits", "u1"), ("win_len", "<u4")])
WINDOW = 32768
#: Fixed values of deflate: extra bits and first values of length and distance codes, order of code lengths.
LENGTH_EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 0)
LENGTH_BASE = (3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258)
DISTANCE_EXTRA = tuple(max(0, c // 2 - 1) for c in range(30))
CODE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _prefix_table(sizes: list[int]) -> tuple[list, int]:
    """(table, mask): the next bits of a stream, masked, give (bits of the code, symbol); None where no code begins so."""
    top = max(sizes, default=0)
    table, code = [None] * (1 << top), 0
    for size in range(1, top + 1):
        for symbol, s in enumerate(sizes):
            if s == size:
                first = int(f"{code:0{size}b}"[::-1], 2)
                table[first :: 1 << size] = [(size, symbol)] * (1 << (top - size))
                code += 1
        code <<= 1
    return table, (1 << top) - 1


@functools.cache
def _fixed() -> tuple:
    return (*_prefix_table([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), *_prefix_table([5] * 30))


class _Bits:
    """A stream's bits from a position on."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def peek(self) -> int:
        """At least 57 bits; zeros behind the end."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        got = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("stream ends early")
        return got


def _dynamic(bits: _Bits) -> tuple:
    n_len, n_dist, n_code = 257 + bits.take(5), 1 + bits.take(5), 4 + bits.take(4)
    sizes = [0] * 19
    for i in CODE_ORDER[:n_code]:
        sizes[i] = bits.take(3)
    table, mask = _prefix_table(sizes)
    got: list[int] = []
    while len(got) < n_len + n_dist:
        size, symbol = table[bits.peek() & mask] or (0, -1)
        bits.take(size)
        if symbol < 0 or (symbol == 16 and not got):
            raise ValueError("not a code")
        if symbol < 16:
            got.append(symbol)
        else:
            got += {16: got[-1:], 17: [0], 18: [0]}[symbol] * ({16: 3, 17: 3, 18: 11}[symbol] + bits.take({16: 2, 17: 3, 18: 7}[symbol]))
    return (*_prefix_table(got[:n_len]), *_prefix_table(got[n_len:]))


def _body(bits: _Bits, tables: tuple) -> int:
    """Bytes that a block of codes stands for; the bits move behind it."""
    lengths, l_mask, distances, d_mask = tables
    data, at, made, end = bits.data, bits.at, 0, 8 * len(bits.data)
    while at < end:
        byte = at >> 3
        word = int.from_bytes(data[byte : byte + 8], "little") >> (at & 7)  # a symbol takes 48 bits at most
        size, symbol = lengths[word & l_mask] or (0, 286)
        if symbol < 256:
            made += 1
        elif symbol == 256:
            bits.at = at + size
            return made
        elif symbol > 285:
            raise ValueError("not a code")
        else:
            extra = LENGTH_EXTRA[symbol - 257]
            made += LENGTH_BASE[symbol - 257] + (word >> size & ((1 << extra) - 1))
            size += extra
            far, code = distances[word >> size & d_mask] or (0, 30)
            if code > 29:
                raise ValueError("not a distance")
            size += far + DISTANCE_EXTRA[code]
        at += size
    raise ValueError("stream ends early")


def header_length(data: bytes) -> int:
    """Bytes of a gzip member's header."""
    if data[:3] != b"\x1f\x8b\x08" or len(data) < 18:
        raise ValueError("not gzip")
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for name in (8, 16):
        if flags & name:
            at = data.index(b"\0", at) + 1
    return at + (2 if flags & 2 else 0)


def block_starts(data: bytes) -> np.ndarray:
    """(bit, output position) where each deflate block but the last begins."""
    bits, out, starts = _Bits(data, 8 * header_length(data)), 0, []
    while True:
        at = bits.at
        last, kind = bits.take(1), bits.take(2)
        if last:
            return np.array(starts, np.int64).reshape(-1, 2)
        starts.append((at, out))
        if kind == 0:
            bits.at = -(-bits.at // 8) * 8
            size = bits.take(16)
            bits.take(16)
            bits.at += 8 * size
            out += size
        elif kind == 3:
            raise ValueError("not a block")
        else:
            out += _body(bits, _fixed() if kind == 1 else _dynamic(bits))


def _thinned(starts: np.ndarray, span: int) -> np.ndarray:
    """At most about one start a span: those on a multiple of it, and the last one before a multiple that is passed without being hit."""
    starts = starts[np.append(starts[1:, 1] != starts[:-1, 1], True)[: len(starts)]]
    here = starts[:, 1]
    after = np.append(here[1:], -1)[: len(here)]
    target = (here // span + 1) * span
    return starts[(here % span == 0) | (after > target)]


def build(data: bytes, span: int = 1 << 20, level: int | None = 6) -> tuple[bytes, bytes]:
    """(index file, output) of a gzip stream. level: that of zlib for windows and entries; None stores them plainly."""
    inflater = zlib.decompressobj(31)
    raw = inflater.decompress(data)
    if not inflater.eof:
        raise ValueError("stream ends early")
    pack: Callable[[bytes], bytes] = (lambda b: b) if level is None else (lambda b: zlib.compress(b, level))
    kept = _thinned(block_starts(data), span)
    entries, windows, at = np.zeros(len(kept), ENTRY), [], HEADER.size
    entries["de_pos"], entries["en_pos"] = kept[:, 1], -(-kept[:, 0] // 8)
    entries["bits"] = entries["en_pos"] * 8 - kept[:, 0]
    for e in entries:
        window = pack(raw[max(0, e["de_pos"] - WINDOW) : e["de_pos"]].rjust(WINDOW, b"\0"))
        e["win_pos"], e["win_len"] = at, len(window)
        windows.append(window)
        at += len(window)
    area = pack(entries.tobytes())
    head = HEADER.pack(MAGIC, 1, 0, level is not None, level or 0, 0, span, WINDOW, ENTRY.itemsize, len(entries), len(data), at + len(area), len(raw), b"", at, len(area), 0)
    return head[:-4] + struct.pack("<I", extend(head[:-4])) + b"".join(windows) + area, raw


def parse(index: bytes | None, gzip_size: int) -> tuple[str, dict, np.ndarray]:
    """(status, header, entries): entries only where the status is ok."""
    none = np.zeros(0, ENTRY)
    if index is None or len(index) < HEADER.size:
        return "no header", {}, none
    head = dict(zip(FIELDS, HEADER.unpack_from(index), strict=True))
    wrong = {
        "wrong size": head["index_size"] != len(index),
        "wrong checksum": head["crc"] != extend(index[: HEADER.size - 4]),
        "wrong version": head["major"] != 1,
        "wrong entry size": head["entry_size"] != ENTRY.itemsize,
        "not an index": head["magic"] != MAGIC,
        "wrong area": head["start"] + head["area"] != len(index),
        "another stream": head["gzip_size"] != gzip_size,
        "unknown compression": head["algo"] not in (0, 1),
    }
    if any(wrong.values()):
        return next(s for s, bad in wrong.items() if bad), head, none
    area = index[head["start"] :]
    try:
        area = zlib.decompress(area) if head["algo"] else area
    except zlib.error:
        return "wrong entries", head, none
    if len(area) != head["n"] * ENTRY.itemsize:
        return "wrong entries", head, none
    return "ok", head, np.frombuffer(area, ENTRY)


@functools.cache
def _padding(shift: int) -> tuple[int, int]:
    """(bits, their number) of deflate blocks without output whose length leaves `shift` when divided by 8."""
    fields = []
    if shift % 2:  # one block with codes of its own, 93 bits: 256 symbols without a code, then two codes of one bit, and the end
        sizes = [(int(i in (1, 18)), 3) for i in CODE_ORDER]
        fields = [(0, 1), (2, 2), (0, 5), (0, 5), (15, 4), *sizes, (1, 1), (127, 7), (1, 1), (107, 7), (0, 1), (0, 1), (0, 1)]
    while sum(n for _, n in fields) % 8 != shift:
        fields += [(0, 1), (1, 2), (0, 7)]  # fixed codes and the end, 10 bits
    bits, at = 0, 0
    for value, n in fields:
        bits |= value << at
        at += n
    return bits, at


def read(data: bytes, index: bytes, head: dict, entries: np.ndarray, offset: int, count: int, chunk: int = 1 << 16) -> bytes:
    """A range of the output, decoded from the last checkpoint at or before the offset; short at the output's end."""
    count = min(count, head["raw_size"] - offset)
    if offset < 0 or count <= 0:
        return b""
    if len(entries):
        e = entries[max(0, int(np.searchsorted(entries["de_pos"], offset, "right")) - 1)]
        window = index[e["win_pos"] : int(e["win_pos"]) + int(e["win_len"])]
        bit, pos = 8 * int(e["en_pos"]) - int(e["bits"]), int(e["de_pos"])
        inflater = zlib.decompressobj(-15, zdict=zlib.decompress(window) if head["algo"] else window)
    else:
        bit, pos, inflater = 8 * header_length(data), 0, zlib.decompressobj(-15)
    byte, shift = bit >> 3, bit & 7
    ahead, n = _padding(shift)
    fed, got = (ahead | data[byte] >> shift << n).to_bytes((n + 8 - shift) // 8, "little"), bytearray()
    byte += 1
    while len(got) < count and not inflater.eof:
        out = inflater.decompress(fed, 1 << 20)
        skip = min(len(out), max(0, offset - pos))
        got += out[skip : skip + count - len(got)]
        pos += len(out)
        fed = inflater.unconsumed_tail
        if not fed and len(out) < 1 << 20:
            fed = data[byte : byte + chunk]
            byte += chunk
            if not fed:
                break
    return bytes(got)


def _built(data: bytes | None, span: int, level: int | None) -> tuple:
    if data is None:
        return "no data", None, None, None, None
    try:
        index, raw = build(bytes(data), span, level)
    except (ValueError, IndexError, zlib.error):
        return "not a gzip stream", None, None, None, None
    return "ok", index, HEADER.unpack_from(index)[FIELDS.index("n")], len(raw), "sha256:" + hashlib.sha256(raw).hexdigest()


def _piece(data: bytes | None, index: bytes | None, offset: int, count: int) -> tuple:
    if data is None:
        return "no data", None
    data, index = bytes(data), None if index is None else bytes(index)
    status, head, entries = parse(index, len(data))
    return status, read(data, index, head, entries, int(offset), int(count)) if status == "ok" else None


def build_indexes(files: DataFrame, span: int = 1 << 20, level: int | None = 6) -> DataFrame:
    """(file_id, data, status, index, n_points, raw_size, digest) of gzip streams (file_id, data), each decoded once.

    Bytes that are no whole gzip stream, and null, give their status and nulls.
    """
    made = ["status", "index", "n_points", "raw_size", "digest"]

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame([_built(b, span, level) for b in pdf["data"]], columns=made, index=pdf.index)
        return pd.concat([pdf, got.astype({"n_points": "Int64", "raw_size": "Int64"})], axis=1)

    kind = StructType.fromDDL("file_id long, data binary, status string, index binary, n_points long, raw_size long, digest string")
    # an index may be larger than its stream: a window a span
    return files.select("file_id", "data").mapInArrow(codecs.by_parts(add, kind, room=WINDOW), kind)


def checkpoints(files: DataFrame) -> DataFrame:
    """(file_id, status, de_pos, en_pos, bits, win_len) of index files (file_id, index, gzip_size); one row with nulls where an index is refused or empty."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for file_id, index, size in pdf.itertuples(index=False):
                status, _, entries = parse(None if index is None else bytes(index), size)
                got = pd.DataFrame({c: entries[c].astype(np.int64) for c in ("de_pos", "en_pos", "bits", "win_len")})
                got = got if len(got) else pd.DataFrame([(None,) * 4], columns=got.columns).astype("Int64")
                yield got.assign(file_id=file_id, status=status)[["file_id", "status", "de_pos", "en_pos", "bits", "win_len"]]

    return files.select("file_id", "index", "gzip_size").mapInPandas(run, "file_id long, status string, de_pos long, en_pos long, bits long, win_len long")


def read_ranges(reads: DataFrame) -> DataFrame:
    """Reads (data, index, offset, count, ...) answered through their indexes: status and piece take the place of data and index.

    Other columns stay, a status of the reads is replaced. No piece where an index is refused.
    """
    kept = reads.drop("data", "index", "status", "piece").schema.add("status", "string").add("piece", "binary")
    names = kept.names

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in parts for part in codecs.parts(whole, "index")):
            got = [_piece(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("data", "index", "offset", "count")), strict=True)]
            new = {"status": pa.array([s for s, _ in got], pa.string()), "piece": pa.array([p for _, p in got], pa.binary())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return reads.mapInArrow(run, kept)
