import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from layerframe.functions.checksums import extend
from layerframe.sources import gzip_index as gi


def _text(rng, n):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(300)]
    return " ".join(rng.choices(words, k=n // 5)).encode()


def _streams():
    rng = random.Random(7)
    noise = rng.randbytes(150_000)
    yield "words", _text(rng, 200_000), {"level": 6}
    yield "small blocks", _text(rng, 60_000), {"level": 6, "memLevel": 1}
    yield "fixed codes", _text(rng, 60_000), {"level": 6, "memLevel": 1, "strategy": zlib.Z_FIXED}
    yield "no matches", _text(rng, 60_000), {"level": 6, "memLevel": 1, "strategy": zlib.Z_HUFFMAN_ONLY}
    yield "runs", b"a" * 300_000 + b"b" * 7, {"level": 9, "memLevel": 1}
    yield "stored", noise, {"level": 0}
    yield "noise and words", noise[:70_000] + _text(rng, 100_000) + noise[70_000:], {"level": 6}
    yield "short", b"xyz", {"level": 6}
    yield "empty", b"", {"level": 6}


@pytest.mark.parametrize("name,raw,how", list(_streams()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("level", [None, 6])
def test_reads(name, raw, how, level):
    c = zlib.compressobj(wbits=31, **how)
    data = c.compress(raw) + c.flush()
    index, got = gi.build(data, 4096, level)
    status, head, entries = gi.parse(index, len(data))
    assert got == raw and status == "ok" and head["raw_size"] == len(raw)
    if how.get("memLevel") == 1:
        assert len(entries) > 3 and (len(raw) > 200_000 or len(set(entries["bits"].tolist())) > 2)
    rng = random.Random(3)
    for at in [0, 1, len(raw) // 2, max(0, len(raw) - 3), len(raw), len(raw) + 9, *[rng.randrange(len(raw) + 1) for _ in range(25)]]:
        n = rng.choice([1, 64, 5000, 1 << 20])
        assert gi.read(data, index, head, entries, at, n, rng.choice([7, 1000, 1 << 16])) == raw[at : at + n]


def test_every_start_decodes():
    """Each block start, thinned or not, is a place from which the rest decodes."""
    raw = _text(random.Random(1), 40_000)
    c = zlib.compressobj(6, zlib.DEFLATED, 31, 1)
    data = c.compress(raw) + c.flush()
    starts = gi.block_starts(data)
    assert len(starts) > 20 and tuple(starts[0]) == (80, 0)
    bits = int.from_bytes(data, "little")
    for bit, out in starts.tolist():
        rest = bits >> bit
        d = zlib.decompressobj(-15, zdict=raw[max(0, out - 32768) : out])
        assert d.decompress(rest.to_bytes(rest.bit_length() // 8 + 1, "little")) == raw[out:]


def test_padding():
    for shift in range(8):
        bits, n = gi._padding(shift)
        assert n % 8 == shift
        end = 0b011 << n  # a last block with fixed codes and no symbol
        assert zlib.decompressobj(-15).decompress((bits | end).to_bytes((n + 10 + 7) // 8, "little")) == b""


def test_thinning():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        at = np.unique(np.append(0, rng.integers(0, 3000, 60) // rng.choice([1, 25])))
        kept, last, expected = [], None, 0
        for p in at.tolist():  # a plain pass: the next multiple, and the last start below it
            if p > expected:
                if last is not None:
                    kept.append(last)
                expected = -(-p // 100) * 100
            last = p
            if p == expected:
                kept.append(p)
                last, expected = None, expected + 100
        assert gi._thinned(np.stack([at, at], 1), 100)[:, 1].tolist() == kept


def test_headers():
    raw = b"some text " * 50
    plain = gzip.compress(raw, mtime=0)
    named = plain[:3] + bytes([4 | 8 | 16 | 2]) + plain[4:10] + struct.pack("<H", 3) + b"abc" + b"name\0" + b"remark\0"
    named += struct.pack("<H", zlib.crc32(named) & 0xFFFF) + plain[10:]
    index, got = gi.build(named)
    assert got == raw and gi.read(named, index, *gi.parse(index, len(named))[1:], 13, 20) == raw[13:33]


def test_refused():
    data = gzip.compress(_text(random.Random(2), 300_000), mtime=0)
    index, _ = gi.build(data, 65536)

    def changed(field, value):
        head = list(gi.HEADER.unpack_from(index))
        head[gi.FIELDS.index(field)] = value
        raw = gi.HEADER.pack(*head)[:-4]
        return raw + struct.pack("<I", extend(raw)) + index[gi.HEADER.size :]

    cases = {"no header": index[:100], "wrong size": index + b"x", "wrong checksum": index[:20] + bytes([index[20] ^ 1]) + index[21:], "wrong version": changed("major", 2),
             "wrong entry size": changed("entry_size", 30), "not an index": changed("magic", b"other\0\0\0"), "wrong area": changed("start", 400), "another stream": changed("gzip_size", 1),
             "unknown compression": changed("algo", 3), "wrong entries": changed("n", 1 << 20)}
    assert {s: gi.parse(b, len(data))[0] for s, b in cases.items()} == {s: s for s in cases}
    assert gi.parse(None, 1)[0] == "no header" and gi.parse(index, len(data))[0] == "ok"


def test_frames(spark):
    raw = _text(random.Random(4), 100_000)
    good = gzip.compress(raw, mtime=0)
    rows = [(1, bytearray(good)), (2, bytearray(good[:-500])), (3, bytearray(b"plain text, not gzip at all")), (4, None), (5, bytearray(gzip.compress(b""))), (6, bytearray(b""))]
    files = spark.createDataFrame(rows, "file_id long, data binary")
    built = gi.build_indexes(files, 1 << 16)
    got = {r["file_id"]: r for r in built.collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "ok", 2: "not a gzip stream", 3: "not a gzip stream", 4: "no data", 5: "ok", 6: "not a gzip stream"}
    assert got[1]["digest"] == "sha256:" + hashlib.sha256(raw).hexdigest() and got[1]["raw_size"] == len(raw) and got[5]["raw_size"] == 0
    both = built.selectExpr("file_id", "data", "status", "index", "70000L AS offset", "10L AS count", "struct(file_id) AS extra")
    pieces = {r["file_id"]: (r["status"], r["piece"]) for r in gi.read_ranges(both).collect() if r["extra"]["file_id"] == r["file_id"]}
    assert pieces == {1: ("ok", bytearray(raw[70000:70010])), 2: ("no header", None), 3: ("no header", None), 4: ("no data", None), 5: ("ok", bytearray(b"")), 6: ("no header", None)}
    points = gi.checkpoints(both.selectExpr("file_id", "index", "length(data) AS gzip_size")).collect()
    assert sum(r["file_id"] == 1 for r in points) == got[1]["n_points"] and all(r["de_pos"] is None for r in points if r["file_id"] in (2, 4))
