import struct

import pandas as pd

from layerframe.functions.checksums import extend
from layerframe.sources import trace_file

ROWS = [("R", 3, 4096, 0), ("W", 1, 512, 1 << 40), ("R", 4294967295, 1, 7)]


def test_format():
    raw = trace_file.pack(pd.DataFrame(ROWS, columns=["op", "layer_index", "count", "offset"]))
    body = b"".join(struct.pack("<c3xIQq", o.encode(), i, n, at) for o, i, n, at in ROWS)
    assert raw == struct.pack("<I4xQI4x", 3270449184, len(body), extend(body)) + body
    status, rec = trace_file.parse(raw)
    assert status == "ok" and [(o.decode(), *r) for o, *r in rec.tolist()] == ROWS


def test_damage(spark):
    good = trace_file.pack(pd.DataFrame(ROWS, columns=["op", "layer_index", "count", "offset"]))
    empty = trace_file.pack(pd.DataFrame([], columns=["op", "layer_index", "count", "offset"]))
    files = [(0, good), (1, b"x" + good[1:]), (2, good[:-24]), (3, good[:30] + bytes([good[30] ^ 1]) + good[31:]), (4, None), (5, empty), (6, good[:10])]
    got = trace_file.load(spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in files], "file long, data binary")).collect()
    assert [(r["seq"], r["op"], r["layer_index"], r["count"], r["offset"]) for r in got if r["file"] == 0] == [(i, *r) for i, r in enumerate(ROWS)]
    rest = {r["file"]: r for r in got if r["file"]}
    assert {f: r["status"] for f, r in rest.items()} == {1: "not a trace", 2: "wrong size", 3: "wrong checksum", 4: "no header", 5: "ok", 6: "no header"}
    assert len(got) == 3 + len(rest) and all(r["seq"] is None and r["offset"] is None for r in rest.values())
