"""Tar archives as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 512
SCHEMA = ("layer int, seq long, path string, typeflag string, mode int, uid int, gid int, size long, mtime long, linkname string, pax map<string,string>, data_offset long")


def parse_pax(raw: bytes) -> dict[str, str]:
    """Records `length key=value\\n`; a malformed one is an error."""
    out, at = {}, 0
    while at < len(raw):
        head, _, _ = raw[at:].partition(b" ")
        if not head.isdigit() or int(head) < 5:
            raise ValueError("malformed extended header")
        record = raw[at + len(head) + 1 : at + int(head) - 1]
        key, eq, value = record.partition(b"=")
        if not eq:
            raise ValueError("malformed extended header")
        out[key.decode()] = value.decode("utf-8", "replace")
        at += int(head)
    return out


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _octal(raw: bytes) -> int:
    digits = raw.split(b"\0", 1)[0].strip()
    return int(digits, 8) if digits else 0


def checksum_ok(head: bytes) -> bool:
    """The stored sum as unsigned or signed bytes, with its own field as blanks."""
    blank = head[:148] + b" " * 8 + head[156:]
    return _octal(head[148:156]) in (sum(blank), sum(b - 256 if b > 127 else b for b in blank))


def entries(data: bytes) -> Iterator[dict]:
    """Entries in order; two zero blocks end the archive; long names and extended headers belong to the next entry; global ones are ignored."""
    at, pax, long_name, long_link = 0, {}, None, None
    while at + BLOCK <= len(data):
        head = data[at : at + BLOCK]
        if head == bytes(BLOCK):
            if data[at + BLOCK : at + 2 * BLOCK].strip(b"\0") == b"":
                return
            at += BLOCK
            continue
        if not checksum_ok(head):
            raise ValueError(f"wrong header sum at {at}")
        flag, size = head[156:157].decode("latin-1"), _octal(head[124:136])
        body = data[at + BLOCK : at + BLOCK + size]
        step = BLOCK + -(-size // BLOCK) * BLOCK
        if flag in "xgLK":
            if flag == "x":
                pax = parse_pax(body)
            elif flag == "L":
                long_name = _text(body)
            elif flag == "K":
                long_link = _text(body)
            at += step
            continue
        size = int(pax.get("size", size))
        prefix = _text(head[345:500]) if head[257:262] == b"ustar" else ""
        name = _text(head[:100])
        yield {
            "path": pax.get("path") or long_name or (f"{prefix}/{name}" if prefix else name), "typeflag": flag, "mode": _octal(head[100:108]), "uid": _octal(head[108:116]), "gid": _octal(head[116:124]),
            "size": size, "mtime": _octal(head[136:148]), "linkname": pax.get("linkpath") or long_link or _text(head[157:257]), "pax": pax, "data_offset": at + BLOCK}
        pax, long_name, long_link = {}, None, None
        at += BLOCK + (-(-size // BLOCK) * BLOCK if flag in "0\0" else 0)


def read(files: DataFrame) -> DataFrame:
    """Entries of archives given as (layer, data)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for layer, data in pdf[["layer", "data"]].itertuples(index=False):
                rows = [{"layer": layer, "seq": i, **e} for i, e in enumerate(entries(bytes(data)))]
                if rows:
                    yield pd.DataFrame(rows)[names]

    return files.select("layer", "data").mapInPandas(run, SCHEMA)
