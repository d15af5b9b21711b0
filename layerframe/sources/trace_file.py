"""Trace files: a header with a checksum, then records of reads. A damaged file gives no record at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from layerframe.functions.checksums import extend_many

#: Fixed values of the format.
MAGIC = 3270449184
RECORD = np.dtype({"names": ["op", "layer_index", "count", "offset"], "formats": ["S1", "<u4", "<u8", "<i8"], "offsets": [0, 4, 8, 16], "itemsize": 24})
HEAD = np.dtype({"names": ["magic", "size", "checksum"], "formats": ["<u4", "<u8", "<u4"], "offsets": [0, 8, 16], "itemsize": 24})
FIELDS = "op string, layer_index long, count long, offset long"


def pack(rows: pd.DataFrame) -> bytes:
    """One trace file of rows (op, layer_index, count, offset) in their order."""
    body = np.zeros(len(rows), RECORD)
    for c in RECORD.names:
        body[c] = rows[c].to_numpy("S1" if c == "op" else np.int64)
    raw = body.tobytes()
    head = np.zeros(1, HEAD)
    head["magic"], head["size"], head["checksum"] = MAGIC, len(raw), extend_many([raw])[0]
    return head.tobytes() + raw


def parse(data: bytes | None) -> tuple[str, np.ndarray]:
    """(status, records): records only where the status is ok."""
    none = np.zeros(0, RECORD)
    if data is None or len(data) < HEAD.itemsize:
        return "no header", none
    head = np.frombuffer(data[: HEAD.itemsize], HEAD)[0]
    if head["magic"] != MAGIC:
        return "not a trace", none
    raw = data[HEAD.itemsize :]
    if int(head["size"]) != len(raw) or len(raw) % RECORD.itemsize:
        return "wrong size", none
    if extend_many([raw])[0] != head["checksum"]:
        return "wrong checksum", none
    return "ok", np.frombuffer(raw, RECORD)


def dump(records: DataFrame) -> DataFrame:
    """(file, data): a trace file per file of records (file, seq, op, layer_index, count, offset), in the order of seq.

    A trace is one value: the reads of one container's start, in one task.
    """
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"file": [key[0]], "data": [pack(rows.sort_values(["seq", "offset", "count", "layer_index", "op"]))]})

    return records.select("file", "seq", "op", "layer_index", "count", "offset").groupBy("file").applyInPandas(run, "file long, data binary")


def load(files: DataFrame) -> DataFrame:
    """(file, status, seq, op, layer_index, count, offset) of files (file, data); seq counts from 0.

    A file that is damaged, or holds no record, gives one row with its status and nulls.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for file, data in pdf.itertuples(index=False):
                status, rec = parse(None if data is None else bytes(data))
                got = pd.DataFrame({"seq": np.arange(len(rec)), "op": [o.decode("latin-1") for o in rec["op"].tolist()], **{c: rec[c].astype(np.int64) for c in RECORD.names[1:]}})
                if not len(got):
                    got = pd.DataFrame([(None,) * 5], columns=got.columns).astype({c: "Int64" for c in got.columns if c != "op"})
                yield got.assign(file=file, status=status)[["file", "status", "seq", "op", "layer_index", "count", "offset"]]

    return files.select("file", "data").mapInPandas(run, f"file long, status string, seq long, {FIELDS}")
