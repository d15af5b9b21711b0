"""Compressed streams: whole and random reads, detection, digests."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from layerframe.functions import codecs


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, data) of binary files; kind by their first bytes."""
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("string")
    def kind(data: pd.Series) -> pd.Series:
        return data.map(lambda b: codecs.detect(bytes(b[:512])))

    return files.select("path", "length", kind("content").alias("kind"), F.col("content").alias("data"))


def inflate(files: DataFrame) -> DataFrame:
    """(file_id, data, digest) of gzip and zstd streams, frame after frame; other bytes stay as they are."""
    def plain(data: bytes) -> bytes:
        kind = codecs.detect(data[:512])
        if kind == "gzip":
            return codecs.gzip_read(data, 0, 1 << 62)
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        return data

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            data = [plain(bytes(b)) for b in pdf["data"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "data": data, "digest": ["sha256:" + hashlib.sha256(b).hexdigest() for b in data]})

    return files.select("file_id", "data").mapInPandas(run, "file_id long, data binary, digest string")


def gzip_streams(files: DataFrame, level: int = 6, memory: int = 8) -> DataFrame:
    """(file_id, data) as gzip streams; the less memory, the shorter their deflate blocks. Null stays null."""
    kind = StructType.fromDDL("file_id long, data binary")
    made = lambda pdf: pd.DataFrame({"file_id": pdf["file_id"], "data": [None if b is None else codecs.gzip_stream(bytes(b), level, memory) for b in pdf["data"]]})
    return files.select("file_id", "data").mapInArrow(codecs.by_parts(made, kind), kind)
