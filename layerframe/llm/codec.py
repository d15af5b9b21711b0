"""BPE encoding and decoding of every document by content-defined chunk reuse (see bpe.ChunkEncoder).

Defined results: a null text is the empty text, with no ids; texts of any length are encoded whole; equal texts get
equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .token_file import tokenizer_path


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """key, n_tokens and the digests of ids and decoded text; with full also ids (decimal, spaced) and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        with bpe.at_rest(bpe.chunk_encoder(tokenizer)) as encoder:
            for batch in batches:
                for at, part in bpe.slices(batch.column(1)):
                    out = encoder.encode(part)
                    cols = [batch.column(0).slice(at, len(part)), pa.array([x[0] for x in out], pa.int64()),
                            pa.array([sha(x[1]) for x in out]), pa.array([sha(x[2]) for x in out])]
                    names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if full:
                        cols += [pa.array([x[1] for x in out]), pa.array([x[2] for x in out])]
                        names += ["ids", "decoded"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[key].dataType.simpleString()
    more = ", ids string, decoded string" if full else ""
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("k", key)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
