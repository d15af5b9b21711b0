"""A corpus pipeline of five stages over the documents table. Part of the llm subpackage.

Each stage is (spark, docs, sf_dir) -> DataFrame over everything its predecessor kept. All but the last return the
columns of documents.

- quality: rows that fail the base rules or the cascade go (op 3).
- lines: later copies of repeated runs of lines are deleted from the texts; a document of which nothing is left goes (op 8).
- near: of each group of near-duplicates the smallest id stays, a row without an id only if no other has one (op 5). Texts without words are no group.
- mix: documents get the words and repetitions that their source's target grants; those that get none go (op 2).
- encode: ids and decoded text of each document as digests (op 9).

The mix stage returns the columns of documents with a row for each repetition. Null, empty and very long texts, ties, repeated rows
and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerframe.llm import codec, line_dedup, mixing, ngram_join, quality_rules, token_file
from layerframe.llm.common import Scratch, split_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CORE = ["doc_id", "text", "source"]


def _core(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns that operators need, and all others in a struct that no operator's result can clash with."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in CORE]
    return docs.select(*CORE, *more, F.struct(*(rest or [F.lit(0).alias("none")])).alias("_row"))


def _back(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    return df.select(*[new.get(c, F.col(c) if c in CORE else F.col("_row")[c]).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(quality_rules.keep(_core(docs)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(_core(docs))
    out = out.where((F.col("n_deleted") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    size = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("_row")["n_chars"])
    return _back(out, docs, n_chars=size)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tag = F.xxhash64("text").alias("tag")  # tells rows with one id and different texts apart
    found = ngram_join.join(_core(docs, tag), tag="tag")
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("one")).select("one.doc_id", "one.tag")
    stays = first.union(found.where("group IS NULL").select("doc_id", "tag")).distinct().select(F.col("doc_id").alias("id"), F.col("tag").alias("is"))
    stays = Scratch(spark, "near").save(stays)
    rows = _core(docs, tag)
    kept = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("is")), "left_semi")
    return _back(kept.dropDuplicates(["doc_id", "tag"]), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = _core(docs, F.size(split_words(F.col("text"))).cast("bigint").alias("size"))
    mixed = mixing.mix(sized, "size").where("repeats > 0 AND size > 0")
    return _back(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return codec.encode(docs, token_file.tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near), ("mix sources", mix), ("BPE encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The last stage's ids come from a tokenizer that SQL does not have; tests hold run() against a brute-force version.
ORACLE_SQL = None
