"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total by its weight. Sources whose share lies above max_epochs times their size are
clamped there and the excess goes to the others by weight, until no share is above its cap. A source is then taken in
whole epochs plus a seeded fraction: its documents in the order of md5(seed, id) until the rest is filled.

Defined results: a null text has size 0; the null source is a source of its own, last by name; a source of size 0 has target 0;
repeated rows are taken or left one by one in the order of their hash and then their text; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, global_rank, split_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
#: Leading hex digits of the md5 that make a bucket: sums per (source, bucket) locate the place where a fraction ends.
BUCKET_DIGITS = 3


def water_fill(scratch: Scratch, sources: DataFrame, total: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target (double) to sources(source, source_size long, weight long). Only sums reach the driver."""
    held = sources.withColumn("clamped", F.col("source_size") == 0)
    while True:
        s = held.agg(
            F.coalesce(F.sum(F.when(F.col("clamped"), F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("weight"))), F.lit(0)),
            F.count(F.when(F.col("clamped"), 1)),
        ).first()
        free, weights = total - max_epochs * int(s[0]), int(s[1])
        over = F.lit(max_epochs).cast("decimal(38,0)") * F.col("source_size") * F.lit(weights) < F.col("weight").cast("decimal(20,0)") * F.lit(free)
        nxt = held.withColumn("clamped", F.col("clamped") | over)
        if not weights or nxt.where("clamped").count() == s[2]:
            break
        held = scratch.save(nxt)
    share = (F.col("weight") * F.lit(free)).cast("double") / F.lit(float(weights or 1))
    return held.withColumn("target", F.when(F.col("clamped"), (max_epochs * F.col("source_size")).cast("double")).otherwise(share)).drop("clamped")


def mix(df: DataFrame, size: str, source: str = "source", key: str = "doc_id", tie: list[str] | None = None,
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """df (with a long size column) plus source_size, target and repeats (int, 0 to max_epochs).

    `key` names a row for the seeded order; equal keys are told apart by the `tie` columns and else taken in any order
    (they are then equal rows). Extra columns pass through; those named as a result are replaced; names that start with _mix_ are reserved.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    ids = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    rows = df.withColumn("_mix_h", ids).withColumn("_mix_b", F.substring("_mix_h", 1, BUCKET_DIGITS))
    buckets = scratch.save(rows.groupBy(F.col(source).alias("_mix_s"), "_mix_b").agg(F.sum(size).alias("n")))
    named = buckets.groupBy("_mix_s").agg(F.sum("n").alias("source_size"))
    named = named.withColumn("_mix_null", F.col("_mix_s").isNull()).withColumn("one", F.lit(1).cast("bigint"))
    cycle = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    ranked = global_rank(scratch, named, ["_mix_null", "_mix_s"], "one", "_mix_rank").withColumn(
        "weight", F.element_at(cycle, (F.col("_mix_rank") % len(weights) + 1).cast("int")))
    ranked = scratch.save(ranked.drop("one", "_mix_null"))
    total = int(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    filled = scratch.save(water_fill(scratch, ranked, total, max_epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = filled.withColumn("_mix_whole", whole).withColumn("_mix_extra", F.col("target") - F.col("_mix_whole") * F.col("source_size"))
    # where in each source the fraction ends: a running sum over its buckets, at most 16**BUCKET_DIGITS rows a source
    upto = Window.partitionBy("_mix_s").orderBy("_mix_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        buckets.withColumn("_hi", F.sum("n").over(upto)).withColumn("_lo", F.col("_hi") - F.col("n"))
        .join(plan.select(F.col("_mix_s").alias("_s"), "_mix_extra"), F.col("_mix_s").eqNullSafe(F.col("_s")))
        .where("_lo <= _mix_extra AND _mix_extra < _hi")
        .select(F.col("_mix_s").alias("_s"), F.col("_mix_b").alias("_mix_edge"), F.col("_lo").alias("_mix_lo"))
    )
    plan = scratch.save(
        plan.join(edge, F.col("_mix_s").eqNullSafe(F.col("_s")), "left")
        .select("_mix_s", F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"), "_mix_whole", "_mix_extra", "_mix_edge", "_mix_lo")
    )
    small = plan.count() <= 20_000  # a checked bound: beyond it, the join shuffles and AQE splits hot sources
    side = F.broadcast(plan) if small else plan
    joined = rows.join(side, F.col(source).eqNullSafe(F.col("_mix_s")), "left")
    # Only the documents of the bucket in which the fraction ends are put in order, source by source.
    at_edge = F.coalesce(F.col("_mix_b") == F.col("_mix_edge"), F.lit(False))
    order = ["_mix_h", *[c for c in (tie or []) if c != key]]
    run = Window.partitionBy("_mix_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        joined.where(at_edge).withColumn("_mix_cum", F.col("_mix_lo") + F.sum(size).over(run))
        .withColumn("_mix_more", 2 * F.col("_mix_cum") - F.col(size) <= 2 * F.col("_mix_extra")).drop("_mix_cum")
    )
    before = F.coalesce(F.col("_mix_b") < F.col("_mix_edge"), F.lit(False))
    outside = joined.where(~at_edge).withColumn("_mix_more", before)
    return (
        outside.unionByName(inside).withColumns({
            "source_size": F.col("_mix_size"), "target": F.col("_mix_target"), "repeats": F.col("_mix_whole") + F.col("_mix_more").cast("int")})
        .drop("_mix_h", "_mix_b", "_mix_s", "_mix_size", "_mix_target", "_mix_whole", "_mix_extra", "_mix_edge", "_mix_lo", "_mix_more")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", F.size(split_words(F.col("text"))).cast("bigint").alias("size"))
    return mix(sized, "size").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def water_fill_sql(docs: str = "d") -> str:
    """The same mix as SQL: shares by the level at which clamping stops, then the seeded order with running sums."""
    return rf"""
s0 AS (SELECT source, sum(size) AS source_size FROM {docs} GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s0),
s2 AS (SELECT *, 3.0 * source_size / weight AS lvl FROM s1),
s3 AS (SELECT *, (SELECT sum(source_size) FROM s2) AS total,
  coalesce((SELECT sum(3 * b.source_size) FROM s2 b WHERE b.lvl <= a.lvl), 0) AS capped,
  coalesce((SELECT sum(b.weight) FROM s2 b WHERE b.lvl > a.lvl), 0) AS rest FROM s2 a),
lim AS (SELECT coalesce(max(lvl) FILTER (WHERE capped + rest * lvl <= total), -1) AS top FROM s3),
s4 AS (SELECT s2.*, lvl <= top AS clamped FROM s2, lim),
s5 AS (SELECT source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE
  (weight * ((SELECT sum(source_size) FROM s4) - 3 * coalesce((SELECT sum(source_size) FROM s4 WHERE clamped), 0)))::DOUBLE
   / (SELECT sum(weight) FROM s4 WHERE NOT clamped)::DOUBLE END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM s5),
m AS (SELECT {docs}.*, source_size, target, whole, target - whole * source_size AS extra,
  sum(size) OVER (PARTITION BY {docs}.source ORDER BY md5('42:' || coalesce(doc_id::VARCHAR, 'null')) ROWS UNBOUNDED PRECEDING) AS cum
  FROM {docs} JOIN s6 ON {docs}.source IS NOT DISTINCT FROM s6.source)"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
{water_fill_sql()}
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (whole + CASE WHEN 2 * cum - size <= 2 * extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""
