"""Extent tables derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS dev", "CAST(l_linenumber AS INT) AS layer", "l_orderkey AS write_seq", "(l_partkey * 37 + l_orderkey) % 4096 AS lo",
        "(l_partkey * 37 + l_orderkey) % 4096 + CAST(l_quantity AS BIGINT) AS hi", "l_orderkey * 64 AS moff", "l_returnflag = 'R' AS zeroed")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").join(F.broadcast(n)).selectExpr(  # one row
        "o_custkey % n + 1 AS dev", "o_orderkey AS req_id", "(o_orderkey * 53) % 4096 AS lo", "(o_orderkey * 53) % 4096 + 1 + o_custkey % 64 AS hi").distinct()


SEGMENTS = """segments AS (SELECT l_suppkey AS dev, l_linenumber::INT AS layer, l_orderkey AS write_seq, (l_partkey * 37 + l_orderkey) % 4096 AS lo,
  (l_partkey * 37 + l_orderkey) % 4096 + l_quantity::BIGINT AS hi, l_orderkey * 64 AS moff, l_returnflag = 'R' AS zeroed FROM lineitem)"""

READS = """reads AS (SELECT DISTINCT o_custkey % (SELECT count(*) FROM supplier) + 1 AS dev, o_orderkey AS req_id, (o_orderkey * 53) % 4096 AS lo,
  (o_orderkey * 53) % 4096 + 1 + o_custkey % 64 AS hi FROM orders)"""


def flat_sql(src: str = "segments", out: str = "flat", order: str = "layer DESC, write_seq DESC, moff DESC, hi DESC, lo DESC, zeroed DESC") -> str:
    return f"""{out}_p AS (SELECT dev, lo AS x FROM {src} UNION SELECT dev, hi FROM {src}),
{out}_a AS (SELECT dev, x AS a, lead(x) OVER (PARTITION BY dev ORDER BY x) AS b FROM {out}_p),
{out}_w AS (SELECT * FROM (SELECT s.*, a, b, row_number() OVER (PARTITION BY s.dev, a ORDER BY {order}) AS rn FROM {out}_a t JOIN {src} s ON s.dev = t.dev AND s.lo <= a AND s.hi >= b) WHERE rn = 1),
{out}_b AS (SELECT *, CASE WHEN lag(b) OVER w = a THEN 0 ELSE 1 END AS brk FROM {out}_w WINDOW w AS (PARTITION BY dev, layer, write_seq, moff, hi, lo, zeroed ORDER BY a)),
{out}_i AS (SELECT *, sum(brk) OVER (PARTITION BY dev, layer, write_seq, moff, hi, lo, zeroed ORDER BY a) AS isl FROM {out}_b),
{out} AS (SELECT dev, min(a) AS lo, max(b) AS hi, moff + CASE WHEN zeroed THEN 0 ELSE min(a) - i.lo END AS moff, zeroed, layer, write_seq FROM {out}_i i GROUP BY dev, layer, write_seq, moff, i.hi, i.lo, zeroed, isl)"""
