"""Shared helpers: the shared scratch folder, word splitting, distributed ranks and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contract: words are maximal runs of anything else.
WHITE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder that the application has set.

    In a local session, where one machine does everything, a folder of its own is made if none is named. On a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="layerframe-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written under the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Deletes saved tables that nothing reads any more, and lets Spark's cleaner free their shuffle files."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def global_rank(scratch: Scratch, df: DataFrame, keys: list[str], weight: str, rank: str) -> DataFrame:
    """Adds `rank`: the sum of `weight` over all rows with smaller keys. Keys must be distinct.

    A range sort deals the rows out, each range sums its own rows, and only one row per range is summed globally,
    so no group of keys has to fit into one task.
    """
    dealt = scratch.save(
        df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_pid", F.spark_partition_id())
    )
    totals = dealt.groupBy("_pid").agg(F.sum(weight).alias("_total"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_pid", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    # one row per range, at most spark.sql.shuffle.partitions of them
    return ranked.join(F.broadcast(base), "_pid").withColumn(rank, F.col("_base") + F.col("_in")).drop("_pid", "_base", "_in")


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for the long columns (a, b) of edges; component is the smallest node.

    Alternating large-star and small-star rounds. Each is a minimum per node, which is summed before the
    shuffle, and a join on the node, which AQE splits where it is skewed; a hub never meets one task. The edge
    count never grows, and rounds are logarithmic in the length of a chain; they go on until only stars are left. Nodes without an edge to another
    node are left out; null ends are ignored.
    """
    apart = lambda low: low.hint("rebalance")  # noqa: E731  an exchange of its own, so AQE can split the join on a hub
    e = scratch.save(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        # large star: all larger neighbours of u go to the smallest node of u's neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(apart(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        large = scratch.save(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(apart(low), "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u <> v").distinct())
        # done when every node that has an edge down has one, and none up: stars that share no node
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(after.select("v", F.lit(0), F.lit(1)))
        worst = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).agg(F.max(F.greatest("down", F.col("up") * 2 * F.col("down")))).first()[0]
        scratch.drop(e, large)
        e = after
        if (worst or 0) <= 1:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
