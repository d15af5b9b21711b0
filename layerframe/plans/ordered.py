"""Ordered computations without one task per key: windows run inside bins of the position, bins are stitched by their summaries.

A key's bins are summed to one row each before a window runs over the key, so the window's input is smaller than the data by the number
of rows in a bin; choose the width so that a bin holds some thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(pos: Column | str, width: int) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / F.lit(width)).cast("long")


def with_previous(df: DataFrame, keys: list[str], pos: str, fields: list[str], width: int, order: list[str] | None = None, name: str = "prev") -> DataFrame:
    """Adds struct `name` of the fields of the row before, within keys, by pos and then the order columns; null for the first row."""
    order = [pos, *(order or [])]
    binned = df.withColumn("_bin", bin_of(pos, width))
    here = F.struct(*fields)
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    last = binned.groupBy(*keys, "_bin").agg(F.max_by(here, F.struct(*order)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bin"))).drop("_last")
    out = binned.withColumn(name, F.lag(here).over(inside)).withColumn("_rn", F.row_number().over(inside))
    out = out.join(carry, [*keys, "_bin"])
    return out.withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col(name))).drop("_bin", "_rn", "_carry")


#: Bins that one bin of the second level holds.
GROUP = 4096


def _sums_before(totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _bin, _base) of (keys, _bin, _t): sums over the bins before. Groups of bins are summed by themselves, then one row per group."""
    group = F.floor(F.col("_bin") / GROUP).cast("long")
    inside = Window.partitionBy(*keys, "_group").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bins = totals.withColumn("_group", group)
    carry = bins.groupBy(*keys, "_group").agg(F.sum("_t").alias("_t"))
    carry = carry.select(*keys, "_group", F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_carry"))
    bins = bins.select(*keys, "_bin", "_group", F.coalesce(F.sum("_t").over(inside), F.lit(0)).alias("_in"))
    return bins.join(carry, [*keys, "_group"]).select(*keys, "_bin", (F.col("_in") + F.col("_carry")).alias("_base"))


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, width: int, name: str, order: list[str] | None = None) -> DataFrame:
    """Adds `name` (long): the sum of value over the rows before, within keys (none: the whole table), by pos and the order columns."""
    order = [pos, *(order or [])]
    binned = df.withColumn("_bin", bin_of(pos, width)).withColumn("_v", value.cast("long"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*keys, "_bin").agg(F.sum("_v").alias("_t"))
    base = _sums_before(totals, keys)
    out = binned.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    out = out.join(base, [*keys, "_bin"])
    return out.withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_bin", "_v", "_in", "_base")


def islands(df: DataFrame, keys: list[str], pos: str, fields: list[str], breaks: Column, width: int, order: list[str] | None = None, name: str = "island") -> DataFrame:
    """Adds `name`: the running number of breaks, a condition over the row's fields and `prev` (its predecessor's); a first row always breaks.

    One pass: breaks are counted inside bins, and the summaries, which hold a bin's first and last row, tell whether its first row breaks.
    """
    order = [pos, *(order or [])]
    here, at = F.struct(*fields), F.struct(*order)
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    rows = df.withColumn("_bin", bin_of(pos, width)).withColumn("prev", F.lag(here).over(inside))
    rows = rows.withColumn("_break", F.when(F.col("prev").isNull(), 0).when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    bins = rows.groupBy(*keys, "_bin").agg(F.min_by(here, at).alias("_first"), F.max_by(here, at).alias("_last"), F.sum("_break").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_bin")
    names = [c for c in fields if c not in keys]
    bins = bins.select(*keys, "_bin", "_n", F.lag("_last").over(along).alias("prev"), *[F.col("_first")[c].alias(c) for c in names])
    bins = bins.withColumn("_head", F.when(F.col("prev").isNull() | F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    base = bins.select(*keys, "_bin", (F.coalesce(F.sum(F.col("_n") + F.col("_head")).over(before), F.lit(0)) + F.col("_head")).alias("_base"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_in", F.sum("_break").over(upto)).join(base, [*keys, "_bin"])
    return out.withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_bin", "_break", "_in", "_base", "prev")


def floor_join(probe: DataFrame, points: DataFrame, keys: list[str], at: str, pos: str, fields: list[str], width: int) -> DataFrame:
    """As-of join: to each probe the fields of the last point with pos <= at, or of the first point of the key where there is none.

    Points and probes meet in bins; a probe whose bin has no point at or before it takes the last point of the bins before, from the
    bins' summaries. Equal positions: the largest field values win.
    """
    pts = points.select(*keys, F.col(pos).alias("_p"), F.struct(pos, *[f for f in fields if f != pos]).alias("_f")).withColumn("_bin", bin_of("_p", width))
    prb = probe.withColumn("_bin", bin_of(at, width))
    both = (
        pts.select(*keys, "_bin", F.col("_p").alias("_at"), F.lit(0).alias("_side"), "_f", F.lit(None).cast(prb.drop("_bin").schema).alias("_row"))
        .unionByName(prb.select(*keys, "_bin", F.col(at).alias("_at"), F.lit(1).alias("_side"),
                                F.lit(None).cast(pts.schema["_f"].dataType).alias("_f"), F.struct(*probe.columns).alias("_row")))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_at", "_side", "_f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_found", F.last("_f", ignorenulls=True).over(inside)).where("_side = 1")
    place = F.when(F.col("_side") == 0, F.struct("_at", "_f"))  # null, so left out, for probes
    bins = both.groupBy(*keys, "_bin").agg(F.max_by("_f", place).alias("_l"), F.min_by("_f", place).alias("_s"))
    carried = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = bins.select(*keys, "_bin", F.last("_l", ignorenulls=True).over(carried).alias("_before"), F.first("_s", ignorenulls=True).over(whole).alias("_first"))
    out = seen.join(carry, [*keys, "_bin"], "left")
    found = F.coalesce("_found", "_before", "_first")
    return out.select("_row.*", *[found[f].alias(f) for f in dict.fromkeys([pos, *fields])])
