"""Operators on tables of extents: (dev, layer, write_seq, lo, hi, moff, zeroed), hi exclusive, in sectors.

A larger layer lies nearer the top. zeroed extents read as zeros and hide what lies below; holes show it. All joins meet
on (dev, bin), where a bin is BIN sectors, so no device has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerframe.plans.ordered import islands, running_sum, with_previous

BIN = 64
#: Longest segment, in sectors; joined segments stay strictly below it.
MAX_LENGTH = 16383
MAX_LAYERS = 255
#: Rows of a device that a window sees at once lie in so many sectors.
SPAN = 4096

SOURCE = ["layer", "write_seq", "moff", "hi", "lo", "zeroed"]
BY_LAYER = ["layer", "write_seq", "moff", "hi", "lo", "zeroed"]
BY_WRITE = ["write_seq", "layer", "moff", "hi", "lo", "zeroed"]


def trimmed(moff: Column, cut: Column, zeroed: Column) -> Column:
    """Where a mapping points after `cut` sectors are taken from its left end: zeroed mappings stay."""
    return moff + F.when(zeroed, F.lit(0)).otherwise(cut)


def into_bins(df: DataFrame, lo: str = "lo", hi: str = "hi", width: int = BIN) -> DataFrame:
    first, last = F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)
    return df.where(F.col(lo) < F.col(hi)).withColumn("bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def flatten(segments: DataFrame, priority: list[str] = BY_LAYER, keys: tuple[str, ...] = ("dev",), width: int = BIN) -> DataFrame:
    """What is seen from above: for each place the segment that is greatest by the priority columns.

    Segments are cut at bins of at most 64 sectors, so that a piece is a mask of bits. In a bin, from the top down, a piece is seen where no mask
    before it has a bit: one running OR, which holds one row at a time. The runs of ones that are left are joined again over bins, so a
    write that nothing splits comes out whole; different writes are never joined. Rows without a key are left out.
    """
    if not 1 <= width <= 64:
        raise ValueError("a bin has 1 to 64 sectors")
    keys, c, none = list(keys), F.col, F.lit(0).cast("long")
    cut = into_bins(segments.dropna(subset=keys), width=width)
    off = F.greatest(c("lo") - c("bin") * width, none)
    size = F.least(c("hi") - c("bin") * width, F.lit(width)) - off
    cut = cut.withColumns({"_off": off.cast("int"), "_size": size.cast("int")})
    cut = cut.select(*keys, "bin", *dict.fromkeys([*priority, *SOURCE]), F.expr("shiftleft(shiftrightunsigned(-1L, 64 - _size), _off)").alias("_mask"))
    above = Window.partitionBy(*keys, "bin").orderBy(*[c(p).desc() for p in priority]).rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("_seen", c("_mask").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("_mask").over(above), none)))).where("_seen <> 0")
    seen = seen.withColumn("_starts", F.expr("_seen & ~shiftleft(_seen, 1)"))
    only = "CASE WHEN _starts < 0 THEN 63 ELSE bit_count(_starts - 1) END"  # the place of a single bit
    places = lambda bits: f"filter(sequence(0, 63), i -> (shiftrightunsigned({bits}, i) & 1) = 1)"
    ones = F.expr(f"""CASE WHEN bit_count(_starts) = 1 THEN array(named_struct('a', {only}, 'b', {only} + bit_count(_seen)))
        ELSE zip_with({places('_starts')}, {places('(_seen & ~shiftrightunsigned(_seen, 1))')}, (x, y) -> named_struct('a', x, 'b', y + 1)) END""")
    at = c("bin") * width
    runs = seen.select(*keys, *SOURCE, "bin", F.explode(ones).alias("_r")).select(*keys, *SOURCE, "bin", (at + c("_r.a")).alias("_a"), (at + c("_r.b")).alias("_b"))
    # A write in two bins has at most one run on each side of their border, and those join. In a longer write, which is a window of its own, a run
    # joins the one before that ends where it starts. Short writes share windows, and are not changed there.
    first, last = F.floor(c("lo") / width), F.floor((c("hi") - 1) / width)
    cut_off = ((c("_a") == at) & (c("lo") < c("_a"))) | ((c("_b") == at + width) & (c("hi") > c("_b")))
    runs = runs.withColumns({"_long": last - first > 1, "_short": F.when(cut_off, F.lit(-1).cast("long")).otherwise(c("_a") - c("lo"))})
    runs = runs.withColumn("_home", F.when(c("_long"), F.xxhash64(*SOURCE)).otherwise(first.cast("long"))).drop("bin")
    along = Window.partitionBy(*keys, "_long", "_home").orderBy(*SOURCE, "_a")
    touches = F.lag(F.struct(*SOURCE, c("_b").alias("_x"))).over(along).eqNullSafe(F.struct(*SOURCE, c("_a").alias("_x")))
    runs = runs.withColumn("_new", F.when(touches, 0).otherwise(1))
    island = F.when(c("_long"), F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).otherwise(c("_short"))
    whole = runs.withColumn("_island", island).groupBy(*keys, "_long", "_home", *SOURCE, "_island").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return whole.select(*keys, c("_a").alias("lo"), c("_b").alias("hi"), trimmed(c("moff"), c("_a") - c("lo"), c("zeroed")).alias("moff"), "zeroed", "layer", "write_seq")


def insert_all(writes: DataFrame, **how) -> DataFrame:
    """Last writer wins: the mappings after all writes, in the order of write_seq."""
    return flatten(writes, BY_WRITE, **how)


def combine(delta: DataFrame, base: DataFrame) -> DataFrame:
    """Two indexes, each without overlaps: the delta where it has a mapping, else the base; layers kept."""
    both = delta.withColumn("_top", F.lit(1)).unionByName(base.withColumn("_top", F.lit(0)))
    return flatten(both, ["_top", *BY_LAYER])


def lookup(index: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("dev",), width: int = BIN) -> DataFrame:
    """Mappings of each range (keys, req_id, lo, hi), clipped to it. Each pair is found in the bin where both begin to overlap."""
    keys = list(keys)
    idx = into_bins(index, width=width)
    req = into_bins(ranges.select(*keys, "req_id", F.col("lo").alias("rlo"), F.col("hi").alias("rhi")), "rlo", "rhi", width)
    a, b = F.greatest("lo", "rlo"), F.least("hi", "rhi")
    hit = idx.join(req, [*keys, "bin"]).where((a < b) & (F.floor(a / width) == F.col("bin")))
    rest = [c for c in index.columns if c not in (*keys, "lo", "hi", "moff")]
    return hit.select(*keys, "req_id", a.alias("lo"), b.alias("hi"), trimmed(F.col("moff"), a - F.col("lo"), F.col("zeroed")).alias("moff"), *rest)


def segments_of(index: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("dev",)) -> DataFrame:
    """Every range as ordered pieces of kind hole, zero or data; holes (also at the end) are made up and have no moff."""
    keys = list(keys)
    found = lookup(index, ranges, tuple(keys)).select(*keys, "req_id", "lo", "hi", F.when(F.col("zeroed"), "zero").otherwise("data").alias("kind"), F.when(~F.col("zeroed"), F.col("moff")).alias("moff"))
    ends = ranges.select(*keys, "req_id", F.col("hi").alias("lo"), F.col("hi"), F.lit("end").alias("kind"), F.lit(None).cast("long").alias("moff"))
    starts = ranges.select(*keys, "req_id", F.col("lo").alias("_from"))
    seen = with_previous(found.unionByName(ends), [*keys, "req_id"], "lo", ["hi"], SPAN, ["hi"])
    gaps = (
        seen.join(starts, [*keys, "req_id"]).withColumn("_from", F.coalesce("prev.hi", "_from")).where("_from < lo")
        .select(*keys, "req_id", F.col("_from").alias("lo"), F.col("lo").alias("hi"), F.lit("hole").alias("kind"), F.lit(None).cast("long").alias("moff"))
    )
    return found.unionByName(gaps)


def mend(moff: Column, lo: Column, hi: Column, zeroed: Column) -> Column:
    return moff + F.when(zeroed, F.lit(0)).otherwise(hi - lo)


def _touching(physical: bool) -> Column:
    p = F.col("prev")
    same = (p["hi"] == F.col("lo")) & (p["zeroed"] == F.col("zeroed")) & (p["layer"] == F.col("layer"))
    return same & (mend(p["moff"], p["lo"], p["hi"], p["zeroed"]) == F.col("moff")) if physical else same


def coalesce(index: DataFrame, physical: bool = True) -> DataFrame:
    """Joins mappings that touch logically and physically, of one layer and kind, without a length cap."""
    marked = islands(index, ["dev"], "lo", ["lo", "hi", "moff", "zeroed", "layer"], ~_touching(physical), SPAN)
    return marked.groupBy("dev", "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("moff", "lo").alias("moff"), F.first("zeroed").alias("zeroed"), F.first("layer").alias("layer")).drop("island")


def coalesce_capped(index: DataFrame, physical: bool = True, cap: int = MAX_LENGTH) -> DataFrame:
    """As coalesce, but from left to right and only while the joined length stays strictly below the cap.

    The cap makes this a fold, but only inside an uncapped island: each island is folded on its own.
    """
    marked = islands(index, ["dev"], "lo", ["lo", "hi", "moff", "zeroed", "layer"], ~_touching(physical), SPAN)
    rows = marked.groupBy("dev", "island").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "moff", "zeroed", "layer"))).alias("a"))
    kind = "array<struct<lo:bigint,hi:bigint,moff:bigint,zeroed:boolean,layer:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc["open"], 1)
        joined = F.struct(last["lo"].alias("lo"), x["hi"].alias("hi"), last["moff"].alias("moff"), last["zeroed"].alias("zeroed"), last["layer"].alias("layer"))
        fits = (F.size(acc["open"]) > 0) & ((x["hi"] - last["lo"]) < cap)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], acc["open"])).alias("done"),
            F.when(fits, F.array(joined)).otherwise(F.array(x)).cast(kind).alias("open"))

    empty = F.array().cast(kind)
    folded = rows.select("dev", F.explode(F.aggregate(F.col("a").cast(kind), F.struct(empty.alias("done"), empty.alias("open")), step, lambda s: F.concat(s["done"], s["open"]))).alias("x"))
    return folded.select("dev", "x.*")


def coalesced_size(index: DataFrame) -> DataFrame:
    """dev, n_segments and n_estimated: segments after joining all logical neighbours of a kind, physical neighbours or not."""
    marked = islands(index, ["dev"], "lo", ["lo", "hi", "moff", "zeroed", "layer"], ~_touching(False), SPAN)
    return marked.groupBy("dev").agg(F.count("*").alias("n_segments"), F.max("island").alias("n_estimated"))


def allocated(index: DataFrame) -> DataFrame:
    return index.groupBy("dev").agg(F.coalesce(F.sum(F.when(~F.col("zeroed"), F.col("hi") - F.col("lo"))), F.lit(0)).cast("long").alias("sectors"), F.count("*").alias("n_segments"))


def ends(index: DataFrame) -> DataFrame:
    """First and last mapping of each device."""
    row = F.struct("lo", "hi", "moff", "zeroed", "layer")
    got = index.groupBy("dev").agg(F.min_by(row, "lo").alias("f"), F.max_by(row, "lo").alias("b"))
    return got.select("dev", *[F.col(f"f.{c}").alias(f"front_{c}") for c in ("lo", "hi", "moff", "layer")], *[F.col(f"b.{c}").alias(f"back_{c}") for c in ("lo", "hi", "moff", "layer")])


def dump(index: DataFrame) -> DataFrame:
    """The mappings in order, range-partitioned by device and place."""
    return index.orderBy("dev", "lo")


def layers_between(index: DataFrame, low: int, high: int) -> DataFrame:
    """Mappings of layers in [low, high)."""
    return index.where((F.col("layer") >= low) & (F.col("layer") < high))


def shift_layers(index: DataFrame, by: int) -> DataFrame:
    return index.withColumn("layer", (F.col("layer") + by).cast("int"))


def commit_delta(delta: DataFrame, base: DataFrame) -> DataFrame:
    """The base one layer down, the coalesced delta on top as layer 0 from above (the largest here)."""
    top = coalesce_capped(delta).withColumn("write_seq", F.lit(0).cast("long"))
    return combine(top.withColumn("layer", F.lit(MAX_LAYERS)), base)


def order_violations(index: DataFrame, keys: tuple[str, ...] = ("dev",)) -> DataFrame:
    """Neighbours that overlap: rows whose predecessor ends behind their start."""
    seen = with_previous(index, list(keys), "lo", ["lo", "hi"], SPAN, ["hi", "moff", "write_seq", "zeroed"])
    return seen.where(F.col("prev.hi") > F.col("lo")).withColumns({"prev_lo": F.col("prev.lo"), "prev_hi": F.col("prev.hi")}).drop("prev")


def offset_violations(index: DataFrame, begin: int, end: int) -> DataFrame:
    """Mappings whose data lie outside [begin, end); zeroed ones may sit at the end."""
    stop = F.when(F.col("zeroed"), F.col("moff")).otherwise(F.col("moff") + F.col("hi") - F.col("lo"))
    return index.where((F.col("moff") < begin) | (stop > end))


def split_long(index: DataFrame, cap: int = MAX_LENGTH) -> DataFrame:
    """Segments of at most cap sectors."""
    pieces = index.withColumn("_at", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(cap).cast("long"))))
    cut = F.col("_at") - F.col("lo")
    return pieces.withColumns({"moff": trimmed(F.col("moff"), cut, F.col("zeroed")), "hi": F.least("hi", F.col("_at") + cap), "lo": F.col("_at")}).drop("_at")


def running_offsets(index: DataFrame, moved: Column, begin: int = 8) -> DataFrame:
    """new_moff: where the data of `moved` mappings land when copied densely from sector `begin` on, in order; others get the place reached."""
    length = F.when(moved, F.col("hi") - F.col("lo")).otherwise(F.lit(0))
    return running_sum(index, ["dev"], "lo", length, SPAN, "new_moff").withColumn("new_moff", F.col("new_moff") + begin)
