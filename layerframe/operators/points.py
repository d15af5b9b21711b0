"""Point lookups: which mapping covers a sector. Mappings and probes meet in bins, by a hash join in generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlay import BIN, into_bins, trimmed

#: Pieces of mappings that are sent to every task, at most (about 64 bytes each).
MOST_SENT = 2_000_000


def lookup_points(index: DataFrame, probes: DataFrame, most_sent: int = MOST_SENT, width: int = BIN) -> DataFrame:
    """(dev, sector, moff, zeroed, layer) for each probe (dev, sector) that a mapping covers; the index has no overlaps.

    A mapping has a piece in every bin that it covers, so a probe looks at the pieces of one bin. They are counted first, up to the
    bound: no more than it allows are broadcast, and a larger index is joined by a shuffle on the bins.
    """
    key = lambda dev, at: F.xxhash64(dev, at)  # noqa: E731  one long, so that the hash table is keyed by a primitive
    idx = into_bins(index.select("dev", "lo", "hi", "moff", "zeroed", "layer"), width=width)
    idx = idx.select(key(F.col("dev"), F.col("bin")).alias("_key"), F.col("dev").alias("_dev"), "lo", "hi", "moff", "zeroed", "layer")
    if idx.select(F.lit(1)).limit(most_sent + 1).count() <= most_sent:
        idx = F.broadcast(idx)
    ask = probes.select(F.col("dev").cast("long").alias("dev"), F.col("sector").cast("long").alias("sector")).where("dev IS NOT NULL AND sector >= 0")
    ask = ask.withColumn("_key", key(F.col("dev"), F.expr(f"sector div {width}")))
    got = ask.join(idx, "_key").where("dev = _dev AND lo <= sector AND sector < hi")
    return got.select("dev", "sector", trimmed(F.col("moff"), F.col("sector") - F.col("lo"), F.col("zeroed")).alias("moff"), "zeroed", "layer")
