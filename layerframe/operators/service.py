"""What the service around images does, as tables: stacking with checks, snapshot requests, grouped index records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerframe.functions.scalars import query_params
from layerframe.plans.ordered import running_sum

from .layers import provenance

#: Answers by status code (fixed values).
MESSAGES = {200: "Snapshot created successfully", 400: "Missing dev_id or config in snapshot request", 404: "Image file not found", 500: "Failed to create snapshot"}


def stack(upper: DataFrame, lower: DataFrame, check: bool = True) -> DataFrame:
    """(dev, status, n_layers, virtual_size) of writable layers over sealed ones, a row per upper (dev, virtual_size).

    lower: (dev, layer, uuid, parent_uuid, virtual_size). An upper without a size takes that of the topmost lower layer. With check, a lower
    layer whose parent is not the layer below refuses the stack. An upper without lower layers stands alone.
    """
    below = lower.groupBy("dev").agg(F.count("*").alias("_n"), F.max_by("virtual_size", "layer").alias("_size"))
    out = upper.select("dev", "virtual_size").join(below, "dev", "left")
    if check:
        out = out.join(provenance(lower).select("dev", F.lit(True).alias("_wrong")).distinct(), "dev", "left")
    else:
        out = out.withColumn("_wrong", F.lit(False))
    own = F.coalesce("virtual_size", F.lit(0))
    return out.select("dev", F.when(F.col("_wrong"), "wrong parent").otherwise("ok").alias("status"), (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("n_layers"),
                      F.when(own == 0, F.coalesce("_size", F.lit(0))).otherwise(own).cast("long").alias("virtual_size"))


def snapshot_requests(requests: DataFrame, images: DataFrame, configs: DataFrame) -> DataFrame:
    """(req_id, dev_id, config, code, message) of requests (req_id, target), target like `/snapshot?dev_id=...&config=...`.

    images: (dev_id, data, index) of the upper layer in use; configs: (config, data, index), null where a config names no upper layer. Each
    request is judged against these images. A snapshot needs an upper layer whose data and index both differ from those in use. A missing
    or empty parameter counts before an unknown image, that before a config that cannot be used.
    """
    params = query_params(F.when(F.instr("target", "?") > 0, F.regexp_extract("target", r"(?s)\?(.*)$", 1)).otherwise(""))
    asked = requests.withColumn("_p", params).select("req_id", F.coalesce(F.col("_p")["dev_id"], F.lit("")).alias("dev_id"), F.coalesce(F.col("_p")["config"], F.lit("")).alias("config"))
    used = images.dropDuplicates(["dev_id"]).select("dev_id", F.col("data").alias("_data"), F.col("index").alias("_index"), F.lit(True).alias("_known"))
    new = configs.dropDuplicates(["config"]).select("config", F.col("data").alias("_new_data"), F.col("index").alias("_new_index"))
    got = asked.join(used, "dev_id", "left").join(new, "config", "left")
    fresh = F.coalesce((F.col("_new_data") != F.col("_data")) & (F.col("_new_index") != F.col("_index")), F.lit(False))
    code = F.when((F.col("dev_id") == "") | (F.col("config") == ""), 400).when(F.col("_known").isNull(), 404).when(~fresh, 500).otherwise(200)
    text = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return got.select("req_id", "dev_id", "config", code.alias("code")).withColumn("message", text[F.col("code")])


def group_commit(log: DataFrame, size: int, width: int = 1 << 12) -> DataFrame:
    """Index records (dev, layer, write_seq, lo, hi, moff, zeroed) as they are appended in groups of `size`: adds group_id, slot and valid.

    The last group of a layer is filled up with records that are not valid and have no other values. Records are numbered inside bins.
    """
    keys = ["dev", "layer"]
    at = F.col("_before")
    rows = running_sum(log, keys, "write_seq", F.lit(1), width, "_before", ["lo", "hi", "moff", "zeroed"])
    rows = rows.withColumns({"group_id": F.floor(at / size).cast("long"), "slot": (at % size).cast("int"), "valid": F.lit(True)}).drop("_before")
    n = log.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") % size != 0)
    fill = n.select(*keys, F.floor(F.col("_n") / size).cast("long").alias("group_id"), F.explode(F.sequence((F.col("_n") % size).cast("int"), F.lit(size - 1))).alias("slot"), F.lit(False).alias("valid"))
    return rows.unionByName(fill, allowMissingColumns=True)


def audit_lines(operations: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """(ts, line): one JSON line per operation, its fields in the order given, nulls left out; sorted inside partitions by `order`."""
    return operations.sortWithinPartitions(*order).select("ts", F.to_json(F.struct(*fields)).alias("line"))
