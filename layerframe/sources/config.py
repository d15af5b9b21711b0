"""Image and service configuration as nested JSON with defaults."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYER = "struct<file:string,targetFile:string,targetDigest:string,gzipIndex:string,dir:string,digest:string,size:bigint>"
IMAGE = f"struct<repoBlobUrl:string,lowers:array<{LAYER}>,upper:struct<index:string,data:string,target:string,gzipIndex:string>,resultFile:string,accelerationLayer:boolean,recordTracePath:string>"


def parse_images(raw: DataFrame, text: str = "value") -> DataFrame:
    """Columns of image documents; missing fields get their defaults; a broken document gives nulls in all but its text."""
    doc = F.from_json(F.col(text), IMAGE)
    return raw.select(F.col(text), doc.alias("c")).select(
        text, F.coalesce("c.repoBlobUrl", F.lit("")).alias("repo_blob_url"), F.coalesce("c.lowers", F.from_json(F.lit("[]"), f"array<{LAYER}>")).alias("lowers"),
        F.col("c.upper").alias("upper"), F.coalesce("c.accelerationLayer", F.lit(False)).alias("acceleration_layer"), F.coalesce("c.recordTracePath", F.lit("")).alias("record_trace_path"))


def merge(left: dict, right: dict) -> dict:
    """Deep merge: objects join, anything else of the right wins."""
    out = dict(left)
    for k, v in right.items():
        out[k] = merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def merged_json():
    """merge() of two JSON text columns."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(merge(json.loads(x or "{}"), json.loads(y or "{}")), sort_keys=True) for x, y in zip(a, b, strict=True)])

    return run


def auth_entries(text: Column) -> Column:
    """{"auths": {address: {auth | username, password}}} as a map."""
    return F.from_json(text, "struct<auths:map<string,struct<auth:string,username:string,password:string>>>")["auths"]
