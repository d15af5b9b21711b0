"""Queries that have to take every row of their tables, against brute force on the smallest tables."""

import bisect
import os

import pytest

from layerframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def test_checkpoint_floor(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    events = [r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    points = {f: sorted(o["o_orderkey"] * 512 for o in orders if o["o_custkey"] % 8 == f) for f in range(8)}
    want = []
    for e in events:
        at = points[e % 8]
        if at:
            pos = at[max(0, bisect.bisect_right(at, e * 7919 % 4000000) - 1)]
            want.append((e, pos, pos // 4))
        else:
            want.append((e, None, None))
    got = QUERIES["checkpoint_floor"](spark, SF).select("req_id", "de_pos", "en_pos").collect()
    assert len(got) == len(events) and sorted(map(tuple, got)) == sorted(want)
