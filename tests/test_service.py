import random
import struct

import pytest
from pyspark.sql import functions as F

from layerframe.functions import checksums
from layerframe.operators import layers, service, tree
from layerframe.plans.ordered import running_sum
from layerframe.sources import block_file, qcow2


def _guest(rng, n):
    """Clusters of words, of noise and of zeros."""
    parts = [rng.choice([bytes(512), rng.randbytes(512), (b"%d " % rng.randrange(9)) * 256])[:512] for _ in range(n)]
    return b"".join(parts) + b"tail"


@pytest.mark.parametrize("bits", [9, 10, 12, 16])
def test_disk_image(bits):
    raw = _guest(random.Random(bits), 900)
    image = qcow2.pack(raw, bits)
    rows = list(qcow2.clusters(image))
    size = 1 << bits
    assert [r["logical_offset"] for r in rows] == list(range(0, len(raw), size))
    assert b"".join(qcow2.cluster_data(image, r) for r in rows) == raw.ljust(len(rows) * size, b"\0")
    assert any(r["is_compressed"] for r in rows) and (bits > 9 or any(r["is_zero"] for r in rows) and any(r["is_unallocated"] for r in rows))
    plain = [r for r in rows if not (r["is_compressed"] or r["is_zero"] or r["is_unallocated"])]
    assert all(r["physical_offset"] % size == 0 for r in plain) and (bits > 10 or plain)


def test_disk_image_frames(spark):
    raw = _guest(random.Random(1), 40)
    good = qcow2.pack(raw)
    backing = good[:8] + struct.pack(">Q", 9) + good[16:]
    features = good[:72] + struct.pack(">Q", 16) + good[80:]
    rows = [(1, bytearray(good)), (2, bytearray(backing)), (3, bytearray(features)), (4, bytearray(good[:50])), (5, None), (6, bytearray(b"")), (7, bytearray(b"x" * 200)), (8, bytearray(qcow2.pack(b"")))]
    files = spark.createDataFrame(rows, "file_id long, data binary")
    got = {r["file_id"]: r for r in qcow2.read_images(files).collect()}
    want = {1: "ok", 2: "unsupported feature", 3: "unsupported feature", 4: "not a whole image", 5: "no data", 6: "not a whole image", 7: "not a supported image", 8: "ok"}
    assert {i: r["status"] for i, r in got.items()} == want
    assert bytes(got[1]["data"]) == raw.ljust(41 * 512, b"\0") and got[8]["data"] == b"" and got[2]["data"] is None
    maps = qcow2.read_clusters(files).collect()
    assert sum(r["file_id"] == 1 for r in maps) == 41 and {r["file_id"]: r["status"] for r in maps} == {i: s for i, s in want.items() if i != 8}


def test_block_file_status(spark):
    good = block_file.compress(b"abc" * 5000)
    rows = [(1, good), (2, good[:40] + bytes([good[40] ^ 1]) + good[41:]), (3, b"Q" + good[1:]), (4, b""), (5, None)]
    got = block_file.statuses(spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "file_id long, data binary")).collect()
    assert {r["file_id"]: r["status"] for r in got} == {1: 1, 2: -1, 3: 0, 4: 0, 5: None}


def test_sums_of_few_and_many():
    rng = random.Random(5)
    for n in (1, 63, 64, 200):
        data = [rng.randbytes(rng.choice([0, 1, 9, 100])) for _ in range(n)]
        assert checksums.extend_many(data, 7).tolist() == [checksums.extend(b, 7) for b in data]


def test_snapshot_requests(spark):
    targets = ["/snapshot?dev_id=a&config=/new", "/snapshot?dev_id=a&config=/same_index", "/snapshot?dev_id=a&config=/none", "/snapshot?dev_id=a&config=/empty", "/snapshot?dev_id=zz&config=/new",
               "/snapshot?dev_id=&config=/new", "/snapshot?dev_id=zz", "/snapshot", None, "/snapshot?config=%2Fnew&x=1&dev_id=a"]
    requests = spark.createDataFrame(list(enumerate(targets)), "req_id long, target string")
    images = spark.createDataFrame([("a", "d0", "i0")], "dev_id string, data string, index string")
    configs = spark.createDataFrame([("/new", "d1", "i1"), ("/same_index", "d1", "i0"), ("/empty", None, None)], "config string, data string, index string")
    got = {r["req_id"]: r["code"] for r in service.snapshot_requests(requests, images, configs).collect()}
    assert [got[i] for i in range(len(targets))] == [200, 500, 500, 500, 404, 400, 400, 400, 400, 200]


def test_stack(spark):
    upper = spark.createDataFrame([(1, 0), (2, 10), (3, None), (4, 0), (5, 0)], "dev long, virtual_size long")
    lower = spark.createDataFrame([(1, 1, "a", None, 5), (1, 2, "b", "a", 7), (2, 1, "a", "zz", 5), (4, 1, "a", None, 5), (4, 2, "b", "x", 6)], "dev long, layer int, uuid string, parent_uuid string, virtual_size long")
    got = {r["dev"]: tuple(r)[1:] for r in service.stack(upper, lower).collect()}
    assert got == {1: ("ok", 3, 7), 2: ("ok", 2, 10), 3: ("ok", 1, 0), 4: ("wrong parent", 3, 6), 5: ("ok", 1, 0)}
    assert {r["status"] for r in service.stack(upper, lower, check=False).collect()} == {"ok"}


def test_group_commit(spark):
    log = spark.createDataFrame([(d, 1, w, w, w + 1, 0, False) for d, n in ((1, 7), (2, 4), (3, 1)) for w in range(n)], "dev long, layer int, write_seq long, lo long, hi long, moff long, zeroed boolean")
    got = service.group_commit(log, 4, 3).collect()
    for dev, n in ((1, 7), (2, 4), (3, 1)):
        rows = sorted((r["group_id"], r["slot"], r["valid"], r["write_seq"]) for r in got if r["dev"] == dev and r["valid"])
        assert rows == [(i // 4, i % 4, True, i) for i in range(n)]
        fill = sorted((r["group_id"], r["slot"], r["write_seq"]) for r in got if r["dev"] == dev and not r["valid"])
        assert fill == [(i // 4, i % 4, None) for i in range(n, -(-n // 4) * 4)]
    assert service.group_commit(log.limit(0), 4).count() == 0


def test_audit_lines(spark):
    ops = spark.createDataFrame([(2, "read", None, 5), (1, "open", "f", None)], "ts long, op string, file string, count long").coalesce(1)
    assert [r["line"] for r in service.audit_lines(ops, ["op", "file", "count"], ["ts"]).collect()] == ['{"op":"open","file":"f"}', '{"op":"read","count":5}']


def test_freeze(spark, tmp_path):
    df = spark.range(100).selectExpr("id % 3 AS dev", "id * 2 AS lo", "id * 2 + 1 AS hi")
    got = layers.freeze(df, f"file://{tmp_path}/frozen")
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_attributes_and_directories(spark):
    pax = {"SCHILY.xattr.user.a": "1", "SCHILY.xattr.trusted.b": "2", "path": "x"}
    rows = [("/f", "0", 0o100644, pax), ("/l", "2", 0o777, pax), ("/d", "5", 0o755, None), ("/d/e/g", "0", 0o600, {})]
    e = spark.createDataFrame([(p, t, 1, 2, 3, m, x) for p, t, m, x in rows], "path string, typeflag string, uid long, gid long, mtime long, mode long, pax map<string, string>")
    got = {r["path"]: (r["mode"], r["xattrs"]) for r in tree.attributes(e).collect()}
    assert got == {"/f": (0o644, {"user.a": "1", "trusted.b": "2"}), "/l": (None, {"trusted.b": "2"}), "/d": (0o755, {}), "/d/e/g": (0o600, {})}
    folders = sorted(map(tuple, tree.read_directories(e).collect()))
    assert folders == [("/", "d", "5"), ("/", "f", "0"), ("/", "l", "2"), ("/d", "e", "5"), ("/d/e", "g", "0")]


def test_links_in_chains_and_rings(spark):
    links = [(f"/c{i}", f"c{i + 1}") for i in range(30)] + [("/ring", "/ring2"), ("/ring2", "ring"), ("/deep/x", "../c25/y")]
    paths = ["/c0/z", "/ring", "/deep/x/w", "/none", "/c5/../c29", "/"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = tree.resolve(df, spark.createDataFrame(links, "path string, linkname string")).collect()
    assert {r["path"]: r["resolved"] for r in got} == {"/c0/z": "/c30/z", "/ring": None, "/deep/x/w": "/c30/y/w", "/none": "/none", "/c5/../c29": "/c30", "/": "/"}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sums_over_groups_of_bins(spark, keys):
    """Positions far apart: many groups of bins, most with few bins; negative positions too."""
    rng = random.Random(8)
    rows = [(rng.randrange(3), p, rng.randrange(-5, 9)) for p in rng.sample(range(-300_000, 900_000), 600)]
    got = running_sum(spark.createDataFrame(rows, "k long, p long, v long"), keys, "p", F.col("v"), 16, "s").collect()
    want = {(k, p): sum(w for j, q, w in rows if q < p and (not keys or j == k)) for k, p, _ in rows}
    assert {(r["k"], r["p"]): r["s"] for r in got} == want
