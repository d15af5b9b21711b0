import io
import random
import tarfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from layerframe.functions import checksums, codecs
from layerframe.functions import scalars as sc
from layerframe.operators import blocks, cache, trace, tree
from layerframe.sources import block_file, config, layer_blob, qcow2, tar


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("path", "want"), [
    ("/tar_test///busybox", "/tar_test/busybox"), ("/tar_test/./busybox", "/tar_test/busybox"), ("/tar_test/bin/../busybox", "/tar_test/busybox"),
    ("/tar_test/bin/./../busybox", "/tar_test/busybox"), ("/tar_test/test/bin/./../../busybox", "/tar_test/busybox"), ("/.././tar_test/./test/bin/../busybox", "/tar_test/test/busybox"),
    (".././tar_test/./test/bin/../busybox", "../tar_test/test/busybox"), ("", "."), ("./", "."), ("/", "/"), ("tar_test/", "tar_test"), ("../..", "../..")])
def test_clean_path(spark, path, want):
    assert one(spark, sc.clean_path(F.lit(path)))[0] == want


def test_scalars(spark):
    r = one(spark, sc.query_params(F.lit("dev_id=a%20b&config=x=y&flag&dev_id=2")).alias("p"), sc.basic_credentials(F.lit("dXNlcjpwOnc=")).alias("c"),
            sc.challenge_map(F.lit('Bearer realm="https://a/t",service="s",scope="x,y"')).alias("m"), sc.pax_record(F.lit("path"), F.lit("x" * 91)).alias("x"),
            sc.blob_segments(F.lit("https://h/v2/ns/img/blobs/sha")).alias("s"), sc.is_uuid(F.lit("d2637e65-4494-4c08-d2a2-c8ec4fcfae8a")).alias("u"),
            sc.big_endian(F.unhex(F.lit("00010203")), 0, 4).alias("b"), sc.config_and_device(F.lit("path/to/config.v1.json;123")).alias("d"))
    assert r["p"] == {"dev_id": "2", "config": "x=y", "flag": ""}
    assert tuple(r["c"]) == ("user", "p:w") and tuple(r["d"]) == ("path/to/config.v1.json", "123")
    assert r["m"] == {"Bearer realm": "https://a/t", "service": "s", "scope": "x,y"}
    assert len(r["x"]) == int(r["x"].split(" ")[0]) and r["s"] == ["h", "ns", "img"] and r["u"] and r["b"] == 0x010203
    size = 10 << 20
    for off, n, want in ((0, 5, 5), (-1, 5, -1), (size, 1, 0), (size - 1, 2, 1), (size - 400, 1000, 400), (size + 5, 1, 0)):
        assert one(spark, sc.clamp_read(F.lit(off), F.lit(n), F.lit(size)))[0] == want


def test_crc_and_blocks(spark):
    # the inverted form of this sum has a well-known check value
    assert checksums.extend(b"123456789", 0xFFFFFFFF) ^ 0xFFFFFFFF == 0xE3069283
    data = [random.Random(i).randbytes(i * 37 % 500) for i in range(50)]
    assert checksums.extend_many(data, checksums.SALT).tolist() == [checksums.extend(d, checksums.SALT) for d in data]
    raw = random.Random(5).randbytes(3000) + b"z" * 9000
    files = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b""))], "file_id long, data binary")
    for algo in ("lz4", "zstd"):
        packed = blocks.compress(blocks.split_blocks(files), algo)
        assert blocks.validate(packed).count() == 0
        assert bytes(blocks.join_blocks(blocks.decompress(packed, algo)).first()["data"]) == raw
        broken = packed.withColumn("crc", F.when(F.col("block_id") == 1, F.col("crc") + 1).otherwise(F.col("crc")))
        assert [r["block_id"] for r in blocks.decompress(broken, algo).where("NOT ok").collect()] == [1]


@pytest.mark.parametrize("algo", ["lz4", "zstd"])
@pytest.mark.parametrize("verify", [False, True])
@pytest.mark.parametrize("size", [4096, 65536])
def test_block_file(algo, verify, size):
    raw = random.Random(9).randbytes(50_000) + b"q" * 100_001
    data = block_file.compress(raw, algo, size, verify)
    f = block_file.Reader(data)
    rng = random.Random(1)
    for _ in range(50):
        o, n = rng.randrange(len(raw)), rng.randrange(20_000)
        assert f.read(o, n) == raw[o : o + n]
    assert block_file.status(data) == 1 and block_file.status(b"x" * 600) == 0
    assert block_file.status(data[:400] + b"\1\2\3\4" + data[404:]) == -1
    if verify:
        assert f.validate() == []
        bad = block_file.Reader(data[:8192] + bytes(512) + data[8704:])
        assert bad.validate()


def test_layer_blob():
    import pandas as pd

    rows = pd.DataFrame({"lo": [0, 100, 50], "hi": [10, 130, 60], "moff": [8, 18, 18], "zeroed": [False, False, True]})
    blob = layer_blob.write(rows, b"d" * 5000, layer_blob.Header(virtual_size=1 << 20, uuid="u", parent_uuid="p", user_tag=b"t"))
    head, got = layer_blob.parse(blob)
    assert (head.uuid, head.parent_uuid, head.virtual_size, head.user_tag) == ("u", "p", 1 << 20, b"t")
    assert got.to_dict("list") == rows.sort_values("lo").to_dict("list")
    with pytest.raises(ValueError):
        layer_blob.parse(b"\0" * 9000)


def test_tar(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, data in (("a/b.txt", b"hello"), ("n" * 150, b""), ("é" * 80, b"x" * 600)):
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), 0o640
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "a/b.txt"
        t.addfile(link)
    raw = buf.getvalue()
    got = tar.read(spark.createDataFrame([(0, bytearray(raw))], "layer int, data binary")).orderBy("seq").collect()
    assert [r["path"] for r in got] == ["a/b.txt", "n" * 150, "é" * 80, "l"]
    assert raw[got[0]["data_offset"] :][: got[0]["size"]] == b"hello" and got[3]["linkname"] == "a/b.txt" and got[0]["mode"] == 0o640
    with pytest.raises(ValueError):
        list(tar.entries(b"\1" * 512 + raw))


def test_tree_against_model(spark):
    rng, rows, model = random.Random(11), [], {}
    for layer in range(6):
        mine, marks = {}, []
        for seq in range(30):
            d, n = f"/d{rng.randrange(4)}", f"f{rng.randrange(6)}"
            kind = rng.random()
            if kind < 0.15:
                marks.append((f"{d}/{n}", False))
                rows.append((layer, seq, f"{d}/.wh.{n}", "0"))
            elif kind < 0.22:
                marks.append((d, True))
                rows.append((layer, seq, f"{d}/.wh..wh..opq", "0"))
            else:
                mine[f"{d}/{n}"] = (layer, seq)
                rows.append((layer, seq, f"{d}/{n}", "0"))
        for target, opaque in marks:
            model = {p: v for p, v in model.items() if not (p.startswith(target + "/") or (not opaque and p == target))}
        model |= mine
    got = tree.merge(spark.createDataFrame(rows, "layer int, seq long, path string, typeflag string"))
    assert {r["path"]: (r["layer"], r["seq"]) for r in got.collect()} == model
    swap = spark.createDataFrame([(0, 0, "/a/b", "0"), (0, 1, "/a/b/c", "0"), (1, 0, "/a", "2"), (1, 1, "/a/x", "0")], "layer int, seq long, path string, typeflag string")
    assert sorted(r["path"] for r in tree.replace_types(swap).collect()) == ["/a", "/a/x"]
    links = spark.createDataFrame([("/a", "b/../c"), ("/c/d", "/e")], "path string, linkname string")
    paths = spark.createDataFrame([("/a/d/f",), ("/x",)], "path string")
    assert {r["path"]: r["resolved"] for r in tree.resolve(paths, links).collect()} == {"/a/d/f": "/e/f", "/x": "/x"}


def test_cache(spark):
    ext = spark.createDataFrame([("f", 0, 8192), ("f", 8192, 12288), ("f", 40960, 49152)], "file string, lo long, hi long")
    reads = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 4096, 20000), ("f", 3, 12000, 30000), ("g", 4, 5, 5)], "file string, req_id long, offset long, count long")
    got = {r["req_id"]: (r["refill_offset"], r["refill_count"]) for r in cache.miss_range(reads, ext, 4096).collect()}
    assert got == {1: (0, 0), 2: (12288, 12288), 3: (12288, 28672), 4: (0, 4096)}


def plain_eviction(log, watermark):
    """The cache's rule as it reads: a list with the last used file first."""
    order, size, opened, used, out = [], {}, {}, 0, []
    for seq, file, now, count, short in log:
        used += max(0, now - size.get(file, 0))
        size[file], opened[file] = now, count
        order = [file, *(f for f in order if f != file)]
        left = min(max(used - watermark if used >= watermark else 0, short), used)
        for _ in range(10 * len(order)):
            if left <= 0 or not order:
                break
            victim, freed = order[-1], size[order[-1]]
            order.pop()
            if opened[victim]:
                order.insert(0, victim)
                size[victim] = 0
            else:
                del size[victim]
            if freed:
                out.append((seq, victim, freed, opened[victim] > 0))
                used, left = used - freed, left - freed
    return out


def test_eviction(spark):
    rng = random.Random(9)
    rows = []
    for pool in (1, 2, None):
        rows += [(pool, i, rng.choice("abcdefgh"), rng.choice([0, 5, 10, 30]), int(rng.random() < 0.3), rng.choice([0, 0, 0, 0, 25, 10**6])) for i in range(200)]
    log = spark.createDataFrame(rows, "pool int, seq long, file string, len long, open_count int, disk_short long")
    got = cache.evict_lru(log, ["pool"], 60).collect()
    for pool in (1, 2, None):
        want = plain_eviction([r[1:] for r in rows if r[0] == pool], 60)
        assert len(want) > 20 and sorted((r["seq"], r["victim"], r["freed"], r["kept_open"]) for r in got if r["pool"] == pool) == sorted(want)
    few = spark.createDataFrame([(1, i, f, 10, int(f == "a")) for i, f in enumerate("abcabd")], "pool int, seq long, file string, len long, open_count int")
    out = cache.evict_lru(few, ["pool"], 25).orderBy("seq").collect()
    assert [(r["seq"], r["victim"], r["freed"], r["kept_open"]) for r in out] == [(2, "a", 10, True), (3, "b", 10, False), (4, "c", 10, False), (5, "a", 10, True)]


def test_thinning_against_fold(spark):
    rng, span = random.Random(3), 100
    cand = sorted({rng.randrange(0, 3000) // rng.choice([1, 100]) * rng.choice([1, 100]) for _ in range(120)})
    cand = [c for c in cand if c < 3000]
    kept, last, expected = [], None, 0
    for c in cand:
        if c < expected:
            last = c
            continue
        if c > expected:
            if last is not None:
                kept.append(last)
            last = c
            while expected < c:
                expected += span
        if c == expected:
            last = None
            kept.append(c)
            expected += span
    df = spark.createDataFrame([(1, c) for c in cand], "file_id long, de_pos long")
    assert sorted(r["de_pos"] for r in blocks.thin(df, span, 500).collect()) == kept


def test_streams_and_formats(spark, tmp_path):
    raw = random.Random(2).randbytes(5000)
    data = codecs.gzip_stream(raw)
    for o, n in ((0, 10), (699, 5), (1400, 900), (4990, 100)):
        assert codecs.gzip_read(data + data, o, n) == (raw + raw)[o : o + n]
    assert codecs.detect(data) == "gzip" and config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    disk = bytearray(1 << 20)
    disk[510:512] = b"\x55\xaa"
    disk[446:462] = bytes([0, 0, 0, 0, 0x83, 0, 0, 0]) + (64).to_bytes(4, "little") + (100).to_bytes(4, "little")
    assert qcow2.partitions(bytes(disk)) == [{"number": 1, "lo": 64, "hi": 164}]
    got = config.parse_images(spark.createDataFrame([('{"lowers":[{"file":"x"}]}',), ("{",)], "value string")).collect()
    assert got[0]["lowers"][0]["file"] == "x" and got[0]["acceleration_layer"] is False


def test_ttl(spark):
    rows = spark.sql("SELECT 'k' AS k, timestamp_seconds(s) AS ts FROM VALUES (0), (5), (29), (31), (40), (62) AS t(s)")
    got = [r["hit"] for r in trace.ttl_hits(rows, "k", "ts", 30).orderBy("ts").collect()]
    assert got == [False, True, True, False, True, False]


def test_batches_are_taken_in_bounded_parts(spark, monkeypatch):
    """However many rows an Arrow batch has, Python takes out PART bytes at once, or one row."""
    data = [b"x" * 10, None, b"", b"y" * 25, b"z" * 3] * 20
    batch = pa.RecordBatch.from_pydict({"file_id": list(range(100)), "data": pa.array(data, pa.binary())})
    got = list(codecs.parts(batch, most=30))
    assert pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
    sizes = [sum(len(x or b"") for x in b.column("data").to_pylist()) for b in got]
    assert max(sizes) <= 30 and len(got) > 20
    assert all(b.num_rows for b in codecs.parts(batch, most=1))
    assert not list(codecs.parts(batch.slice(0, 0)))
    monkeypatch.setattr(codecs, "PART", 64)
    kind = StructType.fromDDL("n int, file_id long")
    seen = []
    made = codecs.by_parts(lambda pdf: (seen.append(len(pdf)), pd.DataFrame({"n": [len(pdf)] * len(pdf), "file_id": pdf["file_id"]}))[1], kind)
    assert [i for b in made(iter([batch])) for i in b.column("file_id").to_pylist()] == list(range(100)) and max(seen) < 20


def test_lru_goes_through_batches(spark):
    """A pool is not gathered in one frame: its log comes batch by batch, and pools follow each other in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        log = spark.range(400).selectExpr("cast(id % 3 AS int) AS pool", "id AS seq", "concat('f', id * 7 % 11) AS file", "10 + id % 5 AS len", "cast(id % 4 = 0 AS int) AS open_count")
        small = cache.evict_lru(log, ["pool"], 60)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
        small = sorted(map(tuple, small.collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert small == sorted(map(tuple, cache.evict_lru(log, ["pool"], 60).collect())) and len(small) > 100
        assert {r[0] for r in small} == {0, 1, 2}
        for p in range(3):
            assert [r[1:] for r in small if r[0] == p] == sorted(tuple(r)[1:] for r in cache.evict_lru(log.where(f"pool = {p}"), ["pool"], 60).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
