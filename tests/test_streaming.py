from layerframe.operators import overlay
from layerframe.streaming import extents


def cover(rows):
    return {(r["dev"], s): (r["zeroed"], None if r["zeroed"] else r["moff"] + s - r["lo"]) for r in rows for s in range(r["lo"], r["hi"])}


def test_stream_equals_batch(spark, tmp_path):
    writes = spark.range(200).selectExpr("id % 3 AS dev", "0 AS layer", "id AS write_seq", "(id * 37) % 400 AS lo", "(id * 37) % 400 + 1 + id % 40 AS hi", "id * 100 AS moff", "id % 5 = 0 AS zeroed")
    want = cover(overlay.insert_all(writes).collect())
    src = str(tmp_path / "in")
    for i in range(3):
        writes.where(f"write_seq % 3 = {i}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = extents.stream_lww(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert cover(spark.read.parquet(str(tmp_path / "state" / "v2")).collect()) == want


def test_ttl_stream(spark, tmp_path):
    spark.sql("SELECT 'k' AS k, timestamp_seconds(s) AS ts FROM VALUES (0), (5), (31) AS t(s)").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = extents.ttl_cache(s, "k", 30).writeStream.format("memory").queryName("ttl_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["hit"] for r in spark.sql("SELECT * FROM ttl_out ORDER BY ts").collect()] == [False, True, False]


def test_bucketed_stream(spark, tmp_path):
    writes = spark.range(240).selectExpr("id % 3 AS dev", "0 AS layer", "id AS write_seq", "65000 + (id * 37) % 900 AS lo", "65000 + (id * 37) % 900 + 1 + id % 90 AS hi", "id * 100 AS moff", "id % 5 = 0 AS zeroed")
    want = cover(overlay.insert_all(writes).collect())
    src, table = str(tmp_path / "in"), str(tmp_path / "state")
    for i in range(4):
        writes.where(f"write_seq % 4 = {i}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(src)
    extents.stream_lww_bucketed(stream, table, str(tmp_path / "ck"), 4).awaitTermination()
    assert cover(extents.bucketed_state(spark, table).collect()) == want
    kept = extents._versions(spark, table)
    assert kept and all(len(v) <= 2 for v in kept.values())
    assert extents.bucketed_state(spark, str(tmp_path / "none")).count() == 0


def test_convert_twice(spark, tmp_path):
    folder, out = tmp_path / "files", str(tmp_path / "out")
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.bin").write_bytes(b"x" * (i + 1))
    for ck in ("a", "b"):  # a new checkpoint folder makes the batch run again
        extents.convert_files(spark, str(folder), out, str(tmp_path / ck), lambda df: df.select("length")).awaitTermination()
    assert sorted(r["length"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
