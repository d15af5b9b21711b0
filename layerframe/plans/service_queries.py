"""Queries on stacks, requests, index records, file attributes, disk images and small text functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from layerframe.functions import codecs
from layerframe.functions import scalars as sc
from layerframe.operators import blocks, layers, overlay, service, tree
from layerframe.sources import block_file, layer_files, qcow2

from . import fixtures as fx
from .more_queries import REPLACED, entries
from .queries import FLAT, HITS, ORACLES, flat, query


@query(f"{FLAT} SELECT * FROM flat")
def freeze_index(spark, sf):
    """The merged index made read-only: written once and read from there."""
    return layers.freeze(flat(spark, sf), layer_files.shared_folder(spark, "frozen"))


@query(f"""{ORACLES['overlay_two_level'].removesuffix(' SELECT * FROM flat')}, {fx.READS}, {HITS} SELECT * FROM hits""")
def combo_lookup(spark, sf):
    """Ranges looked up in the writable layers first, in the layers below where those have nothing."""
    s = fx.segments(spark, sf)
    both = overlay.combine(overlay.flatten(s.where("layer >= 5")), overlay.flatten(s.where("layer < 5")))
    return overlay.lookup(both, fx.reads(spark, sf))


@query(f"{ORACLES['overlay_lww_insert'].removesuffix(' SELECT * FROM flat')}, {fx.READS}, {HITS} SELECT * FROM hits")
def writable_lookup(spark, sf):
    """Ranges looked up in the mappings after all writes, the last writer winning."""
    return overlay.lookup(overlay.insert_all(fx.segments(spark, sf)), fx.reads(spark, sf))


LOWER = """lower_layers AS (SELECT s_nationkey AS dev, row_number() OVER w AS layer, md5(s_suppkey::VARCHAR) AS uuid, (s_suppkey % 4) * 1024 AS virtual_size,
md5((CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE lag(s_suppkey) OVER w END)::VARCHAR) AS parent_uuid FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))"""


@query(f"""WITH {LOWER}, b AS (SELECT *, lag(uuid) OVER (PARTITION BY dev ORDER BY layer) AS below FROM lower_layers),
g AS (SELECT dev, count(*) AS n, arg_max(virtual_size, layer) AS size, bool_or(below IS NOT NULL AND below IS DISTINCT FROM parent_uuid) AS wrong FROM b GROUP BY dev),
u AS (SELECT n_nationkey AS dev, (n_nationkey % 2) * 4096 AS size FROM nation)
SELECT u.dev, CASE WHEN wrong THEN 'wrong parent' ELSE 'ok' END AS status, coalesce(n, 0) + 1 AS n_layers, CASE WHEN u.size = 0 THEN coalesce(g.size, 0) ELSE u.size END AS virtual_size FROM u LEFT JOIN g ON u.dev = g.dev""")
def stack_checked(spark, sf):
    fx.table(spark, sf, "supplier").createOrReplaceTempView("_supplier")
    lower = spark.sql("""SELECT s_nationkey AS dev, row_number() OVER w AS layer, md5(CAST(s_suppkey AS STRING)) AS uuid, (s_suppkey % 4) * 1024 AS virtual_size,
        md5(CAST(CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE lag(s_suppkey) OVER w END AS STRING)) AS parent_uuid FROM _supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
    upper = fx.table(spark, sf, "nation").selectExpr("n_nationkey AS dev", "(n_nationkey % 2) * 4096 AS virtual_size")
    return service.stack(upper, lower)


@query("""WITH r AS (SELECT c_custkey AS req_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'dev ' || (c_custkey % 40) END AS dev_id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '/etc/' || (c_custkey % 30) || '.json' END AS config, c_custkey % 40 AS d, c_custkey % 30 AS f FROM customer),
c AS (SELECT req_id, dev_id, config, CASE WHEN dev_id = '' OR config = '' THEN 400 WHEN d >= 25 THEN 404 WHEN f >= 25 OR f % 5 = 4 OR d = f OR d % 3 = f % 3 THEN 500 ELSE 200 END::INT AS code FROM r)
SELECT *, CASE code WHEN 200 THEN 'Snapshot created successfully' WHEN 400 THEN 'Missing dev_id or config in snapshot request' WHEN 404 THEN 'Image file not found' ELSE 'Failed to create snapshot' END AS message FROM c""")
def snapshot_codes(spark, sf):
    c = fx.table(spark, sf, "customer").selectExpr("c_custkey AS req_id", """concat('/snapshot?', CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('dev_id=dev%20', c_custkey % 40, '&') END,
        CASE WHEN c_custkey % 13 = 0 THEN 'config=' ELSE concat('config=%2Fetc/', c_custkey % 30, '.json') END) AS target""")
    n = fx.table(spark, sf, "nation")
    images = n.selectExpr("concat('dev ', n_nationkey) AS dev_id", "concat('data', n_nationkey) AS data", "concat('index', n_nationkey % 3) AS index")
    configs = n.where("n_nationkey % 5 <> 4").selectExpr("concat('/etc/', n_nationkey, '.json') AS config", "concat('data', n_nationkey) AS data", "concat('index', n_nationkey % 3) AS index")
    return service.snapshot_requests(c, images, configs)


@query(f"""WITH {fx.SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY dev, layer ORDER BY write_seq, lo, hi, moff, zeroed) - 1 AS rn FROM segments),
n AS (SELECT dev, layer, count(*) AS n FROM segments GROUP BY dev, layer)
SELECT dev, layer, write_seq, lo, hi, moff, zeroed, rn // 64 AS group_id, (rn % 64)::INT AS slot, true AS valid FROM r
UNION ALL SELECT dev, layer, NULL, NULL, NULL, NULL, NULL, n // 64, unnest(generate_series(n % 64, 63))::INT, false FROM n WHERE n % 64 <> 0""")
def group_commit(spark, sf):
    return service.group_commit(fx.segments(spark, sf), 64)


@query("""SELECT concat('/', p_partkey) AS path, p_size::BIGINT AS uid, (p_size + 1)::BIGINT AS gid, p_partkey * 1000 AS mtime, CASE WHEN p_partkey % 4 <> 2 THEN (p_partkey * 7) % 4096 END AS mode,
array_to_string(list_sort(list_concat(CASE WHEN p_partkey % 3 = 0 THEN ['security.x=' || p_type] ELSE [] END, CASE WHEN p_partkey % 4 IN (0, 1) THEN ['user.brand=' || p_brand] ELSE [] END)), ';') AS xattrs FROM part""")
def tar_attributes(spark, sf):
    """Owner, time, mode and extended attributes of entries that are files, directories, symbolic links and devices in turn."""
    p = fx.table(spark, sf, "part").selectExpr(
        "concat('/', p_partkey) AS path", "element_at(array('0', '5', '2', '3'), cast(p_partkey % 4 AS int) + 1) AS typeflag", "cast(p_size AS bigint) AS uid", "cast(p_size + 1 AS bigint) AS gid",
        "p_partkey * 1000 AS mtime", "32768 + (p_partkey * 7) % 4096 AS mode",
        "map_concat(map('path', p_type, 'SCHILY.xattr.user.brand', p_brand), CASE WHEN p_partkey % 3 = 0 THEN map('SCHILY.xattr.security.x', p_type) ELSE map() END) AS pax")
    flatly = F.array_join(F.array_sort(F.transform(F.map_entries("xattrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return tree.attributes(p).withColumn("xattrs", flatly)


@query(rf"""WITH {REPLACED}, m AS (SELECT path, arg_max(typeflag, layer * 1000000000::BIGINT + seq) AS typeflag FROM rep GROUP BY path),
ups AS (SELECT DISTINCT '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:i], '/') AS path
  FROM (SELECT path, unnest(generate_series(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) - 1)) AS i FROM m)),
p AS (SELECT path, typeflag FROM m UNION ALL SELECT path, '5' FROM ups WHERE path NOT IN (SELECT path FROM m))
SELECT CASE WHEN f = '' THEN '/' ELSE f END AS folder, name, typeflag AS kind FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS f, regexp_extract(path, '[^/]*$') AS name, typeflag FROM p)""")
def tree_directories(spark, sf):
    return tree.read_directories(tree.merge(entries(spark, sf)))


@query("""WITH b AS (SELECT doc_id AS file_id, unnest(generate_series(0, (octet_length(encode(text)) - 1) // 4096)) AS block_id FROM documents WHERE octet_length(encode(text)) > 0)
SELECT file_id, block_id, CASE WHEN (file_id + block_id) % 5 = 0 THEN 'none' ELSE 'differs' END AS stored FROM b WHERE (file_id + block_id) % 5 IN (0, 1)""")
def block_validation(spark, sf):
    """Blocks that fail their check: of every five one has lost its sum, and one has a wrong last byte."""
    d = fx.table(spark, sf, "documents").selectExpr("doc_id AS file_id", "cast(text AS binary) AS data")
    packed = blocks.compress(blocks.split_blocks(d))
    kind, n = (F.col("file_id") + F.col("block_id")) % 5, F.length("data")
    other = F.unhex(F.when(F.substring("data", -1, 1) == F.unhex(F.lit("00")), "01").otherwise("00"))
    damaged = packed.withColumns({"crc": F.when(kind != 0, F.col("crc")), "data": F.when(kind == 1, F.concat(F.substring("data", F.lit(1), n - 1), other)).otherwise(F.col("data"))})
    return blocks.validate(damaged).select("file_id", "block_id", F.when(F.col("crc").isNull(), "none").otherwise("differs").alias("stored"))


FILES = StructType([StructField("file_id", LongType()), StructField("data", BinaryType())])


def _packed(pack):
    """A function for mapInArrow that packs each file."""
    return codecs.by_parts(lambda pdf: pd.DataFrame({"file_id": pdf["file_id"], "data": [None if b is None else pack(bytes(b)) for b in pdf["data"]]}), FILES)


@query("SELECT doc_id AS file_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN -1 ELSE 0 END::INT AS status FROM documents")
def block_file_status(spark, sf):
    """Block files told from damaged ones (a byte of the header differs) and from others (a byte of the magic differs)."""
    d = fx.table(spark, sf, "documents").selectExpr("doc_id AS file_id", "cast(text AS binary) AS data")
    files = d.mapInArrow(_packed(block_file.compress), FILES)
    at = F.when(F.col("file_id") % 3 == 1, 61).otherwise(2)  # a byte of the field for the data's size, or of the magic
    changed = F.concat(F.substring("data", F.lit(1), at - 1), F.unhex(F.lit("5A")), F.substring("data", at + 1, F.length("data")))
    return block_file.statuses(files.withColumn("data", F.when(F.col("file_id") % 3 == 0, F.col("data")).otherwise(changed)))


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'no data' ELSE 'ok' END AS status, sha256(encode(text) || from_hex(repeat('00', ((512 - n % 512) % 512)::INT))) AS digest,
CASE WHEN text IS NULL THEN 1 ELSE (n + 511) // 512 END AS n_clusters FROM (SELECT *, octet_length(encode(text)) AS n FROM documents)""")
def disk_image_read(spark, sf):
    """Texts as disk images with plain, deflated and absent clusters: their cluster maps, and what a guest reads."""
    d = fx.table(spark, sf, "documents").selectExpr("doc_id AS file_id", "cast(text AS binary) AS data")
    images = d.mapInArrow(_packed(qcow2.pack), FILES)
    maps = qcow2.read_clusters(images).groupBy("file_id").agg(F.count("*").alias("n_clusters"))
    got = qcow2.read_images(images).select("file_id", "status", F.sha2("data", 256).alias("digest"))
    return got.join(maps, "file_id", "left").select(F.col("file_id").alias("doc_id"), "status", "digest", F.coalesce("n_clusters", F.lit(0).cast("long")).alias("n_clusters"))


@query(r"""SELECT p_partkey, trim('  ' || p_type || ' ', ' ') AS trimmed, p_brand AS a, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '1+1' END AS b, p_brand AS username, 'x:' || p_type AS password,
'https://auth/' || p_size AS realm, 'repository:' || p_partkey || ':pull,push' AS scope, p_partkey % 3 > 0 AS uuid, p_partkey AS number,
(octet_length(encode(' k=' || p_type || chr(10))) + 2) || ' k=' || p_type || chr(10) AS record FROM part""")
def text_functions(spark, sf):
    """Trimming, parameters, credentials, challenges, identifiers, big-endian numbers and extended records."""
    p = fx.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    params = sc.query_params(F.concat(F.lit("a="), F.regexp_replace("p_brand", "#", "%23"), F.when(F.col("p_partkey") % 2 == 0, "&b").otherwise("&b=0&b=1%2B1"), F.lit("&")))
    cred = sc.basic_credentials(F.base64(F.concat("p_brand", F.lit(":x:"), "p_type")))
    ask = sc.challenge_map(F.concat(F.lit('realm="https://auth/'), "p_size", F.lit('",scope="repository:'), key, F.lit(':pull,push"')))
    name = F.concat(F.lit("0f8fad5b-d9cb-469f-a165-"), F.lpad(key, 12, "0"))
    return p.select(
        "p_partkey", sc.trim_char(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"), params["a"].alias("a"), params["b"].alias("b"), cred["username"].alias("username"), cred["password"].alias("password"),
        ask["realm"].alias("realm"), ask["scope"].alias("scope"), sc.is_uuid(F.when(F.col("p_partkey") % 3 > 0, name).otherwise(F.concat(name, F.lit("0")))).alias("uuid"),
        sc.big_endian(F.unhex(F.lpad(F.hex("p_partkey"), 16, "0")), 2, 6).alias("number"), sc.pax_record(F.lit("k"), F.col("p_type")).alias("record"))
