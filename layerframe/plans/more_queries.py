"""Queries on trees, blocks, caches and traces, and on scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from layerframe.functions import scalars as sc
from layerframe.functions.checksums import crc32c_salted
from layerframe.operators import blocks, cache, layers, trace, tree
from layerframe.sources import config

from . import fixtures as fx
from .queries import FLAT, ORACLES, flat, query

# ---- trees

TREE = """e0 AS (SELECT p_size % 5 AS layer, p_partkey AS seq, '/' || replace(p_brand, '#', '') || '/' || p_type AS dir, p_partkey FROM part),
entries AS (SELECT layer::INT AS layer, seq, CASE WHEN p_partkey % 97 = 0 THEN dir || '/.wh..wh..opq' WHEN p_partkey % 11 = 0 THEN dir || '/.wh.' || (p_partkey % 50)
  WHEN p_partkey % 13 = 0 THEN dir WHEN p_partkey % 17 = 0 THEN dir || '/' || (p_partkey % 50) || '/x' ELSE dir || '/' || (p_partkey % 50) END AS path,
  CASE WHEN p_partkey % 13 = 0 THEN '5' ELSE '0' END AS typeflag, p_partkey * 100 AS size FROM e0)"""


def entries(spark, sf):
    e = fx.table(spark, sf, "part").selectExpr("CAST(p_size % 5 AS INT) AS layer", "p_partkey AS seq", "concat('/', replace(p_brand, '#', ''), '/', p_type) AS dir", "p_partkey")
    path = """CASE WHEN p_partkey % 97 = 0 THEN concat(dir, '/.wh..wh..opq') WHEN p_partkey % 11 = 0 THEN concat(dir, '/.wh.', p_partkey % 50)
        WHEN p_partkey % 13 = 0 THEN dir WHEN p_partkey % 17 = 0 THEN concat(dir, '/', p_partkey % 50, '/x') ELSE concat(dir, '/', p_partkey % 50) END"""
    return e.selectExpr("layer", "seq", f"{path} AS path", "CASE WHEN p_partkey % 13 = 0 THEN '5' ELSE '0' END AS typeflag", "p_partkey * 100 AS size")


WHITEOUT = TREE + r""", parts AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/[^/]*$', '') AS folder FROM entries),
marks AS (SELECT DISTINCT CASE WHEN base = '.wh..wh..opq' THEN folder ELSE folder || '/' || substr(base, 5) END AS target, base = '.wh..wh..opq' AS opaque, layer AS ml FROM parts WHERE starts_with(base, '.wh.')),
kept AS (SELECT layer, seq, path, typeflag, size FROM parts p WHERE NOT starts_with(base, '.wh.') AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.ml > p.layer AND (starts_with(p.path, m.target || '/') OR (NOT opaque AND p.path = m.target))))"""
REPLACED = WHITEOUT + """, rep AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept b WHERE b.typeflag <> '5' AND starts_with(k.path, b.path || '/') AND (b.layer > k.layer OR (b.layer = k.layer AND b.seq > k.seq))))"""


@query(f"WITH {WHITEOUT} SELECT layer, seq, path, typeflag, size FROM kept")
def whiteout_apply(spark, sf):
    return tree.apply_whiteouts(entries(spark, sf))


@query(f"WITH {REPLACED} SELECT * FROM rep")
def type_replace(spark, sf):
    return tree.replace_types(tree.apply_whiteouts(entries(spark, sf)))


@query(f"WITH {REPLACED} SELECT path, layer, seq, typeflag, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY layer DESC, seq DESC) AS rn FROM rep) WHERE rn = 1")
def tree_merge(spark, sf):
    return tree.merge(entries(spark, sf))


@query(f"""WITH {WHITEOUT}, ups AS (SELECT DISTINCT '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:i], '/') AS path
  FROM (SELECT path, unnest(generate_series(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) - 1)) AS i FROM kept)),
named AS (SELECT path, bool_or(typeflag = '5') AS d FROM kept GROUP BY path)
SELECT ups.path, 493 AS mode, d IS NOT NULL AS conflict FROM ups LEFT JOIN named USING (path) WHERE d IS NULL OR NOT d""")
def implicit_dirs(spark, sf):
    return tree.implicit_directories(tree.apply_whiteouts(entries(spark, sf)))


DUMP = TREE + """, dump AS (SELECT layer, seq, path, typeflag, size, 512 * coalesce(sum(1 + CASE WHEN typeflag = '0' THEN ceil(size / 512.0)::BIGINT ELSE 0 END) OVER (PARTITION BY layer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS header_offset FROM entries)"""


@query(f"WITH {DUMP} SELECT *, header_offset + 512 AS data_offset FROM dump")
def tar_header_dump(spark, sf):
    return tree.header_dump(entries(spark, sf))


@query(f"""WITH {DUMP} SELECT layer, path, coalesce(sum(4096 * ceil(size / 4096.0)::BIGINT) OVER (PARTITION BY layer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", size AS count, header_offset + 512 AS roffset
FROM dump WHERE typeflag = '0' AND size > 0""")
def tar_remote_ranges(spark, sf):
    return tree.remote_ranges(tree.header_dump(entries(spark, sf)))


MESSY = "CASE p_partkey % 6 WHEN 0 THEN '/a/../../' || p_type || '//./x/' WHEN 1 THEN '../' || p_brand || '/./../y' WHEN 2 THEN './' WHEN 3 THEN '/' || p_brand || '/b/../../../c' WHEN 4 THEN p_type || '/' ELSE 'q/../..' || '/' || p_brand END"


@query(f"""WITH m AS (SELECT p_partkey, {MESSY} AS path FROM part),
f AS (SELECT p_partkey, path, list_reduce(list_concat([''], string_split(path, '/')), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc
  WHEN x = '..' THEN CASE WHEN acc = '' OR ends_with(acc, '/..') THEN CASE WHEN starts_with(path, '/') THEN acc ELSE acc || '/..' END ELSE regexp_replace(acc, '/[^/]*$', '') END ELSE acc || '/' || x END) AS c FROM m)
SELECT p_partkey, path, CASE WHEN starts_with(path, '/') THEN CASE WHEN c = '' THEN '/' ELSE c END WHEN c = '' THEN '.' ELSE substr(c, 2) END AS cleaned FROM f""")
def path_clean(spark, sf):
    return fx.table(spark, sf, "part").selectExpr("p_partkey", f"{MESSY.replace('||', '||')} AS path").withColumn("cleaned", sc.clean_path(F.col("path")))


NAMES = "p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS pax, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS gnu, CASE WHEN p_partkey % 2 = 0 THEN 'ustar' ELSE '' END AS magic, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'pre' END AS prefix, p_name AS name"


@query(f"SELECT p_partkey, coalesce(pax, gnu, CASE WHEN magic = 'ustar' AND prefix <> '' THEN prefix || '/' || name ELSE name END) AS pathname FROM (SELECT {NAMES} FROM part)")
def name_precedence(spark, sf):
    n = fx.table(spark, sf, "part").selectExpr(*[x.strip() for x in NAMES.split(", ")])
    return n.select("p_partkey", sc.effective_name(*[F.col(c) for c in ("pax", "gnu", "magic", "prefix", "name")]).alias("pathname"))


@query("""SELECT p_partkey, o AS field, d AS value, CASE WHEN d & 61440 <> 0 THEN d ELSE d | CASE t WHEN '2' THEN 40960 WHEN '3' THEN 8192 WHEN '4' THEN 24576 WHEN '5' THEN 16384 WHEN '6' THEN 4096 ELSE 32768 END END AS mode
FROM (SELECT p_partkey, lpad((p_partkey % 8)::VARCHAR || ((p_partkey // 8) % 8)::VARCHAR || '4', 7, '0') AS o, (64 * (p_partkey % 8) + 8 * ((p_partkey // 8) % 8) + 4)::BIGINT AS d, (p_partkey % 8)::VARCHAR AS t FROM part)""")
def octal_mode(spark, sf):
    o = fx.table(spark, sf, "part").selectExpr("p_partkey", "lpad(concat(p_partkey % 8, (p_partkey div 8) % 8, '4'), 7, '0') AS field", "cast(p_partkey % 8 AS string) AS t")
    v = sc.octal(F.col("field"))
    return o.select("p_partkey", "field", v.alias("value"), sc.mode_of(v, F.col("t"), F.lit("f")).alias("mode"))


# ---- blocks

BLK = "b AS (SELECT doc_id AS file_id, unnest(generate_series(0, (n_chars - 1) // 1024)) AS block_id, n_chars FROM documents WHERE n_chars > 0), l AS (SELECT file_id, block_id, least(1024, n_chars - block_id * 1024) + 4 AS comp_len FROM b)"


def lengths(spark, sf):
    d = fx.table(spark, sf, "documents").where("n_chars > 0").selectExpr("doc_id AS file_id", "explode(sequence(cast(0 AS bigint), (n_chars - 1) div 1024)) AS block_id", "n_chars")
    return d.selectExpr("file_id", "block_id", "least(1024, n_chars - block_id * 1024) + 4 AS comp_len")


@query(f"""WITH {BLK}, o AS (SELECT *, 512 + coalesce(sum(comp_len) OVER (PARTITION BY file_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM l),
p AS (SELECT *, min("offset") OVER (PARTITION BY file_id, block_id // 16) AS part_offset FROM o)
SELECT *, "offset" - part_offset AS delta, comp_len > 4 AND "offset" - part_offset < 65535 AS valid FROM p""")
def block_jump_table(spark, sf):
    return blocks.jump_table(lengths(spark, sf))


@query("""WITH r AS (SELECT event_id AS req_id, event_id % (SELECT count(*) FROM documents) AS file_id, (event_id * 37) % 5000 AS o, 1 + event_id % 3000 AS c FROM events),
s AS (SELECT req_id, file_id, o, least(o + c, n_chars) AS stop FROM r JOIN documents d ON d.doc_id = r.file_id WHERE o < n_chars),
x AS (SELECT *, unnest(generate_series(o // 1024, (stop - 1) // 1024)) AS block_id FROM s)
SELECT file_id, req_id, block_id, greatest(o, block_id * 1024) - block_id * 1024 AS skip, least(stop, (block_id + 1) * 1024) - greatest(o, block_id * 1024) AS take FROM x""")
def block_range_scan(spark, sf):
    d = fx.table(spark, sf, "documents")
    n = d.agg(F.count("*").alias("n"))
    r = fx.table(spark, sf, "events").join(F.broadcast(n)).selectExpr("event_id AS req_id", "event_id % n AS file_id", "(event_id * 37) % 5000 AS offset", "1 + event_id % 3000 AS count")  # one row
    return blocks.touched_blocks(r, d.selectExpr("doc_id AS file_id", "n_chars AS size"), 1024)


@query("""WITH p AS (SELECT o_custkey % 8 AS file_id, o_orderkey * 512 AS de_pos, max(o_orderkey * 128) AS en_pos FROM orders GROUP BY ALL),
r AS (SELECT event_id AS req_id, event_id % 8 AS file_id, (event_id * 7919) % 4000000 AS "offset" FROM events),
f AS (SELECT file_id, min(de_pos) AS de_pos, arg_min(en_pos, de_pos) AS en_pos FROM p GROUP BY file_id)
SELECT r.req_id, r.file_id, r."offset", coalesce(p.de_pos, f.de_pos) AS de_pos, coalesce(p.en_pos, f.en_pos) AS en_pos
FROM r ASOF LEFT JOIN p ON r.file_id = p.file_id AND r."offset" >= p.de_pos LEFT JOIN f ON f.file_id = r.file_id""")
def checkpoint_floor(spark, sf):
    return _floor(fx.table(spark, sf, "orders"), fx.table(spark, sf, "events"))


def _floor(orders, events):
    p = orders.selectExpr("o_custkey % 8 AS file_id", "o_orderkey * 512 AS de_pos", "o_orderkey * 128 AS en_pos").groupBy("file_id", "de_pos").agg(F.max("en_pos").alias("en_pos"))
    r = events.selectExpr("event_id AS req_id", "event_id % 8 AS file_id", "(event_id * 7919) % 4000000 AS offset")
    return blocks.checkpoint_floor(r, p, ["file_id"], 1 << 20)


@query("""WITH c AS (SELECT DISTINCT o_custkey % 5 AS file_id, o_orderkey * 256 AS de_pos FROM orders), n AS (SELECT *, lead(de_pos) OVER (PARTITION BY file_id ORDER BY de_pos) AS nxt FROM c)
SELECT file_id, de_pos FROM n WHERE de_pos % 65536 = 0 OR coalesce(nxt // 65536 > de_pos // 65536 AND nxt <> (de_pos // 65536 + 1) * 65536, false)""")
def span_thinning(spark, sf):
    c = fx.table(spark, sf, "orders").selectExpr("o_custkey % 5 AS file_id", "o_orderkey * 256 AS de_pos").distinct()
    return blocks.thin(c, 65536, 1 << 22)


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def blob_digest(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", sc.digest(F.col("text")).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def block_file_roundtrip(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id AS file_id", "cast(text AS binary) AS data")
    packed = blocks.compress(blocks.split_blocks(d))
    back = blocks.join_blocks(blocks.decompress(packed).where("ok").select("file_id", "block_id", "data"))
    empty = F.when(F.col("_null"), None).otherwise(F.coalesce("data", F.lit(b"")))  # a file without bytes has no block
    return d.select("file_id", F.col("data").isNull().alias("_null")).join(back, "file_id", "left").select(F.col("file_id").alias("doc_id"), F.sha2(empty, 256).alias("digest"))


@query()
def crc32c_block(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id AS file_id", "cast(text AS binary) AS data")
    return blocks.split_blocks(d).select("file_id", "block_id", crc32c_salted()("data").alias("crc"))


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'no data' ELSE 'ok' END AS status, n AS raw_size, 'sha256:' || sha256(text) AS digest, substr(h, (n // 2 * 2)::INT + 1, 128) AS piece
FROM (SELECT *, lower(hex(encode(text))) AS h, octet_length(encode(text)) AS n FROM documents)""")
def gzip_random_read(spark, sf):
    """Gzip streams without flushes, an index of each built from its deflate blocks, and 64 bytes from the middle of every text read through it."""
    from layerframe.sources import gzip_index
    from layerframe.sources.streams import gzip_streams

    d = fx.table(spark, sf, "documents").selectExpr("doc_id AS file_id", "cast(text AS binary) AS data")
    built = gzip_index.build_indexes(gzip_streams(d, memory=2), 1024)
    got = gzip_index.read_ranges(built.withColumns({"offset": F.expr("coalesce(raw_size, 0) div 2"), "count": F.lit(64)}))
    return got.select(F.col("file_id").alias("doc_id"), "status", "raw_size", "digest", F.lower(F.hex("piece")).alias("piece"))


# ---- caches


def _cached(spark, sf):
    return flat(spark, sf).where("NOT zeroed").selectExpr("dev AS file", "lo * 512 AS lo", "hi * 512 AS hi")


@query(f"""{FLAT}, {fx.READS}, e AS (SELECT dev AS file, lo * 512 AS lo, hi * 512 AS hi FROM flat WHERE NOT zeroed),
x AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY file ORDER BY lo) = lo THEN 0 ELSE 1 END AS brk FROM e), y AS (SELECT *, sum(brk) OVER (PARTITION BY file ORDER BY lo) AS isl FROM x),
m AS (SELECT file, min(lo) AS lo, max(hi) AS hi FROM y GROUP BY file, isl),
r AS (SELECT dev AS file, req_id, (lo * 512) // 4096 * 4096 AS a, (hi * 512 + 4095) // 4096 * 4096 AS b FROM reads),
s AS (SELECT r.*, coalesce((SELECT max(m.hi) FROM m WHERE m.file = r.file AND m.lo <= a AND a < m.hi), a) AS st, coalesce((SELECT min(m.lo) FROM m WHERE m.file = r.file AND m.lo < b AND b <= m.hi), b) AS sp FROM r)
SELECT file, req_id, CASE WHEN st < sp THEN st // 16384 * 16384 ELSE 0 END AS refill_offset, CASE WHEN st < sp THEN (sp + 16383) // 16384 * 16384 - st // 16384 * 16384 ELSE 0 END AS refill_count FROM s""")
def cache_miss_range(spark, sf):
    r = fx.reads(spark, sf).selectExpr("dev AS file", "req_id", "lo * 512 AS offset", "(hi - lo) * 512 AS count")
    return cache.miss_range(r, _cached(spark, sf), 16384)


@query(f"""{FLAT}, e AS (SELECT dev AS file, lo * 512 AS lo, hi * 512 AS hi FROM flat WHERE NOT zeroed)
SELECT file, lo, least(hi, 500000) AS hi FROM e WHERE lo < least(hi, 500000) UNION ALL SELECT file, greatest(lo, 1000000), hi FROM e WHERE greatest(lo, 1000000) < hi""")
def cache_evict_range(spark, sf):
    e = _cached(spark, sf)
    return cache.evict_range(e, e.select("file").distinct().selectExpr("file", "cast(500000 AS bigint) AS hole_lo", "cast(1000000 AS bigint) AS hole_hi"))


@query("SELECT c_custkey, capacity, greatest(floor(capacity * 9 / 10)::BIGINT, capacity - 53687091200) AS watermark FROM (SELECT c_custkey, c_custkey * 1073741824 AS capacity FROM customer)")
def cache_watermark(spark, sf):
    return fx.table(spark, sf, "customer").selectExpr("c_custkey", "c_custkey * 1073741824 AS capacity").withColumn("watermark", sc.watermark(F.col("capacity")))


@query("SELECT key, count(*) AS n_files, min(path) AS first_path FROM (SELECT '/' || p_brand || '/sha256:' || md5(p_type) AS path, 'sha256:' || md5(p_type) AS key FROM part) GROUP BY key")
def content_key(spark, sf):
    return cache.content_keys(fx.table(spark, sf, "part").selectExpr("concat('/', p_brand, '/sha256:', md5(p_type)) AS path"))


@query("SELECT doc_id AS file, n_chars AS file_size, coalesce(sum(ceil(n_chars / 64.0)::BIGINT) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS blk_idx FROM documents")
def ns_block_address(spark, sf):
    return cache.block_addresses(fx.table(spark, sf, "documents").selectExpr("doc_id AS file", "n_chars AS file_size"), 64, 64)


@query()
def lru_evictions(spark, sf):
    log = fx.table(spark, sf, "events").selectExpr("cast(user_id % 7 AS int) AS pool", "event_id AS seq", "concat('f', user_id % 97) AS file", "4096 * (1 + event_id % 16) AS len", "cast(event_id % 5 = 0 AS int) AS open_count")
    return cache.evict_lru(log, ["pool"], 1 << 19)


@query("""SELECT file, x AS "offset", least(33554432, o + n - x) AS count FROM (SELECT file, o, n, unnest(generate_series(o, o + n - 1, 33554432)) AS x FROM (SELECT c_custkey AS file, c_custkey * 1000 AS o, (1 + c_custkey % 50) * 10000000 AS n FROM customer))""")
def prefetch_steps(spark, sf):
    return cache.prefetch_steps(fx.table(spark, sf, "customer").selectExpr("c_custkey AS file", "c_custkey * 1000 AS offset", "(1 + c_custkey % 50) * 10000000 AS count")).select("file", "offset", F.col("count").cast("long").alias("count"))


# ---- traces and the service

TRACE = """t AS (SELECT CASE WHEN event_type = 'purchase' THEN 'W' ELSE 'R' END AS op, (user_id % 7)::INT AS layer_index, 4096 * (1 + event_id % 16) AS count, (event_id * 4096) % 67108864 AS "offset" FROM events)"""


def _trace(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("CASE WHEN event_type = 'purchase' THEN 'W' ELSE 'R' END AS op", "cast(user_id % 7 AS int) AS layer_index", "4096 * (1 + event_id % 16) AS count", "(event_id * 4096) % 67108864 AS offset")


@query(f"WITH {TRACE} SELECT layer_index, op, count, \"offset\" FROM t WHERE op = 'R' AND layer_index IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 4)")
def trace_replay_join(spark, sf):
    known = fx.table(spark, sf, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").cast("int").alias("layer_index"))
    return trace.replayable(_trace(spark, sf), known, 8)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'disabled' WHEN event_id % 4 = 0 THEN 'record' ELSE 'replay' END AS mode FROM events")
def trace_mode(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", sc.trace_mode(F.col("event_id") % 3 != 0, F.col("event_id") % 4).alias("mode"))


@query("""WITH x AS (SELECT doc_id AS file, doc_id * 8192 AS lo, 3000000 AS len, n_chars * 1000 AS size FROM documents), c AS (SELECT file, lo, least(len, (size + 511) // 512 * 512) AS n FROM x WHERE size > 0),
s AS (SELECT *, unnest(generate_series(0, n - 1, 1048576)) AS at_ FROM c) SELECT file, lo + at_ AS "offset", least(1048576, n - at_)::BIGINT AS count FROM s""")
def prefetch_slices(spark, sf):
    x = fx.table(spark, sf, "documents").selectExpr("doc_id AS file", "doc_id * 8192 AS lo", "cast(3000000 AS bigint) AS len", "n_chars * 1000 AS size")
    return trace.slices(x).withColumn("count", F.col("count").cast("long"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS qps, coalesce(sum(CASE WHEN r > 0 THEN r END), 0)::BIGINT AS throughput, max(user_id) AS max_latency
FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN -1 ELSE 4096 * (1 + event_id % 16) END AS r FROM events) GROUP BY ALL""")
def io_metrics_window(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr("ts", "event_type", "user_id AS latency", "CASE WHEN event_id % 10 = 0 THEN -1 ELSE 4096 * (1 + event_id % 16) END AS ret")
    return trace.metrics(e, ["event_type"], window="1 hour")


@query("""SELECT 'layer_qps{node="n1",type="' || event_type || '"} ' || count(*)::VARCHAR AS line FROM events GROUP BY event_type""")
def metrics_exposition(spark, sf):
    n = fx.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return trace.exposition(n, F.lit("layer_qps"), {"node": F.lit("n1"), "type": F.col("event_type")}, F.col("n"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'data' WHEN 'O' THEN 'unallocated' ELSE 'zero' END AS kind, count(*) AS n, sum(65536)::BIGINT AS bytes FROM orders GROUP BY ALL")
def cluster_kind_counts(spark, sf):
    from layerframe.sources.qcow2 import kind_counts

    return kind_counts(fx.table(spark, sf, "orders").selectExpr("o_orderkey AS logical_offset", "65536 AS cluster_size", "o_orderstatus = 'O' AS is_unallocated", "o_orderstatus = 'P' AS is_zero"))


@query("""WITH p AS (SELECT n_nationkey AS part, n_nationkey * 100000 AS lo, n_nationkey * 100000 + 60000 AS hi FROM nation),
c AS (SELECT o_orderkey AS id, (o_orderkey * 97) % 2500000 AS lo, (o_orderkey * 97) % 2500000 + 4096 AS hi FROM orders),
b AS (SELECT *, coalesce(sum(hi - lo) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM p)
SELECT DISTINCT id, part, greatest(c.lo, b.lo) AS lo, least(c.hi, b.hi) AS hi, base + greatest(c.lo, b.lo) - b.lo AS target, c.lo < b.lo OR c.hi > b.hi AS clipped FROM c JOIN b ON c.lo < b.hi AND c.hi > b.lo""")
def partition_overlap(spark, sf):
    from layerframe.sources.qcow2 import remap

    p = fx.table(spark, sf, "nation").selectExpr("n_nationkey AS part", "n_nationkey * 100000 AS lo", "n_nationkey * 100000 + 60000 AS hi")
    c = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "(o_orderkey * 97) % 2500000 AS lo", "(o_orderkey * 97) % 2500000 + 4096 AS hi").distinct()
    return remap(c, p)


AUTH_URL = "'https://' || (CASE WHEN p_partkey % 3 = 0 THEN 'reg.io' ELSE 'hub.net' END) || '/v2/' || lower(replace(p_brand, '#', '')) || '/img' || (p_partkey % 4) || '/blobs/sha256:' || p_partkey"


@query(f"""WITH u AS (SELECT {AUTH_URL} AS url FROM part), w AS (SELECT url, string_split(regexp_replace(url, '^https?://', ''), '/') AS w FROM u),
s AS (SELECT url, list_concat(w[1:1], w[3:len(w) - 2]) AS s FROM w), p AS (SELECT url, unnest(list_transform(generate_series(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS addr FROM s)
SELECT url, addr FROM p WHERE addr IN ('reg.io', 'hub.net/brand11', 'hub.net/brand23/img1', 'reg.io/brand12/img0/blobs')""")
def auth_prefix_match(spark, sf):
    u = fx.table(spark, sf, "part").selectExpr(f"{AUTH_URL} AS url")
    a = spark.createDataFrame([("reg.io",), ("hub.net/brand11",), ("hub.net/brand23/img1",), ("reg.io/brand12/img0/blobs",)], "addr string")
    return trace.credentials_for(u, a)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'refused: read-only' WHEN t = c AND NOT f THEN 'none' WHEN t < c AND NOT f THEN 'refused: shrink without filesystem'
WHEN t > c THEN CASE WHEN f THEN 'device,filesystem' ELSE 'device' END WHEN t < c THEN 'filesystem,device' ELSE 'filesystem' END AS action FROM (SELECT o_orderkey, o_custkey % 3 AS c, o_orderkey % 3 AS t, o_custkey % 2 = 0 AS f FROM orders)""")
def resize_policy(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", sc.resize_action(F.col("o_custkey") % 3, F.col("o_orderkey") % 3, F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 5 == 0).alias("action"))


@query("""SELECT event_id, CASE WHEN o < 0 THEN -1 WHEN o >= 10485760 THEN 0 ELSE least(n, 10485760 - o) END::BIGINT AS ret FROM (SELECT event_id, (event_id * 104729) % 12000000 - 5 AS o, event_id % 9000 AS n FROM events)""")
def read_clamp(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr("event_id", "(event_id * 104729) % 12000000 - 5 AS o", "event_id % 9000 AS n")
    return e.select("event_id", sc.clamp_read(F.col("o"), F.col("n"), F.lit(10 << 20)).alias("ret"))


@query("""SELECT event_id, down, up, (x >> 9)::BIGINT AS sector, bit, with_bit, cfg, dev, msg FROM (SELECT event_id, event_id * 37 AS x, event_id * 37 // 4096 * 4096 AS down, (event_id * 37 + 4095) // 4096 * 4096 AS up,
(event_id & 4) <> 0 AS bit, event_id | 8 AS with_bit, CASE WHEN event_id % 2 = 0 THEN 'a.json' ELSE 'b' END AS cfg, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE '' END AS dev,
CASE event_id % 4 WHEN 0 THEN 'No such file or directory' WHEN 1 THEN 'Authentication failed' WHEN 2 THEN 'Too many requests' ELSE 'Cannot assign requested address' END AS msg FROM events)""")
def scalar_functions(spark, sf):
    e = fx.table(spark, sf, "events")
    i = F.col("event_id")
    x = i * 37
    cd = sc.config_and_device(F.when(i % 2 == 0, F.concat(F.lit("a.json;"), i.cast("string"))).otherwise("b"))
    eno = F.when(i % 4 == 0, 2).when(i % 4 == 1, 13).when(i % 4 == 2, 16).otherwise(99)
    return e.select("event_id", sc.align_down(x, 4096).alias("down"), sc.align_up(x, 4096).alias("up"), sc.to_sectors(x).alias("sector"), sc.get_bit(i, 2).alias("bit"), sc.set_bit(i, 3).alias("with_bit"),
                    cd["config"].alias("cfg"), cd["dev_id"].alias("dev"), sc.error_message(eno).alias("msg"))


@query(ORACLES["overlay_lww_insert"])
def stream_lww(spark, sf):
    """The streamed last-writer-wins state of a device after all batches, by the batch operator that the stream applies."""
    from layerframe.streaming.extents import replay_in_batches

    return replay_in_batches(fx.segments(spark, sf), 4)


# ---- stacks, candidates, configuration

STACK = "m AS (SELECT s_nationkey AS dev, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS layer, (s_suppkey % 3) * 1024 AS virtual_size FROM supplier)"


@query(f"WITH {STACK} SELECT dev, arg_max(virtual_size, layer) AS virtual_size FROM m WHERE virtual_size > 0 GROUP BY dev")
def stack_virtual_size(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    m = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("dev"), F.row_number().over(w).alias("layer"), ((F.col("s_suppkey") % 3) * 1024).alias("virtual_size"))
    return layers.open_stack(fx.segments(spark, sf), m)[1]


@query(f"""WITH {fx.SEGMENTS}, {fx.READS}, e AS (SELECT dev, layer, max(moff + hi - lo) AS e FROM segments GROUP BY dev, layer),
w AS (SELECT dev, (1 + req_id % 9)::INT AS layer, req_id + 1000000000 AS write_seq, lo, hi, false AS zeroed FROM reads),
a AS (SELECT w.dev, w.layer, write_seq, lo, hi, coalesce(e, 8) + coalesce(sum(hi - lo) OVER (PARTITION BY w.dev, w.layer ORDER BY write_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS moff, zeroed
  FROM w LEFT JOIN e ON w.dev = e.dev AND w.layer = e.layer)
SELECT * FROM segments UNION ALL SELECT * FROM a""")
def append_writes(spark, sf):
    w = fx.reads(spark, sf).selectExpr("dev", "cast(1 + req_id % 9 AS int) AS layer", "req_id + 1000000000 AS write_seq", "lo", "hi", "cast(0 AS bigint) AS moff", "false AS zeroed")
    return layers.append_writes(fx.segments(spark, sf), w)


@query(f"{FLAT} SELECT dev, lo, hi, moff, zeroed, layer, write_seq FROM flat WHERE layer < 7 UNION ALL SELECT dev, lo, hi, moff, zeroed, 8 AS layer, write_seq FROM flat WHERE layer = 7")
def restack(spark, sf):
    f = flat(spark, sf)
    return layers.restack(f.where("layer < 7"), f.where("layer = 7"))


@query("""WITH c AS (SELECT s_nationkey AS layer, ['file', 'commit', 'sealed'][(s_suppkey % 3 + 1)::INT] AS kind, s_suppkey % 2 = 0 AS present FROM supplier)
SELECT layer, coalesce(arg_min(kind, CASE kind WHEN 'file' THEN 0 WHEN 'commit' THEN 1 ELSE 2 END) FILTER (WHERE present), 'remote') AS kind FROM c GROUP BY layer""")
def layer_candidates(spark, sf):
    c = fx.table(spark, sf, "supplier").selectExpr("s_nationkey AS layer", "element_at(array('file', 'commit', 'sealed'), cast(s_suppkey % 3 + 1 AS int)) AS kind", "s_suppkey % 2 = 0 AS present")
    return trace.first_candidate(c, {"file": 0, "commit": 1, "sealed": 2})


CONFIG = """'{"repoBlobUrl":"https://r/' || s_suppkey || '","lowers":[{"file":"f' || s_nationkey || '","size":' || s_suppkey || '},{"dir":"d"}]' || CASE WHEN s_suppkey % 2 = 0 THEN ',"accelerationLayer":true' ELSE '' END || '}'"""


@query(f"""WITH c AS (SELECT {CONFIG} AS value FROM supplier)
SELECT value, value->>'$.repoBlobUrl' AS repo_blob_url, json_array_length(value, '$.lowers')::INT AS n_lowers, value->>'$.lowers[0].file' AS first_file, (value->>'$.lowers[0].size')::BIGINT AS first_size, coalesce((value->>'$.accelerationLayer')::BOOLEAN, false) AS acceleration_layer FROM c""")
def image_config(spark, sf):
    got = config.parse_images(fx.table(spark, sf, "supplier").selectExpr(f"{CONFIG} AS value"))
    return got.select("value", "repo_blob_url", F.size("lowers").alias("n_lowers"), F.col("lowers")[0]["file"].alias("first_file"), F.col("lowers")[0]["size"].alias("first_size"), "acceleration_layer")


@query("""WITH RECURSIVE a AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT user_id, ts, n, false AS hit, ts AS at_ FROM a WHERE n = 1
  UNION ALL SELECT a.user_id, a.ts, a.n, a.ts - at_ < INTERVAL 3600 SECOND, CASE WHEN a.ts - at_ < INTERVAL 3600 SECOND THEN at_ ELSE a.ts END FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1)
SELECT user_id, ts, hit FROM r""")
def ttl_hits(spark, sf):
    return trace.ttl_hits(fx.table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", 3600)
