"""The queries on extents, layers, trees, blocks, caches and traces, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerframe.operators import layers, overlay, points

from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return put


FLAT = f"WITH {fx.SEGMENTS}, {fx.flat_sql()}"


def flat(spark, sf):
    return overlay.flatten(fx.segments(spark, sf))


@query(f"{FLAT} SELECT * FROM flat")
def overlay_flatten(spark, sf):
    return flat(spark, sf)


@query(f"WITH {fx.SEGMENTS}, {fx.flat_sql(order='write_seq DESC, layer DESC, moff DESC, hi DESC, lo DESC, zeroed DESC')} SELECT * FROM flat")
def overlay_lww_insert(spark, sf):
    return overlay.insert_all(fx.segments(spark, sf))


@query(f"""WITH {fx.SEGMENTS}, d AS (SELECT * FROM segments WHERE layer >= 5), b AS (SELECT * FROM segments WHERE layer < 5), {fx.flat_sql('d', 'fd')}, {fx.flat_sql('b', 'fb')},
u AS (SELECT *, 1 AS top FROM fd UNION ALL SELECT *, 0 FROM fb), {fx.flat_sql('u', 'flat', 'top DESC, layer DESC, write_seq DESC, moff DESC, hi DESC, lo DESC, zeroed DESC')} SELECT * FROM flat""")
def overlay_two_level(spark, sf):
    s = fx.segments(spark, sf)
    return overlay.combine(overlay.flatten(s.where("layer >= 5")), overlay.flatten(s.where("layer < 5")))


HITS = """hits AS (SELECT f.dev, req_id, greatest(f.lo, r.lo) AS lo, least(f.hi, r.hi) AS hi, moff + CASE WHEN zeroed THEN 0 ELSE greatest(f.lo, r.lo) - f.lo END AS moff, zeroed, layer, write_seq
  FROM flat f JOIN reads r ON f.dev = r.dev AND f.lo < r.hi AND f.hi > r.lo)"""


@query(f"{FLAT}, {fx.READS}, {HITS} SELECT * FROM hits")
def range_lookup(spark, sf):
    return overlay.lookup(flat(spark, sf), fx.reads(spark, sf))


@query(f"""{FLAT}, {fx.READS}, {HITS},
e AS (SELECT dev, req_id, lo, hi FROM hits UNION ALL SELECT dev, req_id, hi, hi FROM reads),
g AS (SELECT e.dev, e.req_id, coalesce(lag(e.hi) OVER (PARTITION BY e.dev, e.req_id ORDER BY e.lo, e.hi), r.lo) AS lo, e.lo AS hi FROM e JOIN reads r ON e.dev = r.dev AND e.req_id = r.req_id)
SELECT dev, req_id, lo, hi, CASE WHEN zeroed THEN 'zero' ELSE 'data' END AS kind, CASE WHEN NOT zeroed THEN moff END AS moff FROM hits
UNION ALL SELECT dev, req_id, lo, hi, 'hole', NULL FROM g WHERE lo < hi""")
def holes_and_zeroes(spark, sf):
    return overlay.segments_of(flat(spark, sf), fx.reads(spark, sf))


def _isl(physical: bool) -> str:
    phys = "AND lag(moff + CASE WHEN zeroed THEN 0 ELSE hi - lo END) OVER w = moff" if physical else ""
    return f"""x AS (SELECT *, CASE WHEN lag(hi) OVER w = lo AND lag(zeroed) OVER w = zeroed AND lag(layer) OVER w = layer {phys} THEN 0 ELSE 1 END AS brk FROM flat WINDOW w AS (PARTITION BY dev ORDER BY lo)),
y AS (SELECT *, sum(brk) OVER (PARTITION BY dev ORDER BY lo) AS isl FROM x)"""


@query(f"{FLAT}, {_isl(True)} SELECT dev, min(lo) AS lo, max(hi) AS hi, arg_min(moff, lo) AS moff, first(zeroed) AS zeroed, first(layer) AS layer FROM y GROUP BY dev, isl")
def coalesce_islands(spark, sf):
    return overlay.coalesce(flat(spark, sf))


@query(f"""WITH RECURSIVE {fx.SEGMENTS}, {fx.flat_sql()}, {_isl(True)}, o AS (SELECT *, row_number() OVER (PARTITION BY dev, isl ORDER BY lo) AS n FROM y),
r AS (SELECT dev, isl, n, lo, hi, lo AS a FROM o WHERE n = 1
  UNION ALL SELECT o.dev, o.isl, o.n, o.lo, o.hi, CASE WHEN o.hi - a < 16383 THEN a ELSE o.lo END FROM r JOIN o ON o.dev = r.dev AND o.isl = r.isl AND o.n = r.n + 1)
SELECT r.dev, a AS lo, max(r.hi) AS hi, arg_min(moff, r.lo) AS moff, first(zeroed) AS zeroed, first(layer) AS layer FROM r JOIN o ON r.dev = o.dev AND r.isl = o.isl AND r.n = o.n GROUP BY r.dev, a""")
def coalesce_capped(spark, sf):
    return overlay.coalesce_capped(flat(spark, sf))


@query(f"{FLAT}, {_isl(False)} SELECT dev, count(*) AS n_segments, max(isl)::BIGINT AS n_estimated FROM y GROUP BY dev")
def coalesce_estimate(spark, sf):
    return overlay.coalesced_size(flat(spark, sf))


@query(f"{FLAT} SELECT dev, coalesce(sum(CASE WHEN NOT zeroed THEN hi - lo END), 0)::BIGINT AS sectors, count(*) AS n_segments FROM flat GROUP BY dev")
def allocated_blocks(spark, sf):
    return overlay.allocated(flat(spark, sf))


@query(f"""{FLAT} SELECT dev, arg_min(lo, lo) AS front_lo, arg_min(hi, lo) AS front_hi, arg_min(moff, lo) AS front_moff, arg_min(layer, lo) AS front_layer,
arg_max(lo, lo) AS back_lo, arg_max(hi, lo) AS back_hi, arg_max(moff, lo) AS back_moff, arg_max(layer, lo) AS back_layer FROM flat GROUP BY dev""")
def front_back(spark, sf):
    return overlay.ends(flat(spark, sf))


@query(f"{FLAT} SELECT dev, lo, hi, moff, zeroed, layer FROM flat ORDER BY dev, lo")
def index_dump(spark, sf):
    return overlay.dump(flat(spark, sf)).select("dev", "lo", "hi", "moff", "zeroed", "layer")


@query(f"{FLAT} SELECT dev, lo, hi, moff, zeroed, (layer + 3)::INT AS layer, write_seq FROM flat WHERE layer >= 2 AND layer < 5")
def tag_range(spark, sf):
    return overlay.shift_layers(overlay.layers_between(flat(spark, sf), 2, 5), 3)


@query(f"""WITH {fx.SEGMENTS}, x AS (SELECT *, lag(lo) OVER w AS prev_lo, lag(hi) OVER w AS prev_hi FROM segments WINDOW w AS (PARTITION BY dev, layer ORDER BY lo, hi, moff, write_seq, zeroed))
SELECT * FROM x WHERE prev_hi > lo""")
def index_violations(spark, sf):
    return overlay.order_violations(fx.segments(spark, sf), ("dev", "layer"))


@query(f"{FLAT} SELECT * FROM flat WHERE moff < 640 OR moff + CASE WHEN zeroed THEN 0 ELSE hi - lo END > 200000")
def offset_violations(spark, sf):
    return overlay.offset_violations(flat(spark, sf), 640, 200_000)


@query(f"""WITH {fx.SEGMENTS}, d0 AS (SELECT * FROM segments WHERE layer = 7), b AS (SELECT * FROM segments WHERE layer < 7), {fx.flat_sql('d0', 'fd')}, {fx.flat_sql('b', 'fb')},
x AS (SELECT *, CASE WHEN lag(hi) OVER w = lo AND lag(zeroed) OVER w = zeroed AND lag(moff + CASE WHEN zeroed THEN 0 ELSE hi - lo END) OVER w = moff THEN 0 ELSE 1 END AS brk FROM fd WINDOW w AS (PARTITION BY dev ORDER BY lo)),
y AS (SELECT *, sum(brk) OVER (PARTITION BY dev ORDER BY lo) AS isl FROM x),
c AS (SELECT dev, min(lo) AS lo, max(hi) AS hi, arg_min(moff, lo) AS moff, first(zeroed) AS zeroed, 255 AS layer, 0::BIGINT AS write_seq FROM y GROUP BY dev, isl),
u AS (SELECT *, 1 AS top FROM c UNION ALL SELECT *, 0 FROM fb), {fx.flat_sql('u', 'flat', 'top DESC, layer DESC, write_seq DESC, moff DESC, hi DESC, lo DESC, zeroed DESC')} SELECT * FROM flat""")
def commit_delta(spark, sf):
    s = fx.segments(spark, sf)
    return overlay.commit_delta(overlay.flatten(s.where("layer = 7")), overlay.flatten(s.where("layer < 7")))


@query(f"{FLAT} SELECT *, 8 + coalesce(sum(CASE WHEN zeroed THEN 0 ELSE hi - lo END) OVER (PARTITION BY dev ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_moff FROM flat")
def compact_offsets(spark, sf):
    return layers.compact(flat(spark, sf))


@query(f"""{FLAT} SELECT *, CASE WHEN layer % 2 = 1 THEN moff ELSE 8 + coalesce(sum(CASE WHEN zeroed OR layer % 2 = 1 THEN 0 ELSE hi - lo END)
OVER (PARTITION BY dev ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS new_moff FROM flat""")
def warp_compact_offsets(spark, sf):
    return layers.compact_warp(flat(spark, sf), F.col("layer") % 2 == 1)


@query(f"""{FLAT} SELECT dev, lo, hi, 8 + coalesce(sum(CASE WHEN zeroed THEN 0 ELSE hi - lo END) OVER (PARTITION BY dev ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS moff, zeroed, 0 AS layer, write_seq FROM flat""")
def merge_layers(spark, sf):
    return layers.merge(fx.segments(spark, sf))


@query(f"{FLAT} SELECT dev, greatest(lo, 1024)::BIGINT AS lo, least(hi, 3072)::BIGINT AS hi, CASE WHEN zeroed THEN 'zero' ELSE 'data' END AS kind FROM flat WHERE lo < 3072 AND hi > 1024")
def data_ranges(spark, sf):
    return layers.data_ranges(flat(spark, sf), 1024, 3072)


@query(f"""{FLAT}, t AS (SELECT dev, 512 * coalesce(sum(CASE WHEN NOT zeroed THEN hi - lo END), 0)::BIGINT AS total_bytes FROM segments GROUP BY dev),
v AS (SELECT dev, 512 * coalesce(sum(CASE WHEN NOT zeroed THEN hi - lo END), 0)::BIGINT AS valid_bytes FROM flat GROUP BY dev)
SELECT t.dev, total_bytes, valid_bytes, CASE WHEN total_bytes > 0 THEN 1 - valid_bytes::DOUBLE / total_bytes ELSE 0.0 END AS garbage_ratio FROM t JOIN v USING (dev)""")
def live_garbage_ratio(spark, sf):
    return layers.live_statistics(fx.segments(spark, sf))


@query("""WITH m AS (SELECT s_nationkey AS dev, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS layer, md5(s_suppkey::VARCHAR) AS uuid,
md5((CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) END)::VARCHAR) AS parent_uuid FROM supplier),
x AS (SELECT *, lag(uuid) OVER (PARTITION BY dev ORDER BY layer) AS below_uuid FROM m)
SELECT dev, layer, parent_uuid, below_uuid FROM x WHERE below_uuid IS NOT NULL AND parent_uuid IS DISTINCT FROM below_uuid""")
def layer_provenance(spark, sf):
    fx.table(spark, sf, "supplier").createOrReplaceTempView("_supplier")
    m = spark.sql("""SELECT s_nationkey AS dev, row_number() OVER w AS layer, md5(CAST(s_suppkey AS STRING)) AS uuid,
        md5(CAST(CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE lag(s_suppkey) OVER w END AS STRING)) AS parent_uuid FROM _supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
    return layers.provenance(m)


@query(f"{FLAT} SELECT dev, lo, least(hi, 2048)::BIGINT AS hi, moff, zeroed, layer, write_seq FROM flat WHERE lo < 2048")
def virtual_resize(spark, sf):
    return layers.resize(flat(spark, sf), 2048)


@query(f"""WITH {fx.READS}, {fx.SEGMENTS}, r AS (SELECT dev, 99 AS layer, req_id + 1000000000 AS write_seq, lo, hi, 0::BIGINT AS moff, true AS zeroed FROM reads),
u AS (SELECT * FROM segments UNION ALL SELECT * FROM r), {fx.flat_sql('u', 'flat')} SELECT * FROM flat""")
def discard_ranges(spark, sf):
    holes = fx.reads(spark, sf).selectExpr("dev", "99 AS layer", "req_id + 1000000000 AS write_seq", "lo", "hi")
    return overlay.flatten(layers.discard(fx.segments(spark, sf), holes))


@query("""WITH r AS (SELECT c_custkey AS dev, c_custkey * 4096 AS "offset", (1 + c_custkey % 40) * 1048576 AS n, c_custkey * 512 AS roffset FROM customer),
s AS (SELECT dev, "offset" // 512 AS lo, ("offset" + n) // 512 AS hi, roffset // 512 AS moff FROM r), p AS (SELECT *, unnest(generate_series(lo, hi - 1, 16383)) AS x FROM s)
SELECT dev, x AS lo, least(hi, x + 16383) AS hi, moff + x - lo AS moff, false AS zeroed, 'remoteData' AS source FROM p""")
def remote_mappings(spark, sf):
    return layers.remote_mappings(fx.table(spark, sf, "customer").selectExpr("c_custkey AS dev", "c_custkey * 4096 AS offset", "(1 + c_custkey % 40) * 1048576 AS count", "c_custkey * 512 AS roffset"))


@query(f"{FLAT} SELECT dev, lo, hi, lo + 8 AS moff FROM flat WHERE NOT zeroed")
def sparse_mappings(spark, sf):
    return layers.sparse_mappings(flat(spark, sf).where("NOT zeroed").select("dev", "lo", "hi"))


POINTS = """p AS (SELECT DISTINCT event_id % (SELECT count(*) FROM supplier) + 1 AS dev, (event_id * 7919) % 4200 AS sector FROM events)"""


@query(f"""{FLAT}, {POINTS} SELECT p.dev, sector, moff + CASE WHEN zeroed THEN 0 ELSE sector - lo END AS moff, zeroed, layer FROM p JOIN flat f ON p.dev = f.dev AND lo <= sector AND sector < hi""")
def point_lookup(spark, sf):
    n = fx.table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    probes = fx.table(spark, sf, "events").join(F.broadcast(n)).selectExpr("event_id % n + 1 AS dev", "(event_id * 7919) % 4200 AS sector").distinct()  # one row
    return points.lookup_points(flat(spark, sf), probes)


from . import file_queries, more_queries, service_queries  # noqa: E402, F401  the rest registers itself
