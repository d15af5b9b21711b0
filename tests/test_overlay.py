"""Literal goldens and a shadow-array model for the extent operators."""

import random

import pytest

from layerframe.operators import layers, overlay, points

KIND = "dev long, layer int, write_seq long, lo long, hi long, moff long, zeroed boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def seg(dev, layer, seq, offset, length, moff, zeroed=False):
    return (dev, layer, seq, offset, offset + length, moff, zeroed)


def triples(df, *more):
    return sorted((r["lo"], r["hi"] - r["lo"], r["moff"], *[r[c] for c in more]) for r in df.collect())


def test_lookup_golden(spark):
    idx = table(spark, [seg(1, 0, i, *t) for i, t in enumerate([(0, 10, 0), (10, 10, 50), (100, 10, 20)])])
    want = {(5, 10): [(5, 5, 5), (10, 5, 50)], (16, 10): [(16, 4, 56)], (26, 10): [], (6, 100): [(6, 4, 6), (10, 10, 50), (100, 6, 20)]}
    reqs = spark.createDataFrame([(1, i, o, o + n) for i, (o, n) in enumerate(want)], "dev long, req_id long, lo long, hi long")
    got = overlay.lookup(idx, reqs).collect()
    for i, rows in enumerate(want.values()):
        assert sorted((r["lo"], r["hi"] - r["lo"], r["moff"]) for r in got if r["req_id"] == i) == rows


def test_insert_golden(spark):
    writes = [(0, 20, 0), (10, 15, 50), (30, 100, 20), (5, 10, 3), (40, 10, 123), (200, 10, 2133), (150, 100, 21)]
    got = triples(overlay.insert_all(table(spark, [seg(1, 0, i, *w) for i, w in enumerate(writes)])))
    assert got == [(0, 5, 0), (5, 10, 3), (15, 10, 55), (30, 10, 20), (40, 10, 123), (50, 80, 40), (150, 100, 21)]


M = [
    [(5, 5, 0), (10, 10, 50), (100, 10, 20)],
    [(0, 1, 7), (2, 4, 5), (15, 10, 22), (30, 15, 89), (87, 50, 32), (150, 10, 84)],
    [(1, 3, 134), (8, 4, 873), (18, 72, 320), (100, 100, 4893), (1000, 1000, 39823)],
    [(23, 10, 0), (65, 10, 50), (89, 10, 20), (230, 43, 432), (1999, 31, 2393)],
]
N3 = [(0, 1, 7, 0), (1, 1, 134, 1), (2, 3, 5, 0), (5, 5, 0, 2), (10, 10, 50, 2), (20, 5, 27, 0), (25, 5, 327, 1), (30, 15, 89, 0), (45, 42, 347, 1), (87, 13, 32, 0),
      (100, 10, 20, 2), (110, 27, 55, 0), (137, 13, 4930, 1), (150, 10, 84, 0), (160, 40, 4953, 1), (1000, 1000, 39823, 1)]
N2 = [(0, 1, 7, 0), (2, 3, 5, 0), (5, 5, 0, 1), (10, 10, 50, 1), (20, 5, 27, 0), (30, 15, 89, 0), (87, 13, 32, 0), (100, 10, 20, 1), (110, 27, 55, 0), (150, 10, 84, 0)]
N4 = [*[(a, b, c, 3 if d == 2 else d) for a, b, c, d in N3[:-1]], (230, 43, 432, 2), N3[-1], (2000, 30, 2394, 2)]


@pytest.mark.parametrize(("n", "want"), [(2, N2), (3, N3), (4, N4)])
def test_merge_golden(spark, n, want):
    rows = [seg(1, n - i, 0, *t) for i in range(n) for t in M[i]]
    got = triples(overlay.flatten(table(spark, rows)), "layer")
    tag = lambda layer: n - 1 if layer == n else n - layer - 1
    assert [(a, b, c, tag(d)) for a, b, c, d in got] == want


@pytest.mark.parametrize(("rows", "want"), [
    ([(5, 5, 0, 0), (10, 10, 5, 0), (100, 10, 20, 0)], [(5, 15, 0, 0), (100, 10, 20, 0)]),
    ([(5, 5, 0, 0), (10, 10, 5, 0), (20, 10, 15, 0), (100, 10, 20, 0)], [(5, 25, 0, 0), (100, 10, 20, 0)]),
    ([(5, 5, 0, 0), (10, 10, 5, 0), (20, 10, 15, 1), (100, 10, 20, 0)], [(5, 15, 0, 0), (20, 10, 15, 1), (100, 10, 20, 0)]),
    ([(5, 5, 0, 3), (10, 10, 5, 3), (20, 10, 15, 3), (30, 10, 20, 0)], [(5, 25, 0, 3), (30, 10, 20, 0)]),
])
def test_coalesce(spark, rows, want):
    idx = table(spark, [seg(1, t[3], 0, *t[:3]) for t in rows])
    assert triples(overlay.coalesce(idx), "layer") == want
    assert triples(overlay.coalesce_capped(idx), "layer") == want


def test_coalesce_cap_is_strict(spark):
    idx = table(spark, [seg(1, 0, 0, i * 8000, 8000, i * 8000) for i in range(4)])
    assert triples(overlay.coalesce_capped(idx)) == [(0, 16000, 0), (16000, 16000, 16000)]
    assert triples(overlay.coalesce_capped(idx, cap=16000)) == [(i * 8000, 8000, i * 8000) for i in range(4)]


def test_remote_mappings_golden(spark):
    got = layers.remote_mappings(spark.createDataFrame([(1, 0, 26 << 20, 0)], "dev long, offset long, count long, roffset long"))
    assert [n for _, n, _ in triples(got)] == [16383] * 3 + [4099]


def test_shadow_array(spark):
    rng = random.Random(154574045)
    size, rows, shadow = 3000, [], {}
    for layer in range(3):
        for k in range(120):
            lo, n = rng.randrange(size), rng.randrange(1, 256)
            rows.append(seg(7, layer, layer * 1000 + k, lo, min(n, size - lo), rng.randrange(1 << 30), rng.random() < 0.25))
            r = rows[-1]
            for s in range(r[3], r[4]):
                shadow[s] = (r[6], None if r[6] else r[5] + s - r[3], layer)
    flat = overlay.flatten(table(spark, rows))
    seen = {}
    for r in flat.collect():
        for s in range(r["lo"], r["hi"]):
            assert s not in seen
            seen[s] = (r["zeroed"], None if r["zeroed"] else r["moff"] + s - r["lo"], r["layer"])
    assert seen == shadow
    packed = layers.compact(flat).where("NOT zeroed").orderBy("lo").collect()
    at = 8
    for r in packed:
        assert r["new_moff"] == at
        at += r["hi"] - r["lo"]
    reqs = spark.createDataFrame([(7, 1, 0, size), (7, 2, 100, 500), (9, 3, 0, 10)], "dev long, req_id long, lo long, hi long")
    pieces = overlay.segments_of(flat, reqs).collect()
    for req, lo, hi in ((1, 0, size), (2, 100, 500), (3, 0, 10)):
        mine = sorted((r["lo"], r["hi"], r["kind"]) for r in pieces if r["req_id"] == req)
        assert mine[0][0] == lo and mine[-1][1] == hi and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
        if req < 3:
            for a, b, kind in mine:
                assert all(kind == ("hole" if s not in shadow else "zero" if shadow[s][0] else "data") for s in range(a, b))


def test_empty_tables(spark):
    empty = table(spark, [])
    reqs = spark.createDataFrame([(1, 1, 0, 4)], "dev long, req_id long, lo long, hi long")
    assert overlay.flatten(empty).count() == 0
    assert overlay.coalesce(empty).count() == 0
    assert [(r["lo"], r["hi"], r["kind"]) for r in overlay.segments_of(empty, reqs).collect()] == [(0, 4, "hole")]


def test_provenance_and_image(spark):
    m = spark.createDataFrame([(1, 1, "a", ""), (1, 2, "b", "a"), (1, 3, "c", "x")], "dev long, layer int, uuid string, parent_uuid string")
    assert [(r["layer"], r["below_uuid"]) for r in layers.provenance(m).collect()] == [(3, "b")]
    idx = table(spark, [seg(1, 1, 0, 0, 1, 8), seg(1, 2, 0, 2, 1, 9, True)])
    blocks = spark.createDataFrame([(1, 1, 8, b"ab")], "dev long, layer int, sector long, data binary")
    got = layers.read_image(idx, spark.createDataFrame([(1, 1, 0, 3)], "dev long, req_id long, lo long, hi long"), blocks).first()["data"]
    assert bytes(got) == b"ab" + bytes(3 * 512 - 2)


@pytest.mark.parametrize("most", [10**6, 2])
def test_points(spark, most):
    idx = table(spark, [seg(1, 0, 0, 5, 5, 100), seg(1, 0, 0, 10, 10, 50, True), seg(3, 1, 0, 0, 200, 7)])
    probes = spark.createDataFrame([(1, 4), (1, 5), (1, 9), (1, 10), (1, 19), (1, 20), (2, 5), (3, 0), (3, 199), (3, 200), (None, 1), (3, 10**9)], "dev long, sector long")
    got = sorted((r["dev"], r["sector"], r["moff"]) for r in points.lookup_points(idx, probes, most).collect())
    assert got == [(1, 5, 100), (1, 9, 104), (1, 10, 50), (1, 19, 50), (3, 0, 7), (3, 199, 206)]
    assert points.lookup_points(idx.limit(0), probes, most).count() == 0


@pytest.mark.parametrize("width", [1, 7, 64])
def test_flatten_masks(spark, width):
    """Writes over many bins, bits 0 and 63, equal rows and null keys against a painted array; pieces are shuffled once and never joined."""
    rnd = random.Random(8)
    rows = [(rnd.randrange(2), rnd.randrange(4), i, lo, lo + rnd.choice([1, 2, 30, 63, 64, 65, 200, 500]), 1000 * i, rnd.random() < 0.2) for i, lo in enumerate(rnd.choice([0, 63, 64, 127, rnd.randrange(900)]) for _ in range(90))]
    rows += rows[:5] + [(None, 1, 999, 0, 10, 0, False), (1, 1, 998, 10, 10, 0, False)]
    painted = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        painted.update({(r[0], x): r for x in range(r[3], r[4])})
    want = []
    for d, x in sorted(painted):
        r = painted[d, x]
        if want and want[-1][0] == (d, *r) and want[-1][2] == x:
            want[-1][2] = x + 1
        else:
            want.append([(d, *r), x, x + 1])
    flat = overlay.flatten(table(spark, rows), width=width)
    assert sorted(tuple(r) for r in flat.collect()) == sorted((w[0], a, b, w[6] + (0 if w[7] else a - w[4]), w[7], w[2], w[3]) for w, a, b in want)
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == (2 if "Initial Plan" not in plan else 4)
    with pytest.raises(ValueError, match="64 sectors"):
        overlay.flatten(table(spark, rows), width=65)
