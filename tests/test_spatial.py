import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lindero.functions import geometry as G
from lindero.operators import skew, spatial, zones
from lindero.operators.substring import contains_join

BOX = "id long, x0 double, y0 double, x1 double, y1 double"
coord = st.integers(-40, 40).map(lambda v: v * 5.0)
side = st.sampled_from([0.0, 1.0, 5.0, 64.0, 130.0, 900.0])
boxes = st.lists(st.tuples(coord, coord, side, side), min_size=1, max_size=8)


def frame(spark, items, name):
    rows = [(i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(items)]
    return spark.createDataFrame(rows, BOX).select(
        F.col("id").alias(f"{name}_id"), F.struct("x0", "y0", "x1", "y1").alias(f"{name}_box"))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=boxes, b=boxes, touching=st.booleans())
def test_box_join_equals_brute_force(spark, a, b, touching):
    # floor_rows=0 makes every busy cell count as hot, so the salted path is taken.
    got = spatial.box_join(frame(spark, a, "l"), frame(spark, b, "r"), "l_box", "r_box", "l_id",
                           touching, base=32.0, share=4, floor_rows=0)
    pairs = sorted((r.l_id, r.r_id) for r in got.collect())
    want = []
    for i, (ax, ay, aw, ah) in enumerate(a):
        for j, (bx, by, bw, bh) in enumerate(b):
            if touching:
                hit = ax <= bx + bw and bx <= ax + aw and ay <= by + bh and by <= ay + ah
            else:
                hit = ax < bx + bw and bx < ax + aw and ay < by + bh and by < ay + ah
            if hit:
                want.append((i, j))
    assert pairs == want


def inside(x, y, ring):
    hit, j = False, len(ring) - 1
    for i, (xi, yi) in enumerate(ring):
        xj, yj = ring[j]
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi + 1e-12) + xi:
            hit = not hit
        j = i
    return hit


@pytest.mark.parametrize("hot", [False, True])
def test_points_in_zones_equals_brute_force(spark, hot):
    rnd = random.Random(7)
    rings = {}
    for z in range(40):
        cx, cy, r = rnd.uniform(0, 2000), rnd.uniform(0, 2000), rnd.choice([20, 150, 1500])
        rings[f"z{z}"] = [[(cx + rnd.uniform(-r, r), cy + rnd.uniform(-r, r)) for _ in range(6)]
                          for _ in range(1 + z % 2)]
    # With `hot`, a third of all points lie in the same place.
    pts = [(i, 777.0, 777.0) if hot and i % 3 == 0 else
           (i, rnd.uniform(-100, 2100), rnd.uniform(-100, 2100)) for i in range(300)]
    p = spark.createDataFrame(pts, "k long, x double, y double")
    z = spark.createDataFrame(
        [(n, [[{"x": x, "y": y} for x, y in ring] for ring in rr]) for n, rr in rings.items()],
        "id string, rings array<array<struct<x:double,y:double>>>")
    opts = {"share": 8, "floor_rows": 0} if hot else {}
    got = sorted((r.k, r.id) for r in spatial.points_in_zones(p, z, "k", **opts).collect())
    want = sorted((k, n) for k, x, y in pts for n, rr in rings.items()
                  if any(inside(x, y, ring) for ring in rr))
    assert got == want and want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_keeps_every_row_once(spark, how):
    left = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("key"),
        F.col("id").alias("v"))
    right = spark.range(0, 900, 2).select(F.col("id").alias("key"), (F.col("id") * 2).alias("w"))
    right = right.unionByName(spark.createDataFrame([(1, 5), (1, 6)], "key long, w long"))
    got = skew.salted_join(left, right, ["key"], ["v"], how, share=16, floor_rows=0)
    want = left.join(right, "key", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == \
        sorted(map(tuple, want.collect()), key=str)
    assert skew.hot_keys(left, ["key"], 16, 0).count() == 1


def test_running_total_is_the_global_rank(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), F.lit(2).alias("w"))
    rows = skew.running_total(df, ["v"], "w").collect()
    assert all(r.before == r.v * 2 for r in rows) and len(rows) == 1000


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ABC ", max_size=5), min_size=1, max_size=12),
       st.lists(st.text("ABC ", max_size=9), min_size=1, max_size=12))
def test_contains_join_equals_brute_force(spark, needles, hays):
    n = spark.createDataFrame([(v,) for v in needles], "n string")
    h = spark.createDataFrame([(v,) for v in hays], "h string")
    got = sorted((r.n, r.h) for r in contains_join(n, "n", h, "h").collect())
    assert got == sorted({(a, b) for a in needles for b in hays if a and b and a in b})


def test_nested_zones_rank_by_area(spark):
    def sq(x, y, s):
        return [[{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s},
                 {"x": x, "y": y + s}]]
    z = spark.createDataFrame(
        [("big", "f", "c", "u", sq(0.0, 0.0, 100.0), 0), ("small", "f", "c", "u", sq(10.0, 10.0, 20.0), 1),
         ("equal", "f", "c", "u", sq(5.0, 5.0, 20.0), 2)],
        "id string, ficha_id string, categoria string, ficha_url string, "
        "rings array<array<struct<x:double,y:double>>>, ord long")
    p = spark.createDataFrame([(1, 15.0, 15.0), (2, 90.0, 90.0), (3, 500.0, 5.0)],
                              "k int, x double, y double")
    hits = zones.zone_hits(p, z, "k")
    assert {r.k: r.id for r in zones.main_zone(hits, "k").collect()} == {1: "small", 2: "big"}
    others = {(r.k, r.id) for r in zones.overlapping_zones(hits, "k").collect()}
    assert others == {(1, "equal"), (1, "big")}


def test_ring_figures(spark):
    df = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 2.0},
                                  {"x": 0.0, "y": 2.0}],)], "r array<struct<x:double,y:double>>")
    row = df.select(G.ring_area(F.col("r")).alias("a"), G.bbox(F.col("r")).alias("b"),
                    G.vertex_mean(F.col("r")).alias("m")).first()
    assert row.a == 8.0 and tuple(row.b) == (0.0, 0.0, 4.0, 2.0) and tuple(row.m) == (2.0, 1.0)


@pytest.mark.parametrize("hot", [False, True])
def test_first_zones_equal_those_of_all_hits(spark, hot):
    rnd = random.Random(11)
    rings = []
    for z in range(60):
        cx, cy, r = rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.choice([20, 300, 1500])
        square = [(cx - r, cy - r), (cx + r, cy - r), (cx + r, cy + r), (cx - r, cy + r)]
        odd = [(cx + rnd.uniform(-r, r), cy + rnd.uniform(-r, r)) for _ in range(6)]
        rings.append((z, z % 3, rnd.choice([[square], [odd], [odd, square]])))
    pts = [(i, rnd.uniform(0, 900), rnd.uniform(0, 900)) for i in range(300)]
    pts += [(300, 64.0, 128.0), (301, float("nan"), 5.0), (302, float("inf"), 5.0), (303, None, 5.0)]
    pts += [(304, pts[0][1], pts[0][2])]
    p = spark.createDataFrame(pts, "k long, x double, y double")
    z = spark.createDataFrame([(a, b, [[{"x": x, "y": y} for x, y in r] for r in c]) for a, b, c in rings],
                              "ord long, kind long, rings array<array<struct<x: double, y: double>>>")
    opts = dict(base=16.0, share=4, floor_rows=0) if hot else {}
    hits = {}
    for k, x, y in pts[:301] + pts[304:]:
        for o, kind, rr in rings:
            if any(inside(x, y, r) for r in rr):
                hits.setdefault((k, kind), []).append(o)

    def first(rows, n):
        own = {}
        for r in rows:
            own.setdefault((r.k, r.kind), []).append(r.ord)
        return {key: sorted(v)[:n] for key, v in own.items()}

    for n in (1, 2):
        rows = spatial.first_in_zones(p, z, "k", ["ord"], ["kind"], n, **opts).collect()
        assert first(rows, n) == {key: sorted(v)[:n] for key, v in hits.items()}
        assert all(r.ord in hits[(r.k, r.kind)] for r in rows)
    # Fewer pairs than all: zones after those that cover a cell are left out.
    assert len(rows) < sum(len(v) for v in hits.values())
    any_zone = {r.k for r in zones.keys_in_zones(p, z, "k", guard="add", **opts).collect()}
    assert any_zone == {k for k, _ in hits}
    near = spatial.first_in_zones(p, z, "k", ["ord"], ["kind"], 2, 50.0, **opts).collect()
    want = {}
    for k, x, y in pts[:301] + pts[304:]:
        for o, kind, rr in rings:
            xs, ys = [v[0] for r in rr for v in r], [v[1] for r in rr for v in r]
            if x - 50 <= max(xs) and x + 50 >= min(xs) and y - 50 <= max(ys) and y + 50 >= min(ys):
                want.setdefault((k, kind), []).append(o)
    assert first(near, 2) == {key: sorted(v)[:2] for key, v in want.items()}


def test_a_place_is_looked_up_once(spark):
    p = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 1.0), (3, 5.0, 1.0), (4, None, 1.0)],
                              "k long, x double, y double")
    seen = []

    def look_up(at, key):
        seen.append(at.count())
        return at.filter("x = 0").select(key, F.lit("found").alias("what"))

    got = sorted((r.k, r.what) for r in spatial.by_place(p, "k", look_up).collect())
    assert got == [(1, "found"), (2, "found")] and seen == [2]


def test_all_zones_of_a_place_are_found_once(spark, monkeypatch):
    pick = random.Random(4)
    spots = [(pick.randint(0, 400) * 1.0, pick.randint(0, 400) * 1.0) for _ in range(40)]
    rows = [(i, *spots[i % 40]) for i in range(400)] + [(400, None, 1.0)]
    p = spark.createDataFrame(rows, "k long, x double, y double")
    shapes = [(pick.randint(0, 300), pick.randint(0, 300), pick.randint(20, 300)) for _ in range(30)]
    z = spark.createDataFrame([(f"z{i}", "", "", "", [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]], i)
                               for i, (x, y, s) in enumerate([tuple(map(float, t)) for t in shapes])],
                              "id string, ficha_id string, categoria string, ficha_url string, "
                              "rings array<array<struct<x:double,y:double>>>, ord long")
    hits = zones.zone_hits(p, z, "k")
    want = sorted(map(tuple, hits.select("k", "id").collect()))
    monkeypatch.setattr(spatial, "GATHERED", 3)
    assert spatial.gathered(p, "k").count() > 40 * 2
    got = sorted(map(tuple, zones.all_zones(p, z, "k").collect()))
    assert got == want and len(want) > 400


ZONES = ("id string, ficha_id string, categoria string, ficha_url string, "
         "rings array<array<struct<x:double,y:double>>>, ord long")


def odd_zones(spark, n):
    """Crossing rings, squares, a ring that hardly rises, equal areas; and points, some of one place."""
    rnd, rows = random.Random(21), []
    for i in range(n):
        cx, cy, r = rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.choice([20, 300, 1500])
        square = [(cx - r, cy - r), (cx + r, cy - r), (cx + r, cy + r), (cx - r, cy + r)]
        odd = [(cx + rnd.uniform(-r, r), cy + rnd.uniform(-r, r)) for _ in range(6)]
        flat = [(cx, cy), (cx + 900, cy + 1e-6), (cx + 900, cy + r), (cx, cy + r), (cx, cy)]
        rows.append((f"z{i}", f"f{i}", "c", "u", rnd.choice([[square], [odd], [odd, square], [flat]]), i))
    pts = [(i, rnd.uniform(0, 900), rnd.uniform(0, 900)) for i in range(200)]
    pts += [(200, 64.0, 128.0), (201, None, 5.0), (202, pts[0][1], pts[0][2]), (203, 9e6, 9e6)]
    return spark.createDataFrame(rows, ZONES), spark.createDataFrame(pts, "k long, x double, y double")


@pytest.mark.parametrize("hot", [False, True])
def test_other_zones_equal_those_of_all_hits(spark, hot):
    z, p = odd_zones(spark, 40)
    want = sorted(map(tuple, zones.overlapping_zones(zones.zone_hits(p, z, "k"), "k").select("k", "id").collect()))
    opts = dict(base=16.0, share=4, floor_rows=0) if hot else {}
    got = zones.other_zones(p, z, "k", **opts)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 400


def test_zone_lookup_moves_no_list_of_zones(spark):
    from lindero.plans.enrichment import zone_lookup
    from lindero.registry import DEFAULT_REGISTRY
    home = DEFAULT_REGISTRY[0]

    def sq(x, y, s):
        x, y = x + home.xmin, y + home.ymin
        return [[{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]]
    z = spark.createDataFrame(
        [("big", "f1", "c", "u1", sq(0.0, 0.0, 500.0), 0), ("small", "f2", "d", "u2", sq(10.0, 10.0, 20.0), 1),
         ("equal", "f3", "e", "u3", sq(5.0, 5.0, 20.0), 2)], ZONES)
    spots = [(1, 15.0, 15.0), (2, 15.0, 15.0), (3, 90.0, 90.0), (4, 900.0, 5.0), (5, -9.0, 5.0), (6, None, 5.0)]
    p = spark.createDataFrame([(k, x if x is None else x + home.xmin, y + home.ymin) for k, x, y in spots],
                              "rc14 int, x double, y double")
    cards = spark.createDataFrame([("small", "d2", "Long")], "zone string, categoria string, nombre_largo string")
    records = spark.createDataFrame([("big", 7.5)], "key string, superficie double")
    got = zone_lookup(p, z, cards, records, home)
    rows = {r.rc14: (r.inside, r.id, r.ficha_id, r.nombre_largo, r.superficie, r.overlapping, r.note) for r in got.collect()}
    note = "inside the extent but in no zone"
    assert rows == {1: (True, "small", "f2", "Long", None, ["equal", "big"], None),
                    2: (True, "small", "f2", "Long", None, ["equal", "big"], None),
                    3: (True, "big", "f1", None, 7.5, [], None), 4: (True, None, None, None, None, None, note),
                    5: (False, None, None, None, None, None, None), 6: (None, None, None, None, None, None, None)}
    # Points come back after the last join.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_ids") < plan.index("Join")


def test_equal_boxes_are_looked_up_once(spark, monkeypatch):
    from pyspark.sql import DataFrame
    spots = [(0.0, 0.0), (0.0, 0.0), (40.0, 0.0), (0.0, 0.0), (900.0, 900.0)]
    req = spark.createDataFrame([(i, f"r{i}", x, y) for i, (x, y) in enumerate(spots)],
                                "req long, note string, x double, y double").select(
        "req", "note", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 30).alias("x1"),
                                (F.col("y") + 30).alias("y1")).alias("box"))
    par = spark.createDataFrame([(n, [(x, 5.0), (x + 10, 5.0), (x + 10, 15.0), (x, 15.0)])
                                 for n, x in (("a", 5.0), ("b", 30.0), ("c", 200.0))],
                                "refcat string, poly array<struct<x:double,y:double>>")
    chunks = spark.createDataFrame([(0, 0, 500, 500)], "x1 int, y1 int, x2 int, y2 int")
    seen, join = [], zones.box_join

    def counted(left: DataFrame, *rest, **opts):
        seen.append(left.count())
        return join(left, *rest, **opts)
    monkeypatch.setattr(zones, "box_join", counted)
    rows = zones.parcels_in_boxes(req, par, chunks, "req").collect()
    want = [(i, f"r{i}", True, n) for i in (0, 1, 3) for n in "ab"] + [(2, "r2", True, "b"), (4, "r4", False, None)]
    assert sorted((r.req, r.note, r.covered, r.refcat) for r in rows) == sorted(want) and seen == [2]


def test_levels_of_zones_are_planned_one_by_one(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    plans, put = [], DataFrameWriter.parquet

    def seen(self, path, *args, **kw):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return put(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    p = spark.createDataFrame([(i, 10.0 + 97 * i, 20.0) for i in range(30)], "k int, x double, y double")
    z = spark.createDataFrame([(i, [[(0.0, 0.0), (s, 0.0), (s, 40.0), (0.0, 40.0), (0.0, 0.0)]]) for i, s in enumerate(
        (50.0, 120.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0))], "ord int, rings array<array<struct<x:double,y:double>>>")
    got = {r.k: r.ord for r in spatial.first_in_zones(p, z, "k", ["ord"], limit=1).groupBy("k").agg(
        F.min("ord").alias("ord")).collect()}
    size = (50, 120, 250, 500, 1000, 2000, 4000)
    assert got == {i: next(n for n, s in enumerate(size) if 10 + 97 * i < s) for i in range(30)}
    # Each plan has one level, however many there are.
    assert max(plans) < 50, plans


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    import os

    from lindero import session
    shared = session.shared_dir(spark)

    def left():
        return {f for f in os.listdir(shared) if f.startswith(("inner", "deep", "kept", "outer"))}

    def deep():
        return session.settle(spark.range(5), "deep").filter("id > 1")

    def make():
        one = session.settle(spark.range(9), "inner")
        return one.join(session.settle_alone(deep, "kept"), "id")

    out = session.settle_alone(make, "outer")
    assert [f.split("-")[0] for f in left()] == ["outer"] and out.count() == 3
    session.settle(spark.range(1), "kept")
    assert len(left()) == 2


def test_zones_are_not_shuffled_to_meet_few_cells(spark, monkeypatch):
    cells = spark.createDataFrame([(i, j) for i in range(6) for j in range(5)], "_cx long, _cy long")
    zones = spark.createDataFrame([(i, [[(i * 20.0, 0.0), (i * 20 + s, 0.0), (i * 20 + s, s), (i * 20.0, s), (i * 20.0, 0.0)]])
                                   for i, s in enumerate((50.0, 300.0, 900.0))], "ord int, rings array<array<struct<x:double,y:double>>>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {}
        for few in (spatial.FEW_CELLS, 0):
            monkeypatch.setattr(spatial, "FEW_CELLS", few)
            rows = spatial.cell_zones(cells, zones, spatial.BASE_M, "add")
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan) == (few == 0)
            found[few] = sorted((r["_cx"], r["_cy"], r["ord"], r["_prep"] is None) for r in rows.collect())
        assert found[0] == found[max(found)] and len(found[0]) > 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
