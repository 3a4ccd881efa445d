from pyspark.sql import functions as F

from lindero.functions import grid, keys
from lindero.operators import locate as L
from lindero.plans.location import locate_keys
from lindero.registry import DEFAULT_REGISTRY, Municipality, as_struct

# Positions with their sheet and relative place.
GOLDEN = [
    (270012.86, 4805037.449, "16-K", "I", "NW", "PLANO_16_K_I.pdf", 0.2006, 0.9621),
    (270205.357, 4806520.942, "16-I", "I", "NW", "PLANO_16_I_I.pdf", 0.555, 0.7113),
    (270564.852, 4805389.373, "16-J", "IV", "SE", "PLANO_16_J_IV.pdf", 0.2631, 0.9507),
    (271395.012, 4807149.445, "17-H", "I", "NW", "PLANO_17_H_I.pdf", 0.8377, 0.8922),
    (263563.476, 4804736.246, "9-K", "IV", "SE", "PLANO_9_K_IV.pdf", 0.7265, 0.8363),
    (267389.546, 4804590.695, "13-L", "II", "NE", "PLANO_13_L_II.pdf", 0.14, 0.2894),
    (267939.676, 4805193.033, "14-K", "I", "NW", "PLANO_14_K_I.pdf", 0.199, 0.5412),
    (268655.482, 4804931.179, "14-K", "IV", "SE", "PLANO_14_K_IV.pdf", 0.563, 0.3089),
    (268992.649, 4806207.833, "15-I", "III", "SW", "PLANO_15_I_III.pdf", 0.23, 0.6177),
    (269537.688, 4804757.24, "15-K", "IV", "SE", "PLANO_15_K_IV.pdf", 0.2796, 0.7795),
    (269914.449, 4805093.839, "15-K", "II", "NE", "PLANO_15_K_II.pdf", 0.9733, 0.8096),
]


def test_golden_positions(spark):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(GOLDEN)],
                               "i int, x double, y double")
    rows = L.grid_columns(df, as_struct(DEFAULT_REGISTRY[0])).orderBy("i").collect()
    for row, want in zip(rows, GOLDEN):
        assert (row.cell, row.sub, row.compass, row.sheet_name) == want[2:6]
        assert abs(row.rx - want[6]) <= 1e-4 and abs(row.ry - want[7]) <= 1e-4


def test_strict_and_lenient_keys(spark):
    valid = ["8653019TP6085S0002QW", "9254317TP6095S0001ZT", "9651017TP6095S", " 9651017tp6095s\n"]
    invalid = ["", "ABC", "no-es-una-rc", "8653019TP6085S00", "12345", "8653019TP6085S0002Q", None]
    df = spark.createDataFrame([(v,) for v in valid + invalid], "raw string")
    out = {r.raw: (r.rc14, r.error) for r in L.validate_keys(df).collect()}
    assert all(len(out[v][0]) == 14 and out[v][1] is None for v in valid)
    assert all(out[v][0] is None for v in invalid)
    assert out[None][1] == "not_text" and out["ABC"][1] == "bad_length"
    lenient = {
        "9651017TP6095S0001IT": True, "33900A10600069": True, "9651017tp6095s0001it": True,
        "AAAA": False, "A" * 13: False, "A" * 15: False, "A" * 21: False,
        "9651017TP6095S 0001IT": False, "9651017TP6095S0001I!": False, "../../etc/passwd": False}
    df = spark.createDataFrame([(v,) for v in lenient], "raw string")
    got = {r.raw: r.ok for r in df.select("raw", keys.is_lenient(F.col("raw")).alias("ok")).collect()}
    assert got == lenient


ROUTES = [
    (264600.0, 4805400.0, None, 33044), (284900.0, 4824800.0, None, 33024),
    (274000.0, 4814000.0, None, 33044), (274000.0, 4814000.0, 33024, 33024),
    (264600.0, 4805400.0, 99999, None), (440000.0, 4475000.0, None, None)]


def test_routing(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ROUTES)],
                               "rc14 int, x double, y double, given_ine int")
    got = {r.rc14: r.id_ine for r in L.route_known(df).collect()}
    assert [got[i] for i in range(len(ROUTES))] == [r[3] for r in ROUTES]


def test_large_registry_routes_like_the_inline_form(spark):
    many = [Municipality(id_ine=i, slug=str(i), xmin=i * 10.0, ymin=0.0, xmax=i * 10.0 + 25,
                         ymax=50.0) for i in range(100)]
    df = spark.range(300).select(F.col("id").alias("rc14"), (F.col("id") * 3.3).alias("x"),
                                 F.lit(10.0).alias("y"))
    wide = {r.rc14: r.id_ine for r in L.route(df, many).collect()}
    for rc, ine in wide.items():
        x = rc * 3.3
        want = next((m.id_ine for m in many if m.xmin <= x <= m.xmax), None)
        assert ine == want


def test_rows_of_one_key_are_routed_by_their_own_place(spark):
    for n in (64, 65, 200):
        many = [Municipality(id_ine=i, slug=str(i), xmin=i * 10.0, ymin=0.0, xmax=i * 10.0 + 9,
                             ymax=50.0) for i in range(n)]
        df = spark.createDataFrame([("k", 5.0, 1.0), ("k", 105.0, 1.0), ("k", 1e6, 1.0),
                                    (None, 5.0, 1.0), ("k", None, None)],
                                   "rc14 string, x double, y double")
        got = sorted(L.route(df, many).collect(), key=repr)
        assert sorted((repr(r.rc14), repr(r.x), r.id_ine) for r in got if r.id_ine is not None) == [
            ("'k'", "105.0", 10), ("'k'", "5.0", 0), ("None", "5.0", 0)] and len(got) == 5


def test_two_gridded_municipalities_with_equal_names(spark):
    from dataclasses import replace
    from lindero.operators import calibration as C
    from lindero.plans.location import locate_with_quality
    from lindero.registry import DEFAULT_REGISTRY
    home, shift = DEFAULT_REGISTRY[0], 100_000.0
    away = replace(home, id_ine=2, xmin=home.xmin + shift, xmax=home.xmax + shift,
                   x0=home.x0 + shift, snu_x0=home.snu_x0 + shift)
    towns = (home, away)
    x, y = 270012.86, 4805037.449
    coords = spark.createDataFrame([("1111111TP1111A", x, y, "a"), ("2222222TP2222A", x + shift, y, "b")],
                                   "rc14 string, x double, y double, address string")
    sheets = spark.createDataFrame([(home.id_ine, "PLANO_16_K_I.pdf", "home"),
                                    (2, "PLANO_16_K_I.pdf", "away")],
                                   "id_ine int, sheet_name string, url string")
    labels = spark.createDataFrame(
        [("1111111TP1111A", "accept", 5, 5, 0, 0), ("2222222TP2222A", "accept", 20, 1, 0, 0)],
        "rc string, action string, dx int, dy int, cal_dx int, cal_dy int")
    calibration = C.recalibrate(labels, coords, None, towns)
    again = C.recalibrate(labels, coords, calibration, towns)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, calibration.collect()))
    assert calibration.count() == 6
    requests = spark.createDataFrame([("1111111TP1111A",), ("2222222TP2222A",), ("bad",)], "raw string")
    got = {r.raw: r for r in locate_with_quality(requests, coords, sheets, calibration, towns).collect()}
    assert len(got) == 3 and got["bad"].cal_dx is None and got["bad"].reliability is None
    one, two = got["1111111TP1111A"], got["2222222TP2222A"]
    assert (one.sheet_url, one.cal_dx, one.cal_dy, one.n_labels) == ("home", 10, 10, 1)
    assert (two.sheet_url, two.cal_dx, two.cal_dy, two.n_labels) == ("away", 40, 2, 1)
    rural = spark.createDataFrame([(home.id_ine, "PLANO_A_1.pdf"), (2, "PLANO_B_2.pdf")],
                                  "id_ine int, sheet_name string")
    points = L.route(coords, towns)
    near = {r.rc14[0]: r.snu_sheet for r in L.nearest_rural_sheet(points, rural, towns).collect()}
    assert near == {"1": "PLANO_A_1.pdf", "2": "PLANO_B_2.pdf"}


def test_full_record_of_a_moved_key(spark):
    from lindero import schemas
    from lindero.plans.location import locate_keys
    from lindero.plans.records import result_records
    coords = spark.createDataFrame([("0152067TP7005S", 270012.86, 4805037.449, "street")],
                                   "rc14 string, x double, y double, address string")
    sheets = spark.createDataFrame([("PLANO_16_K_I.pdf", "url")], "sheet_name string, url string")
    requests = spark.createDataFrame([(1, "0152067TP7005S"), (2, "bad")], "job int, raw string")
    located = locate_keys(requests, coords, sheets)
    calibration = spark.createDataFrame(
        [("quadrant", "15-L-II", 1.0, 2.0, 4, 3.0, 4.0, 5.0, True)], schemas.CALIBRATION)
    snaps = spark.createDataFrame([("0152067TP7005S", 3, -4, 0.2)], "rc14 string, dx int, dy int, score double")
    tried = [("PLANO_15_L_II.pdf", 0.6)]
    moves = spark.createDataFrame(
        [("0152067TP7005S", "PLANO_15_L_II.pdf", 0.6, 7, 1, "PLANO_16_K_I.pdf", 0.2, 0.6, tried)],
        "rc14 string, sheet_name string, snap_score double, dx int, dy int, from_sheet string,"
        " from_score double, to_score double,"
        " tried array<struct<sheet:string,score:double>>")
    parcels = spark.createDataFrame([("0152067TP7005S", 12.5, "P1")],
                                    "refcat string, area_m2 double, label string")
    units = spark.createDataFrame([("0152067TP7005S",)] * 3, "rc14 string")
    got = result_records(located, calibration, snaps, moves, parcels, units).collect()
    assert len(got) == 1
    r = got[0].asDict(recursive=True)
    assert len(r) == 20 and r.pop("job") == 1 and r.pop("raw") == r["rc"]
    assert (r["cell"], r["sub_quadrant"], r["sheet_name"]) == ("15-L", "II", "PLANO_15_L_II.pdf")
    assert r["edge_override"] == {"from_sheet": "PLANO_16_K_I.pdf", "from_score": 0.2,
                                  "to_sheet": "PLANO_15_L_II.pdf", "to_score": 0.6}
    assert r["edge_candidates_tried"] == [{"sheet": "PLANO_15_L_II.pdf", "score": 0.6}]
    assert r["snap"] == {"dx": 7, "dy": 1, "score": 0.6}  # of the sheet it was moved to
    assert r["calibration_quality"]["source"] == "quadrant" and r["calibration_quality"]["n_labels"] == 4
    assert (r["polygon_area_m2"], r["polygon_label"], r["n_units"], r["municipality"]) == (
        12.5, "P1", 3, "m33044")
    assert r["utm"] == {"x": 270012.86, "y": 4805037.449} and r["body_relative"]["rx"] == 0.2006


def test_rural_letters_come_from_the_entry(spark):
    from dataclasses import replace
    from lindero.registry import DEFAULT_REGISTRY
    wide = replace(DEFAULT_REGISTRY[0], snu_letters="ABCDEFGHIJKL", snu_rows=12)
    sheets = spark.createDataFrame([("PLANO_L_3.pdf",), ("PLANO_M_3.pdf",)], "sheet_name string")
    assert [tuple(r) for r in L.available_rural_cells(sheets, wide).collect()] == [("L", 3, 11)]


def test_reject_reasons(spark):
    coords = spark.createDataFrame([
        ("1111111TP1111A", 270012.86, 4805037.449, "a"), ("2222222TP2222A", 100.0, 100.0, "b"),
        ("3333333TP3333A", 284900.0, 4824800.0, "c"), ("4444444TP4444A", 260000.0, 4814900.0, "d"),
        ("5555555TP5555A", 270205.357, 4806520.942, "e")],
        "rc14 string, x double, y double, address string")
    sheets = spark.createDataFrame([("PLANO_16_K_I.pdf", "u")], "sheet_name string, url string")
    raws = ["1111111TP1111A", "2222222TP2222A", "3333333TP3333A", "4444444TP4444A",
            "5555555TP5555A", "6666666TP6666A", "junk", None]
    req = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.i: r.reason for r in locate_keys(req, coords, sheets).collect()}
    assert [got[i] for i in range(8)] == [
        None, "out_of_extent", "no_grid", "row_out_of_range", "no_sheet", "not_found",
        "bad_format", "bad_format"]


def test_rural_grid(spark):
    inside = [(264600.0, 4805400.0), (265200.0, 4806000.0), (264000.0, 4805000.0)]
    outside = [(0.0, 0.0), (440000.0, 4470000.0)]
    df = spark.createDataFrame(inside + outside, "x double, y double")
    m = as_struct(DEFAULT_REGISTRY[0])
    got = {(r.x, r.y): r.snu_exact for r in L.rural_columns(df, m).collect()}
    assert all(got[p].startswith("PLANO_") for p in inside) and not any(got[p] for p in outside)


def test_central_meridian_and_known_point(spark):
    df = spark.createDataFrame([(-3.0, 43.0), (-5.845, 43.3614)], "lon double, lat double")
    u = df.select(grid.lonlat_to_utm30(F.col("lon"), F.col("lat")).alias("u")).collect()
    assert u[0].u.x == 500000.0
    # Quadrant length of the meridian at 43 degrees times the scale factor.
    assert abs(u[0].u.y - 0.9996 * 4762815.9) < 300
    assert 269000 < u[1].u.x < 270500 and 4804000 < u[1].u.y < 4806500


def test_moved_records_over_the_given_tables(spark):
    from parity import sources  # noqa: F401
    from parity.base import ORACLE, QUERIES
    from parity.check import compare, duck
    sf = "/root/testdata/sf0.001"
    query = QUERIES["snk1_moved_records"]
    rows = query(spark, sf).collect()
    moved = [r for r in rows if r.from_sheet is not None]
    assert moved and all(r.sheet_name == r.to_sheet != r.from_sheet for r in moved)
    assert all(r.sheet_name == f"PLANO_{r.cell.replace('-', '_')}_{r.sub_quadrant}.pdf" for r in rows)
    assert any(r.n_tried and r.from_sheet is None for r in rows)
    for field in ("polygon_area_m2", "polygon_label"):
        assert {r[field] is None for r in rows} == {True, False}
    assert compare(spark, duck(sf), sf, query, ORACLE["snk1_moved_records"])[0].startswith("ok")


def test_a_rural_cell_is_worked_out_once_however_it_is_filtered(spark):
    m = as_struct(DEFAULT_REGISTRY[0])
    p = spark.range(40).select("id", (F.col("id") * 3000.0 + 240000).alias("x"), F.lit(4805000.0).alias("y"))
    out = L.rural_columns(p, m)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 40 and rows[0].snu_col is None and rows[0].snu_exact is None and rows[5].snu_exact
    kept = out.filter(F.col("snu_col").isNotNull()).filter((F.col("snu_col") * 5 + F.col("snu_row") * 3) % 3 != 0)
    assert {r.id for r in kept.collect()} == {
        k for k, r in rows.items() if r.snu_col is not None and (r.snu_col * 5 + r.snu_row * 3) % 3}
    # Not anew for every part that is read or filtered.
    plan = kept.select("snu_exact").distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("pmod(") < 10
