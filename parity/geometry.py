"""Rings, projections, zones, layer features and parcels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lindero.functions import geometry as GM
from lindero.functions import grid, text
from lindero.operators import locate as L
from lindero.operators import zones as Z
from lindero.operators.skew import first_per_key
from lindero.operators.spatial import by_place
from lindero.registry import as_struct
from parity import derived as D
from parity.base import add, table
from parity.derived import G, with_sql


def home():
    return as_struct(D.HOME)


def show_px(poly):
    return F.array_join(F.transform(
        poly, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), ";")


ELL_LIST = ("[{'x': ox, 'y': oy}, {'x': ox + w, 'y': oy}, {'x': ox + w, 'y': oy + h / 2},"
            " {'x': ox + w / 2, 'y': oy + h / 2}, {'x': ox + w / 2, 'y': oy + h},"
            " {'x': ox, 'y': oy + h}, {'x': ox, 'y': oy}]")


def sql_px(x: str, y: str) -> str:
    return (f"array_to_string(list_transform({ELL_LIST}, lambda p: ({x})::VARCHAR || ',' || "
            f"({y})::VARCHAR), ';')")


D.define("zone_areas", """
SELECT zid, abs(sum(xj * yi - xi * yj)) / 2 AS area, min(xi) AS x0, min(yi) AS y0, max(xi) AS x1,
       max(yi) AS y1 FROM zone_edges GROUP BY zid""", "zone_edges")


@add("ag1_polygon_bbox", with_sql("SELECT refcat, ox AS x0, oy AS y0, ox + w AS x1, oy + h AS y1 FROM"
                                  " parcels", "parcels"))
def _(spark, sf):
    return D.parcels(spark, sf).withColumn("b", GM.bbox(F.col("poly"))).select("refcat", "b.*")


@add("ag2_vertex_mean", with_sql("""
SELECT refcat, (ox + (ox + w) + (ox + w) + (ox + w / 2) + (ox + w / 2) + ox + ox) / 7 AS x,
       (oy + oy + (oy + h / 2) + (oy + h / 2) + (oy + h) + (oy + h) + oy) / 7 AS y FROM parcels""", "parcels"))
def _(spark, sf):
    return D.parcels(spark, sf).withColumn("m", GM.vertex_mean(F.col("poly"))).select(
        "refcat", "m.*")


@add("ag3_shoelace_area", with_sql("""
SELECT id, w * h * 0.75 * CASE WHEN twin THEN 2 ELSE 1 END AS area FROM zones""", "zones"))
def _(spark, sf):
    return D.zones(spark, sf).select("id", GM.rings_area(F.col("rings")).alias("area"))


# ---- layer features ----------------------------------------------------------------------

LAYER_SQL = ("CASE s_suppkey % 6 WHEN 0 THEN 'n15_UNIDADES_GESTION' WHEN 1 THEN 'n25_AREAS_MODIF_URBANISTICAS'"
             " WHEN 2 THEN 'n22_INSTRUMENTOS_PLANEAMIENTO' WHEN 3 THEN 'n12_USOS_PORMENORIZADOS'"
             " WHEN 4 THEN 'n06_NUCLEOS_RURALES' ELSE 'n07_SIST_GENERALES_AREAS' END")
D.define("features", f"""
SELECT z.id, s.s_suppkey AS ord, {LAYER_SQL} AS layer, s.s_suppkey % 6 AS layer_ord,
  CASE WHEN s.s_suppkey % 10 = 9 THEN 33024 ELSE 33044 END AS id_municipio,
  CASE WHEN s.s_suppkey % 4 = 0 THEN '' ELSE 'UG-' || n_name END AS label,
  CASE WHEN s.s_suppkey % 3 = 0 THEN NULL ELSE n_name || ' ' || (s.s_suppkey % 50)::VARCHAR END AS area_name,
  CASE WHEN s.s_suppkey % 6 = 2 AND s.s_suppkey % 5 <> 0 THEN 'PLAN ' || r_name END AS instrument,
  CASE WHEN s.s_suppkey % 6 = 4 THEN r_name END AS official,
  CASE WHEN s.s_suppkey % 6 = 3 THEN 'ORD ' || n_name END AS ordinance,
  CASE WHEN s.s_suppkey % 12 = 0 THEN 'RESIDENCIAL' END AS use1,
  CASE WHEN s.s_suppkey % 6 = 3 THEN 'TERCIARIO' END AS use2,
  (s.s_suppkey % 40 / 10.0)::DOUBLE::VARCHAR AS ratio, ox, oy, w, h
FROM supplier s JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN zones z ON z.tier = 0 AND z.zk = s.s_suppkey""", "zones")


def features(spark, sf):
    s = F.col("zk")
    six = s % 6
    layer = None
    for i, name in enumerate(Z.LAYERS):
        layer = F.when(six == i, name) if layer is None else layer.when(six == i, name)
    z = D.zones(spark, sf).filter(F.col("tier") == 0) \
        .join(table(spark, sf, "nation"), F.col("nat") == F.col("n_nationkey")) \
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n, r = F.col("n_name"), F.col("r_name")
    props = {
        Z.LABEL: F.when(s % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("UG-"), n)),
        Z.AREA_NAME: F.when(s % 3 != 0, F.concat(n, F.lit(" "), (s % 50).cast("string"))),
        Z.INSTRUMENT_NAME: F.when((six == 2) & (s % 5 != 0), F.concat(F.lit("PLAN "), r)),
        Z.OFFICIAL_NAME: F.when(six == 4, r),
        Z.ORDINANCE_NAME: F.when(six == 3, F.concat(F.lit("ORD "), n)),
        Z.USE: F.when(s % 12 == 0, F.lit("RESIDENCIAL")),
        Z.USE_DETAIL: F.when(six == 3, F.lit("TERCIARIO")),
        Z.FLOOR_RATIO: ((s % 40) / F.lit(10.0)).cast("string"),
    }
    return z.select(
        "id", s.alias("ord"), layer.alias("layer"), six.alias("layer_ord"),
        F.when(s % 10 == 9, 33024).otherwise(33044).alias("id_municipio"),
        F.create_map(*[c for k, v in props.items() for c in (F.lit(k), v)]).alias("props"),
        F.substring(layer, 1, 3).alias("categoria"), "rings")


@add("wn4_first_listed", """
SELECT l_orderkey AS k, l_partkey AS pk, l_suppkey AS sk FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"))
    return first_per_key(rows, ["k"], [F.col("ln"), F.col("pk"), F.col("sk")]).drop("ln")


@add("ag4_zone_summary", with_sql("""
SELECT etiqueta, layer, substr(layer, 1, 3) AS categoria, ox AS xmin, oy AS ymin,
  CASE WHEN twin THEN ox + w + 100 + w ELSE ox + w END AS xmax, oy + h AS ymax,
  round_even(CASE WHEN twin THEN (s7x + s7x2) / 14 ELSE s7x / 7 END, 2) AS cx, round_even(s7y / 7, 2) AS cy,
  CASE WHEN twin THEN 14 ELSE 7 END AS n_points
FROM (SELECT f.*, ord % 7 = 0 AS twin, coalesce(nullif(label, ''), nullif(area_name, ''), instrument, '') AS etiqueta,
        ox + (ox + w) + (ox + w) + (ox + w / 2) + (ox + w / 2) + ox + ox AS s7x,
        (ox + w + 100) * 7 + 3 * w AS s7x2,
        oy + oy + (oy + h / 2) + (oy + h / 2) + (oy + h) + (oy + h) + oy AS s7y FROM features f)
WHERE etiqueta <> ''
QUALIFY row_number() OVER (PARTITION BY etiqueta ORDER BY layer_ord DESC, ord DESC) = 1""", "features"))
def _(spark, sf):
    return Z.zone_summary(features(spark, sf))


# ---- points in zones ----------------------------------------------------------------------

@add("sf12_point_in_ring", with_sql("""
SELECT refcat, i, (SELECT count(*) FROM (SELECT unnest(e) AS g) WHERE (g.yi > y) <> (g.yj > y)
   AND x < (g.xj - g.xi) * (y - g.yi) / (g.yj - g.yi + 1e-12::DOUBLE) + g.xi) % 2 = 1 AS inside
FROM (SELECT refcat, i, ox + (i * 37 % 120) / 100.0::DOUBLE * w AS x, oy + (i * 61 % 120) / 100.0::DOUBLE * h AS y, [
  {'xi': ox + w, 'yi': oy, 'xj': ox, 'yj': oy},
  {'xi': ox + w, 'yi': oy + h / 2, 'xj': ox + w, 'yj': oy},
  {'xi': ox + w / 2, 'yi': oy + h / 2, 'xj': ox + w, 'yj': oy + h / 2},
  {'xi': ox + w / 2, 'yi': oy + h, 'xj': ox + w / 2, 'yj': oy + h / 2},
  {'xi': ox, 'yi': oy + h, 'xj': ox + w / 2, 'yj': oy + h},
  {'xi': ox, 'yi': oy, 'xj': ox, 'yj': oy + h}] AS e
  FROM parcels, range(8) t(i))""", "parcels"))
def _(spark, sf):
    i = F.col("i")
    p = D.parcels(spark, sf).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    x = F.col("ox") + (i * 37 % 120) / F.lit(100.0) * F.col("w")
    y = F.col("oy") + (i * 61 % 120) / F.lit(100.0) * F.col("h")
    return p.select("refcat", "i", GM.in_ring(x, y, F.col("poly")).alias("inside"))


@add("jn6_points_in_zones", with_sql("SELECT k, id FROM hits", "hits"))
def _(spark, sf):
    return Z.all_zones(D.points(spark, sf), D.zones(spark, sf), "k")


D.define("ranked", """
SELECT h.k, h.id, row_number() OVER (PARTITION BY k ORDER BY w * z.h * 0.75 * CASE WHEN twin THEN 2 ELSE 1 END, ord) AS rank,
       z.ord
FROM hits h JOIN zones z ON z.id = h.id""", "hits", "zones")


@add("jn7_most_specific_zone", with_sql("SELECT k, id FROM ranked WHERE rank = 1", "ranked"))
def _(spark, sf):
    return by_place(D.points(spark, sf), "k", lambda at, key: Z.main_zones(
        at, D.zones(spark, sf), key)).select("k", "id")


@add("jn8_overlapping_zones", with_sql("SELECT k, id FROM ranked WHERE rank > 1", "ranked"))
def _(spark, sf):
    return Z.other_zones(D.points(spark, sf), D.zones(spark, sf), "k")


@add("jn9_keys_in_card_zones", with_sql("""
SELECT DISTINCT rc14 FROM hits JOIN zones USING (id) WHERE zk % 3 = 1""", "hits", "zones"))
def _(spark, sf):
    carded = D.zones(spark, sf).filter(F.col("zk") % 3 == 1)
    inside = by_place(D.points(spark, sf), "k", lambda at, key: Z.keys_in_zones(
        at, carded, key).select(key))
    return D.points(spark, sf).join(inside, "k", "left_semi").select("rc14")


# What tells two looked-up places apart.
PLACE = ("x", "y", "id_ine")


def routed(spark, sf):
    return L.route(D.points(spark, sf).select("k", "rc14", "x", "y")).filter("id_ine is not null")


D.define("found", """
SELECT p.k, f.* FROM (SELECT DISTINCT k, id FROM hits) hh JOIN features f ON f.id = hh.id
JOIN points p ON p.k = hh.k
WHERE f.id_municipio = CASE WHEN x BETWEEN 253000 AND 278000 AND y BETWEEN 4798000 AND 4815000 THEN 33044
 WHEN x BETWEEN 270921 AND 292773 AND y BETWEEN 4813038 AND 4829451 THEN 33024 END
QUALIFY row_number() OVER (PARTITION BY p.k, f.layer ORDER BY f.ord) <= 10""", "hits", "features", "points")


@add("jn10_planning_layers", with_sql("""
SELECT k, layer, count(*) AS n, string_agg(id, ',' ORDER BY ord) AS ids FROM found GROUP BY k, layer""", "found"))
def _(spark, sf):
    def layers(at, key):
        return Z.features_at(at, features(spark, sf), key).groupBy(key, "layer").agg(
            F.count(F.lit(1)).alias("n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))),
                                     lambda s: s["id"]), ",").alias("ids"))

    return by_place(routed(spark, sf), "k", layers, PLACE)


@add("jn12_zone_name", with_sql("""
WITH f1 AS (SELECT k, layer_ord, arg_min(f, f.ord) AS f FROM found f GROUP BY k, layer_ord),
w AS (SELECT k, any_value(f) FILTER (layer_ord = 0) AS n15, any_value(f) FILTER (layer_ord = 1) AS n25,
  any_value(f) FILTER (layer_ord = 2) AS n22, any_value(f) FILTER (layer_ord = 3) AS n12,
  any_value(f) FILTER (layer_ord = 4) AS n06 FROM f1 GROUP BY k)
SELECT k, coalesce(n15.area_name, nullif(n15.label, ''), n25.area_name, nullif(n25.label, ''),
   n22.instrument, n22.official, n22.ordinance, nullif(n22.label, ''),
   n06.instrument, n06.official, n06.ordinance, nullif(n06.label, ''),
   n12.instrument, n12.official, n12.ordinance, nullif(n12.label, '')) AS ambito,
   coalesce(nullif(n15.label, ''), nullif(n25.label, ''), nullif(n22.label, '')) AS etiqueta,
   n15 IS NOT NULL OR n25 IS NOT NULL OR n22 IS NOT NULL AS has_card_zone,
   coalesce(n15.use1, n12.use2) AS uso_predominante, n15.ratio::DOUBLE AS edificabilidad FROM w""".replace(
    "WITH f1 AS", "WITH f1 AS").replace("SELECT k, coalesce(n15", "SELECT k, coalesce(n15"), "found")
    .replace("\nWITH f1 AS", ", f1 AS"))
def _(spark, sf):
    found = by_place(routed(spark, sf), "k", lambda at, key: Z.resolve_names(
        Z.features_at(at, features(spark, sf), key, per_layer=1), key), PLACE)
    return found.select(
        "k", "ambito", "etiqueta", "has_card_zone", "uso_predominante", "edificabilidad")


# Heritage features: the small zones.
D.define("heritage", """
SELECT id, ord, CASE WHEN zk % 2 = 0 THEN 'n23_ELEM_CATALOGADOS_AREAS' ELSE 'n27_BICS' END AS layer,
  CASE WHEN zk % 11 = 0 THEN 33024 ELSE 33044 END AS id_municipio,
  CASE WHEN zk % 3 = 0 THEN 'BIC ' || zk::VARCHAR ELSE '' END AS bic,
  CASE WHEN zk % 3 = 1 THEN 'ELEM ' || zk::VARCHAR END AS elem, 'H' || (zk % 9)::VARCHAR AS label,
  ox AS hx0, oy AS hy0, CASE WHEN twin THEN ox + w + 100 + w ELSE ox + w END AS hx1, oy + h AS hy1
FROM zones WHERE tier = 1""", "zones")


def heritage(spark, sf):
    zk = F.col("zk")
    props = F.create_map(
        F.lit("Nombre_del_BIC"), F.when(zk % 3 == 0, F.concat(F.lit("BIC "), zk.cast("string")))
        .otherwise(F.lit("")),
        F.lit("Denominación_Elemento_Protegido"),
        F.when(zk % 3 == 1, F.concat(F.lit("ELEM "), zk.cast("string"))),
        F.lit(Z.LABEL), F.concat(F.lit("H"), (zk % 9).cast("string")))
    return D.zones(spark, sf).filter(F.col("tier") == 1).select(
        "id", "ord", F.when(zk % 2 == 0, Z.HERITAGE_LAYERS[0]).otherwise(Z.HERITAGE_LAYERS[1])
        .alias("layer"), F.when(zk % 11 == 0, 33024).otherwise(33044).alias("id_municipio"),
        props.alias("props"), "rings")


D.define("near_heritage", """
SELECT p.k, hh.layer AS tipo, hh.ord, coalesce(nullif(bic, ''), elem, label) AS nombre, label AS etiqueta
FROM points p JOIN heritage hh ON p.x + 50 >= hx0 AND p.x - 50 <= hx1 AND p.y + 50 >= hy0 AND p.y - 50 <= hy1
WHERE hh.id_municipio = CASE WHEN x BETWEEN 253000 AND 278000 AND y BETWEEN 4798000 AND 4815000 THEN 33044
 WHEN x BETWEEN 270921 AND 292773 AND y BETWEEN 4813038 AND 4829451 THEN 33024 END
QUALIFY row_number() OVER (PARTITION BY p.k, hh.layer ORDER BY hh.ord) <= 10""", "points", "heritage")


@add("jn11_heritage_near", with_sql("SELECT * FROM near_heritage", "near_heritage"))
def _(spark, sf):
    return by_place(routed(spark, sf), "k", lambda at, key: Z.heritage_near(
        at, heritage(spark, sf), key), PLACE).select(
        "k", "tipo", "ord", "nombre", "etiqueta")


# ---- parcels ------------------------------------------------------------------------------

D.define("chunks", """
SELECT DISTINCT (floor(ox / 500) * 500)::INT AS x1, (floor(oy / 500) * 500)::INT AS y1,
  (floor(ox / 500) * 500)::INT + 500 AS x2, (floor(oy / 500) * 500)::INT + 500 AS y2 FROM parcels""", "parcels")


def chunks(spark, sf):
    x1 = (F.floor(F.col("ox") / 500) * 500).cast("int")
    y1 = (F.floor(F.col("oy") / 500) * 500).cast("int")
    return D.parcels(spark, sf).select(
        x1.alias("x1"), y1.alias("y1"), (x1 + 500).alias("x2"), (y1 + 500).alias("y2")).distinct()


D.define("boxes", """
SELECT k AS req, x - 300 AS bx0, y - 200 AS by0, x + 300 AS bx1, y + 200 AS by1 FROM points WHERE k % 4 = 0""",
         "points")


def boxes(spark, sf):
    x, y = F.col("x"), F.col("y")
    return D.points(spark, sf).filter(F.col("k") % 4 == 0).select(
        F.col("k").alias("req"), F.struct(
            (x - 300).alias("x0"), (y - 200).alias("y0"), (x + 300).alias("x1"),
            (y + 200).alias("y1")).alias("box"))


@add("jn4_parcels_in_box", with_sql("""
SELECT req, covered, refcat FROM (SELECT *, bx0 >= cx0 AND bx1 <= cx1 AND by0 >= cy0 AND by1 <= cy1 AS covered FROM boxes,
 (SELECT min(x1) AS cx0, min(y1) AS cy0, max(x2) AS cx1, max(y2) AS cy1 FROM chunks))
LEFT JOIN parcels ON covered AND ox <= bx1 AND ox + w >= bx0 AND oy <= by1 AND oy + h >= by0
WHERE NOT covered OR refcat IS NOT NULL""", "boxes", "chunks", "parcels"))
def _(spark, sf):
    return Z.parcels_in_boxes(
        boxes(spark, sf), D.parcels(spark, sf).select("refcat", "poly"), chunks(spark, sf), "req"
    ).select("req", "covered", "refcat")


@add("jn5_tiered_polygon", with_sql("""
SELECT ck, CASE WHEN ck % 3 = 0 THEN 'own' WHEN ck % 3 = 1 THEN 'index' END AS tier,
  CASE WHEN ck % 3 = 0 THEN 'OWN' WHEN ck % 3 = 1 THEN label END AS label,
  CASE WHEN ck % 3 < 2 THEN area_m2 END AS area_m2, CASE WHEN ck % 3 < 2 THEN 7 ELSE NULL END AS n_vertices
FROM parcels""", "parcels"))
def _(spark, sf):
    p = D.parcels(spark, sf)
    ck = F.col("ck")
    own = p.filter(ck % 3 == 0).withColumn("label", F.lit("OWN"))
    index = p.filter(ck % 3 != 2)
    keyed = p.select("ck", F.col("refcat").alias("rc14"))
    return Z.parcel_polygon(keyed, own, index).select(
        "ck", "tier", "label", "area_m2",
        F.when(F.col("poly").isNotNull(), F.size("poly")).alias("n_vertices"))


D.define("plot_units", """
SELECT lpad(c::VARCHAR, 7, '0') || 'TP0000' || chr((65 + c % 26)::INT) AS rc14
FROM (SELECT l_orderkey % (SELECT max(c_custkey) + 1 FROM customer) AS c FROM lineitem)""")


def plot_units(spark, sf):
    c = F.col("l_orderkey") % D.key_range(spark, sf, "customer", "c_custkey")
    return table(spark, sf, "lineitem").select(F.concat(
        F.lpad(c.cast("string"), 7, "0"), F.lit("TP0000"), F.char(65 + c % 26)).alias("rc14"))


@add("jn26_surroundings", with_sql("""
SELECT k, count(refcat) AS n_parcels, coalesce(sum(u), 0)::BIGINT AS n_units
FROM points LEFT JOIN (SELECT p.*, coalesce(n, 0) AS u FROM parcels p LEFT JOIN
   (SELECT rc14, count(*) AS n FROM plot_units GROUP BY rc14) ON rc14 = refcat) q
 ON ox <= x + 80 AND ox + w >= x - 80 AND oy <= y + 80 AND oy + h >= y - 80 GROUP BY k""",
    "points", "parcels", "plot_units"))
def _(spark, sf):
    return by_place(D.points(spark, sf), "k", lambda at, key: Z.surroundings(
        at, D.parcels(spark, sf), plot_units(spark, sf), key)).select("k", "n_parcels", "n_units")


# ---- projections --------------------------------------------------------------------------

D.define("plots", """
SELECT refcat, ck, ox, oy, w, h, (100 + ck % 50)::DOUBLE AS bx, (80 + ck % 30)::DOUBLE AS b_y,
  (2400 + ck % 9)::DOUBLE AS bw, (1600 + ck % 7)::DOUBLE AS bh, (ck % 21 - 10)::INT AS dx, (ck % 17 - 8)::INT AS dy,
  floor((ox - {x0}) / {cw})::INT AS col, floor(({ym} - oy) / {ch})::INT AS row FROM parcels""".format(**G), "parcels")


def plots(spark, sf):
    ck = F.col("ck")

    def d(c):
        return c.cast("double")
    p = D.parcels(spark, sf)
    body = F.struct(d(100 + ck % 50).alias("x"), d(80 + ck % 30).alias("y"),
                    d(2400 + ck % 9).alias("w"), d(1600 + ck % 7).alias("h"))
    p = p.withColumn("x", F.col("ox")).withColumn("y", F.col("oy")).withColumn("body", body)
    return L.grid_columns(p, home()).withColumn("dx", (ck % 21 - 10).cast("int")).withColumn(
        "dy", (ck % 17 - 8).cast("int"))


AX = "({x0} + col * {cw} + CASE WHEN (ox - ({x0} + col * {cw})) / {cw} < 0.5 THEN 0.0::DOUBLE ELSE {cw} / 2 END - {mx})".format(**G)
AY = "({ym} - row * {ch} - CASE WHEN ({ym} - row * {ch} - oy) / {ch} < 0.5 THEN 0.0::DOUBLE ELSE {ch} / 2 END + {my})".format(**G)
BW, BH = "({cw} / 2 + 2 * {mx})".format(**G), "({ch} / 2 + 2 * {my})".format(**G)


@add("prj10_polygon_to_sheet", with_sql("SELECT refcat, " + sql_px(
    f"trunc(bx + (p.x - {AX}) / {BW} * bw)::INT + dx", f"trunc(b_y + ({AY} - p.y) / {BH} * bh)::INT + dy")
    + " AS px FROM plots", "plots"))
def _(spark, sf):
    p = plots(spark, sf)
    corner = grid.anchor(F.col("col"), F.col("row"), F.col("compass"), F.col("_m"))
    px = grid.polygon_to_sheet(F.col("poly"), F.col("body"), corner, F.col("_m"),
                               F.col("dx"), F.col("dy"))
    return p.select("refcat", show_px(px).alias("px"))


@add("prj11_point_to_pixel", with_sql(f"""
SELECT refcat, trunc(bx + (ox - {AX}) / {BW} * bw)::INT AS px, trunc(b_y + ({AY} - oy) / {BH} * bh)::INT AS py
FROM plots""", "plots"))
def _(spark, sf):
    p = plots(spark, sf)
    rel = grid.body_relative(F.col("x"), F.col("y"), F.col("col"), F.col("row"), F.col("compass"),
                             F.col("_m"))
    at = grid.relative_to_pixel(rel["rx"], rel["ry"], F.col("body"))
    return p.select("refcat", at["x"].alias("px"), at["y"].alias("py"))


PADDED = "SELECT *, ox - pad AS ex0, oy - pad AS ey0, ox + w + pad AS ex1, oy + h + pad AS ey1 FROM (" \
    "SELECT *, greatest(50.0::DOUBLE, 0.4::DOUBLE * greatest((ox + w) - ox, (oy + h) - oy)) AS pad FROM parcels)"
D.define("padded", PADDED, "parcels")


@add("prj12_padded_image", with_sql("SELECT refcat, ex0, ey1, " + sql_px(
    "trunc((p.x - ex0) / (ex1 - ex0) * 900)::INT", "trunc((ey1 - p.y) / (ey1 - ey0) * 700)::INT")
    + " AS px FROM padded", "padded"))
def _(spark, sf):
    p = D.parcels(spark, sf).withColumn("e", grid.padded_extent(GM.bbox(F.col("poly"))))
    px = grid.polygon_to_image(F.col("poly"), F.col("e"), F.lit(900), F.lit(700))
    return p.select("refcat", F.col("e.x0").alias("ex0"), F.col("e.y1").alias("ey1"),
                    show_px(px).alias("px"))


@add("prj13_polygon_to_plan", with_sql(
    "SELECT refcat, " + sql_px(
        "round_even(mx + (p.x - ox) * kk + dx, 0)::INT", "round_even(my - (p.y - oy) * kk + dy, 0)::INT")
    + " AS px FROM (SELECT *, (bx + (bx + bw)) / 2 AS mx, (b_y + (b_y + bh)) / 2 AS my,"
      " 200.0::DOUBLE / 25.4::DOUBLE * 1000 / (CASE WHEN ck % 2 = 0 THEN 1000 ELSE 2000 END) AS kk FROM plots)",
    "plots"))
def _(spark, sf):
    p, b = plots(spark, sf), F.col("body")
    mid = F.struct(((b["x"] + (b["x"] + b["w"])) / 2).alias("x"),
                   ((b["y"] + (b["y"] + b["h"])) / 2).alias("y"))
    px = grid.polygon_to_plan(
        F.col("poly"), F.struct(F.col("ox").alias("x"), F.col("oy").alias("y")), mid,
        F.when(F.col("ck") % 2 == 0, 1000).otherwise(2000), F.col("dx"), F.col("dy"))
    return p.select("refcat", show_px(px).alias("px"))


RR = D.HOME
D.define("rural_plots", f"""
SELECT * FROM (SELECT *, {RR.snu_x0}::DOUBLE + (c - 1) * ({RR.snu_w}::DOUBLE / 9) AS rx0,
  {RR.snu_ymax}::DOUBLE - r * ({RR.snu_h}::DOUBLE / 10) AS ry1 FROM (SELECT *,
  floor((ox - {RR.snu_x0}::DOUBLE) / ({RR.snu_w}::DOUBLE / 9))::INT + 1 AS c,
  floor(({RR.snu_ymax}::DOUBLE - oy) / ({RR.snu_h}::DOUBLE / 10))::INT AS r FROM parcels))
WHERE c BETWEEN 1 AND 9 AND r BETWEEN 0 AND 9""", "parcels")
RW, RH = f"({RR.snu_w}::DOUBLE / 9)", f"({RR.snu_h}::DOUBLE / 10)"


@add("prj15_rural_overlay", with_sql(
    f"SELECT refcat, rx0, ry1 - {RH} AS ry0, rx0 + {RW} AS rx1, ry1, " + sql_px(
        f"trunc(14 + (p.x - rx0) / ((rx0 + {RW}) - rx0) * (2698 - 14))::INT",
        f"trunc(9 + (ry1 - p.y) / (ry1 - (ry1 - {RH})) * (1745 - 9))::INT")
    + " AS px FROM rural_plots", "rural_plots"))
def _(spark, sf):
    p = D.parcels(spark, sf).withColumn("x", F.col("ox")).withColumn("y", F.col("oy"))
    p = L.rural_columns(p, home()).filter(F.col("snu_col").isNotNull())
    p = p.withColumn("b", grid.snu_bbox(F.col("snu_col"), F.col("snu_row"), home()))
    px = grid.polygon_to_rural_sheet(F.col("poly"), F.col("b"), F.lit(2840), F.lit(1918))
    return p.select("refcat", F.col("b.x0").alias("rx0"), F.col("b.y0").alias("ry0"),
                    F.col("b.x1").alias("rx1"), F.col("b.y1").alias("ry1"), show_px(px).alias("px"))


@add("sf13_plan_scale", with_sql("""
SELECT doc_id, CASE WHEN s BETWEEN 200 AND 50000 THEN s ELSE 1000 END AS scale FROM (
 SELECT doc_id, TRY_CAST(regexp_extract(t, '[Ee][Ss][Cc][Aa][Ll][Aa]\\s*[:=]?\\s*1\\s*[:/]\\s*(\\d{3,5})', 1) AS INT) AS s
 FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Escala: 1/' || (doc_id * 13 % 70000)::VARCHAR
   WHEN doc_id % 3 = 1 THEN ' ESCALA 1:' || (100 + doc_id % 900)::VARCHAR ELSE '' END AS t FROM documents))""".replace("\\\\", "\\")))
def _(spark, sf):
    d = F.col("doc_id")
    tail = (F.when(d % 3 == 0, F.concat(F.lit("\nEscala: 1/"), (d * 13 % 70000).cast("string")))
            .when(d % 3 == 1, F.concat(F.lit(" ESCALA 1:"), (100 + d % 900).cast("string")))
            .otherwise(F.lit("")))
    return table(spark, sf, "documents").select(
        "doc_id", text.plan_scale(F.concat("text", tail)).alias("scale"))


def utm_sql(rows: str) -> str:
    """Ground metres of rows (k, lon, lat)."""
    return """
SELECT k, round_even(500000.0::DOUBLE + 0.9996::DOUBLE * rad * (eta + a1 * cos(2 * xi) * sinh(2 * eta)
    + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 2) AS x,
  round_even(0.9996::DOUBLE * rad * (xi + a1 * sin(2 * xi) * cosh(2 * eta)
    + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 2) AS y
FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM (
 SELECT *, sinh(atanh(sin(phi)) - ecc * atanh(ecc * sin(phi))) AS t FROM (
  SELECT k, radians(lat) AS phi, radians(lon + 3) AS lam, n,
   n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 + 41 * n * n * n * n / 180 AS a1,
   13 * n * n / 48 - 3 * n * n * n / 5 + 557 * n * n * n * n / 1440 AS a2,
   61 * n * n * n / 240 - 103 * n * n * n * n / 140 AS a3,
   6378137.0::DOUBLE / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS rad, 2 * sqrt(n) / (1 + n) AS ecc
  FROM (SELECT k, lon, lat, f / (2 - f) AS n FROM """ + rows + """, (SELECT 1 / 298.257222101::DOUBLE AS f)))))"""


UTM = utm_sql("""(SELECT k, -6.0::DOUBLE + (k * 7919 % 400000) / 100000.0::DOUBLE AS lon,
     43.0::DOUBLE + (k * 104729 % 90000) / 100000.0::DOUBLE AS lat FROM keyed)""")


@add("sf14_lonlat_to_utm", with_sql(UTM, "keyed"))
def _(spark, sf):
    k = F.col("k")
    lon = F.lit(-6.0) + (k * 7919 % 400000) / F.lit(100000.0)
    lat = F.lit(43.0) + (k * 104729 % 90000) / F.lit(100000.0)
    u = grid.lonlat_to_utm30(lon, lat)
    return D.keyed(spark, sf).select("k", u["x"].alias("x"), u["y"].alias("y"))


@add("sf17_pixel_metres", with_sql(f"""
SELECT rc, seq, dx / 11.81::DOUBLE AS dx_m, dy / 11.81::DOUBLE AS dy_m, dx / 11.81::DOUBLE / {BW} AS drx,
  dy / 11.81::DOUBLE / {BH} AS dry FROM label_events""", "label_events"))
def _(spark, sf):
    rel = grid.drag_to_relative(F.col("dx"), F.col("dy"), home())
    return D.label_events(spark, sf).select(
        "rc", "seq", grid.px_to_m(F.col("dx")).alias("dx_m"),
        grid.px_to_m(F.col("dy")).alias("dy_m"), rel["rx"].alias("drx"), rel["ry"].alias("dry"))
