"""Landed responses made by Spark from the given tables, parsed back; sinks; streams; all in one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lindero.functions import text as T
from lindero.operators import zones as Z
from lindero.plans import enrichment as E
from lindero.operators import calibration as C
from lindero.operators import locate as L
from lindero.plans.location import locate_keys
from lindero.plans.records import result_records
from lindero.session import fresh_path, settle
from lindero.sources import files as FI
from lindero.sources import listings as LI
from lindero.sources import responses as R
from lindero.sources import sinks as S
from lindero.streaming import labels as ST
from parity import derived as D
from parity.base import add, table
from parity.calibration import matches
from parity.derived import with_sql
from parity.geometry import features, heritage, utm_sql
from parity.linkage import cards, link_pairs_sql, links_sql
from parity.location import quality_sql, rural_sheets, warned_sql


def txt(c):
    return c.cast("string")


def num(c):
    """Whole numbers written without a fraction, as in the landed files."""
    return F.format_string("%.2f", c)


# ---- parcels -------------------------------------------------------------------------------

def gml(p, with_ref=True):
    """One parcel element; every ninth lacks its reference, every eighth its positions."""
    pos = F.array_join(F.transform("poly", lambda v: F.concat(num(v["x"]), F.lit(" "), num(v["y"]))),
                       " ")
    ref = F.concat(F.lit("<cp:nationalCadastralReference>"), "refcat",
                   F.lit("</cp:nationalCadastralReference>"))
    ck = F.col("ck")
    return F.concat(
        F.lit('<cp:CadastralParcel gml:id="P'), txt(ck), F.lit('">'),
        F.when(F.col("area_m2").isNotNull(), F.concat(
            F.lit('<cp:areaValue uom="m2">'), num(F.col("area_m2")), F.lit("</cp:areaValue>")))
        .otherwise(""),
        F.when((ck % 9 != 0) | F.lit(not with_ref), ref).otherwise(""),
        F.when(F.col("label") != "", F.concat(
            F.lit("<cp:label>"), "label", F.lit("</cp:label>"))).otherwise(""),
        F.when(ck % 8 != 0, F.concat(
            F.lit('<gml:posList srsDimension="2">'), pos, F.lit("</gml:posList>\n")))
        .otherwise(""),
        F.lit('<gml:posList>0 0 1 1</gml:posList>' if not with_ref else ""),
        F.lit("</cp:CadastralParcel>"))


def gml_pages(spark, sf):
    """Twenty parcels per response."""
    p = D.parcels(spark, sf)
    one = F.struct("ck", gml(p).alias("g"))
    return p.groupBy(F.floor(F.col("ck") / 20).alias("page")).agg(F.concat(
        F.lit("<wfs:FeatureCollection>"), F.array_join(F.transform(
            F.array_sort(F.collect_list(one)), lambda s: s["g"]), "\n"),
        F.lit("</wfs:FeatureCollection>")).alias("body"))


def flat(df):
    ring = F.col("poly")
    return df.withColumn("n", F.size(ring)).withColumn("x2", ring[2]["x"]).withColumn(
        "y4", ring[4]["y"]).drop("poly")


@add("src1_parcel_responses", with_sql("""
SELECT refcat, label, area_m2, 7 AS n, ox + w AS x2, oy + h AS y4 FROM parcels WHERE ck % 9 <> 0 AND ck % 8 <> 0""", "parcels"))
def _(spark, sf):
    return flat(R.parse_parcels(gml_pages(spark, sf)).select("refcat", "label", "area_m2", "poly"))


def landed(spark, bodies, name):
    """The bodies written as text files of the shared folder; returns the folder."""
    path = fresh_path(spark, name)
    bodies.select("body").write.text(path)
    return path


@add("src1_split_files", with_sql("""
SELECT refcat, label, area_m2, ox AS x1, oy AS y1, ox + w / 2 AS x4, oy + h / 2 AS y4, ox AS x7, oy AS y7 FROM parcels WHERE ck % 9 <> 0 AND ck % 8 <> 0""", "parcels"))
def _(spark, sf):
    path = landed(spark, gml_pages(spark, sf), "parcels")
    ring = F.col("poly")
    p = R.parse_parcels(R.read_elements(spark, path, "cp:CadastralParcel"))
    return p.select("refcat", "label", "area_m2", *[
        ring[i - 1][c].alias(f"{c}{i}") for i in (1, 4, 7) for c in ("x", "y")])


@add("src2_single_parcel", with_sql("""
SELECT refcat, nullif(label, '') AS label, area_m2, 7 AS n, ox + w AS x2, oy + h AS y4 FROM parcels WHERE ck % 8 <> 0""", "parcels"))
def _(spark, sf):
    p = D.parcels(spark, sf)
    return flat(R.parse_single_parcels(p.select("refcat", gml(p).alias("body"))))


def chunk_files(spark, sf):
    """Two overlapping sets of chunk files; every tenth file is cut off."""
    p = D.parcels(spark, sf)
    shape = F.struct("refcat", "label", "area_m2", F.transform(
        "poly", lambda v: F.array(v["x"], v["y"])).alias("poly_utm"))
    ck = F.col("ck")
    a = p.select(F.concat(F.lit("bbox_a"), F.lpad(txt(F.floor(ck / 16)), 7, "0")).alias("file"),
                 (F.floor(ck / 16) % 10 == 3).alias("cut"), "ck", shape.alias("s"))
    b = p.filter(ck % 2 == 0).withColumn("label", F.lit("again")).select(
        F.concat(F.lit("bbox_b"), F.lpad(txt(F.floor(ck / 50)), 7, "0")).alias("file"),
        F.lit(False).alias("cut"), "ck", shape.alias("s"))
    return a.unionByName(b).groupBy("file", "cut").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("ck", "s"))), lambda e: e["s"])).alias("j")).select(
        "file", F.when(F.col("cut"), F.concat(F.lit("]{"), "j")).otherwise(F.col("j")).alias("body"))


@add("src3_parcel_chunks", with_sql("""
SELECT refcat, CASE WHEN (ck // 16) % 10 = 3 THEN 'again' ELSE label END AS label, area_m2, 7 AS n, ox + w AS x2, oy + h AS y4
FROM parcels WHERE (ck // 16) % 10 <> 3 OR ck % 2 = 0""", "parcels"))
def _(spark, sf):
    return flat(R.parse_chunks(chunk_files(spark, sf)).drop("file", "pos"))


# ---- units ---------------------------------------------------------------------------------

# One registry record per line item; orders 0 mod 3 as a list, 1 as an object, 2 as one property.
D.define("unit_rows", """
SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty, year(l_shipdate) AS yr
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1 OR l_orderkey % 3 = 0""")
D.define("unit_list", """
SELECT rc14, (row_number() OVER (PARTITION BY o ORDER BY ln, pk, sk, qty) - 1)::INT AS pos, o, ln, pk, sk, qty, yr,
  rc14 || lpad(ln::VARCHAR, 4, '0') || 'XY' AS rc,
  CASE pk % 3 WHEN 0 THEN 'C/' WHEN 1 THEN 'Av.' ELSE 'ZZ' END || ' CALLE ' || (pk % 9)::VARCHAR || CASE WHEN sk % 2 = 0 THEN ' ' || (sk % 30)::VARCHAR ELSE '' END AS address,
  CASE WHEN ln % 2 = 0 THEN '0' || ln::VARCHAR ELSE '' END AS floor,
  CASE WHEN pk % 7 = 0 THEN '' ELSE 'Residencial' END AS use, CASE WHEN pk % 11 = 0 THEN 0 ELSE round_even(qty + 0.5, 0)::INT END AS area_m2,
  CASE WHEN pk % 5 = 0 THEN NULL ELSE yr END::INT AS year FROM unit_rows JOIN keyed ON k = o""", "unit_rows", "keyed")


def unit_bodies(spark, sf):
    """Only the figures of the lines are gathered; the records are made of them afterwards."""
    item = F.struct(
        F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"), F.col("l_quantity").alias("qty"),
        F.year("l_shipdate").alias("yr"))
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(item)).alias("a")).join(
        D.keyed(spark, sf).select(F.col("k").alias("l_orderkey"), "rc14"), "l_orderkey")

    def record(e, own):
        ln, pk, sk = e["ln"], e["pk"], e["sk"]
        key = F.struct(F.left("rc14", F.lit(7)).alias("pc1"), F.substring("rc14", 8, 7).alias("pc2"),
                       F.lpad(txt(ln), 4, "0").alias("car"), F.lit("X").alias("cc1"),
                       F.lit("Y").alias("cc2"))
        street = F.struct(
            F.when(pk % 3 == 0, "CL").when(pk % 3 == 1, "AV").otherwise("ZZ").alias("tv"),
            F.concat(F.lit(" CALLE "), txt(pk % 9)).alias("nv"),
            F.when(sk % 2 == 0, F.concat(txt(sk % 30), F.lit(" "))).alias("pnp"))
        inside = F.struct(F.when(ln % 2 == 0, F.concat(F.lit("0"), txt(ln))).alias("pt"))
        debi = F.struct(
            F.when(pk % 7 != 0, "Residencial").alias("luso"),
            F.when(pk % 11 != 0, F.concat(txt(e["qty"].cast("int")), F.lit(",5"))).alias("sfc"),
            F.when(pk % 5 == 0, F.lit("s/d")).otherwise(txt(e["yr"])).alias("ant"))
        dt = F.struct(F.struct(F.struct(F.struct(street.alias("dir"), inside.alias("loint"))
                                        .alias("lourb")).alias("lous")).alias("locs"))
        if own:
            return F.struct(F.struct(key.alias("rc")).alias("idbi"), dt.alias("dt"),
                            debi.alias("debi"))
        return F.struct(key.alias("rc"), dt.alias("dt"), debi.alias("debi"))

    plain = F.transform("a", lambda e: record(e, False))
    first = F.get("a", F.lit(0))
    kind = F.col("l_orderkey") % 3

    def wrapped(inner):
        return F.concat(F.lit('{"consulta_dnprcResult":'), inner, F.lit("}"))

    listed = F.concat(F.lit('{"lrcdnp":{"rcdnp":'), F.to_json(plain), F.lit("}}"))
    one = F.concat(F.lit('{"lrcdnp":{"rcdnp":'), F.to_json(record(first, False)), F.lit("}}"))
    own = F.concat(F.lit('{"bico":{"bi":'), F.to_json(record(first, True)), F.lit("}}"))
    return per.select("rc14", wrapped(F.when(kind == 0, listed).when(kind == 1, one).otherwise(own))
                      .alias("body"))


@add("src4_unit_registry", with_sql("""
SELECT rc14, pos, rc, address, floor, '' AS door, '' AS stair, use, area_m2, year FROM unit_list""", "unit_list"))
def _(spark, sf):
    return R.parse_units(unit_bodies(spark, sf))


@add("sf4_safe_int", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0 ELSE round_even(value, 0)::INT END AS n FROM events""")
def _(spark, sf):
    e = F.col("event_id") % 4
    v = txt(F.col("value"))
    raw = F.when(e == 0, v).when(e == 1, F.translate(v, ".", ",")).when(
        e == 2, F.concat(F.lit(" "), v)).otherwise("s/d")
    return table(spark, sf, "events").select("event_id", T.safe_int(raw).alias("n"))


@add("prj16_addresses", with_sql("""
SELECT k, CASE k % 3 WHEN 0 THEN 'C/' WHEN 1 THEN 'Rda.' ELSE 'QQ' END || ' MAYOR ' || (k % 50)::VARCHAR AS urban,
  CASE k % 3 WHEN 0 THEN 'CL' WHEN 1 THEN 'RD' ELSE 'QQ' END || ' MAYOR ' || (k % 50)::VARCHAR || ' VILLA (PROVINCIA)' AS registry,
  nullif(concat_ws(' · ', CASE WHEN k % 2 = 0 THEN 'PARAJE ' || (k % 9)::VARCHAR END, CASE WHEN k % 5 <> 0 THEN 'Pol ' || (k % 40)::VARCHAR || ' Parc ' || CASE WHEN k % 7 = 0 THEN '' ELSE (k % 70)::VARCHAR END END,
    CASE WHEN k % 3 <> 0 THEN 'VILLA' END), '') AS rural FROM keyed""", "keyed"))
def _(spark, sf):
    k = F.col("k")
    urban = T.urban_address(F.when(k % 3 == 0, "CL").when(k % 3 == 1, "RD").otherwise("QQ"),
                            F.lit(" MAYOR "), txt(k % 50))
    block = F.when(k % 5 != 0, txt(k % 40))
    rural = T.rural_address(
        F.when(k % 2 == 0, F.concat(F.lit("PARAJE "), txt(k % 9))), block,
        F.when((k % 5 != 0) & (k % 7 != 0), txt(k % 70)), F.when(k % 3 != 0, F.lit(" VILLA ")))
    return D.keyed(spark, sf).select("k", urban.alias("urban"), T.registry_address(
        urban, " VILLA (PROVINCIA)").alias("registry"), rural.alias("rural"))


@add("jn25_build_coords", with_sql("""
SELECT refcat AS rc14, (ox + (ox + w) + (ox + w) + (ox + w / 2) + (ox + w / 2) + ox + ox) / 7 AS x,
  (oy + oy + (oy + h / 2) + (oy + h / 2) + (oy + h) + (oy + h) + oy) / 7 AS y,
  CASE WHEN ck % 3 = 0 THEN '' ELSE 'AV RIO ' || (ck % 12)::VARCHAR || ' VILLA (PROVINCIA)' END AS address FROM parcels""", "parcels"))
def _(spark, sf):
    p = D.parcels(spark, sf)
    ck = F.col("ck")
    parcels = p.select(F.lit("a").alias("file"), ck.alias("pos"), "refcat", "poly")
    units = p.filter(ck % 3 != 0).select(F.col("refcat").alias("rc14"), F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.concat(F.lit("Av. RIO "), txt(ck % 12)).alias("address")),
        F.struct(F.lit(1).alias("pos"), F.lit("C/ OTRA").alias("address")))).alias("u")).select(
        "rc14", "u.*")
    return Z.build_coords(parcels, units, " VILLA (PROVINCIA)")


# ---- layers and zones ------------------------------------------------------------------------

def feature_pages(spark, sf):
    """Ten features per page; odd ones as MultiPolygon; each polygon gets a hole."""
    f = features(spark, sf).withColumn("twin", F.size("rings"))
    pairs = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    hole = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))
    f = f.withColumn("_p", pairs).withColumn("_multi", (F.col("twin") > 1))
    geometry = F.when(F.col("_multi"), F.concat(
        F.lit('{"type":"MultiPolygon","coordinates":'),
        F.to_json(F.transform("_p", lambda r: F.array(r, hole))), F.lit("}"))).when(
        F.col("ord") % 13 == 5, F.lit('{"type":"Point","coordinates":[1,2]}')).otherwise(F.concat(
            F.lit('{"type":"Polygon","coordinates":'),
            F.to_json(F.array(F.get("_p", F.lit(0)), hole)), F.lit("}")))
    one = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("props"),
                   F.lit(',"geometry":'), geometry, F.lit("}"))
    page = F.floor(F.col("ord") / 60)
    return f.groupBy("layer", page.alias("page")).agg(F.concat(
        F.lit('{"features":['), F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("ord", one.alias("j")))), lambda s: s["j"]), ","), F.lit("]}")).alias("body"))


@add("src5_layer_pages", with_sql("""
SELECT layer, nullif(label, '') AS label, area_name, ratio, CASE WHEN ord % 7 = 0 THEN 2 WHEN ord % 13 = 5 THEN 0 ELSE 1 END AS n_rings,
  CASE WHEN ord % 7 = 0 OR ord % 13 <> 5 THEN ox + w END AS x2 FROM features""", "features"))
def _(spark, sf):
    p = F.col("props")
    return R.parse_features(feature_pages(spark, sf)).select(
        "layer", F.nullif(p[Z.LABEL], F.lit("")).alias("label"), p[Z.AREA_NAME].alias("area_name"),
        p[Z.FLOOR_RATIO].alias("ratio"), F.size("rings").alias("n_rings"),
        F.get(F.get("rings", F.lit(0)), F.lit(2))["x"].alias("x2"))


def kml_files(spark, sf):
    """Fifty placemarks per file, every sixth with too few points, some in several polygons."""
    k = F.col("zk")
    z = D.zone_base(spark, sf).filter(F.col("tier") == 1)

    def pt(dx, dy):
        lon = F.format_string("%.5f", F.lit(-6.0) + (k * 13 % 90000) / F.lit(100000.0) + dx)
        lat = F.format_string("%.5f", F.lit(43.2) + (k * 17 % 30000) / F.lit(100000.0) + dy)
        return F.concat(lon, F.lit(","), lat, F.lit(",0"))
    pts = F.concat_ws("\n ", pt(0.0, 0.0), pt(0.01, 0.0), F.when(k % 6 != 0, pt(0.01, 0.01)),
                      F.when(k % 6 == 0, F.lit("x,y")))
    poly = F.concat(F.lit("<Polygon><outerBoundaryIs><coordinates>\n"), pts,
                    F.lit("\n</coordinates></outerBoundaryIs></Polygon>"))
    geom = F.when(k % 4 == 0, F.concat(F.lit("<MultiGeometry>"), poly, poly,
                                       F.lit("</MultiGeometry>"))).otherwise(poly)
    desc = F.when(k % 3 == 0, F.concat(F.lit('<a href="ficha.php?id=AP '), txt(k), F.lit('">ver</a>'))) \
        .otherwise(F.lit("sin enlace"))
    mark = F.concat(F.lit("<Placemark>\n<name>APP-"), txt(k), F.lit(" B</name>\n<description>"),
                    desc, F.lit("</description><styleUrl>#a</styleUrl>"), geom,
                    F.lit("\n</Placemark>"))
    return z.groupBy(F.floor(k / 50).alias("f")).agg(F.concat(F.lit("<kml>"), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("zk", mark.alias("m")))),
                    lambda s: s["m"]), "\n"), F.lit("</kml>")).alias("body")).select(
        F.concat(F.lit("pgo"), txt(F.col("f"))).alias("file"), "body")


@add("src6_zone_placemarks", with_sql("""
SELECT 'APP-' || zk::VARCHAR || ' B' AS id, CASE WHEN zk % 3 = 0 THEN 'AP_' || zk::VARCHAR ELSE 'APP-' || zk::VARCHAR || '_B' END AS ficha_id,
  'APP' AS categoria, CASE WHEN zk % 4 = 0 THEN 2 ELSE 1 END AS n_rings, 3 AS n_points FROM zone_base WHERE tier = 1 AND zk % 6 <> 0""", "zone_base"))
def _(spark, sf):
    z = R.parse_zones(kml_files(spark, sf), "https://cards.example/ficha.php?id=")
    return z.select("id", "ficha_id", "categoria", F.size("rings").alias("n_rings"),
                    F.size(F.col("rings")[0]).alias("n_points"))


D.define("kml_points", utm_sql("""(SELECT zk * 3 + i AS k,
  round(-6.0::DOUBLE + (zk * 13 % 90000) / 100000.0::DOUBLE + CASE WHEN i > 0 THEN 0.01::DOUBLE ELSE 0 END, 5) AS lon,
  round(43.2::DOUBLE + (zk * 17 % 30000) / 100000.0::DOUBLE + CASE WHEN i > 1 THEN 0.01::DOUBLE ELSE 0 END, 5) AS lat
  FROM zone_base, range(3) t(i) WHERE tier = 1)"""), "zone_base")


@add("src6_split_files", with_sql("""
SELECT 'APP-' || zk::VARCHAR || ' B' AS id, CASE WHEN zk % 3 = 0 THEN 'AP_' || zk::VARCHAR ELSE 'APP-' || zk::VARCHAR || '_B' END AS ficha_id,
  CASE WHEN zk % 4 = 0 THEN 2 ELSE 1 END AS n_rings, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3
FROM zone_base JOIN kml_points a ON a.k = zk * 3 JOIN kml_points b ON b.k = zk * 3 + 1 JOIN kml_points c ON c.k = zk * 3 + 2
WHERE tier = 1 AND zk % 6 <> 0""", "zone_base", "kml_points"))
def _(spark, sf):
    path = landed(spark, kml_files(spark, sf), "placemarks")
    z = R.parse_zones(R.read_elements(spark, path, "Placemark"), "https://cards.example/ficha.php?id=")
    last = F.element_at("rings", -1)
    return z.select("id", "ficha_id", F.size("rings").alias("n_rings"), *[
        last[i - 1][c].alias(f"{c}{i}") for i in (1, 2, 3) for c in ("x", "y")])


# ---- listings: the given pages with links added ------------------------------------------------

def linked_pages(spark, sf, links):
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("page"), F.concat("html", *links).alias("body"))


def anchor(href, name):
    return F.concat(F.lit('<a href="'), href, F.lit('" class="card-title" title="x"> '), name,
                    F.lit("</a>\n"))


P = "page_id"


@add("src7_urban_listing", """
SELECT 'PLANO_' || (page_id % 60)::VARCHAR || '_' || substr('ABCDE', (i + 1)::INT, 1) || '_II.pdf' AS sheet_name,
  'https://town.example/documents/35127/ab-' || min(page_id)::VARCHAR AS url
FROM pages, range(5) t(i) GROUP BY page_id % 60, i""")
def _(spark, sf):
    k = F.col(P)
    links = []
    for i, letter in enumerate("ABCDE"):
        raw = F.concat(F.lit("PLANO__" if i % 2 else "PLANO_"), txt(k % 60),
                       F.lit(f"-{letter}__II.pdf" if i % 3 else f"_{letter}_II.pdf"))
        links.append(anchor(F.concat(F.lit("/documents/35127/ab-"), txt(k), F.lit("?v=1")), raw))
    return LI.urban_sheets(linked_pages(spark, sf, links), "https://town.example")


@add("src8_rural_listing", """
SELECT 'PLANO_' || substr('ABCDEFGHIJ', (page_id % 10 + 1)::INT, 1) || '_' || (page_id % 9 + 1)::VARCHAR || '.pdf' AS sheet_name,
  'https://town.example/documents/35127/r' || min(page_id)::VARCHAR AS url,
  (SELECT 'https://town.example/documents/9/MAPA_GUIA_' || min(page_id)::VARCHAR || '.pdf' FROM pages WHERE page_id % 50 = 7) AS index_map
FROM pages GROUP BY page_id % 10, page_id % 9""")
def _(spark, sf):
    k = F.col(P)
    name = F.concat(F.lit("plano_"), F.lower(F.substring(F.lit("ABCDEFGHIJ"), (k % 10 + 1).cast("int"), F.lit(1))),
                    F.lit("_0"), txt(k % 9 + 1), F.lit(".pdf"))
    links = [anchor(F.concat(F.lit("/documents/35127/r"), txt(k), F.lit("?documentThumbnail=1")), name),
             F.when(k % 50 == 7, F.concat(F.lit('<a href="/documents/9/MAPA_GUIA_'), txt(k),
                                          F.lit('.pdf">guia</a>'))).otherwise("")]
    return LI.rural_sheets(linked_pages(spark, sf, links), "https://town.example")


@add("src9_card_listing", """
SELECT 'ZONA_' || (page_id % 90)::VARCHAR || '_UG_RC' || (page_id % 90 % 7)::VARCHAR || '_Ficha_n_' || lpad((page_id % 90)::VARCHAR, 4, '0') || '_PGOU.pdf' AS filename,
  'https://town.example/documents/35127/c' || min(page_id)::VARCHAR AS url, 'UG' AS tipo, 'RC' || (page_id % 90 % 7)::VARCHAR AS codigo,
  (page_id % 90)::INT AS num, min(page_id) AS page, 0 AS pos FROM pages GROUP BY page_id % 90""")
def _(spark, sf):
    m = F.col(P) % 90
    name = F.concat(F.lit("ZONA_"), txt(m), F.lit("_UG_RC"), txt(m % 7), F.lit("_Ficha_n_"),
                    F.lpad(txt(m), 4, "0"), F.lit("_PGOU.pdf"))
    links = [anchor(F.concat(F.lit("/documents/35127/c"), txt(F.col(P))), name)]
    cards = LI.card_listing(linked_pages(spark, sf, links), "https://town.example")
    return cards.select("filename", "url", "tipo", "codigo", "num", "ord.page", "ord.pos")


@add("src10_zone_cards", """
SELECT page_id AS zone, 'Suelo urbano' AS clase, 'Cat ' || (page_id % 5)::VARCHAR AS categoria, CASE WHEN page_id % 2 = 0 THEN 'PERI' ELSE 'ED' END AS plan_desarrollo,
  'Privada' AS iniciativa, 'Zona ' || page_id::VARCHAR AS nombre_largo,
  CASE WHEN page_id % 4 <> 0 THEN 'https://docs.example/doc/Urbanismo/PGO/Fichas/F' || page_id::VARCHAR || '.pdf' END AS ficha_pdf_url,
  CASE WHEN page_id % 5 <> 0 THEN 'https://docs.example/doc/Urbanismo/PGO/Planos/P' || page_id::VARCHAR || '.pdf' END AS plano_pdf_url
FROM pages WHERE page_id % 3 <> 0""")
def _(spark, sf):
    k = F.col(P)
    head = F.concat(
        F.lit("<h2> Zona "), txt(k), F.lit(" </h2>\n<h3>Clase: Suelo urbano</h3><p>x</p><h4>Categoría: Cat "),
        txt(k % 5), F.lit("</h4>\n<h4> Plan de Desarrollo: "), F.when(k % 2 == 0, "PERI").otherwise("ED"),
        F.lit(" </h4><h4>Iniciativa: Privada</h4>"))
    links = [F.when(k % 3 != 0, head).otherwise(""),
             F.when(k % 4 != 0, F.concat(F.lit('<a href="https://docs.example/doc/Urbanismo/PGO/Fichas/F'),
                                         txt(k), F.lit('.pdf">f</a>'))).otherwise(""),
             F.when(k % 5 != 0, F.concat(F.lit('<a href="https://docs.example/doc/Urbanismo/PGO/Planos/P'),
                                         txt(k), F.lit('.pdf">p</a>'))).otherwise("")]
    return LI.zone_cards(linked_pages(spark, sf, links).withColumnRenamed("page", "zone"))


# ---- files ----------------------------------------------------------------------------------

@add("src11_file_integrity", """
SELECT doc_id::VARCHAR AS name, kind, CASE WHEN doc_id % 6 = 5 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'bad_header'
  WHEN octet_length(encode(text)) + 5 < CASE kind WHEN 'pdf' THEN 10000 ELSE 1000 END THEN 'too_small' ELSE 'ok' END AS status
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'png' END AS kind FROM documents)""")
def _(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    kind = F.when(d % 2 == 0, "pdf").otherwise("png")
    head = F.when(d % 5 == 0, F.encode(F.lit("<html"), "UTF-8")).when(
        d % 2 == 0, F.encode(F.lit("%PDF-"), "UTF-8")).otherwise(F.unhex(F.lit("89504E470D")))
    content = F.concat(head, F.encode("text", "UTF-8"))
    files = docs.filter(d % 6 != 5).select(
        txt(d).alias("name"), F.octet_length(content).alias("bytes"),
        F.substring(content, 1, 8).alias("head"))
    return FI.integrity(docs.select(txt(d).alias("name"), kind.alias("kind")), files)


@add("src12_tile_catalog", with_sql("""
SELECT (x - 300)::INT AS x1, (y - 300)::INT AS y1, x::INT AS x2, y::INT AS y2, (k % 9 / 10.0)::DOUBLE AS mpp, k * 10 AS bytes
FROM points WHERE k % 3 = 0""", "points"))
def _(spark, sf):
    k, x, y = F.col("k"), F.col("x").cast("int"), F.col("y").cast("int")
    name = F.when(k % 3 == 0, F.concat(
        F.lit("wms_"), F.concat_ws("_", x - 300, y - 300, x, y), F.lit("_"),
        txt(k % 9 / F.lit(10.0)), F.lit(".png"))).otherwise(F.concat(F.lit("other_"), txt(k)))
    files = D.points(spark, sf).select(name.alias("name"), name.alias("path"),
                                       (k * 10).alias("bytes"))
    return FI.tile_catalog(files).drop("path")


# ---- sinks ----------------------------------------------------------------------------------

# Neighbour sheets of every placed key by side (1 west, 2 north, 3 south, 4 east); a side's snap is
# the best of the line with its number, with a score of 0 where there is none.
D.define("edge_sides", """
SELECT e.k AS rc, n_sheet, coalesce(n.score, 0.0) AS n_score, n.dx AS n_dx, n.dy AS n_dy,
  row_number() OVER (PARTITION BY e.k ORDER BY e.side)::INT AS i
FROM (SELECT k, side, 'PLANO_' || ncol::VARCHAR || '_' || substr({L}, nrow + 1, 1) || '_'
        || CASE (CASE WHEN ny < 0.5 THEN 'N' ELSE 'S' END) || (CASE WHEN nx < 0.5 THEN 'W' ELSE 'E' END)
             WHEN 'NW' THEN 'I' WHEN 'NE' THEN 'II' WHEN 'SW' THEN 'III' ELSE 'IV' END || '.pdf' AS n_sheet
      FROM (SELECT k, 1 AS side, col - 1 AS ncol, row AS nrow, x_in + 1 AS nx, y_in AS ny FROM placed WHERE x_in * {cw} < 50
            UNION ALL SELECT k, 2, col, row - 1, x_in, y_in + 1 FROM placed WHERE y_in * {ch} < 50
            UNION ALL SELECT k, 3, col, row + 1, x_in, y_in - 1 FROM placed WHERE (1 - y_in) * {ch} < 50
            UNION ALL SELECT k, 4, col + 1, row, x_in - 1, y_in FROM placed WHERE (1 - x_in) * {cw} < 50)
      WHERE nrow BETWEEN 0 AND 24) e
LEFT JOIN (SELECT rc, side, max(score) AS score, arg_min(dx, row(-score, ord, dx, dy)) AS dx, arg_min(dy, row(-score, ord, dx, dy)) AS dy
           FROM (SELECT *, (ord // 1000000)::INT AS side FROM snaps) GROUP BY rc, side) n
  ON n.rc = e.k AND n.side = e.side
WHERE n_sheet IN (SELECT sheet_name FROM sheets)""".format(L=D.LETTERS, **D.G), "placed", "sheets", "snaps")
# The fold of `edge_fold` over these sheets, from the chosen snap of each located key.
D.define("edge_moves", """
WITH RECURSIVE p AS (SELECT l.k AS rc, l.sheet_name AS sheet, sc.score, sc.dx, sc.dy FROM located l
  JOIN snap_choice sc ON sc.rc = l.k WHERE l.reason IS NULL),
f AS (SELECT rc, 0 AS i, sheet, score, dx, dy, NULL::VARCHAR AS from_sheet, NULL::DOUBLE AS from_score, score AS first FROM p
  UNION ALL SELECT f.rc, n.i, CASE WHEN n.n_score > f.score + 0.05::DOUBLE THEN n.n_sheet ELSE f.sheet END,
    CASE WHEN n.n_score > f.score + 0.05::DOUBLE THEN n.n_score ELSE f.score END,
    CASE WHEN n.n_score > f.score + 0.05::DOUBLE THEN n.n_dx ELSE f.dx END,
    CASE WHEN n.n_score > f.score + 0.05::DOUBLE THEN n.n_dy ELSE f.dy END,
    CASE WHEN n.n_score > f.score + 0.05::DOUBLE THEN f.sheet ELSE f.from_sheet END,
    CASE WHEN n.n_score > f.score + 0.05::DOUBLE THEN f.score ELSE f.from_score END, f.first
  FROM f JOIN edge_sides n ON n.rc = f.rc AND n.i = f.i + 1 WHERE f.first < 0.25::DOUBLE)
SELECT f.rc, sheet AS sheet_name, score AS snap_score, dx AS snap_dx, dy AS snap_dy, from_sheet, round_even(from_score, 3) AS from_score,
  CASE WHEN from_sheet IS NOT NULL THEN round_even(score, 3) END AS to_score, i AS n_tried,
  coalesce((SELECT string_agg(n_sheet || ' ' || (round_even(n_score * 1000, 0)::INT)::VARCHAR, '|' ORDER BY e.i)
            FROM edge_sides e WHERE e.rc = f.rc AND e.i <= f.i), '') AS tried
FROM f QUALIFY row_number() OVER (PARTITION BY f.rc ORDER BY i DESC) = 1""", "located", "snap_choice", "edge_sides")
D.define("moved_place", """
SELECT p.* REPLACE (CASE WHEN m.from_sheet IS NULL THEN p.sheet_name ELSE m.sheet_name END AS sheet_name,
  CASE WHEN m.from_sheet IS NULL THEN p.cell ELSE split_part(m.sheet_name, '_', 2) || '-' || split_part(m.sheet_name, '_', 3) END AS cell,
  CASE WHEN m.from_sheet IS NULL THEN p.sub ELSE regexp_extract(m.sheet_name, '_([IV]+)[.]pdf$', 1) END AS sub),
  m.from_sheet, m.from_score, m.to_score, m.n_tried, m.tried, m.snap_dx, m.snap_dy, m.snap_score
FROM placed p LEFT JOIN edge_moves m ON m.rc = p.k""", "placed", "edge_moves")
# The quality of the place after the move.
D.define("moved_quality", quality_sql("moved_place"), "moved_place", "calib")
D.define("moved_warned", warned_sql("moved_quality"), "moved_quality")
# Parcels named like the keys: each key not left out has the area and label of its customer's parcel.
D.define("key_parcels", """
SELECT rc14 AS refcat, area_m2, label FROM keyed JOIN parcels ON ck = cust WHERE k % 6 <> 5""", "keyed", "parcels")


def key_parcels(spark, sf):
    return D.keyed(spark, sf).filter(F.col("k") % 6 != 5).join(
        D.parcels(spark, sf), F.col("ck") == F.col("cust")).select(
        F.col("rc14").alias("refcat"), "area_m2", "label")


def edge_moves(spark, sf, located, chosen, candidates):
    """Outcome of `edge_override` for the located keys, by rc14."""
    best = F.min(F.struct((-F.col("score")).alias("less"), F.col("ord").alias("o"), "dx", "dy"))
    scores = candidates.groupBy("rc", F.floor(F.col("ord") / 1000000).cast("int").alias("ord")).agg(
        best.alias("b")).select("rc", "ord", (-F.col("b.less")).alias("n_score"),
                                F.col("b.dx").alias("n_dx"), F.col("b.dy").alias("n_dy"))
    side = (F.when(F.col("n_col") < F.col("col"), 1).when(F.col("n_row") < F.col("row"), 2)
            .when(F.col("n_row") > F.col("row"), 3).otherwise(4))
    sides = L.edge_neighbours(located, D.sheets(spark, sf), F.col("_m")).select(
        F.col("k").alias("rc"), side.alias("ord"), "n_sheet")
    neighbours = sides.join(scores, ["rc", "ord"], "left").select(
        "rc", "ord", "n_sheet", F.coalesce("n_score", F.lit(0.0)).alias("n_score"), "n_dx", "n_dy")
    primary = located.select(F.col("k").alias("rc"), "rc14", "sheet_name").join(
        chosen.select("rc", F.col("score").alias("snap_score"), "dx", "dy"), "rc")
    return C.edge_override(primary, neighbours).join(primary.select("rc", "rc14"), "rc").drop("rc")


@add("snk1_moved_records", with_sql("""
SELECT l.k, v.rc, l.address, l.x, l.y, w.cell, w.sub AS sub_quadrant, l.compass AS sub_compass, w.sheet_name, l.url AS sheet_url,
  concat_ws('|', l.warning, w.qwarning) AS warnings, round_even(l.rx_raw, 4) AS rx, round_even(l.ry_raw, 4) AS ry,
  CASE WHEN w.from_sheet IS NOT NULL THEN w.snap_dx ELSE sc.dx END AS snap_dx, CASE WHEN w.from_sheet IS NOT NULL THEN w.snap_dy ELSE sc.dy END AS snap_dy,
  CASE WHEN w.from_sheet IS NOT NULL THEN w.snap_score ELSE sc.score END AS snap_score, w.from_sheet, w.from_score,
  CASE WHEN w.from_sheet IS NOT NULL THEN w.sheet_name END AS to_sheet, w.to_score, w.n_tried::INT AS n_tried, w.tried,
  w.source, coalesce(w.qn, 0) AS n_labels, w.residual_px, w.residual_m, w.reliability, kp.area_m2 AS polygon_area_m2,
  kp.label AS polygon_label, coalesce(u.n, 0) AS n_units, 'm' || l.id_ine::VARCHAR AS municipality
FROM located l JOIN validated v ON v.k = l.k JOIN coords c ON c.rc14 = l.rc14 JOIN moved_warned w ON w.k = c.k
LEFT JOIN snap_choice sc ON sc.rc = c.k LEFT JOIN key_parcels kp ON kp.refcat = l.rc14
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) u ON u.l_orderkey = c.k
WHERE l.reason IS NULL""", "located", "validated", "moved_warned", "snap_choice", "key_parcels"))
def _(spark, sf):
    from parity.calibration import snaps
    candidates = snaps(spark, sf)
    # Both are read by the moves and by the records.
    located = settle(locate_keys(D.requests(spark, sf), D.coords(spark, sf), D.sheets(spark, sf)),
                     "located").filter(F.col("reason").isNull())
    chosen = settle(C.choose_snap(candidates), "chosen")
    keys = D.keyed(spark, sf).select("k", "rc14")
    units = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).join(keys, "k")
    records = result_records(
        located, D.calib(spark, sf), chosen.join(keys, F.col("rc") == F.col("k")).select(
            "rc14", "dx", "dy", "score"), edge_moves(spark, sf, located, chosen, candidates),
        key_parcels(spark, sf), units.select("rc14"))
    path = fresh_path(spark, "results")
    S.write_results(records, path)
    read = spark.read.schema(records.schema).parquet(path)
    tried = F.transform("edge_candidates_tried", lambda t: F.concat(
        t["sheet"], F.lit(" "), txt(F.bround(t["score"] * 1000, 0).cast("int"))))
    return read.select(
        "k", "rc", "address", "utm.x", "utm.y", "cell", "sub_quadrant", "sub_compass", "sheet_name",
        "sheet_url", F.array_join("warnings", "|").alias("warnings"), "body_relative.rx",
        "body_relative.ry", F.col("snap.dx").alias("snap_dx"), F.col("snap.dy").alias("snap_dy"),
        F.col("snap.score").alias("snap_score"), "edge_override.from_sheet",
        "edge_override.from_score", "edge_override.to_sheet", "edge_override.to_score",
        F.size("edge_candidates_tried").alias("n_tried"), F.array_join(tried, "|").alias("tried"),
        "calibration_quality.source", "calibration_quality.n_labels",
        "calibration_quality.residual_px",
        F.col("calibration_quality.expected_residual_m").alias("residual_m"),
        "calibration_quality.reliability", "polygon_area_m2", "polygon_label", "n_units",
        "municipality")


@add("snk2_versioned_calibration", with_sql("SELECT level, key, dx, dy, n FROM calib", "calib"))
def _(spark, sf):
    t = S.VersionedTable(spark, fresh_path(spark, "calibration"))
    cal = D.calib(spark, sf)
    t.publish(cal.withColumn("dx", F.lit(0.0)))
    t.publish(cal)
    return t.current().select("level", "key", "dx", "dy", "n")


@add("snk3_append_resume", with_sql(
    "SELECT rc14, k % 2 AS run FROM keyed", "keyed"))
def _(spark, sf):
    path = fresh_path(spark, "appended")
    k = D.keyed(spark, sf).select("rc14", (F.col("k") % 2).alias("run"))
    schema = "rc14 string, run long"
    S.append_new(k.filter("run = 0"), path, "rc14", schema)
    S.append_new(k, path, "rc14", schema)
    return S.read_done(spark, path, schema)


@add("snk4_corrections", with_sql("""
SELECT v.idx, rc14 AS rc, verdict, CASE WHEN verdict = 'bad' AND cx IS NOT NULL THEN (cx - k % 800) * 0.25::DOUBLE END AS correction_dx_m,
 CASE WHEN verdict = 'bad' AND cx IS NOT NULL THEN (cy - k % 600) * 0.25::DOUBLE END AS correction_dy_m FROM verdicts v JOIN keyed ON k = idx""", "verdicts", "keyed"))
def _(spark, sf):
    from parity.calibration import verdicts
    k = F.col("k")
    c = D.keyed(spark, sf).select(
        k.alias("idx"), F.col("rc14").alias("rc"), (k % 800).cast("double").alias("px"),
        (k % 600).cast("double").alias("py"), F.lit(0.25).alias("m_per_px"))
    return S.corrections(verdicts(spark, sf), c).select(
        "idx", "rc", "verdict", "correction_dx_m", "correction_dy_m")


# ---- all in one ------------------------------------------------------------------------------

D.define("full_names", """
SELECT DISTINCT ambito, etiqueta FROM (SELECT k, ambito, etiqueta FROM zone_names WHERE has_card_zone)
""", "zone_names")
# The first feature of each layer, and the name, label and figures they give.
D.define("zone_names", """
SELECT k, coalesce(n15.area_name, nullif(n15.label, ''), n25.area_name, nullif(n25.label, ''),
   n22.instrument, n22.official, n22.ordinance, nullif(n22.label, ''),
   n06.instrument, n06.official, n06.ordinance, nullif(n06.label, ''),
   n12.instrument, n12.official, n12.ordinance, nullif(n12.label, '')) AS ambito,
   coalesce(nullif(n15.label, ''), nullif(n25.label, ''), nullif(n22.label, '')) AS etiqueta,
   n15 IS NOT NULL OR n25 IS NOT NULL OR n22 IS NOT NULL AS has_card_zone,
   coalesce(n15.use1, n12.use2) AS uso_predominante, n15.ratio::DOUBLE AS edificabilidad,
   CASE WHEN n15 IS NOT NULL THEN (n15.ord * 3 % 70 / 2.0)::DOUBLE END AS densidad_viv_ha,
   CASE WHEN n15 IS NOT NULL THEN 'SISTEMA ' || (n15.ord % 4)::VARCHAR END AS sistema_actuacion
FROM (SELECT k, any_value(f) FILTER (layer_ord = 0) AS n15, any_value(f) FILTER (layer_ord = 1) AS n25,
        any_value(f) FILTER (layer_ord = 2) AS n22, any_value(f) FILTER (layer_ord = 3) AS n12,
        any_value(f) FILTER (layer_ord = 4) AS n06
      FROM (SELECT k, layer_ord, arg_min(f, f.ord) AS f FROM found f GROUP BY k, layer_ord) GROUP BY k)""", "found")
D.define("full_pairs", link_pairs_sql("full_names"), "full_names", "cards")
D.define("full_links", links_sql("full_pairs"), "full_pairs")
D.define("rural_bodies", """
SELECT k, rc14, nullif(concat_ws(' · ', CASE WHEN k % 2 = 0 THEN 'PARAJE ' || (k % 9)::VARCHAR END,
    CASE WHEN k % 5 <> 0 THEN 'Pol ' || (k % 40)::VARCHAR || ' Parc ' || CASE WHEN k % 7 = 0 THEN '' ELSE (k % 70)::VARCHAR END END,
    CASE WHEN k % 3 <> 0 THEN 'VILLA' END), '') AS address FROM keyed WHERE k % 11 <> 0""", "keyed")


def rural_bodies(spark, sf):
    """Landed registry responses of single rural properties."""
    k = F.col("k")
    land = F.struct(
        F.when(k % 2 == 0, F.concat(F.lit(" PARAJE "), txt(k % 9))).alias("npa"),
        F.struct(F.when(k % 5 != 0, txt(k % 40)).alias("cpo"),
                 F.when((k % 5 != 0) & (k % 7 != 0), txt(k % 70)).alias("cpa")).alias("cpp"))
    dt = F.struct(F.struct(F.struct(land.alias("lorus")).alias("lors")).alias("locs"),
                  F.when(k % 3 != 0, " VILLA ").alias("nm"))
    body = F.to_json(F.struct(F.struct(F.struct(F.struct(dt.alias("dt")).alias("bi")).alias("bico"))
                              .alias("consulta_dnprcResult")))
    return D.keyed(spark, sf).filter(k % 11 != 0).select("k", "rc14", body.alias("body"))


@add("prj16_rural_responses", with_sql(
    "SELECT rc14, address FROM rural_bodies", "rural_bodies"))
def _(spark, sf):
    return R.parse_rural_addresses(rural_bodies(spark, sf))


@add("jn24_full_enrichment", with_sql("""
SELECT r.k, CASE WHEN NOT r.ok THEN 'bad_key' WHEN c.k IS NULL THEN 'not_found' END AS status,
  CASE WHEN c.k % 4 = 0 THEN ra.address ELSE c.address END AS address,
  CASE WHEN l.reason IS NULL THEN l.sheet_name END AS sheet_name, CASE WHEN l.reason IS NULL THEN q.cell END AS cell, CASE WHEN l.reason IS NULL THEN q.sub END AS sub,
  CASE WHEN c.k IS NULL THEN NULL WHEN l.reason IS NULL THEN q.reliability WHEN kp.refcat IS NOT NULL THEN 'rural' END AS reliability,
  CASE WHEN l.reason IS NULL THEN round_even(q.odx, 0)::INT END AS cal_dx, CASE WHEN l.reason IS NULL THEN round_even(q.ody, 0)::INT END AS cal_dy,
  CASE WHEN l.reason IS NULL THEN q.source END AS source, CASE WHEN l.reason IS NULL THEN q.residual_m END AS residual_m,
  CASE WHEN c.k IS NOT NULL AND l.reason IS NULL THEN concat_ws('|', l.warning, q.qwarning) END AS warnings,
  CASE WHEN l.reason IS NULL THEN sc.dx END AS snap_dx, CASE WHEN l.reason IS NULL THEN sc.dy END AS snap_dy, CASE WHEN l.reason IS NULL THEN sc.score END AS snap_score,
  kp.area_m2 AS polygon_area_m2, kp.label AS polygon_label, CASE WHEN c.k IS NOT NULL THEN coalesce(u.n, 0) END AS n_units,
  z.ambito, z.uso_predominante, z.edificabilidad, z.densidad_viv_ha, z.sistema_actuacion, f.fichas, f.top_card, f.superficie,
  CASE WHEN c.k IS NOT NULL AND l.reason IS NOT NULL AND rr.ok THEN rs.snu END AS snu_sheet, CASE WHEN c.k IS NOT NULL THEN coalesce(h.near, '') END AS patrimonio,
  CASE WHEN c.k IS NOT NULL AND l.reason NOT IN ('bad_format', 'no_sheet') THEN 'sin SU: ' || l.reason WHEN c.k IS NOT NULL THEN '' END AS notes
FROM (SELECT *, coalesce(regexp_matches(upper(trim(raw)), '^([0-9A-Z]{14}|[0-9A-Z]{20})$'), false) AS ok FROM requests) r
LEFT JOIN coords c ON r.ok AND c.rc14 = substr(upper(trim(r.raw)), 1, 14)
LEFT JOIN (SELECT * FROM (SELECT k, sheet_name, warning, CASE WHEN id_ine IS NULL THEN 'out_of_extent' WHEN id_ine <> 33044 THEN 'no_grid'
     WHEN letter IS NULL THEN 'row_out_of_range' WHEN url IS NULL THEN 'no_sheet' END AS reason
   FROM (SELECT b.*, s.url, CASE WHEN x BETWEEN 253000 AND 278000 AND y BETWEEN 4798000 AND 4815000 THEN 33044
     WHEN x BETWEEN 270921 AND 292773 AND y BETWEEN 4813038 AND 4829451 THEN 33024 END AS id_ine
     FROM bordered b LEFT JOIN sheets s ON s.sheet_name = b.sheet_name))) l ON l.k = c.k
LEFT JOIN warned q ON q.k = c.k
LEFT JOIN rural_bodies ra ON ra.rc14 = c.rc14
LEFT JOIN snap_choice sc ON sc.rc = c.k
LEFT JOIN key_parcels kp ON kp.refcat = c.rc14
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) u ON u.l_orderkey = c.k
LEFT JOIN zone_names z ON z.k = c.k
LEFT JOIN (SELECT g.*, CASE WHEN d.ord % 3 <> 0 THEN (d.ord * 1.5)::DOUBLE END AS superficie
   FROM (SELECT ambito, etiqueta, string_agg(filename || ' ' || score::VARCHAR || ' ' || tokens_matched::VARCHAR || ' ' || num_matched::VARCHAR, '|' ORDER BY rank) AS fichas,
           arg_min(filename, rank) AS top_card FROM full_links GROUP BY ALL) g JOIN cards d ON d.filename = g.top_card) f
 ON z.has_card_zone AND f.ambito = z.ambito AND f.etiqueta IS NOT DISTINCT FROM z.etiqueta
LEFT JOIN rural rr ON rr.k = c.k
LEFT JOIN (SELECT a.c AS ac, a.r AS ar, arg_min(s.sheet_name, row(greatest(abs(s.c - a.c), abs(s.r - a.r)), (s.c - a.c) ** 2 + (s.r - a.r) ** 2,
          substr('ABCDEFGHIJ', s.r + 1, 1), s.c)) AS snu FROM (SELECT DISTINCT c, r FROM rural WHERE ok) a, rural_sheets s GROUP BY ALL) rs ON rs.ac = rr.c AND rs.ar = rr.r
LEFT JOIN (SELECT k, string_agg(tipo || '/' || ord::VARCHAR || '/' || nombre || '/' || etiqueta, '|' ORDER BY tipo, ord) AS near FROM near_heritage GROUP BY k) h ON h.k = c.k""",
    "requests", "coords", "bordered", "sheets", "warned", "rural_bodies", "snap_choice", "key_parcels", "zone_names", "full_links", "rural", "rural_sheets", "near_heritage"))
def _(spark, sf):
    from parity.calibration import snaps
    keys = D.keyed(spark, sf).select("k", "rc14")
    units = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).join(keys, "k")
    c = cards(spark, sf)
    records = c.filter(F.col("ord") % 3 != 0).select(
        F.regexp_replace("filename", r"\.pdf$", "").alias("key"),
        (F.col("ord") * 1.5).alias("superficie"))
    # Every fourth key has no address of its own.
    coords = D.coords(spark, sf).withColumn(
        "address", F.when(F.col("k") % 4 == 0, "").otherwise(F.col("address")))
    figures = features(spark, sf).withColumn("props", F.map_concat("props", F.create_map(
        F.lit(Z.DENSITY), txt(F.col("ord") * 3 % 70 / F.lit(2.0)),
        F.lit(Z.ACTION_SYSTEM), F.concat(F.lit("SISTEMA "), txt(F.col("ord") % 4)))))
    snap = C.choose_snap(snaps(spark, sf)).join(keys, F.col("rc") == F.col("k"))
    full = E.enrich_keys(
        D.requests(spark, sf), coords, D.sheets(spark, sf), rural_sheets(spark, sf), figures,
        heritage(spark, sf), c, records, D.calib(spark, sf), key_parcels(spark, sf), units,
        R.parse_rural_addresses(rural_bodies(spark, sf)), snap.select("rc14", "dx", "dy", "score"))

    def joined(of, *fields):
        return F.array_join(F.transform(of, lambda e: F.concat_ws(
            "/" if of == "patrimonio" else " ", *[txt(e[x]) for x in fields])), "|").alias(of)
    return full.select(
        "k", "status", "address", "sheet_name", "cell", "sub", "reliability", "cal_dx", "cal_dy",
        "source", "residual_m", F.array_join("warnings", "|").alias("warnings"),
        F.col("snap.dx").alias("snap_dx"), F.col("snap.dy").alias("snap_dy"),
        F.col("snap.score").alias("snap_score"), "polygon_area_m2", "polygon_label", "n_units",
        "ambito", "uso_predominante", "edificabilidad", "densidad_viv_ha", "sistema_actuacion",
        joined("fichas_match", "filename", "score", "tokens_matched", "num_matched").alias("fichas"),
        "top_card", "superficie", "snu_sheet",
        joined("patrimonio", "tipo", "ord", "nombre", "etiqueta"),
        F.array_join("notes", "|").alias("notes"))


# Zones whose names need a file-safe form, card pages of two thirds of them, records of half.
D.define("lookup_zones", """
SELECT *, id || ' (' || nat::VARCHAR || ')' AS name2 FROM zones""", "zones")


@add("zone_lookup", with_sql("""
SELECT p.k, p.x BETWEEN 253000 AND 278000 AND p.y BETWEEN 4798000 AND 4815000 AS inside, m.name2 AS zone,
  CASE WHEN m.tier = 0 THEN 'AUA' WHEN m.tier = 1 THEN 'C' END AS categoria, 'https://cards.example/' || m.id AS ficha_url,
  CASE WHEN m.zk % 3 <> 0 THEN 'Zona ' || m.zk::VARCHAR END AS nombre_largo, CASE WHEN m.zk % 2 = 0 THEN (m.zk * 2.5)::DOUBLE END AS superficie,
  CASE WHEN m.id IS NOT NULL THEN coalesce(o.others, '') END AS overlapping,
  CASE WHEN m.id IS NULL AND p.x BETWEEN 253000 AND 278000 AND p.y BETWEEN 4798000 AND 4815000 THEN 'inside the extent but in no zone' END AS note
FROM points p
LEFT JOIN (SELECT r.k, z.* FROM ranked r JOIN lookup_zones z USING (id) WHERE rank = 1) m
  ON m.k = p.k AND p.x BETWEEN 253000 AND 278000 AND p.y BETWEEN 4798000 AND 4815000
LEFT JOIN (SELECT r.k, string_agg(z.name2, '|' ORDER BY rank) AS others FROM ranked r JOIN lookup_zones z USING (id) WHERE rank > 1 GROUP BY r.k) o ON o.k = m.k""",
    "points", "ranked", "lookup_zones"))
def _(spark, sf):
    name = F.concat("id", F.lit(" ("), txt(F.col("nat")), F.lit(")"))
    zones = D.zones(spark, sf).withColumn("id", name)
    zk = F.col("zk")
    pages = zones.filter(zk % 3 != 0).select(
        F.col("id").alias("zone"), "categoria", F.concat(F.lit("Zona "), txt(zk)).alias("nombre_largo"))
    records = zones.filter(zk % 2 == 0).select(
        T.safe_name(F.col("id")).alias("key"), (zk * 2.5).alias("superficie"))
    found = E.zone_lookup(D.points(spark, sf).select("k", "x", "y"), zones, pages, records, D.HOME, "k")
    return found.select(
        "k", "inside", F.col("id").alias("zone"), "categoria", "ficha_url", "nombre_largo",
        "superficie", F.array_join("overlapping", "|").alias("overlapping"), "note")


# ---- streams --------------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark, sf):
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)


@add("st1_label_upsert", with_sql("SELECT rc, seq, action, dx, dy FROM latest", "latest"))
def _(spark, sf):
    base = fresh_path(spark, "labels")
    store = ST.LabelStore(spark, base)
    ST.upsert_labels(D.label_events(spark, sf, event_stream(spark, sf)), store,
                     base + "/checkpoint").awaitTermination()
    return store.current().select("rc", "seq", "action", "dx", "dy")


def recalibrated(spark, sf):
    base = fresh_path(spark, "recal")
    store = ST.LabelStore(spark, base + "/labels")
    counter = ST.AcceptCounter(spark, base + "/count")
    cal = S.VersionedTable(spark, base + "/calibration")
    ST.recalibrate_on_labels(
        D.label_events(spark, sf, event_stream(spark, sf)), store, counter, D.coords(spark, sf),
        cal, base + "/checkpoint").awaitTermination()
    return counter, cal, base


@add("st2_count_trigger", with_sql("""
SELECT n AS accepts, n // 30 AS fired, n % 30 AS carry FROM (SELECT count(*) AS n FROM label_events WHERE action = 'accept')""", "label_events"))
def _(spark, sf):
    counter, _, _ = recalibrated(spark, sf)
    return counter.batches().agg(
        F.sum("accepts").alias("accepts"), F.sum("fired").alias("fired"),
        F.max_by("carry", "batch_id").alias("carry"))


@add("st3_recalibration", with_sql("""
SELECT 'quadrant' AS level, key, dx, dy, n FROM buckets
UNION ALL SELECT 'cell', regexp_extract(key, '^(.*)-[^-]*$', 1), round_even(median(dx), 1), round_even(median(dy), 1), NULL FROM buckets GROUP BY 2
UNION ALL SELECT 'global', '', round_even(median(dx), 1), round_even(median(dy), 1), NULL FROM buckets""", "buckets"))
def _(spark, sf):
    _, cal, _ = recalibrated(spark, sf)
    return cal.current().select("level", "key", "dx", "dy", "n")


@add("st4_calibration_reload", with_sql("""
SELECT o.l_orderkey AS k, o.l_linenumber AS ln, o.l_partkey AS pk, round_even(odx, 0)::INT AS cal_dx, round_even(ody, 0)::INT AS cal_dy, reliability
FROM lineitem o JOIN warned w ON w.k = o.l_orderkey""", "warned"))
def _(spark, sf):
    base = fresh_path(spark, "reload")
    cal = S.VersionedTable(spark, base + "/calibration")
    cal.publish(D.calib(spark, sf))
    lines = spark.readStream.schema("l_orderkey long, l_partkey long, l_linenumber int").option(
        "pathGlobFilter", "lineitem.parquet").parquet(sf)
    keys = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
                        F.col("l_partkey").alias("pk"))
    placed = D.placed(spark, sf).select("k", "cell", "sub")
    ST.apply_calibration(keys.join(placed, "k"), cal, base + "/out",
                         base + "/checkpoint").awaitTermination()
    return ST.read_batches(spark, base + "/out").select(
        "k", "ln", "pk", "cal_dx", "cal_dy", "reliability")


@add("st5_resumable_gates", with_sql("SELECT outcome, count(*) AS n FROM gated GROUP BY outcome", "gated"))
def _(spark, sf):
    base = fresh_path(spark, "gates")
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    lines = spark.readStream.schema(schema).option(
        "pathGlobFilter", "lineitem.parquet").parquet(sf)
    ST.gate_stream(matches(spark, sf, lines), base, base + "/checkpoint").awaitTermination()
    return ST.read_batches(spark, base + "/stats").groupBy("outcome").agg(F.sum("n").alias("n"))




@add("st5_rates", with_sql("""
SELECT outcome, count(*) AS n, count(*)::DOUBLE / any_value(total) AS share, 4::BIGINT AS batches, true AS timed
FROM gated, (SELECT count(*) AS total FROM gated) GROUP BY outcome""", "gated"))
def _(spark, sf):
    base = fresh_path(spark, "rates")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    # Four parts land one after another, and the job goes on from its checkpoint: one batch for each,
    # of as many files as tasks wrote it.
    for part in range(4):
        rows.filter(F.col("l_orderkey") % 4 == part).write.mode("append").parquet(base + "/lines")
        lines = spark.readStream.schema(schema).parquet(base + "/lines")
        ST.gate_stream(matches(spark, sf, lines), base, base + "/checkpoint").awaitTermination()
    rates = ST.gate_rates(ST.read_batches(spark, base + "/stats"))
    return rates.select("outcome", "n", "share", "batches",
                        (F.col("rows_per_second") > 0).alias("timed"))
