"""Domain tables derived from the given tables by key arithmetic, in Spark and as SQL.

The two forms of each table are kept next to each other; `with_sql` assembles the SQL form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.functions import grid
from lindero.operators import locate as L
from lindero.registry import DEFAULT_REGISTRY, as_struct
from parity.base import table

HOME = DEFAULT_REGISTRY[0]
SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def define(name: str, body: str, *needs: str) -> None:
    SQL[name] = (body, needs)


def with_sql(body: str, *names: str) -> str:
    """`body` preceded by the named derived tables and all they need."""
    done: list[str] = []

    def visit(name: str) -> None:
        for need in SQL[name][1]:
            visit(need)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    if not done:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL[n][0]})" for n in done)
    return f"WITH {ctes}\n{body}"


# ---- keys and points ---------------------------------------------------------------------

define("keyed", """
SELECT k, o_custkey AS cust, lpad((k % 10000000)::VARCHAR, 7, '0') || 'TP'
       || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || chr((65 + k % 26)::INT) AS rc14,
       o_totalprice AS price
FROM (SELECT o_orderkey AS k, o_custkey, o_totalprice FROM orders)
""")


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    rc14 = F.concat(
        F.lpad((k % 10000000).cast("string"), 7, "0"), F.lit("TP"),
        F.lpad((cust % 10000).cast("string"), 4, "0"), F.char((65 + k % 26)))
    return table(spark, sf, "orders", spread=True).select(
        k.alias("k"), cust.alias("cust"), rc14.alias("rc14"), F.col("o_totalprice").alias("price"))


define("points", """
SELECT k, cust, rc14, (253338 + (k * 7919) % 24000)::DOUBLE AS x,
       (CASE WHEN k % 19 = 0 THEN 4814500 + (k * 104729) % 13800
             WHEN k % 23 = 0 THEN 4812500 + (k * 31) % 2400
             ELSE 4798500 + (k * 104729) % 13800 END)::DOUBLE AS y
FROM keyed""", "keyed")


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    y = (F.when(k % 19 == 0, 4814500 + (k * 104729) % 13800)
         .when(k % 23 == 0, 4812500 + (k * 31) % 2400)
         .otherwise(4798500 + (k * 104729) % 13800))
    return keyed(spark, sf).select(
        "k", "cust", "rc14", (253338 + (k * 7919) % 24000).cast("double").alias("x"),
        y.cast("double").alias("y"))


define("coords", """
SELECT rc14, x, y, 'CL CALLE ' || (cust % 50)::VARCHAR AS address, k
FROM points WHERE k % 13 <> 0""", "points")


def coords(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).filter(F.col("k") % 13 != 0).select(
        "rc14", "x", "y",
        F.concat(F.lit("CL CALLE "), (F.col("cust") % 50).cast("string")).alias("address"), "k")


define("requests", """
SELECT k, CASE k % 17 WHEN 0 THEN '  ' || lower(rc14) || ' ' WHEN 1 THEN rc14 || '0001AB'
               WHEN 2 THEN substr(rc14, 1, 13) WHEN 3 THEN 'X' || substr(rc14, 2)
               WHEN 4 THEN NULL ELSE rc14 END AS raw
FROM keyed""", "keyed")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    k, rc = F.col("k"), F.col("rc14")
    kind = k % 17
    raw = (F.when(kind == 0, F.concat(F.lit("  "), F.lower(rc), F.lit(" ")))
           .when(kind == 1, F.concat(rc, F.lit("0001AB")))
           .when(kind == 2, F.left(rc, F.lit(13)))
           .when(kind == 3, F.concat(F.lit("X"), F.substring(rc, 2, 100)))
           .when(kind == 4, F.lit(None).cast("string"))
           .otherwise(rc))
    return keyed(spark, sf).select("k", raw.alias("raw"))


# ---- grid ----------------------------------------------------------------------------------

G = {
    "x0": f"{HOME.x0}::DOUBLE", "ym": f"{HOME.ymax_grid}::DOUBLE", "cw": f"{HOME.cell_w}::DOUBLE",
    "ch": f"{HOME.cell_h}::DOUBLE", "mx": f"{HOME.marg_x}::DOUBLE", "my": f"{HOME.marg_y}::DOUBLE",
}
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXY'"
QUAD = "CASE compass WHEN 'NW' THEN 'I' WHEN 'NE' THEN 'II' WHEN 'SW' THEN 'III' ELSE 'IV' END"

define("placed", """
SELECT *, CASE WHEN row BETWEEN 0 AND 24 THEN substr({L}, row + 1, 1) END AS letter,
       {Q} AS sub,
       col::VARCHAR || '-' || CASE WHEN row BETWEEN 0 AND 24 THEN substr({L}, row + 1, 1) END AS cell,
       'PLANO_' || col::VARCHAR || '_'
       || CASE WHEN row BETWEEN 0 AND 24 THEN substr({L}, row + 1, 1) END || '_' || ({Q}) || '.pdf'
       AS sheet_name,
       (x - ({x0} + col * {cw} + CASE WHEN x_in < 0.5 THEN 0.0 ELSE {cw} / 2 END - {mx}))
         / ({cw} / 2 + 2 * {mx}) AS rx_raw,
       (({ym} - row * {ch} - CASE WHEN y_in < 0.5 THEN 0.0 ELSE {ch} / 2 END + {my}) - y)
         / ({ch} / 2 + 2 * {my}) AS ry_raw
FROM (SELECT *, (CASE WHEN y_in < 0.5 THEN 'N' ELSE 'S' END)
             || (CASE WHEN x_in < 0.5 THEN 'W' ELSE 'E' END) AS compass
      FROM (SELECT *, (x - ({x0} + col * {cw})) / {cw} AS x_in,
                   ({ym} - row * {ch} - y) / {ch} AS y_in
            FROM (SELECT *, floor((x - {x0}) / {cw})::INT AS col,
                         floor(({ym} - y) / {ch})::INT AS row FROM points)))
""".format(L=LETTERS, Q=QUAD, **G), "points")


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return L.grid_columns(points(spark, sf), as_struct(HOME))


define("sheets", """
SELECT sheet_name, 'https://maps.example/' || sheet_name AS url
FROM (SELECT DISTINCT sheet_name, col, row, sub FROM placed WHERE letter IS NOT NULL)
WHERE (col * 7 + row * 3 + length(sub) + 700) % 5 <> 0""", "placed")


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    p = placed(spark, sf).filter(F.col("letter").isNotNull())
    keep = (F.col("col") * 7 + F.col("row") * 3 + F.length("sub") + 700) % 5 != 0
    return p.select("sheet_name", "col", "row", "sub").distinct().filter(keep).select(
        "sheet_name", F.concat(F.lit("https://maps.example/"), "sheet_name").alias("url"))


define("calib", """
WITH q AS (SELECT DISTINCT col, row, cell, sub FROM placed WHERE letter IS NOT NULL)
SELECT 'quadrant' AS level, cell || '-' || sub AS key, ((col * 13 + 300) % 200 - 100) * 0.5::DOUBLE AS dx,
       ((row * 17) % 200 - 100) * 0.5::DOUBLE AS dy, ((col + row + 30) % 5 + 1)::BIGINT AS n,
       ((col * 3 + 30) % 20)::DOUBLE AS std_x, ((row * 3) % 20)::DOUBLE AS std_y,
       ((col * 7 + row * 5 + 70) % 60)::DOUBLE AS residual_px, TRUE AS direct
FROM q WHERE (col + row + 30) % 3 = 0 AND sub <> 'IV'
UNION ALL
SELECT DISTINCT 'cell', cell, ((col * 11 + 300) % 200 - 100) * 0.5::DOUBLE,
       ((row * 19) % 200 - 100) * 0.5::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,
       (col + 30) % 2 = 0
FROM q WHERE (col + row + 30) % 3 <> 2
UNION ALL
SELECT 'global', '', 12.5::DOUBLE, -3.5::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, TRUE
""", "placed")


def calib(spark: SparkSession, sf: str) -> DataFrame:
    q = placed(spark, sf).filter(F.col("letter").isNotNull()).select(
        "col", "row", "cell", "sub").distinct()
    col, row = F.col("col"), F.col("row")
    none = F.lit(None)

    def shape(level: str, key: Column, dx: Column, dy: Column, n: Column, sx: Column, sy: Column,
              res: Column, direct: Column) -> list[Column]:
        return [F.lit(level).alias("level"), key.alias("key"), dx.cast("double").alias("dx"),
                dy.cast("double").alias("dy"), n.cast("long").alias("n"),
                sx.cast("double").alias("std_x"), sy.cast("double").alias("std_y"),
                res.cast("double").alias("residual_px"), direct.alias("direct")]

    quad = q.filter(((col + row + 30) % 3 == 0) & (F.col("sub") != "IV")).select(*shape(
        "quadrant", F.concat_ws("-", "cell", "sub"), ((col * 13 + 300) % 200 - 100) * 0.5,
        ((row * 17) % 200 - 100) * 0.5, (col + row + 30) % 5 + 1, (col * 3 + 30) % 20,
        (row * 3) % 20, (col * 7 + row * 5 + 70) % 60, F.lit(True)))
    cell = q.filter((col + row + 30) % 3 != 2).select(*shape(
        "cell", F.col("cell"), ((col * 11 + 300) % 200 - 100) * 0.5,
        ((row * 19) % 200 - 100) * 0.5, none, none, none, none, (col + 30) % 2 == 0)).distinct()
    over = q.agg(F.count(F.lit(1)).alias("c")).select(*shape(
        "global", F.lit(""), F.lit(12.5), F.lit(-3.5), none, none, none, none, F.lit(True)))
    return quad.unionByName(cell).unionByName(over)


# ---- zones and parcels ----------------------------------------------------------------------


def ell(ox: Column, oy: Column, w: Column, h: Column) -> Column:
    """L-shaped closed ring."""
    def p(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(ox, oy), p(ox + w, oy), p(ox + w, oy + h / 2), p(ox + w / 2, oy + h / 2),
                   p(ox + w / 2, oy + h), p(ox, oy + h), p(ox, oy))


# Edges (previous vertex j, vertex i) of the ring above.
ELL_EDGES = """
SELECT {id} AS zid, unnest([
  {{'xi': ox, 'yi': oy, 'xj': ox, 'yj': oy}},
  {{'xi': ox + w, 'yi': oy, 'xj': ox, 'yj': oy}},
  {{'xi': ox + w, 'yi': oy + h / 2, 'xj': ox + w, 'yj': oy}},
  {{'xi': ox + w / 2, 'yi': oy + h / 2, 'xj': ox + w, 'yj': oy + h / 2}},
  {{'xi': ox + w / 2, 'yi': oy + h, 'xj': ox + w / 2, 'yj': oy + h / 2}},
  {{'xi': ox, 'yi': oy + h, 'xj': ox + w / 2, 'yj': oy + h}},
  {{'xi': ox, 'yi': oy, 'xj': ox, 'yj': oy + h}}], recursive := true)
FROM {src}"""

define("zone_base", """
SELECT 'S' || s_suppkey::VARCHAR AS id, s_suppkey AS zk, s_nationkey AS nat, 0 AS tier,
       (253338 + (s_suppkey * 7001) % 20000)::DOUBLE AS ox,
       (4798500 + (s_suppkey * 3001) % 10000)::DOUBLE AS oy,
       (1500 + (s_suppkey * 37) % 2500)::DOUBLE AS w, (1100 + (s_suppkey * 53) % 1900)::DOUBLE AS h
FROM supplier
UNION ALL
SELECT 'C' || c_custkey::VARCHAR, c_custkey, c_nationkey, 1,
       (253338 + (c_custkey * 4987) % 23000)::DOUBLE, (4798500 + (c_custkey * 6421) % 13000)::DOUBLE,
       (60 + (c_custkey * 13) % 240)::DOUBLE, (60 + (c_custkey * 29) % 240)::DOUBLE
FROM customer""")


def zone_base(spark: SparkSession, sf: str) -> DataFrame:
    s, c = F.col("s_suppkey"), F.col("c_custkey")

    def d(v: Column) -> Column:
        return v.cast("double")

    big = table(spark, sf, "supplier", spread=True).select(
        F.concat(F.lit("S"), s.cast("string")).alias("id"), s.alias("zk"),
        F.col("s_nationkey").alias("nat"), F.lit(0).alias("tier"),
        d(253338 + (s * 7001) % 20000).alias("ox"), d(4798500 + (s * 3001) % 10000).alias("oy"),
        d(1500 + (s * 37) % 2500).alias("w"), d(1100 + (s * 53) % 1900).alias("h"))
    small = table(spark, sf, "customer", spread=True).select(
        F.concat(F.lit("C"), c.cast("string")).alias("id"), c.alias("zk"),
        F.col("c_nationkey").alias("nat"), F.lit(1).alias("tier"),
        d(253338 + (c * 4987) % 23000).alias("ox"), d(4798500 + (c * 6421) % 13000).alias("oy"),
        d(60 + (c * 13) % 240).alias("w"), d(60 + (c * 29) % 240).alias("h"))
    return big.unionByName(small)


# Zones: every seventh also has a second ring, shifted by its width and 100 m.
define("zones", """
SELECT id, zk, nat, tier, replace(id, 'S', 'AUA-') AS name, ox, oy, w, h, zk % 7 = 0 AS twin,
       tier * 1000000000 + zk AS ord
FROM zone_base""", "zone_base")


def zones(spark: SparkSession, sf: str) -> DataFrame:
    ox, oy, w, h = (F.col(c) for c in ("ox", "oy", "w", "h"))
    main = ell(ox, oy, w, h)
    twin = ell(ox + w + 100, oy, w, h)
    return zone_base(spark, sf).select(
        "id", F.col("id").alias("ficha_id"),
        F.when(F.col("tier") == 0, F.lit("AUA")).otherwise(F.lit("C")).alias("categoria"),
        F.concat(F.lit("https://cards.example/"), "id").alias("ficha_url"),
        F.when(F.col("zk") % 7 == 0, F.array(main, twin)).otherwise(F.array(main)).alias("rings"),
        (F.col("tier") * F.lit(1000000000).cast("long") + F.col("zk")).alias("ord"),
        "zk", "nat", "tier", "ox", "oy", "w", "h")


define("zone_edges", ELL_EDGES.format(id="id || '/0'", src="zones") + "\nUNION ALL\n"
       + ELL_EDGES.format(
           id="id || '/1'",
           src="(SELECT id, ox + w + 100 AS ox, oy, w, h FROM zones WHERE twin)"),
       "zones")
define("zone_rings", """
SELECT id, 0 AS r, ox AS bx0, oy AS by0, ox + w AS bx1, oy + h AS by1 FROM zones
UNION ALL
SELECT id, 1, ox + w + 100, oy, ox + w + 100 + w, oy + h FROM zones WHERE twin""", "zones")

# All (point, zone) hits by brute force.
define("hits", """
SELECT DISTINCT p.k, p.rc14, r.id
FROM points p JOIN zone_rings r ON p.x BETWEEN r.bx0 AND r.bx1 AND p.y BETWEEN r.by0 AND r.by1
WHERE (SELECT count(*) FROM zone_edges e
       WHERE e.zid = r.id || '/' || r.r::VARCHAR AND (e.yi > p.y) <> (e.yj > p.y)
         AND p.x < (e.xj - e.xi) * (p.y - e.yi) / (e.yj - e.yi + 1e-12::DOUBLE) + e.xi) % 2 = 1
""", "points", "zone_rings", "zone_edges")

# Parcels: one per customer, the small L-shapes, keyed like the points.
define("parcels", """
SELECT lpad(c_custkey::VARCHAR, 7, '0') || 'TP0000' || chr((65 + c_custkey % 26)::INT) AS refcat,
       c_custkey AS ck, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'P' || (c_custkey % 99)::VARCHAR END AS label,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (w * h * 0.75)::DOUBLE END AS area_m2, ox, oy, w, h
FROM customer JOIN zone_base ON tier = 1 AND zk = c_custkey""", "zone_base")


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    ck = F.col("zk")
    return zone_base(spark, sf).filter(F.col("tier") == 1).select(
        F.concat(F.lpad(ck.cast("string"), 7, "0"), F.lit("TP0000"), F.char(65 + ck % 26))
        .alias("refcat"),
        ck.alias("ck"),
        F.when(ck % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("P"), (ck % 99).cast("string")))
        .alias("label"),
        F.when(ck % 4 == 0, F.lit(None)).otherwise(F.col("w") * F.col("h") * 0.75)
        .cast("double").alias("area_m2"),
        ell(F.col("ox"), F.col("oy"), F.col("w"), F.col("h")).alias("poly"),
        "ox", "oy", "w", "h")


# ---- labels -----------------------------------------------------------------------------------

define("label_events", """
SELECT rc14 || '0001AA' AS rc, e.event_id AS seq, e.ts,
       CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject_unfixable' ELSE 'skip' END AS action,
       (floor(value)::INT % 41 - 20)::INT AS dx, (kk % 31 - 15)::INT AS dy,
       ((e.event_id % 7) * 3 - 9)::INT AS cal_dx, ((e.event_id % 5) * 4 - 8)::INT AS cal_dy,
       (kk / 100.0::DOUBLE)::DOUBLE AS snap_score,
       CASE WHEN kk % 3 = 0 THEN 'UG-' || (e.user_id % 20)::VARCHAR WHEN kk % 3 = 1 THEN '' END AS etiqueta
FROM (SELECT *, json_extract_string(props, '$.k')::INT AS kk FROM events) e
JOIN keyed ON k = (e.user_id * 97 + kk * 7919) % (SELECT max(o_orderkey) + 1 FROM orders)""", "keyed")


def key_range(spark: SparkSession, sf: str, name: str, key: str) -> int:
    """One more than the largest key of a table: keys made by a remainder reach all of it."""
    return (table(spark, sf, name).agg(F.max(key)).first()[0] or 0) + 1


def label_events(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    e = (events if events is not None else table(spark, sf, "events")).withColumn(
        "kk", F.get_json_object("props", "$.k").cast("int"))
    eid, kk = F.col("event_id"), F.col("kk")
    keys = keyed(spark, sf).select("k", "rc14")
    n = key_range(spark, sf, "orders", "o_orderkey")
    e = e.withColumn("k", (F.col("user_id") * 97 + kk * 7919) % n).join(keys, "k")
    action = (F.when(F.col("event_type") == "purchase", "accept")
              .when(F.col("event_type") == "error", "reject_unfixable").otherwise("skip"))
    return e.select(
        F.concat("rc14", F.lit("0001AA")).alias("rc"), eid.alias("seq"), "ts",
        action.alias("action"), (F.floor("value").cast("int") % 41 - 20).alias("dx"),
        (kk % 31 - 15).alias("dy"), ((eid % 7) * 3 - 9).cast("int").alias("cal_dx"),
        ((eid % 5) * 4 - 8).cast("int").alias("cal_dy"),
        (kk / F.lit(100.0)).alias("snap_score"),
        F.when(kk % 3 == 0, F.concat(F.lit("UG-"), (F.col("user_id") % 20).cast("string")))
        .when(kk % 3 == 1, F.lit("")).alias("etiqueta"))


define("latest", """
SELECT * FROM label_events QUALIFY row_number() OVER (PARTITION BY rc ORDER BY ts DESC, seq DESC) = 1
""", "label_events")
