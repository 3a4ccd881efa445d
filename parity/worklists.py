"""Worklists, sampling, tiles and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lindero.functions import geometry as GM
from lindero.operators import locate as L
from lindero.operators import worklists as W
from lindero.operators import zones as Z
from lindero.operators.spatial import by_place
from lindero.registry import as_struct
from parity import derived as D
from parity.base import add, table
from parity.derived import with_sql
from parity.geometry import boxes
from parity.location import rural_sheets

GRID_SQL = """
SELECT {cols}, x1, y1, least(x1 + {step}, bx1) AS x2, least(y1 + {step}, by1) AS y2
FROM (SELECT *, bx0 + i * {step} AS x1, by0 + j * {step} AS y1
      FROM (SELECT *, unnest(range(ceil((bx1 - bx0) / {step})::BIGINT)) AS i
            FROM (SELECT *, unnest(range(ceil((by1 - by0) / {step})::BIGINT)) AS j FROM {src})))"""
D.define("zone_boxes", """
SELECT id, ox AS bx0, oy AS by0, CASE WHEN twin THEN ox + w + 100 + w ELSE ox + w END AS bx1, oy + h AS by1,
  CASE WHEN zk % 2 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS mpp FROM zones""", "zones")


def zone_boxes(spark, sf):
    return D.zones(spark, sf).select(
        "id", GM.rings_bbox(F.col("rings")).alias("box"),
        F.when(F.col("zk") % 2 == 0, 0.25).otherwise(0.5).alias("mpp"))


@add("prj17_covering_chunks", with_sql(
    GRID_SQL.format(cols="id", step="500.0::DOUBLE", src="zone_boxes"), "zone_boxes"))
def _(spark, sf):
    return W.covering_grid(zone_boxes(spark, sf), "box", F.lit(W.CHUNK_M)).select(
        "id", "x1", "y1", "x2", "y2")


@add("prj17_covering_tiles", with_sql(
    GRID_SQL.format(cols="id, mpp", step="(mpp * 2000)", src="zone_boxes"), "zone_boxes"))
def _(spark, sf):
    return W.tile_grid(zone_boxes(spark, sf), "box", F.col("mpp")).select(
        "id", "mpp", "x1", "y1", "x2", "y2")


D.define("eligible", """
SELECT k, rc14, cell, sub FROM placed WHERE letter IS NOT NULL AND sheet_name IN (SELECT sheet_name FROM sheets)
""", "placed", "sheets")


def eligible(spark, sf):
    return W.eligible(D.placed(spark, sf), D.sheets(spark, sf))


@add("prj18_eligible_keys", with_sql("SELECT rc14, cell FROM eligible", "eligible"))
def _(spark, sf):
    return eligible(spark, sf).select("rc14", "cell")


@add("prj18_eligible_urban", with_sql(
    "SELECT rc14, cell FROM eligible WHERE substr(rc14, 8, 3) = 'TP1'", "eligible"))
def _(spark, sf):
    return W.eligible(D.placed(spark, sf), D.sheets(spark, sf), "TP1").select("rc14", "cell")


# Known keys with copies (line items) against done ones.
D.define("todo", """
SELECT DISTINCT rc14 FROM lineitem JOIN keyed ON k = l_orderkey WHERE l_orderkey % 3 <> 0""", "keyed")


def todo(spark, sf):
    k = D.keyed(spark, sf).select("k", "rc14")
    known = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).join(k, "k")
    return W.pending(known, k.filter(F.col("k") % 3 == 0), "rc14")


@add("jn21_pending_keys", with_sql("SELECT rc14 FROM todo", "todo"))
def _(spark, sf):
    return todo(spark, sf)


@add("wn9_worklist_parts", with_sql("""
SELECT rc14, least((rn - 1) // (n // 7), 6)::INT AS part
FROM (SELECT rc14, row_number() OVER (ORDER BY rc14) AS rn, count(*) OVER () AS n FROM todo)""", "todo"))
def _(spark, sf):
    return W.split_parts(todo(spark, sf), "rc14", 7)


@add("tk2_priority_order", with_sql("""
SELECT rc14, z.rc14 IS NOT NULL AS priority, md5(rc14 || '|s1') AS draw
FROM eligible LEFT JOIN (SELECT DISTINCT rc14 FROM hits) z USING (rc14) WHERE k % 5 <> 0""".replace(
    "z.rc14 IS NOT NULL", "(rc14 IN (SELECT rc14 FROM hits))").replace(
    " LEFT JOIN (SELECT DISTINCT rc14 FROM hits) z USING (rc14)", ""), "eligible", "hits"))
def _(spark, sf):
    c = eligible(spark, sf)
    points = D.points(spark, sf).select("k", "rc14", "x", "y")
    inside = by_place(points, "k", lambda at, key: Z.keys_in_zones(
        at, D.zones(spark, sf), key, guard="add").select(key))
    return W.priority_order(
        c.select("rc14"), points.join(inside, "k", "left_semi").select("rc14"), c.filter(F.col("k") % 5 == 0), "rc14", "s1")


D.define("capped", """
SELECT cell, rc14 FROM eligible QUALIFY row_number() OVER (PARTITION BY cell ORDER BY rc14) <= 200""", "eligible")


@add("tk4_keys_per_cell", with_sql("""
SELECT cell, rc14 FROM eligible QUALIFY row_number() OVER (PARTITION BY cell ORDER BY rc14) <= 20""", "eligible"))
def _(spark, sf):
    return W.first_per_cell(eligible(spark, sf).select("cell", "rc14"), 20)


@add("tk3_weighted_sample", with_sql("""
, w AS (SELECT c.cell, coalesce(labels, 0) AS labels FROM (SELECT DISTINCT cell FROM placed WHERE letter IS NOT NULL) c
   LEFT JOIN (SELECT cell, count(*) AS labels FROM eligible WHERE k % 9 = 0 GROUP BY cell) l ON l.cell = c.cell),
nk AS (SELECT cell, count(*) AS n FROM eligible GROUP BY cell),
d AS (SELECT unnest(range(1, 51)) AS draw),
p AS (SELECT draw, arg_min(cell, row(-ln((('0x' || substr(md5(cell || '|' || draw::VARCHAR || '|s3'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
        / (1.0::DOUBLE / ((1.0::DOUBLE + labels) * (1.0::DOUBLE + labels))), cell)) AS cell FROM d, w GROUP BY draw),
sp AS (SELECT draw, arg_min(cell, row(-ln((('0x' || substr(md5(cell || '|' || draw::VARCHAR || '|s3/spare'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / n, cell)) AS cell
  FROM d, nk GROUP BY draw),
t AS (SELECT p.draw, CASE WHEN nk.cell IS NULL THEN sp.cell ELSE p.cell END AS cell FROM p LEFT JOIN nk ON nk.cell = p.cell JOIN sp ON sp.draw = p.draw)
SELECT t.draw::INT AS draw, t.cell, arg_min(rc14, row(md5(rc14 || '|' || t.draw::VARCHAR || '|s3'), rc14)) AS rc14
FROM t JOIN capped c ON c.cell = t.cell GROUP BY t.draw, t.cell""", "placed", "eligible", "capped"))
def _(spark, sf):
    e = eligible(spark, sf)
    covered = D.placed(spark, sf).filter(F.col("letter").isNotNull()).select("cell").distinct()
    counts = e.filter(F.col("k") % 9 == 0).groupBy("cell").agg(F.count(F.lit(1)).alias("labels"))
    return W.weighted_sample(covered, counts, e.select("cell", "rc14"), 50, "s3")


@add("tk5_held_out", with_sql("""
SELECT rc14, md5(rc14 || '|s5') AS draw FROM (SELECT DISTINCT rc14 FROM keyed JOIN lineitem ON l_orderkey = k)
WHERE rc14 NOT IN (SELECT rc14 FROM keyed WHERE k % 4 = 0) ORDER BY draw, rc14 LIMIT 100""", "keyed"))
def _(spark, sf):
    k = D.keyed(spark, sf).select("k", "rc14")
    pool = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).join(k, "k")
    return W.held_out(pool, k.filter(F.col("k") % 4 == 0), "rc14", 100, "s5")


D.define("files", """
SELECT 'F' || lpad(event_id::VARCHAR, 9, '0') || CASE event_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.pdf' ELSE '.json' END AS name,
  CASE event_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'sheet' ELSE 'record' END AS kind,
  (value * CASE WHEN event_id % 4 = 0 THEN 100000 ELSE 3 END)::BIGINT AS bytes, epoch(ts)::BIGINT AS mtime, event_id % 3 = 0 AS empty
FROM events""")


def files(spark, sf):
    e = F.col("event_id")
    four = e % 4
    return table(spark, sf, "events").select(
        F.concat(F.lit("F"), F.lpad(e.cast("string"), 9, "0"),
                 F.when(four == 0, ".png").when(four == 1, ".pdf").otherwise(".json")).alias("name"),
        F.when(four == 0, "image").when(four == 1, "sheet").otherwise("record").alias("kind"),
        F.rint(F.col("value") * F.when(four == 0, 100000).otherwise(3)).cast("long").alias("bytes"),
        F.unix_seconds(F.date_trunc("second", "ts")).alias("mtime"), (e % 3 == 0).alias("empty"))


@add("wn10_retention", with_sql("""
SELECT name, coalesce(kind = 'image' AND (n >= 5000 OR b >= 3221225472) AND rn <= greatest(1, n // 5), false) AS evict,
  kind = 'sheet' AND 1706659200 - mtime > 10 * 86400 AS refresh, name LIKE '%.json' AND bytes < 50 AS drop_small,
  kind = 'record' AND empty AND 1706659200 - mtime > 86400 AS refetch
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mtime, name) AS rn, count(*) OVER (PARTITION BY kind) AS n,
        sum(bytes) OVER (PARTITION BY kind) AS b FROM files)""", "files"))
def _(spark, sf):
    return W.retention(files(spark, sf), F.lit(1706659200), 10).select(
        "name", "evict", "refresh", "drop_small", "refetch")


# Tiles: the cells of the points at two resolutions, some removed.
D.define("tiles", """
SELECT DISTINCT (floor(x / s) * s)::INT AS x1, (floor(y / s) * s)::INT AS y1, (floor(x / s) * s)::INT + s AS x2,
  (floor(y / s) * s)::INT + s AS y2, mpp, ((floor(x / s) + floor(y / s))::BIGINT % 1000 * 100 + 500)::BIGINT AS bytes
FROM points, (VALUES (400, 0.2::DOUBLE), (1000, 0.5::DOUBLE)) t(s, mpp) WHERE (floor(x / s) * 3 + floor(y / s))::BIGINT % 11 <> 0""", "points")


def tiles(spark, sf):
    p = D.points(spark, sf).withColumn("_t", F.explode(F.array(
        F.struct(F.lit(400).alias("s"), F.lit(0.2).alias("mpp")),
        F.struct(F.lit(1000).alias("s"), F.lit(0.5).alias("mpp"))))).select("x", "y", "_t.*")
    s, fx, fy = F.col("s"), F.floor(F.col("x") / F.col("s")), F.floor(F.col("y") / F.col("s"))
    x1, y1 = (fx * s).cast("int"), (fy * s).cast("int")
    return p.filter((fx * 3 + fy) % 11 != 0).select(
        x1.alias("x1"), y1.alias("y1"), (x1 + s).alias("x2"), (y1 + s).alias("y2"), "mpp",
        ((fx + fy) % 1000 * 100 + 500).alias("bytes")).distinct()


@add("jn20_tile_cover", with_sql("""
, h AS (SELECT * FROM boxes JOIN tiles ON x2 > bx0 AND x1 < bx1 AND y2 > by0 AND y1 < by1),
u AS (SELECT req, mpp, min(x1) AS ux0, min(y1) AS uy0, max(x2) AS ux1, max(y2) AS uy1, any_value(bx0) AS a, any_value(by0) AS b,
   any_value(bx1) AS c, any_value(by1) AS d FROM h GROUP BY req, mpp),
g AS (SELECT * FROM u WHERE ux0 <= a AND ux1 >= c AND uy0 <= b AND uy1 >= d QUALIFY row_number() OVER (PARTITION BY req ORDER BY mpp) = 1)
SELECT h.req, h.mpp, x1, y1, x2, y2, trunc((x1 - ux0) / h.mpp)::INT AS ox, trunc((uy1 - y2) / h.mpp)::INT AS oy,
  trunc((x2 - x1) / h.mpp)::INT AS tw, trunc((y2 - y1) / h.mpp)::INT AS th, trunc((bx0 - ux0) / h.mpp)::INT AS cx0,
  trunc((bx1 - ux0) / h.mpp)::INT AS cx1, trunc((uy1 - by1) / h.mpp)::INT AS cy0, trunc((uy1 - by0) / h.mpp)::INT AS cy1
FROM h JOIN g ON g.req = h.req AND g.mpp = h.mpp""", "boxes", "tiles"))
def _(spark, sf):
    return W.tile_cover(boxes(spark, sf), tiles(spark, sf), "req")


@add("ag13_tile_coverage", with_sql("""
SELECT mpp, count(*) AS n_tiles, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2,
  sum(bytes)::BIGINT / 1e6::DOUBLE AS size_mb FROM tiles GROUP BY mpp""", "tiles"))
def _(spark, sf):
    return W.tile_coverage(tiles(spark, sf))


D.define("artifacts", """
SELECT CASE k % 6 WHEN 0 THEN 'PLANO_' || k::VARCHAR || '_A_I.pdf' WHEN 1 THEN 'poly_' || k::VARCHAR || '.json'
  WHEN 2 THEN 'bbox_' || k::VARCHAR || '.json' WHEN 3 THEN 'dnprc_' || rc14 || '.json' WHEN 4 THEN 'wms_' || k::VARCHAR || '.png'
  ELSE 'notes_' || k::VARCHAR || '.txt' END AS name, price::BIGINT AS bytes, k FROM keyed""", "keyed")


def artifacts(spark, sf):
    k, six, txt = F.col("k"), F.col("k") % 6, F.col("k").cast("string")
    name = (F.when(six == 0, F.concat(F.lit("PLANO_"), txt, F.lit("_A_I.pdf")))
            .when(six == 1, F.concat(F.lit("poly_"), txt, F.lit(".json")))
            .when(six == 2, F.concat(F.lit("bbox_"), txt, F.lit(".json")))
            .when(six == 3, F.concat(F.lit("dnprc_"), "rc14", F.lit(".json")))
            .when(six == 4, F.concat(F.lit("wms_"), txt, F.lit(".png")))
            .otherwise(F.concat(F.lit("notes_"), txt, F.lit(".txt"))))
    return D.keyed(spark, sf).select(
        name.alias("name"), F.rint("price").cast("long").alias("bytes"), "k")


@add("ag14_inventory", with_sql("""
, a AS (SELECT *, CASE WHEN name LIKE 'PLANO%' THEN 'sheet' WHEN name LIKE 'poly%' THEN 'polygon' WHEN name LIKE 'bbox%' THEN 'bbox'
   WHEN name LIKE 'dnprc%' THEN 'units' WHEN name LIKE 'wms%' THEN 'tile' ELSE 'other' END AS kind FROM artifacts)
SELECT h.kind, n_files, size_mb, expected, present FROM (SELECT kind, count(*) AS n_files, sum(bytes)::BIGINT / 1e6::DOUBLE AS size_mb
  FROM a WHERE k % 7 <> 0 GROUP BY kind) h LEFT JOIN (SELECT kind, count(*) AS expected, count(*) FILTER (k % 7 <> 0) AS present
  FROM a WHERE kind = 'sheet' GROUP BY kind) e ON e.kind = h.kind""", "artifacts"))
def _(spark, sf):
    a = artifacts(spark, sf)
    return W.inventory(a.filter(F.col("k") % 7 != 0), a.filter(F.col("name").startswith("PLANO")))


@add("ag15_latency_profile", """
SELECT n, median, p95, max, hit_share FROM (SELECT count(*) AS n, median(value) AS median, max(value) AS max,
   avg((value < 50)::INT) AS hit_share FROM events), (SELECT value AS p95 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r,
   count(*) OVER () AS n FROM events) WHERE r = n * 95 // 100)""")
def _(spark, sf):
    return W.latency_profile(table(spark, sf, "events").select(F.col("value").alias("ms")))


@add("ag16_top_categories", with_sql("""
SELECT categoria, count(*) AS n FROM (SELECT CASE WHEN tier = 0 THEN 'AUA' || (zk % 13)::VARCHAR ELSE 'C' || (zk % 5)::VARCHAR END AS categoria FROM zones)
GROUP BY categoria ORDER BY n DESC, categoria LIMIT 10""", "zones"))
def _(spark, sf):
    zk = F.col("zk")
    z = D.zones(spark, sf).withColumn("categoria", F.when(
        F.col("tier") == 0, F.concat(F.lit("AUA"), (zk % 13).cast("string"))).otherwise(
        F.concat(F.lit("C"), (zk % 5).cast("string"))))
    return W.top_categories(z)


@add("ag18_rural_hit_rate", with_sql("""
SELECT sum(h)::BIGINT AS hits, sum(1 - h)::BIGINT AS misses, sum(h) / count(*) AS hit_share
FROM (SELECT (coalesce(exact, '') IN (SELECT sheet_name FROM rural_sheets))::INT AS h FROM rural)""", "rural", "rural_sheets"))
def _(spark, sf):
    p = L.rural_columns(D.points(spark, sf), as_struct(D.HOME))
    return W.rural_hit_rate(p, rural_sheets(spark, sf))


@add("ag19_outcome_report", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN page_id % 9 = 0 THEN 'no_link' WHEN page_id % 7 = 0 THEN 'skip' WHEN page_id % 5 = 0 THEN '404'
  WHEN page_id % 4 = 0 THEN 'error' WHEN page_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM pages) GROUP BY status""")
def _(spark, sf):
    p = F.col("page_id")
    rows = table(spark, sf, "pages").select(
        F.when(p % 9 != 0, F.col("url")).alias("link"), (p % 7 == 0).alias("cached"),
        F.when(p % 5 == 0, 404).when(p % 4 == 0, 500).otherwise(200).alias("http"),
        F.when(p % 3 == 0, F.left("html", F.lit(8))).otherwise("%PDF-1.7").alias("head"))
    status = W.landing_status(F.col("link"), F.col("cached"), F.col("http"), F.col("head"))
    return W.outcome_report(rows.withColumn("status", status))
