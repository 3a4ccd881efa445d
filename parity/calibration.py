"""Labels, recalibration, snap and match outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lindero.operators import calibration as C
from parity import derived as D
from parity.base import add, table
from parity.derived import with_sql


def latest(spark, sf):
    return C.latest_labels(D.label_events(spark, sf))


@add("wn1_latest_label", with_sql("SELECT rc, seq, action, dx, dy FROM latest", "latest"))
def _(spark, sf):
    return latest(spark, sf).select("rc", "seq", "action", "dx", "dy")


@add("wn1_latest_card_label", with_sql("""
SELECT rc, etiqueta, seq FROM label_events WHERE action = 'accept' AND etiqueta <> ''
QUALIFY row_number() OVER (PARTITION BY rc, etiqueta ORDER BY ts DESC, seq DESC) = 1""", "label_events"))
def _(spark, sf):
    return C.card_labels(D.label_events(spark, sf)).select("rc", "etiqueta", "seq")


D.define("estimates", """
SELECT l.rc, CASE WHEN p.letter IS NOT NULL AND c.k IS NOT NULL THEN p.cell || '-' || p.sub END AS key,
   cal_dx + 2 * dx AS ex, cal_dy + 2 * dy AS ey
FROM latest l LEFT JOIN coords c ON c.rc14 = substr(l.rc, 1, 14) LEFT JOIN placed p ON p.k = c.k
WHERE l.action = 'accept'""", "latest", "coords", "placed")
D.define("buckets", """
SELECT key, round_even(median(ex), 1) AS dx, round_even(median(ey), 1) AS dy, count(*) AS n,
  round_even(sx, 2) AS std_x, round_even(sy, 2) AS std_y, round_even(sqrt(sx * sx + sy * sy), 2) AS residual_px
FROM (SELECT *, CASE WHEN c > 1 THEN sqrt((c * sxx - s1 * s1) / (c * (c - 1))) ELSE 0.0 END AS sx,
             CASE WHEN c > 1 THEN sqrt((c * syy - s2 * s2) / (c * (c - 1))) ELSE 0.0 END AS sy
      FROM (SELECT *, count(*) OVER w AS c, sum((ex * ex)::DOUBLE) OVER w AS sxx, sum(ex::DOUBLE) OVER w AS s1,
              sum((ey * ey)::DOUBLE) OVER w AS syy, sum(ey::DOUBLE) OVER w AS s2
            FROM estimates WHERE key IS NOT NULL WINDOW w AS (PARTITION BY key)))
GROUP BY key, sx, sy""", "estimates")
D.define("merged", """
SELECT key, coalesce(b.dx, o.dx) AS dx, coalesce(b.dy, o.dy) AS dy,
  CASE WHEN b.dx IS NOT NULL THEN b.n ELSE o.n END AS n, CASE WHEN b.dx IS NOT NULL THEN b.std_x ELSE o.std_x END AS std_x,
  CASE WHEN b.dx IS NOT NULL THEN b.std_y ELSE o.std_y END AS std_y,
  CASE WHEN b.dx IS NOT NULL THEN b.residual_px ELSE o.residual_px END AS residual_px,
  coalesce(o.dx, 0.0) AS old_dx, coalesce(o.dy, 0.0) AS old_dy, b.dx IS NOT NULL AS updated
FROM buckets b FULL JOIN (SELECT * FROM calib WHERE level = 'quadrant') o USING (key)""", "buckets", "calib")


@add("ag5_quadrant_offsets", with_sql("SELECT * FROM buckets", "buckets"))
def _(spark, sf):
    return C.quadrant_offsets(C.label_estimates(latest(spark, sf), D.coords(spark, sf)))


def merged(spark, sf):
    old = D.calib(spark, sf).filter(F.col("level") == "quadrant")
    new = C.quadrant_offsets(C.label_estimates(latest(spark, sf), D.coords(spark, sf)))
    return C.merge_offsets(old, new)


@add("ag6_merge_calibration", with_sql("SELECT * FROM merged", "merged"))
def _(spark, sf):
    return merged(spark, sf)


@add("ag7_offset_hierarchy", with_sql("""
SELECT 'quadrant' AS level, key, dx, dy, n FROM merged
UNION ALL SELECT 'cell', regexp_extract(key, '^(.*)-[^-]*$', 1), round_even(median(dx), 1), round_even(median(dy), 1), NULL
  FROM merged GROUP BY 2
UNION ALL SELECT 'global', '', round_even(median(dx), 1), round_even(median(dy), 1), NULL FROM merged""", "merged"))
def _(spark, sf):
    return C.calibration_levels(merged(spark, sf)).select("level", "key", "dx", "dy", "n")


@add("ag7_data_lists", with_sql("""
SELECT (SELECT string_agg(DISTINCT c, ',' ORDER BY c) FROM (SELECT regexp_extract(key, '^(.*)-[^-]*$', 1) AS c FROM merged)) AS cells,
       (SELECT string_agg(key, ',' ORDER BY key) FROM merged) AS quadrants""", "merged"))
def _(spark, sf):
    lists = C.calibration_lists(C.calibration_levels(merged(spark, sf)))
    return lists.select(F.array_join("cells_with_direct_data", ",").alias("cells"),
                        F.array_join("quadrants_with_data", ",").alias("quadrants"))


@add("ag8_card_calibration", with_sql("""
SELECT etiqueta, round_even(median(cal_dx + dx), 0)::INT AS dx, round_even(median(cal_dy + dy), 0)::INT AS dy, count(*) AS n_labels
FROM label_events WHERE etiqueta <> '' GROUP BY etiqueta""", "label_events"))
def _(spark, sf):
    return C.card_calibration(D.label_events(spark, sf))


@add("ag9_label_counts", with_sql("""
SELECT action, count(*) AS n, (SELECT count(*) FROM latest) AS total,
  (SELECT count(*) FROM coords) - (SELECT count(*) FROM latest) AS pending FROM latest GROUP BY action""", "latest", "coords"))
def _(spark, sf):
    return C.label_counts(latest(spark, sf), D.coords(spark, sf))


# Snap candidates: one per line item.
D.define("snaps", """
SELECT l_orderkey AS rc, round_even(l_discount * 8 + l_tax, 3) AS score, (l_partkey % 61 - 30)::INT AS dx,
  (l_suppkey % 45 - 22)::INT AS dy, CASE l_linenumber % 4 WHEN 0 THEN 40 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 12 END AS radius,
  (l_linenumber * 1000000 + l_partkey * 50 + l_quantity::INT)::INT AS ord FROM lineitem""")


def snaps(spark, sf):
    ln = F.col("l_linenumber")
    radius = F.when(ln % 4 == 0, 40).when(ln % 4 == 1, 20).when(ln % 4 == 2, 10).otherwise(12)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("rc"),
        F.bround(F.col("l_discount") * 8 + F.col("l_tax"), 3).alias("score"),
        (F.col("l_partkey") % 61 - 30).cast("int").alias("dx"),
        (F.col("l_suppkey") % 45 - 22).cast("int").alias("dy"), radius.alias("radius"),
        (ln * 1000000 + F.col("l_partkey") * 50 + F.col("l_quantity").cast("int")).cast("int")
        .alias("ord"))


D.define("snap_choice", """
SELECT r.rc, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy, coalesce(score, 0.0) AS score
FROM (SELECT DISTINCT rc FROM snaps) r LEFT JOIN (
  SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY rc) AS top FROM snaps
    WHERE abs(dx) <= radius * 0.9::DOUBLE AND abs(dy) <= radius * 0.9::DOUBLE AND score >= 0.1::DOUBLE)
  WHERE score >= top * 0.7::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY rc ORDER BY abs(dx) + abs(dy), score DESC, ord, dx, dy) = 1) s ON s.rc = r.rc""", "snaps")


@add("wn2_snap_choice", with_sql("SELECT * FROM snap_choice", "snap_choice"))
def _(spark, sf):
    return C.choose_snap(snaps(spark, sf))


@add("prj21_snap_confident", with_sql(
    "SELECT rc, coalesce(score >= 0.3::DOUBLE, false) AS confident FROM snap_choice", "snap_choice"))
def _(spark, sf):
    return C.choose_snap(snaps(spark, sf)).select(
        "rc", C.snap_confident(F.col("score")).alias("confident"))


# Primary snaps per order, neighbour candidates from its first line numbers.
D.define("edge_fold", """
WITH RECURSIVE n AS (
  SELECT rc, row_number() OVER (PARTITION BY rc ORDER BY ord)::INT AS i, 'N' || ord::VARCHAR AS sheet, score
  FROM (SELECT rc, ord, max(score) AS score FROM (SELECT rc, (ord // 1000000)::INT AS ord, score FROM snaps) WHERE ord <= 4 GROUP BY rc, ord)),
p AS (SELECT DISTINCT rc, 'P' || (rc % 7)::VARCHAR AS sheet, (rc % 40) / 100.0::DOUBLE AS score FROM snaps),
f AS (SELECT rc, 0 AS i, sheet, score, NULL::VARCHAR AS from_sheet, NULL::DOUBLE AS from_score, score AS first FROM p
  UNION ALL SELECT f.rc, n.i, CASE WHEN n.score > f.score + 0.05::DOUBLE THEN n.sheet ELSE f.sheet END,
    CASE WHEN n.score > f.score + 0.05::DOUBLE THEN n.score ELSE f.score END,
    CASE WHEN n.score > f.score + 0.05::DOUBLE THEN f.sheet ELSE f.from_sheet END,
    CASE WHEN n.score > f.score + 0.05::DOUBLE THEN f.score ELSE f.from_score END, f.first
  FROM f JOIN n ON n.rc = f.rc AND n.i = f.i + 1 WHERE f.first < 0.25::DOUBLE)
SELECT rc, sheet AS sheet_name, score AS snap_score, from_sheet, round_even(from_score, 3) AS from_score, i AS n_tried
FROM f QUALIFY row_number() OVER (PARTITION BY rc ORDER BY i DESC) = 1""", "snaps")


@add("wn3_edge_override", with_sql("SELECT * FROM edge_fold", "edge_fold"))
def _(spark, sf):
    s = snaps(spark, sf)
    side = F.floor(F.col("ord") / 1000000).cast("int")
    neighbours = s.select("rc", side.alias("ord"), "score").filter("ord <= 4").groupBy(
        "rc", "ord").agg(F.max("score").alias("n_score")).select(
        "rc", "ord", F.concat(F.lit("N"), F.col("ord").cast("string")).alias("n_sheet"), "n_score")
    primary = s.select("rc").distinct().select(
        "rc", F.concat(F.lit("P"), (F.col("rc") % 7).cast("string")).alias("sheet_name"),
        ((F.col("rc") % 40) / F.lit(100.0)).alias("snap_score"))
    return C.edge_override(primary, neighbours).select(
        "rc", "sheet_name", "snap_score", "from_sheet", "from_score",
        F.size("tried").alias("n_tried"))


D.define("matches", """
SELECT l_orderkey AS rc, l_linenumber AS ln, l_partkey AS pk, (l_quantity * 20)::INT AS matches,
  (l_quantity * (l_partkey % 21))::INT AS inliers, (l_suppkey * 7 % 400 - 200)::INT AS raw_dx,
  (l_partkey % 330 - 165)::INT AS raw_dy, l_partkey % 17 <> 0 AS has_model FROM lineitem""")
D.define("gated", """
SELECT *, CASE WHEN matches < 200 THEN 'fb_few_matches' WHEN NOT has_model THEN 'fb_no_homog'
   WHEN inliers / matches < 0.4::DOUBLE THEN 'fb_low_ratio' WHEN abs(raw_dx) > 150 OR abs(raw_dy) > 150 THEN 'fb_big_offset'
   ELSE 'applied' END AS outcome FROM matches""", "matches")


def matches(spark, sf, lines=None):
    source = lines if lines is not None else table(spark, sf, "lineitem")
    return source.select(
        F.col("l_orderkey").alias("rc"), F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"), (F.col("l_quantity") * 20).cast("int").alias("matches"),
        (F.col("l_quantity") * (F.col("l_partkey") % 21)).cast("int").alias("inliers"),
        (F.col("l_suppkey") * 7 % 400 - 200).cast("int").alias("raw_dx"),
        (F.col("l_partkey") % 330 - 165).cast("int").alias("raw_dy"),
        (F.col("l_partkey") % 17 != 0).alias("has_model"))


@add("sf16_refinement_gates", with_sql("""
SELECT rc, ln, pk, matches, outcome, outcome = 'applied' AS applied,
  CASE outcome WHEN 'fb_few_matches' THEN 'matches<200' WHEN 'fb_no_homog' THEN 'no_homography'
     WHEN 'fb_low_ratio' THEN 'ratio<0.4' WHEN 'fb_big_offset' THEN 'offset>150' END AS reason,
  CASE WHEN outcome = 'applied' THEN raw_dx * 2 END AS dx_native, CASE WHEN outcome = 'applied' THEN raw_dy * 2 END AS dy_native,
  CASE WHEN outcome NOT IN ('fb_few_matches', 'fb_no_homog') THEN round_even(inliers / matches, 2) END AS inlier_ratio
FROM gated""", "gated"))
def _(spark, sf):
    return C.gate_matches(matches(spark, sf)).select(
        "rc", "ln", "pk", "matches", "outcome", "applied", "reason", "dx_native", "dy_native",
        "inlier_ratio")


@add("ag17_match_funnel", with_sql("""
SELECT outcome, count(*) AS n, count(*) / (SELECT count(*) FROM gated) AS share FROM gated GROUP BY outcome""", "gated"))
def _(spark, sf):
    return C.match_funnel(matches(spark, sf))


# Verdicts on candidates: one candidate per order, a verdict for two thirds of them.
D.define("verdicts", """
SELECT k AS idx, CASE k % 7 WHEN 0 THEN 'skip' WHEN 1 THEN 'bad' WHEN 2 THEN 'bad' ELSE 'ok' END AS verdict,
  CASE WHEN k % 7 = 1 THEN (k % 900)::DOUBLE END AS cx, CASE WHEN k % 7 = 1 THEN (k % 700)::DOUBLE END AS cy
FROM keyed WHERE k % 3 <> 0""", "keyed")


def verdicts(spark, sf):
    k = F.col("k")
    seven = k % 7
    return D.keyed(spark, sf).filter(k % 3 != 0).select(
        k.alias("idx"), F.when(seven == 0, "skip").when(seven.isin(1, 2), "bad").otherwise("ok")
        .alias("verdict"), F.when(seven == 1, (k % 900).cast("double")).alias("cx"),
        F.when(seven == 1, (k % 700).cast("double")).alias("cy"))


@add("ag10_verdict_counts", with_sql("""
SELECT (SELECT count(*) FROM keyed) AS total, count(*) AS done, count(*) FILTER (verdict = 'ok') AS ok,
  count(*) FILTER (verdict = 'bad') AS bad, count(*) FILTER (verdict = 'bad' AND cx IS NOT NULL) AS bad_with_click,
  count(*) FILTER (verdict = 'skip') AS skip FROM verdicts""", "keyed", "verdicts"))
def _(spark, sf):
    return C.verdict_counts(verdicts(spark, sf), D.keyed(spark, sf))


@add("ag11_cell_coverage", with_sql("""
, q AS (SELECT DISTINCT sheet_name, split_part(sheet_name, '_', 2) || '-' || split_part(sheet_name, '_', 3) AS cell FROM sheets),
m AS (SELECT p.cell, count(*) AS labels FROM placed p WHERE p.letter IS NOT NULL AND k % 40 = 0 AND k % 3 <> 0 GROUP BY p.cell),
c AS (SELECT q.cell, count(*) AS nq, coalesce(any_value(labels), 0) AS labels FROM q LEFT JOIN m ON m.cell = q.cell GROUP BY q.cell)
SELECT cell, labels, CASE WHEN labels = 0 THEN 'vacía' WHEN labels <= 2 THEN 'escasa' ELSE 'ok' END AS priority,
  count(*) OVER () AS n_covered, (sum(nq) OVER ())::BIGINT AS n_quadrants,
  count(*) FILTER (labels = 0) OVER () AS n_unlabeled, count(*) FILTER (labels BETWEEN 1 AND 2) OVER () AS n_sparse,
  count(*) FILTER (labels >= 3) OVER () AS n_ok FROM c""", "sheets", "placed"))
def _(spark, sf):
    k = F.col("k")
    manual = D.placed(spark, sf).filter(F.col("letter").isNotNull() & (k % 20 == 0)).select(
        "sheet_name", F.when(k % 40 == 0, "manual").otherwise("snap_ok").alias("action"),
        (k % 3 != 0).alias("has_truth"))
    return C.cell_coverage(D.sheets(spark, sf), manual)
