"""Offset calibration from alignment labels, and the reading of a calibration.

A calibration is one long table: level (`quadrant`, `cell`, `global`), key, dx, dy, and for
quadrants the label statistics. `direct` marks cells that have quadrant data of their own; a cell
row with `direct` false was interpolated. A calibration of several municipalities has `id_ine` as
well, and is then read and merged by municipality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions import grid
from lindero.operators.skew import last_per_key
from lindero.registry import DEFAULT_REGISTRY, Municipality, as_struct, first_containing, \
    lookup_struct, town_keys

# Displayed pixels are half of native ones.
DISPLAY_TO_NATIVE = 2
# Assumed residual (px) and reliability per source without statistics of its own.
FALLBACKS = {
    "cell": (30.0, "ok"), "cell_interpolated": (60.0, "low"), "global": (80.0, "unknown"),
}


def latest_labels(labels: DataFrame, keys: tuple[str, ...] = ("rc",)) -> DataFrame:
    """The last label of each key by time; `seq` decides between equal times."""
    return last_per_key(labels, keys, [F.col("ts"), F.col("seq")])


def card_labels(labels: DataFrame) -> DataFrame:
    """Labels for a record card: accepted ones that name a zone, the last per (rc, zone)."""
    named = labels.filter(
        (F.col("action") == "accept") & (F.coalesce(F.col("etiqueta"), F.lit("")) != "")
    )
    return latest_labels(named, ("rc", "etiqueta"))


def medians(values: DataFrame, key: str | Sequence[str], columns: list[str]) -> DataFrame:
    """Exact median of several columns per key, with `n`, and sample deviation `std_<column>`.

    Equal values are counted before they are gathered, so a key with very many labels contributes
    as many entries as it has distinct pixel values, which the sheet size bounds.
    """
    keys = [key] if isinstance(key, str) else list(key)
    long = values.select(
        *keys, F.explode(F.array(*[
            F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in columns
        ])).alias("_e"),
    ).select(*keys, "_e.axis", "_e.v")
    counted = long.groupBy(*keys, "axis", "v").agg(F.count(F.lit(1)).alias("w"))
    v, w = F.col("v"), F.col("w")
    aggs = []
    for c in columns:
        here = F.col("axis") == c
        n = F.sum(F.when(here, w))
        plain = F.sum(F.when(here, v * w))
        square = F.sum(F.when(here, v * v * w))
        aggs += [
            F.percentile(F.when(here, v), F.lit(0.5), w).alias(c),
            n.alias(f"_n_{c}"),
            # Whole pixel values keep the numerator exact.
            F.when(n > 1, F.sqrt(F.greatest(n * square - plain * plain, F.lit(0.0))
                                 / (n * (n - 1))))
            .otherwise(F.lit(0.0)).alias(f"std_{c}"),
        ]
    out = counted.groupBy(*keys).agg(*aggs).withColumn("n", F.col(f"_n_{columns[0]}"))
    return out.drop(*[f"_n_{c}" for c in columns])


Towns = Municipality | Sequence[Municipality]


def label_estimates(labels: DataFrame, coords: DataFrame,
                    entry: Towns = DEFAULT_REGISTRY[0]) -> DataFrame:
    """Accepted labels with their quadrant `key` (null = skipped) and offset estimate `ex`, `ey`.

    The estimate is absolute: offset in force plus the drag in native pixels. Labels without
    coordinates or outside the grid rows are skipped but stay visible. With several municipalities
    each label belongs to the first whose extent holds it, which `id_ine` then names.
    """
    accepted = labels.filter(F.col("action") == "accept").withColumn(
        "rc14", F.left(F.col("rc"), F.lit(14)))
    placed = accepted.join(coords.select("rc14", "x", "y"), "rc14", "left")
    town = []
    if isinstance(entry, Municipality):
        m = as_struct(entry)
    else:
        placed = placed.withColumn("id_ine", first_containing(F.col("x"), F.col("y"), entry))
        m, town = lookup_struct(F.col("id_ine"), entry), ["id_ine"]
    col, row = grid.col_index(F.col("x"), m), grid.row_index(F.col("y"), m)
    corner = grid.compass(
        grid.x_within(F.col("x"), col, m), grid.y_within(F.col("y"), row, m), m)
    key = F.concat(
        grid.cell_name(col, grid.row_letter(row)), F.lit("-"), grid.quadrant(corner))

    def whole(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return placed.select(
        *town, "rc", F.when(grid.row_valid(row), key).alias("key"),
        (whole("cal_dx") + whole("dx") * DISPLAY_TO_NATIVE).alias("ex"),
        (whole("cal_dy") + whole("dy") * DISPLAY_TO_NATIVE).alias("ey"),
    )


def quadrant_offsets(estimates: DataFrame) -> DataFrame:
    """Median offset and spread per quadrant."""
    town = town_keys(estimates)
    m = medians(estimates.filter(F.col("key").isNotNull()), [*town, "key"], ["ex", "ey"])
    sx, sy = F.col("std_ex"), F.col("std_ey")
    return m.select(
        *town, "key", F.bround("ex", 1).alias("dx"), F.bround("ey", 1).alias("dy"), "n",
        F.bround(sx, 2).alias("std_x"), F.bround(sy, 2).alias("std_y"),
        F.bround(F.sqrt(sx * sx + sy * sy), 2).alias("residual_px"),
    )


def merge_offsets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Quadrants of both calibrations; new figures win, untouched quadrants keep theirs.

    `old_dx`, `old_dy` report what was in force (0 when nothing was).
    """
    names = ("dx", "dy", "n", "std_x", "std_y", "residual_px")
    keys = [*town_keys(old, new), "key"]
    a = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in names])
    b = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in names])
    fresh = F.col("n_dx").isNotNull()
    return a.join(b, keys, "full_outer").select(
        *keys,
        *[F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in names],
        F.coalesce("o_dx", F.lit(0.0)).alias("old_dx"),
        F.coalesce("o_dy", F.lit(0.0)).alias("old_dy"),
        fresh.alias("updated"),
    )


def cell_of(key: Column) -> Column:
    """`15-K-II` -> `15-K`."""
    return F.regexp_extract(key, r"^(.*)-[^-]*$", 1)


def calibration_levels(quadrants: DataFrame) -> DataFrame:
    """The long calibration table: quadrants, cells (median of their quadrants' offsets) and the
    global offset (median of all quadrant offsets, not of the labels), one per municipality."""
    none = F.lit(None)
    town = town_keys(quadrants)
    level_q = quadrants.select(
        *town, F.lit("quadrant").alias("level"), "key", "dx", "dy", F.col("n").cast("long").alias("n"),
        "std_x", "std_y", "residual_px", F.lit(True).alias("direct"),
    )

    def upper(rows: DataFrame, level: str) -> DataFrame:
        m = medians(rows, [*town, "key"], ["dx", "dy"])
        return m.select(
            *town, F.lit(level).alias("level"), "key", F.bround("dx", 1).alias("dx"),
            F.bround("dy", 1).alias("dy"), none.cast("long").alias("n"),
            none.cast("double").alias("std_x"), none.cast("double").alias("std_y"),
            none.cast("double").alias("residual_px"), F.lit(True).alias("direct"),
        )

    cells = upper(quadrants.select(*town, cell_of(F.col("key")).alias("key"), "dx", "dy"), "cell")
    # One row per quadrant goes in here: their number is bounded by the grid.
    everywhere = upper(quadrants.select(*town, F.lit("").alias("key"), "dx", "dy"), "global")
    return level_q.unionByName(cells).unionByName(everywhere)


def calibration_lists(calibration: DataFrame) -> DataFrame:
    """One row: sorted cells with direct data and sorted quadrants with data."""
    def of(level: str) -> Column:
        hit = (F.col("level") == level) & F.col("direct")
        return F.sort_array(F.collect_set(F.when(hit, F.col("key"))))
    return calibration.agg(
        of("cell").alias("cells_with_direct_data"), of("quadrant").alias("quadrants_with_data"))


def recalibrate(labels: DataFrame, coords: DataFrame, old: DataFrame | None = None,
                entry: Towns = DEFAULT_REGISTRY[0]) -> DataFrame:
    """Labels -> new calibration table. Absolute, so running it twice changes nothing."""
    new = quadrant_offsets(label_estimates(labels, coords, entry))
    if old is not None:
        new = merge_offsets(old.filter(F.col("level") == "quadrant"), new)
    return calibration_levels(new)


def card_calibration(labels: DataFrame) -> DataFrame:
    """Whole-pixel offset per zone from record card labels: median of offset in force plus drag."""
    def whole(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))
    est = labels.filter(F.coalesce(F.col("etiqueta"), F.lit("")) != "").select(
        "etiqueta", (whole("cal_dx") + whole("dx")).alias("ex"),
        (whole("cal_dy") + whole("dy")).alias("ey"),
    )
    return medians(est, "etiqueta", ["ex", "ey"]).select(
        "etiqueta", F.bround("ex", 0).cast("int").alias("dx"),
        F.bround("ey", 0).cast("int").alias("dy"), F.col("n").alias("n_labels"),
    )


# ---- reading a calibration --------------------------------------------------------------------


def _level(calibration: DataFrame, town: list[str], level: str, key: str,
           **columns: str) -> DataFrame:
    return calibration.filter(F.col("level") == level).select(
        *town, F.col("key").alias(key), *[F.col(src).alias(out) for out, src in columns.items()])


def attach_offsets(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """Adds whole-pixel `cal_dx`, `cal_dy`: of the quadrant, else the cell, else global, else 0.

    Needs `cell` and `sub`, and `id_ine` for a calibration of several municipalities. The global
    row of a single one is a scalar, so no cross join is planned.
    """
    town = town_keys(rows, calibration)
    q = _level(calibration, town, "quadrant", "_q", _qx="dx", _qy="dy")
    c = _level(calibration, town, "cell", "_c", _cx="dx", _cy="dy")
    overall = calibration.filter(F.col("level") == "global").groupBy(*town).agg(
        F.first(F.struct("dx", "dy"), ignorenulls=True).alias("_g"))
    out = (
        rows.withColumn("_q", F.concat_ws("-", "cell", "sub")).join(q, [*town, "_q"], "left")
        .withColumn("_c", F.col("cell")).join(c, [*town, "_c"], "left")
    )
    out = out.join(overall, town, "left") if town else out.withColumn("_g", overall.scalar())

    def pick(axis: str) -> Column:
        value = F.when(F.col("_qx").isNotNull(), F.col(f"_q{axis}")) \
            .when(F.col("_cx").isNotNull(), F.col(f"_c{axis}")) \
            .otherwise(F.coalesce(F.col("_g")[f"d{axis}"], F.lit(0.0)))
        return F.bround(value, 0).cast("int")

    return out.withColumn("cal_dx", pick("x")).withColumn("cal_dy", pick("y")).drop(
        "_q", "_c", "_g", "_qx", "_qy", "_cx", "_cy")


def attach_quality(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """Adds source, n_labels, residual_px, residual_m and reliability of the offset in force."""
    town = town_keys(rows, calibration)
    q = calibration.filter((F.col("level") == "quadrant") & F.col("n").isNotNull()).select(
        *town, F.col("key").alias("_q"), F.col("n").alias("_n"), F.col("residual_px").alias("_res"))
    c = _level(calibration, town, "cell", "_c", _direct="direct")
    out = (
        rows.withColumn("_q", F.concat_ws("-", "cell", "sub")).join(q, [*town, "_q"], "left")
        .withColumn("_c", F.col("cell")).join(c, [*town, "_c"], "left")
    )
    n, res = F.col("_n"), F.col("_res")
    source = (
        F.when(n.isNotNull(), F.lit("quadrant"))
        .when(F.col("_direct"), F.lit("cell"))
        .when(~F.col("_direct"), F.lit("cell_interpolated"))
        .otherwise(F.lit("global"))
    )
    out = out.withColumn("source", source)
    own = (
        F.when((n >= 3) & (res < 25), F.lit("high"))
        .when((n >= 2) & (res < 50), F.lit("ok"))
        .otherwise(F.lit("low"))
    )
    px = F.when(F.col("source") == "quadrant", res)
    rel = F.when(F.col("source") == "quadrant", own)
    for name, (assumed, word) in FALLBACKS.items():
        hit = F.col("source") == name
        px, rel = px.when(hit, F.lit(assumed)), rel.when(hit, F.lit(word))
    return (
        out.withColumn("n_labels", F.coalesce(n, F.lit(0)).cast("long"))
        .withColumn("residual_px", px)
        .withColumn("residual_m", F.bround(grid.px_to_m(px), 2))
        .withColumn("reliability", rel)
        .drop("_q", "_c", "_n", "_res", "_direct")
    )


def quality_warnings() -> Column:
    """Texts about a weak offset, as an array; reads the columns of `attach_quality`."""
    source, n, metres = F.col("source"), F.col("n_labels"), F.col("residual_m")
    rel, m_text = F.col("reliability"), F.col("residual_m").cast("string")
    # Wording of the three messages.
    weak = F.concat(
        F.lit("Calibración débil ("), source, F.lit(", n="), n.cast("string"),
        F.lit("): residual esperable ±"), m_text, F.lit(" m"))
    missing = F.concat(
        F.lit("Sin calibración local — usando bias global: residual esperable >"), m_text,
        F.lit(" m"))
    wide = F.concat(
        F.lit("Bucket con varianza alta (σ ±"), m_text, F.lit(" m): posible offset residual"))
    return (
        F.when(rel == "low", F.array(weak))
        .when(rel == "unknown", F.array(missing))
        .when(metres > 2, F.array(wide))
        .otherwise(F.array().cast("array<string>"))
    )


# ---- snap and match outcomes -------------------------------------------------------------------

# Gates of the snap choice, the edge override and the refinement.
SNAP_REACH, SNAP_MIN, SNAP_RIVAL, SNAP_CONFIDENT = 0.9, 0.10, 0.7, 0.30
EDGE_WEAK, EDGE_GAIN = 0.25, 0.05
MIN_MATCHES, MIN_INLIER_RATIO, MAX_OFFSET = 200, 0.4, 150


def choose_snap(candidates: DataFrame) -> DataFrame:
    """One shift per key: among candidates scoring 70 % of the best, the smallest one.

    candidates(rc, score, dx, dy, radius, ord). Far or weak candidates are dropped; a key left with
    none gets (0, 0, 0.0). For each size of shift only the best candidate can win, so each key is
    first reduced to one entry per size (at most twice the radius in pixels), before the shuffle.
    """
    score, dx, dy = F.col("score"), F.col("dx"), F.col("dy")
    reach = F.col("radius") * F.lit(SNAP_REACH)
    usable = (F.abs(dx) <= reach) & (F.abs(dy) <= reach) & (score >= SNAP_MIN)
    size = F.when(usable, F.abs(dx) + F.abs(dy))
    per_size = candidates.withColumn("_size", size).groupBy("rc", "_size").agg(
        F.min(F.struct((-score).alias("neg"), F.col("ord"), dx, dy)).alias("_b"))
    entry = F.when(F.col("_size").isNotNull(), F.struct(
        F.col("_size").alias("size"), F.col("_b.neg").alias("neg"), F.col("_b.ord").alias("ord"),
        F.col("_b.dx").alias("dx"), F.col("_b.dy").alias("dy")))
    gathered = per_size.groupBy("rc").agg(
        F.collect_list(entry).alias("_all"),
        F.max(F.when(F.col("_size").isNotNull(), -F.col("_b.neg"))).alias("_top"))
    limit = F.col("_top") * F.lit(SNAP_RIVAL)
    win = F.array_min(F.filter(F.col("_all"), lambda e: -e["neg"] >= limit))
    return gathered.withColumn("_w", win).select(
        "rc", F.coalesce(F.col("_w.dx"), F.lit(0)).alias("dx"),
        F.coalesce(F.col("_w.dy"), F.lit(0)).alias("dy"),
        F.coalesce(-F.col("_w.neg"), F.lit(0.0)).alias("score"))


def edge_override(primary: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Moves a key to a neighbour sheet when its own snap is weak.

    primary(rc, sheet_name, snap_score, dx, dy); neighbours(rc, ord, n_sheet, n_score, n_dx, n_dy), at
    most four per key (`edge_neighbours`). Walked in order: each neighbour replaces the current
    choice when it scores clearly better, so the outcome may differ from the plain maximum. The shift
    is that of the sheet in force; shifts may be left out on either side and are null then.
    """
    def shift(rows: DataFrame, name: str) -> Column:
        return (F.col(name) if name in rows.columns else F.lit(None)).cast("int")

    tried = neighbours.groupBy("rc").agg(F.sort_array(F.collect_list(F.struct(
        "ord", "n_sheet", "n_score", shift(neighbours, "n_dx").alias("n_dx"),
        shift(neighbours, "n_dy").alias("n_dy")))).alias("_t"))
    joined = primary.withColumns({n: shift(primary, n) for n in ("dx", "dy")}).join(
        tried, "rc", "left")
    none = F.filter("_t", lambda t: F.lit(False))
    weak = F.col("snap_score") < EDGE_WEAK
    empty = F.lit(None)
    start = F.struct(
        F.col("sheet_name").alias("sheet"), F.col("snap_score").alias("score"), "dx", "dy",
        empty.cast("string").alias("from_sheet"), empty.cast("double").alias("from_score"))

    def step(cur: Column, t: Column) -> Column:
        better = t["n_score"] > cur["score"] + EDGE_GAIN
        moved = F.struct(
            t["n_sheet"].alias("sheet"), t["n_score"].alias("score"), t["n_dx"].alias("dx"),
            t["n_dy"].alias("dy"), cur["sheet"].alias("from_sheet"),
            cur["score"].alias("from_score"))
        return F.when(better, moved).otherwise(cur)

    # A key without neighbours has walked nowhere.
    known = F.coalesce("_t", F.array().cast(tried.schema["_t"].dataType))
    done = joined.withColumn("_t", known).withColumn(
        "_steps", F.when(weak, F.col("_t")).otherwise(none)).withColumn(
        "_f", F.aggregate("_steps", start, step))
    f = F.col("_f")
    return done.select(
        "rc", f["sheet"].alias("sheet_name"), f["score"].alias("snap_score"),
        f["dx"].alias("dx"), f["dy"].alias("dy"),
        f["from_sheet"].alias("from_sheet"), F.bround(f["from_score"], 3).alias("from_score"),
        F.when(f["from_sheet"].isNotNull(), F.bround(f["score"], 3)).alias("to_score"),
        F.transform("_steps", lambda t: F.struct(
            t["n_sheet"].alias("sheet"), F.bround(t["n_score"], 3).alias("score"))).alias("tried"),
    )


def snap_confident(score: Column) -> Column:
    return F.coalesce(score >= SNAP_CONFIDENT, F.lit(False))


def match_outcome() -> Column:
    """struct(outcome, reason, applied) of a matcher record by its gates, in order."""
    few = F.col("matches") < MIN_MATCHES
    ratio = F.col("inliers") / F.col("matches")
    far = (F.abs(F.col("raw_dx")) > MAX_OFFSET) | (F.abs(F.col("raw_dy")) > MAX_OFFSET)

    def as_outcome(name: str, reason: str | None) -> Column:
        return F.struct(F.lit(name).alias("outcome"),
                        F.lit(reason).cast("string").alias("reason"))

    # Names of the outcomes and texts of the reasons.
    return (
        F.when(few, as_outcome("fb_few_matches", f"matches<{MIN_MATCHES}"))
        .when(~F.col("has_model"), as_outcome("fb_no_homog", "no_homography"))
        .when(ratio < MIN_INLIER_RATIO, as_outcome("fb_low_ratio", f"ratio<{MIN_INLIER_RATIO}"))
        .when(far, as_outcome("fb_big_offset", f"offset>{MAX_OFFSET}"))
        .otherwise(as_outcome("applied", None))
    )


def gate_matches(matches: DataFrame) -> DataFrame:
    """Adds outcome, reason, applied, inlier_ratio and the native shift of applied records."""
    out = matches.withColumn("_o", match_outcome())
    applied = F.col("_o.outcome") == "applied"
    past = ~F.col("_o.outcome").isin("fb_few_matches", "fb_no_homog")
    return out.select(
        *matches.columns, F.col("_o.outcome").alias("outcome"), F.col("_o.reason").alias("reason"),
        applied.alias("applied"),
        F.when(past, F.bround(F.col("inliers") / F.col("matches"), 2)).alias("inlier_ratio"),
        F.when(applied, F.col("raw_dx") * 2).alias("dx_native"),
        F.when(applied, F.col("raw_dy") * 2).alias("dy_native"),
    )


def match_funnel(matches: DataFrame) -> DataFrame:
    """Records and share per outcome."""
    per = gate_matches(matches).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("t")).scalar()
    return per.withColumn("share", F.col("n") / total)


# ---- label reports -----------------------------------------------------------------------------


def label_counts(labels: DataFrame, coords: DataFrame) -> DataFrame:
    """One row per action: its labels, all labels, and keys with coordinates still unlabelled."""
    per = labels.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("t")).scalar()
    cached = coords.agg(F.count(F.lit(1)).alias("c")).scalar()
    return per.withColumn("total", total).withColumn("pending", cached - total)


def verdict_counts(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: total, done, ok, bad, bad_with_click, skip. verdicts(idx, verdict, cx, cy)."""
    v = F.col("verdict")
    click = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    total = candidates.agg(F.count(F.lit(1)).alias("c")).scalar()
    return verdicts.agg(
        F.count(F.lit(1)).alias("done"), F.count_if(v == "ok").alias("ok"),
        F.count_if(v == "bad").alias("bad"),
        F.count_if((v == "bad") & click).alias("bad_with_click"),
        F.count_if(v == "skip").alias("skip"),
    ).withColumn("total", total)


def cell_coverage(sheets: DataFrame, manual: DataFrame) -> DataFrame:
    """Usable manual labels of every covered cell. manual(sheet_name, action, has_truth).

    `priority` is vacía (none), escasa (one or two) or ok; the totals repeat on every row.
    """
    s = grid.split_sheet(F.col("sheet_name"))
    quads = sheets.select(s["col"].alias("c"), s["letter"].alias("l"), s["sub"].alias("s")) \
        .filter(F.col("c").isNotNull()).distinct()
    cells = quads.groupBy(F.concat_ws("-", "c", "l").alias("cell")).agg(
        F.count(F.lit(1)).alias("n_quadrants"))
    parts = F.split(F.regexp_replace(F.regexp_replace("sheet_name", "PLANO_", ""), r"\.pdf", ""),
                    "_")
    counts = manual.filter((F.col("action") == "manual") & F.col("has_truth")) \
        .filter(F.size(parts) >= 2) \
        .groupBy(F.concat_ws("-", parts[0], parts[1]).alias("cell")) \
        .agg(F.count(F.lit(1)).alias("labels"))
    out = cells.join(counts, "cell", "left").withColumn(
        "labels", F.coalesce("labels", F.lit(0)).cast("long"))
    n = F.col("labels")
    # Names of the three classes.
    out = out.withColumn("priority", F.when(n == 0, F.lit("vacía"))
                         .when(n <= 2, F.lit("escasa")).otherwise(F.lit("ok")))
    totals = out.agg(F.struct(
        F.count(F.lit(1)).alias("n_covered"), F.sum("n_quadrants").alias("n_quadrants"),
        F.count_if(n == 0).alias("n_unlabeled"), F.count_if((n > 0) & (n <= 2)).alias("n_sparse"),
        F.count_if(n >= 3).alias("n_ok"),
    ).alias("t")).scalar()
    return out.drop("n_quadrants").withColumn("_t", totals).select(
        "cell", "labels", "priority", F.col("_t.n_covered").alias("n_covered"),
        F.col("_t.n_quadrants").alias("n_quadrants"),
        F.col("_t.n_unlabeled").alias("n_unlabeled"), F.col("_t.n_sparse").alias("n_sparse"),
        F.col("_t.n_ok").alias("n_ok"))
