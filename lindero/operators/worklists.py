"""Worklists, sampling, retention, tile plans and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.functions import keys
from lindero.operators.skew import running_total
from lindero.operators.spatial import box_join
from lindero.registry import town_keys
from lindero.session import settle

# ---- covering grids -------------------------------------------------------------------------

# Side of a parcel chunk in metres and of a map tile in pixels.
CHUNK_M, TILE_PX = 500.0, 2000


def covering_grid(boxes: DataFrame, box: str, step: Column) -> DataFrame:
    """The pieces of side `step` that cover each box; the last row and column are clipped."""
    b = F.col(box)
    out = boxes.withColumn("_step", step.cast("double"))
    s = F.col("_step")

    def starts(lo: Column, hi: Column) -> Column:
        n = F.ceil((hi - lo) / s).cast("int")
        return F.when(n > 0, F.sequence(F.lit(0), n - 1))

    out = out.withColumn("_i", F.explode(starts(b["x0"], b["x1"]))) \
        .withColumn("_j", F.explode(starts(b["y0"], b["y1"])))
    x, y = b["x0"] + F.col("_i") * s, b["y0"] + F.col("_j") * s
    return out.select(
        *boxes.columns, x.alias("x1"), y.alias("y1"), F.least(x + s, b["x1"]).alias("x2"),
        F.least(y + s, b["y1"]).alias("y2"))


def tile_grid(boxes: DataFrame, box: str, mpp: Column) -> DataFrame:
    return covering_grid(boxes, box, mpp * TILE_PX)


# ---- pending keys ---------------------------------------------------------------------------


def pending(all_keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Known keys that are not done, each once."""
    return all_keys.select(key).distinct().join(done.select(key), key, "left_anti")


def split_parts(worklist: DataFrame, key: str, parts: int) -> DataFrame:
    """Adds `part`: the sorted keys in contiguous runs of equal length, the rest to the last."""
    n = worklist.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = running_total(worklist, [key]).withColumn("_size", F.floor(n / F.lit(parts)))
    part = F.when(F.col("_size") > 0, F.least(F.floor(F.col("before") / F.col("_size")),
                                              F.lit(parts - 1))).otherwise(F.lit(parts - 1))
    return ranked.withColumn("part", part.cast("int")).drop("before", "_size")


# Fixed value: the unit suffix that makes a parcel key a full key.
UNIT_SUFFIX = "0001AA"


def eligible(points: DataFrame, sheets: DataFrame, zone_mark: str | None = None) -> DataFrame:
    """Points with a valid key, a valid grid row and a sheet for their quadrant.

    Needs rc14, row and sheet_name (`grid_columns`), and id_ine where the sheets are those of several
    municipalities. With `zone_mark`, keys must have it at characters 8 to 10.
    """
    rc = F.col("rc14")
    out = points.filter(F.col("row").between(0, 24))
    if zone_mark:
        out = out.filter((F.length(rc) == 14) & (F.substring(rc, 8, 3) == zone_mark))
    else:
        out = out.filter(keys.key_error(F.concat(rc, F.lit(UNIT_SUFFIX))).isNull())
    own = [*town_keys(points, sheets), "sheet_name"]
    return out.join(sheets.select(*own), own, "left_semi")


# ---- sampling -------------------------------------------------------------------------------


def draw(seed: str, *parts: Column) -> Column:
    """Reproducible pseudo-random text of a row, the same on any engine."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed)))


def unit_draw(seed: str, *parts: Column) -> Column:
    """Reproducible number in (0, 1)."""
    head = F.conv(F.substring(draw(seed, *parts), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / F.lit(4294967296.0)


def priority_order(candidates: DataFrame, in_zone: DataFrame, done: DataFrame, key: str,
                   seed: str) -> DataFrame:
    """Candidates not done: those in zones first, random within each group."""
    marked = in_zone.select(F.col(key)).distinct().withColumn("priority", F.lit(True))
    out = candidates.join(done.select(key), key, "left_anti").join(marked, key, "left")
    out = out.withColumn("priority", F.coalesce("priority", F.lit(False)))
    return out.withColumn("draw", draw(seed, F.col(key))).orderBy(
        F.col("priority").desc(), "draw", key)


def first_per_cell(points: DataFrame, limit: int = 200) -> DataFrame:
    """At most `limit` keys per cell, by key. The limit is applied before the shuffle too."""
    order = Window.partitionBy("cell").orderBy("rc14")
    return points.withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= limit).drop("_n")


def _weighted_pick(cells: DataFrame, draws: int, seed: str, weight: Column) -> DataFrame:
    """One cell per draw with probability proportional to its weight (exponential keys)."""
    spread = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    at = -F.log(unit_draw(seed, F.col("cell"), F.col("draw"))) / weight
    return spread.groupBy("draw").agg(F.min_by("cell", F.struct(at, F.col("cell"))).alias("cell"))


def weighted_sample(covered: DataFrame, counts: DataFrame, points: DataFrame, draws: int,
                    seed: str) -> DataFrame:
    """`draws` keys: a cell by weight 1/(1+labels)^2, then a key among the cell's first 200.

    covered(cell), counts(cell, labels), points(cell, rc14) eligible ones. A cell without keys falls
    back to a draw over all cells by their number of keys.
    """
    weighted = covered.join(counts, "cell", "left").withColumn(
        "labels", F.coalesce("labels", F.lit(0)))
    one = F.lit(1.0) + F.col("labels")
    picked = _weighted_pick(weighted, draws, seed, F.lit(1.0) / (one * one))
    filled = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n_keys"))
    spare = _weighted_pick(filled, draws, seed + "/spare", F.col("n_keys")) \
        .withColumnRenamed("cell", "_spare")
    target = picked.join(filled, "cell", "left").join(spare, "draw").select(
        "draw", F.when(F.col("n_keys").isNull(), F.col("_spare")).otherwise(F.col("cell"))
        .alias("cell"))
    bucket = first_per_cell(points.select("cell", "rc14"))
    order = draw(seed, F.col("rc14"), F.col("draw"))
    return target.join(bucket, "cell").groupBy("draw", "cell").agg(
        F.min_by("rc14", F.struct(order, F.col("rc14"))).alias("rc14"))


def held_out(pool: DataFrame, used: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """`n` distinct keys in seeded random order, none of the used ones."""
    return pool.filter(F.col(key).isNotNull()).select(key).distinct().join(
        used.select(key), key, "left_anti"
    ).withColumn("draw", draw(seed, F.col(key))).orderBy("draw", key).limit(n)


# ---- retention ------------------------------------------------------------------------------

# Limits of the image cache, smallest JSON, age after which an empty record is stale.
MAX_FILES, MAX_BYTES, EVICT_SHARE = 5000, 3 * 1024**3, 5
MIN_JSON_BYTES, STALE_EMPTY_S = 50, 86400


def retention(files: DataFrame, now: Column, refresh_days: int) -> DataFrame:
    """Adds evict, refresh, drop_small and refetch to files(name, kind, bytes, mtime, empty).

    Above either limit the oldest fifth (one file at least) of the images is evicted; sheets older
    than `refresh_days` are refreshed; JSON files of less than 50 bytes are dropped; records without
    content are fetched again after a day. `mtime` and `now` are seconds.
    """
    images = files.filter(F.col("kind") == "image").select("name", "bytes", "mtime")
    size = images.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")
    ).alias("s")).scalar()
    aged = running_total(images, ["mtime", "name"]).withColumn("_s", size)
    full = (F.col("_s.n") >= MAX_FILES) | (F.col("_s.b") >= MAX_BYTES)
    quota = F.greatest(F.lit(1), F.floor(F.col("_s.n") / EVICT_SHARE))
    gone = aged.filter(full & (F.col("before") < quota)).select("name").withColumn(
        "evict", F.lit(True))
    age = now - F.col("mtime")
    kind = F.col("kind")
    return files.join(gone, "name", "left").select(
        *files.columns, F.coalesce("evict", F.lit(False)).alias("evict"),
        ((kind == "sheet") & (age > refresh_days * 86400)).alias("refresh"),
        (F.col("name").endswith(".json") & (F.col("bytes") < MIN_JSON_BYTES)).alias("drop_small"),
        ((kind == "record") & F.col("empty") & (age > STALE_EMPTY_S)).alias("refetch"))


# ---- tiles ----------------------------------------------------------------------------------


def tile_cover(requests: DataFrame, tiles: DataFrame, request_id: str, **opts) -> DataFrame:
    """Paste plan per request: its tiles at the finest resolution that covers it.

    requests(request_id, box); tiles(x1, y1, x2, y2, mpp). Tiles that only touch the box do not
    count; covered means inside the rectangle around the tiles that do. Offsets are pixels of the
    joined picture, the crop window repeats on each row.
    """
    boxed = tiles.withColumn("_tbox", F.struct(
        F.col("x1").cast("double").alias("x0"), F.col("y1").cast("double").alias("y0"),
        F.col("x2").cast("double").alias("x1"), F.col("y2").cast("double").alias("y1")))
    # Read for the rectangles and again for the tiles of the chosen resolution.
    hits = settle(box_join(requests, boxed, "box", "_tbox", request_id, touching=False, **opts),
                  "tiles")
    b = F.col("box")
    union = hits.groupBy(request_id, "mpp").agg(
        F.min("x1").alias("ux0"), F.min("y1").alias("uy0"), F.max("x2").alias("ux1"),
        F.max("y2").alias("uy1"), F.first("box").alias("_b"))
    b2 = F.col("_b")
    covering = union.filter((F.col("ux0") <= b2["x0"]) & (F.col("ux1") >= b2["x1"])
                            & (F.col("uy0") <= b2["y0"]) & (F.col("uy1") >= b2["y1"]))
    best = covering.groupBy(request_id).agg(
        F.min(F.struct("mpp", "ux0", "uy0", "ux1", "uy1")).alias("_u")).select(request_id, "_u.*")
    plan = hits.join(best, [request_id, "mpp"])
    mpp = F.col("mpp")

    def cut(v: Column) -> Column:
        return (v / mpp).cast("int")

    return plan.select(
        request_id, "mpp", "x1", "y1", "x2", "y2",
        cut(F.col("x1") - F.col("ux0")).alias("ox"), cut(F.col("uy1") - F.col("y2")).alias("oy"),
        cut(F.col("x2") - F.col("x1")).alias("tw"), cut(F.col("y2") - F.col("y1")).alias("th"),
        cut(b["x0"] - F.col("ux0")).alias("cx0"), cut(b["x1"] - F.col("ux0")).alias("cx1"),
        cut(F.col("uy1") - b["y1"]).alias("cy0"), cut(F.col("uy1") - b["y0"]).alias("cy1"))


def tile_coverage(tiles: DataFrame) -> DataFrame:
    """Tiles, extent and megabytes per resolution."""
    return tiles.groupBy("mpp").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.min("x1").alias("x1"), F.min("y1").alias("y1"),
        F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        (F.sum("bytes") / F.lit(1e6)).alias("size_mb"))


# ---- inventories ----------------------------------------------------------------------------

# Name patterns of the artifact kinds.
KINDS = {
    "sheet": r"^PLANO_.*\.pdf$", "polygon": r"^poly_.*\.json$", "bbox": r"^bbox_.*\.json$",
    "units": r"^dnprc_.*\.json$", "tile": r"^wms_.*\.png$",
}


def artifact_kind(name: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        hit = name.rlike(pattern)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("other"))


def inventory(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files, megabytes and expected number per kind. files(name, bytes), expected(name)."""
    def kinds(df: DataFrame) -> DataFrame:
        return df.withColumn("kind", artifact_kind(F.col("name")))
    have = kinds(files).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_files"), (F.sum("bytes") / F.lit(1e6)).alias("size_mb"))
    want = kinds(expected.select("name").distinct())
    present = want.join(files.select("name").distinct().withColumn("_here", F.lit(1)), "name", "left")
    wanted = present.groupBy("kind").agg(
        F.count(F.lit(1)).alias("expected"), F.count("_here").alias("present"))
    return have.join(wanted, "kind", "full_outer").select(
        "kind", F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"), "expected", "present")


def latency_profile(samples: DataFrame, column: str = "ms", hit_ms: float = 50.0) -> DataFrame:
    """One row: n, median, p95 (element int(0.95 n) of the sorted list), max, share below 50 ms.

    Exact at any size: equal values are counted first and ranks come from running totals over
    ranges of values, so no task sorts or holds the whole list.
    """
    counted = samples.filter(F.col(column).isNotNull()).groupBy(
        F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    ranked = running_total(counted, ["v"], "w")
    n = ranked.agg(F.sum("w").alias("n")).scalar()
    r = ranked.withColumn("_n", n)
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    p95 = F.floor(F.col("_n") * F.lit(95) / F.lit(100))

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("w"))

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank), F.col("v")))

    return r.agg(
        F.sum("w").alias("n"), ((at(lo) + at(hi)) / 2).alias("median"), at(p95).alias("p95"),
        F.max("v").alias("max"),
        (F.sum(F.when(F.col("v") < hit_ms, F.col("w")).otherwise(0)) / F.sum("w"))
        .alias("hit_share"))


def fill_rates(records: DataFrame, fields: list[str]) -> DataFrame:
    """Filled records and percent per field. Counted in one pass, then turned into rows."""
    types = dict(records.dtypes)

    def present(c: str) -> Column:
        here = F.col(c).isNotNull()
        if types[c] == "string":
            here = here & (F.col(c) != "")
        elif types[c].startswith("array"):
            here = here & (F.size(c) > 0)
        return F.count_if(here).alias(c)

    counts = records.agg(*[present(c) for c in fields], F.count(F.lit(1)).alias("_total"))
    rows = counts.unpivot(["_total"], fields, "field", "filled")
    return rows.select("field", "filled", F.col("_total").alias("total"), (
        F.lit(100.0) * F.col("filled") / F.greatest(F.col("_total"), F.lit(1))).alias("percent"))


def top_categories(zones: DataFrame, n: int = 10) -> DataFrame:
    return zones.groupBy("categoria").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "categoria").limit(n)


def rural_hit_rate(points: DataFrame, rural_sheets: DataFrame) -> DataFrame:
    """One row: points whose rural cell has a sheet, the others, and the share.

    Points are counted per cell first; only cells meet the sheets.
    """
    per = points.groupBy("snu_exact").agg(F.count(F.lit(1)).alias("n"))
    listed = rural_sheets.select(F.col("sheet_name").alias("snu_exact")).distinct().withColumn(
        "_hit", F.lit(True))
    out = per.join(listed, "snu_exact", "left")
    hit = F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0))
    return out.agg(hit.alias("hits"), (F.sum("n") - hit).alias("misses"),
                   (hit / F.sum("n")).alias("hit_share"))


def landing_status(link: Column, cached: Column, http: Column, head: Column) -> Column:
    """Outcome of one landed download: no_link, skip, 404, error or ok."""
    return (
        F.when(link.isNull(), F.lit("no_link")).when(cached, F.lit("skip"))
        .when(http == 404, F.lit("404")).when(http != 200, F.lit("error"))
        .when(~head.startswith("%PDF"), F.lit("error")).otherwise(F.lit("ok")))


def outcome_report(rows: DataFrame) -> DataFrame:
    """Rows per status."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
