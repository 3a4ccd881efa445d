"""The full result record of every located key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.functions import grid
from lindero.operators import calibration as C
from lindero.plans.location import LOCATED
from lindero.registry import DEFAULT_REGISTRY, Municipality, lookup_struct


def result_records(located: DataFrame, calibration: DataFrame, snaps: DataFrame, moves: DataFrame,
                   parcels: DataFrame, units: DataFrame,
                   registry: Sequence[Municipality] = DEFAULT_REGISTRY) -> DataFrame:
    """One record per located key; refused keys have none.

    located is the outcome of `locate_keys`; snaps(rc14, dx, dy, score) of `choose_snap` and
    moves(rc14, sheet_name, snap_score, dx, dy, from_sheet, from_score, to_score, tried) of
    `edge_override`, each with at most one row per key; parcels(refcat, area_m2, label); units(rc14),
    one row per unit. A key that was moved to a neighbour sheet takes that sheet's name, cell,
    quadrant and snap, and the reliability is that of the new place.
    """
    moved = moves.select("rc14", F.col("sheet_name").alias("_to"), "from_sheet", "from_score",
                         "to_score", "tried", F.struct(
                             "dx", "dy", F.col("snap_score").alias("score")).alias("_snap"))
    shift = snaps.select("rc14", F.struct("dx", "dy", "score").alias("snap"))
    area = parcels.select(F.col("refcat").alias("rc14"), F.col("area_m2").alias("polygon_area_m2"),
                          F.col("label").alias("polygon_label"))
    count = units.groupBy("rc14").agg(F.count(F.lit(1)).alias("n_units"))
    rows = located.filter(F.col("reason").isNull())
    for part in (moved, shift, area, count):
        rows = rows.join(part, "rc14", "left")
    to = F.when(F.col("from_sheet").isNotNull(), F.col("_to"))
    place = grid.split_sheet(to)
    rows = rows.withColumns({
        "sheet_name": F.coalesce(to, "sheet_name"),
        "snap": F.when(to.isNotNull(), F.col("_snap")).otherwise(F.col("snap")),
        "cell": F.coalesce(grid.cell_name(place["col"], place["letter"]), "cell"),
        "sub": F.coalesce(place["sub"], "sub")})
    rated = C.attach_quality(rows, calibration)
    override = F.when(F.col("from_sheet").isNotNull(), F.struct(
        "from_sheet", "from_score", F.col("sheet_name").alias("to_sheet"), "to_score"))
    own = [c for c in located.columns if c not in (*LOCATED, "_m")]  # of the requests
    return rated.select(
        *own, "rc", "address", F.struct("x", "y").alias("utm"), "cell", F.col("sub").alias("sub_quadrant"),
        F.col("compass").alias("sub_compass"), "sheet_name", "sheet_url",
        F.concat("warnings", C.quality_warnings()).alias("warnings"),
        F.struct("rx", "ry").alias("body_relative"), "snap", override.alias("edge_override"),
        F.col("tried").alias("edge_candidates_tried"),
        F.struct("source", "n_labels", "residual_px", F.col("residual_m").alias(
            "expected_residual_m"), "reliability").alias("calibration_quality"),
        "polygon_area_m2", "polygon_label", F.coalesce("n_units", F.lit(0)).alias("n_units"),
        lookup_struct(F.col("id_ine"), registry)["slug"].alias("municipality"))
