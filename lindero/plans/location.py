"""The location job: key -> cell, quadrant, sheet, relative position; rejects stay as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.operators import calibration as C
from lindero.operators import locate as L
from lindero.registry import DEFAULT_REGISTRY, Municipality, lookup_struct

LOCATED = (
    "rc", "rc14", "reason", "address", "x", "y", "id_ine", "col", "row", "cell", "sub", "compass",
    "sheet_name", "sheet_url", "x_in", "y_in", "rx", "ry", "warnings",
)


def locate_keys(requests: DataFrame, coords: DataFrame, sheets: DataFrame,
                registry: Sequence[Municipality] = DEFAULT_REGISTRY,
                raw: str = "raw") -> DataFrame:
    """One row per request. `reason` is null for located keys, else one of bad_format, not_found,
    out_of_extent, no_grid, row_out_of_range, no_sheet (the first that applies)."""
    rows = L.attach_coords(L.validate_keys(requests, raw), coords)
    placed = place_rows(rows, sheets, registry)
    extra = [c for c in requests.columns if c not in LOCATED]
    return placed.select(*extra, *LOCATED, "_m")


def place_rows(rows: DataFrame, sheets: DataFrame,
               registry: Sequence[Municipality] = DEFAULT_REGISTRY) -> DataFrame:
    """Municipality, cell, quadrant, sheet and `reason` of rows that have rc14, error, x and y."""
    routed = L.route(rows, registry)
    # A point outside every extent is judged against the default (first) municipality.
    routed = routed.withColumn("id_ine", F.coalesce("id_ine", F.lit(registry[0].id_ine)))
    placed = L.grid_columns(routed, lookup_struct(F.col("id_ine"), registry))
    placed = L.attach_sheets(placed, sheets)
    m = F.col("_m")
    reason = (
        F.when(F.col("error").isNotNull(), F.lit("bad_format"))
        .when(F.col("x").isNull() | F.col("y").isNull(), F.lit("not_found"))
        .when(~L.within_extent(F.col("x"), F.col("y"), m), F.lit("out_of_extent"))
        .when(m["cell_w"].isNull(), F.lit("no_grid"))
        .when(~F.col("row").between(0, 24), F.lit("row_out_of_range"))
        .when(F.col("sheet_url").isNull(), F.lit("no_sheet"))
    )
    return placed.withColumn("reason", reason)


def locate_with_quality(requests: DataFrame, coords: DataFrame, sheets: DataFrame,
                        calibration: DataFrame,
                        registry: Sequence[Municipality] = DEFAULT_REGISTRY,
                        raw: str = "raw") -> DataFrame:
    """The flagship job: location plus calibration offset and reliability of every key."""
    located = locate_keys(requests, coords, sheets, registry, raw)
    out = C.attach_quality(C.attach_offsets(located, calibration), calibration)
    ok = F.col("reason").isNull()
    warned = F.when(ok, F.concat(F.col("warnings"), C.quality_warnings())).otherwise(
        F.col("warnings"))
    added = [c for c in out.columns if c not in located.columns]
    # A key without a place on a sheet has no offset, reliability or warning about them.
    return out.withColumns({"warnings": warned}).withColumns(
        {c: F.when(ok, F.col(c)) for c in added})
