"""From keys to sheets: coordinates, municipality, grid cell, quadrant, sheet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions import grid, keys
from lindero.operators.skew import first_per_key, join_known
from lindero.operators.spatial import box_join, point_box
from lindero.registry import DEFAULT_REGISTRY, Municipality, as_struct, first_containing, \
    lookup_struct, town_keys

# Up to this many registry entries the routing is one CASE expression; beyond it, a box join.
INLINE_ENTRIES = 64


def validate_keys(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `rc`, `rc14` and `error`; refused keys stay as rows."""
    col = F.col(raw)
    return (
        rows.withColumn("rc", keys.canonical(col))
        .withColumn("rc14", keys.strict_rc14(col))
        .withColumn("error", keys.key_error(col))
    )


def attach_coords(rows: DataFrame, coords: DataFrame) -> DataFrame:
    """Left join on `rc14`; `coords` has one row per key. Misses keep null coordinates.

    No broadcast is forced: the coordinate table grows with the cadastre. A key that many requests
    share is split at run time by the adaptive skew join; refused keys (null) are spread out.
    """
    return join_known(rows, coords.select("rc14", "x", "y", "address"), "rc14")


def route(points: DataFrame, registry: Sequence[Municipality] = DEFAULT_REGISTRY) -> DataFrame:
    """Adds `id_ine` of the first entry, in registry order, whose extent holds the point.

    Both forms give each row the entry of its own position.
    """
    if len(registry) <= INLINE_ENTRIES:
        return points.withColumn("id_ine", first_containing(F.col("x"), F.col("y"), registry))
    spark = points.sparkSession
    boxes = spark.createDataFrame(
        [(i, m.id_ine, m.xmin, m.ymin, m.xmax, m.ymax) for i, m in enumerate(registry)],
        "prio int, id_ine int, x0 double, y0 double, x1 double, y1 double",
    ).select("prio", "id_ine", F.struct("x0", "y0", "x1", "y1").alias("_mbox"))
    # By position, not by key: rows of one key may lie in different places.
    where = points.select("x", "y", point_box(F.col("x"), F.col("y")).alias("_pbox")).distinct() \
        .withColumn("_at", F.struct("x", "y"))
    hits = box_join(where, boxes, "_pbox", "_mbox", "_at").select("x", "y", "prio", "id_ine")
    first = first_per_key(hits, ["x", "y"], [F.col("prio")]).drop("prio")
    return points.join(first, ["x", "y"], "left").select(*points.columns, "id_ine")


def route_known(points: DataFrame, registry: Sequence[Municipality] = DEFAULT_REGISTRY,
                given: str = "given_ine") -> DataFrame:
    """As `route`, but a given `id_ine` wins; when it is not registered the result is null."""
    known = lookup_struct(F.col(given), registry)["id_ine"]
    auto = route(points.drop("id_ine"), registry).withColumnRenamed("id_ine", "_auto")
    return auto.withColumn(
        "id_ine", F.when(F.col(given).isNotNull(), known).otherwise(F.col("_auto"))
    ).drop("_auto")


def within_extent(x: Column, y: Column, m: Column) -> Column:
    """All four sides count as inside."""
    return x.between(m["xmin"], m["xmax"]) & y.between(m["ymin"], m["ymax"])


def grid_columns(points: DataFrame, m: Column) -> DataFrame:
    """Adds col, row, letter, x_in, y_in, compass, sub, cell, sheet_name, rx, ry, warnings.

    Values are null where the row is outside the grid or the municipality has none.
    """
    x, y, mm = F.col("x"), F.col("y"), F.col("_m")
    col, row, x_in, y_in = (F.col(c) for c in ("col", "row", "x_in", "y_in"))
    letter, corner, sub = F.col("letter"), F.col("compass"), F.col("sub")
    # A few wide steps: each one may read the columns of the step before.
    out = points.withColumns({
        "_m": m}).withColumns({
            "col": grid.col_index(x, mm), "row": grid.row_index(y, mm)}).withColumns({
                "letter": grid.row_letter(row), "x_in": grid.x_within(x, col, mm),
                "y_in": grid.y_within(y, row, mm)}).withColumns({
                    "compass": grid.compass(x_in, y_in, mm),
                    "cell": grid.cell_name(col, letter)}).withColumns({
                        "sub": grid.quadrant(corner)})
    rel = grid.body_relative(x, y, col, row, corner, mm)
    return out.withColumns({
        "sheet_name": grid.sheet_name(col, letter, sub), "rx": F.bround(rel["rx"], 4),
        "ry": F.bround(rel["ry"], 4),
        "warnings": grid.border_warnings(x_in, y_in, mm, F.col("cell"))})


def attach_sheets(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Left join on the sheet name; `sheets` holds one row per name, or per `id_ine` and name where
    it lists several municipalities.

    The listing grows with the municipalities served, so its size decides the join: Spark
    broadcasts it only below its threshold and otherwise shuffles with skew splitting.
    """
    town = town_keys(rows, sheets)
    return rows.join(
        sheets.select(*town, "sheet_name", F.col("url").alias("sheet_url")),
        [*town, "sheet_name"], "left")


def edge_neighbours(points: DataFrame, sheets: DataFrame, m: Column,
                    reach: float = grid.BORDER_M) -> DataFrame:
    """Lateral neighbour cells of points near a cell side whose sheet exists, at most four each.

    Needs col, row, x_in and y_in from `grid_columns`. `ord` follows (col, row).
    """
    col, row, x_in, y_in = F.col("col"), F.col("row"), F.col("x_in"), F.col("y_in")
    mm = F.col("_m")

    def side(near: Column, dc: int, dr: int) -> Column:
        ncol, nrow = col + dc, row + dr
        corner = grid.compass(x_in - dc, y_in - dr, mm)
        letter, sub = grid.row_letter(nrow), grid.quadrant(corner)
        return F.when(near & grid.row_valid(nrow), F.struct(
            ncol.alias("n_col"), nrow.alias("n_row"), grid.cell_name(ncol, letter).alias("n_cell"),
            sub.alias("n_sub"), corner.alias("n_compass"),
            grid.sheet_name(ncol, letter, sub).alias("n_sheet"),
        ))

    sides = F.array(
        side(x_in * mm["cell_w"] < reach, -1, 0),
        side(y_in * mm["cell_h"] < reach, 0, -1),
        side((1 - y_in) * mm["cell_h"] < reach, 0, 1),
        side((1 - x_in) * mm["cell_w"] < reach, 1, 0),
    )
    out = (
        points.withColumn("_m", m)
        .select(*[c for c in points.columns if c != "_m"],
                F.posexplode(F.array_compact(sides)).alias("ord", "_n"))
        .select("*", "_n.*").drop("_n")
    )
    town = town_keys(out, sheets)
    listed = sheets.select(*town, F.col("sheet_name").alias("n_sheet"))
    return out.join(listed, [*town, "n_sheet"], "left_semi")


# ---- rural sheets ---------------------------------------------------------------------------


def rural_columns(points: DataFrame, m: Column) -> DataFrame:
    """Adds `snu_col`, `snu_row`, `snu_letter` and the sheet of exactly that cell."""
    # One row for each as it was. A generator, as the optimizer would copy the cell into every use and filter
    # of its parts: a megabyte of code for the rural sheets.
    cell = F.explode(F.array(grid.snu_cell(F.col("x"), F.col("y"), m)))
    out = points.withColumn("_c", cell)
    c = F.col("_c")
    return out.select(
        "*", c["col"].alias("snu_col"), c["row"].alias("snu_row"), c["letter"].alias("snu_letter"),
        grid.snu_sheet(c).alias("snu_exact"),
    ).drop("_c")


def available_rural_cells(rural_sheets: DataFrame, m: Municipality) -> DataFrame:
    """Distinct (letter, col, row) of listed rural sheets that lie on the grid."""
    name = F.col("sheet_name")
    pattern = rf"^PLANO_([{m.snu_letters}])_(\d+)\.pdf$"
    letter = F.regexp_extract(name, pattern, 1)
    col = F.regexp_extract(name, pattern, 2).try_cast("int")
    return (
        rural_sheets.filter(name.rlike(pattern))
        .select(letter.alias("letter"), col.alias("col"),
                (F.instr(F.lit(m.snu_letters), letter) - 1).alias("row"))
        .filter(F.col("col").between(1, m.snu_cols) & (F.col("row") >= 0))
        .distinct()
    )


def nearest_rural_sheet(
        points: DataFrame, rural_sheets: DataFrame,
        entry: Municipality | Sequence[Municipality] = DEFAULT_REGISTRY[0]) -> DataFrame:
    """Adds `snu_sheet`: the cell's own sheet, else the nearest listed one; null outside the grid.

    Nearest means least Chebyshev distance in cells, then least squared distance, then letter and
    column. The listed cells fit in one array of at most cols x rows entries, so each point is
    resolved in a projection and nothing is shuffled. With several municipalities points and
    rural_sheets carry `id_ine`; there is then one such array for each.
    """
    gathered = F.array_sort(F.collect_set(F.struct("letter", "col", "row"))).alias("_listed")
    if isinstance(entry, Municipality):
        listed = available_rural_cells(rural_sheets, entry).agg(gathered).scalar()
        located = rural_columns(points, as_struct(entry)).withColumn("_listed", listed)
    else:
        parts = [available_rural_cells(rural_sheets.filter(F.col("id_ine") == m.id_ine), m)
                 .agg(gathered).withColumn("id_ine", F.lit(m.id_ine))
                 for m in entry if m.snu_letters]
        listed = reduce(DataFrame.unionByName, parts)
        located = rural_columns(points, lookup_struct(F.col("id_ine"), entry)).join(
            listed, "id_ine", "left")

    def distance(s: Column) -> Column:
        dc, dr = F.abs(s["col"] - F.col("snu_col")), F.abs(s["row"] - F.col("snu_row"))
        return F.struct(F.greatest(dc, dr).alias("d"), (dc * dc + dr * dr).alias("e"),
                        s["letter"].alias("letter"), s["col"].alias("col"))

    best = F.array_min(F.transform(F.col("_listed"), distance))
    return located.withColumn(
        "snu_sheet", F.when(F.col("snu_col").isNotNull(), grid.snu_sheet(best))
    ).drop("_listed")
