"""Sheet grid arithmetic. Every function takes the municipality struct `m` of the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lindero.registry import QUADRANTS, ROW_LETTERS

# Rows of the urban grid, border distance in metres, pixels per metre.
GRID_ROWS = 25
BORDER_M = 50
PX_PER_M = 11.81
# Part of a rural sheet image that the map body covers (left, top, right, bottom).
RURAL_BODY = (0.005, 0.005, 0.950, 0.910)


def floor_div(a: Column, b: Column) -> Column:
    """Whole quotient towards minus infinity, exact also where a/b rounds up to a whole number:
    taking the exact remainder off first leaves a multiple of b."""
    return F.rint((a - F.pmod(a, b)) / b).cast("int")


def col_index(x: Column, m: Column) -> Column:
    return floor_div(x - m["x0"], m["cell_w"])


def row_index(y: Column, m: Column) -> Column:
    return floor_div(m["ymax_grid"] - y, m["cell_h"])


def row_valid(row: Column) -> Column:
    return row.between(0, GRID_ROWS - 1)


def row_letter(row: Column) -> Column:
    return F.when(row_valid(row), F.substring(F.lit(ROW_LETTERS), row + 1, F.lit(1)))


def letter_row(letter: Column) -> Column:
    """Inverse of `row_letter`; null for an unknown letter."""
    at = F.instr(F.lit(ROW_LETTERS), letter)
    return F.when(at > 0, at - 1)


def cell_name(col: Column, letter: Column) -> Column:
    return F.concat(col.cast("string"), F.lit("-"), letter)


def x_within(x: Column, col: Column, m: Column) -> Column:
    """West-to-east position inside the cell, 0..1."""
    return (x - (m["x0"] + col * m["cell_w"])) / m["cell_w"]


def y_within(y: Column, row: Column, m: Column) -> Column:
    """North-to-south position inside the cell, 0..1."""
    return (m["ymax_grid"] - row * m["cell_h"] - y) / m["cell_h"]


def compass(x_in: Column, y_in: Column, m: Column) -> Column:
    ns = F.when(y_in < m["ns_thr"], F.lit("N")).otherwise(F.lit("S"))
    ew = F.when(x_in < m["ew_thr"], F.lit("W")).otherwise(F.lit("E"))
    return F.concat(ns, ew)


def quadrant(corner: Column) -> Column:
    out = None
    for name, numeral in QUADRANTS.items():
        hit = corner == F.lit(name)
        out = F.when(hit, F.lit(numeral)) if out is None else out.when(hit, F.lit(numeral))
    return out


def sheet_name(col: Column, letter: Column, sub: Column) -> Column:
    return F.concat(
        F.lit("PLANO_"), col.cast("string"), F.lit("_"), letter, F.lit("_"), sub, F.lit(".pdf")
    )


def split_sheet(name: Column) -> Column:
    """`PLANO_{col}_{letter}_{sub}.pdf` -> struct(col, letter, sub); parts null when too few."""
    parts = F.split(F.regexp_replace(F.regexp_replace(name, "PLANO_", ""), r"\.pdf", ""), "_")
    enough = F.size(parts) >= 3
    return F.struct(
        F.when(enough, parts[0]).alias("col"), F.when(enough, parts[1]).alias("letter"),
        F.when(enough, parts[2]).alias("sub"),
    )


def anchor(col: Column, row: Column, corner: Column, m: Column) -> Column:
    """Ground position of the upper left corner of a sheet's map body."""
    east = F.when(corner.contains("W"), F.lit(0.0)).otherwise(m["cell_w"] / 2)
    south = F.when(corner.contains("N"), F.lit(0.0)).otherwise(m["cell_h"] / 2)
    return F.struct(
        (m["x0"] + col * m["cell_w"] + east - m["marg_x"]).alias("x"),
        (m["ymax_grid"] - row * m["cell_h"] - south + m["marg_y"]).alias("y"),
    )


def body_size(m: Column) -> Column:
    """Metres covered by the map body of one sheet."""
    return F.struct(
        (m["cell_w"] / 2 + 2 * m["marg_x"]).alias("w"),
        (m["cell_h"] / 2 + 2 * m["marg_y"]).alias("h"),
    )


def body_relative(x: Column, y: Column, col: Column, row: Column, corner: Column,
                  m: Column) -> Column:
    """Unrounded position on the sheet body, struct(rx, ry)."""
    a, size = anchor(col, row, corner, m), body_size(m)
    return F.struct(
        ((x - a["x"]) / size["w"]).alias("rx"), ((a["y"] - y) / size["h"]).alias("ry")
    )


def border_distance(x_in: Column, y_in: Column, m: Column) -> Column:
    """Metres to the nearest outer border of the cell."""
    return F.least(
        F.least(x_in, 1 - x_in) * m["cell_w"], F.least(y_in, 1 - y_in) * m["cell_h"]
    )


def midline_distance(x_in: Column, y_in: Column, m: Column) -> Column:
    """Metres to the nearest line between two quadrants."""
    return F.least(F.abs(x_in - 0.5) * m["cell_w"], F.abs(y_in - 0.5) * m["cell_h"])


def border_kind(x_in: Column, y_in: Column, m: Column) -> Column:
    """`inner` or `outer` for keys near the outer border, else null.

    A key near a mid line only counts when it is near the outer border too.
    """
    near_mid = midline_distance(x_in, y_in, m) < BORDER_M
    return F.when(
        border_distance(x_in, y_in, m) < BORDER_M,
        F.when(near_mid, F.lit("inner")).otherwise(F.lit("outer")),
    )


def whole_metres(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint").cast("string")


def border_warnings(x_in: Column, y_in: Column, m: Column, cell: Column) -> Column:
    """Warning texts as an array, empty for keys in the middle of a sheet."""
    kind = border_kind(x_in, y_in, m)
    # Wording of the two messages.
    inner = F.concat(
        F.lit("RC a "), whole_metres(midline_distance(x_in, y_in, m)),
        F.lit(" m del borde interno entre sub-cuadrantes."),
    )
    outer = F.concat(
        F.lit("RC a "), whole_metres(border_distance(x_in, y_in, m)),
        F.lit(" m del borde EXTERNO de la cell "), cell, F.lit("."),
    )
    return (
        F.when(kind == "inner", F.array(inner))
        .when(kind == "outer", F.array(outer))
        .otherwise(F.array().cast("array<string>"))
    )


def truncated(value: Column) -> Column:
    """Towards zero, as pixel positions are cut."""
    return value.cast("int")


def pixel(px: Column, py: Column) -> Column:
    return F.struct(px.alias("x"), py.alias("y"))


def relative_to_pixel(rx: Column, ry: Column, body: Column) -> Column:
    """`body` is struct(x, y, w, h) of the map body in the image."""
    return pixel(truncated(body["x"] + rx * body["w"]), truncated(body["y"] + ry * body["h"]))


def polygon_to_sheet(poly: Column, body: Column, corner_xy: Column, m: Column,
                     dx: Column, dy: Column) -> Column:
    """Ground polygon -> sheet pixels, moved by whole-pixel calibration and snap shifts."""
    size = body_size(m)

    def place(p: Column) -> Column:
        at = relative_to_pixel(
            (p["x"] - corner_xy["x"]) / size["w"], (corner_xy["y"] - p["y"]) / size["h"], body
        )
        return pixel(at["x"] + dx, at["y"] + dy)

    return F.transform(poly, place)


def padded_extent(box: Column) -> Column:
    """Extent widened by 40 % of its longer side, by 50 m at least."""
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    pad = F.greatest(F.lit(50.0), 0.4 * side)
    return F.struct(
        (box["x0"] - pad).alias("x0"), (box["y0"] - pad).alias("y0"),
        (box["x1"] + pad).alias("x1"), (box["y1"] + pad).alias("y1"),
    )


def polygon_to_image(poly: Column, box: Column, width: Column, height: Column) -> Column:
    """Ground polygon -> pixels of an image that shows exactly `box`."""
    return F.transform(
        poly,
        lambda p: pixel(
            truncated((p["x"] - box["x0"]) / (box["x1"] - box["x0"]) * width),
            truncated((box["y1"] - p["y"]) / (box["y1"] - box["y0"]) * height),
        ),
    )


def plan_px_per_m(scale: Column) -> Column:
    """Pixels per metre of a plan of scale 1:`scale` at 200 dots per inch."""
    return F.lit(200.0) / F.lit(25.4) * F.lit(1000) / scale


def polygon_to_plan(poly: Column, centroid: Column, body_mid: Column, scale: Column,
                    dx: Column, dy: Column) -> Column:
    """Ground polygon -> record card plan; the zone's centroid sits in the middle of the body."""
    k = plan_px_per_m(scale)
    return F.transform(
        poly,
        lambda p: pixel(
            F.bround(body_mid["x"] + (p["x"] - centroid["x"]) * k + dx, 0).cast("int"),
            F.bround(body_mid["y"] - (p["y"] - centroid["y"]) * k + dy, 0).cast("int"),
        ),
    )


# ---- rural grid ---------------------------------------------------------------------------


def snu_cell_size(m: Column) -> Column:
    return F.struct((m["snu_w"] / m["snu_cols"]).alias("w"), (m["snu_h"] / m["snu_rows"]).alias("h"))


def snu_cell(x: Column, y: Column, m: Column) -> Column:
    """struct(col from 1, row from 0, letter) of the rural grid; null outside."""
    size = snu_cell_size(m)
    col = floor_div(x - m["snu_x0"], size["w"]) + 1
    row = floor_div(m["snu_ymax"] - y, size["h"])
    inside = (col >= 1) & (col <= m["snu_cols"]) & (row >= 0) & (row < m["snu_rows"])
    letter = F.substring(m["snu_letters"], row + 1, F.lit(1))
    return F.when(inside, F.struct(col.alias("col"), row.alias("row"), letter.alias("letter")))


def snu_sheet(cell: Column) -> Column:
    return F.concat(
        F.lit("PLANO_"), cell["letter"], F.lit("_"), cell["col"].cast("string"), F.lit(".pdf")
    )


def snu_bbox(col: Column, row: Column, m: Column) -> Column:
    """Ground extent of a rural cell."""
    size = snu_cell_size(m)
    west = m["snu_x0"] + (col - 1) * size["w"]
    top = m["snu_ymax"] - row * size["h"]
    return F.struct(
        west.alias("x0"), (top - size["h"]).alias("y0"), (west + size["w"]).alias("x1"),
        top.alias("y1"),
    )


def polygon_to_rural_sheet(poly: Column, box: Column, width: Column, height: Column) -> Column:
    """Ground polygon -> pixels of a rural sheet image; the body is a fixed part of the image."""
    left, top, right, bottom = RURAL_BODY
    bx0, by0 = truncated(width * left), truncated(height * top)
    bx1, by1 = truncated(width * right), truncated(height * bottom)
    return F.transform(
        poly,
        lambda p: pixel(
            truncated(bx0 + (p["x"] - box["x0"]) / (box["x1"] - box["x0"]) * (bx1 - bx0)),
            truncated(by0 + (box["y1"] - p["y"]) / (box["y1"] - box["y0"]) * (by1 - by0)),
        ),
    )


# ---- conversions --------------------------------------------------------------------------


def px_to_m(px: Column) -> Column:
    return px / F.lit(PX_PER_M)


def drag_to_relative(dx_px: Column, dy_px: Column, m: Column) -> Column:
    """Drag in sheet pixels -> shift of the relative position, struct(rx, ry)."""
    size = body_size(m)
    return F.struct(
        (px_to_m(dx_px) / size["w"]).alias("rx"), (px_to_m(dy_px) / size["h"]).alias("ry")
    )


# ---- longitude/latitude to ground coordinates ---------------------------------------------

# GRS80 axis and flattening, scale on the central meridian, false easting, zone 30.
_AXIS, _FLAT, _K0, _EAST0, _LON0 = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, -3.0


def lonlat_to_utm30(lon: Column, lat: Column) -> Column:
    """Transverse Mercator by the Krueger series (third order in the third flattening),
    northern half, rounded to centimetres. Datum ETRS89, equal to WGS84 at this precision."""
    n = _FLAT / (2 - _FLAT)
    radius = _AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
    )
    ecc = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(_LON0))
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - ecc * F.atanh(ecc * sin_phi))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct(
        F.bround(F.lit(_EAST0) + _K0 * radius * east, 2).alias("x"),
        F.bround(_K0 * radius * north, 2).alias("y"),
    )
