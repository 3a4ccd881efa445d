"""Native expressions over rings, i.e. `array<struct<x,y>>`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xs(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["x"])


def ys(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["y"])


def bbox(ring: Column) -> Column:
    """Extent of a ring as struct(x0, y0, x1, y1)."""
    return F.struct(
        F.array_min(xs(ring)).alias("x0"), F.array_min(ys(ring)).alias("y0"),
        F.array_max(xs(ring)).alias("x1"), F.array_max(ys(ring)).alias("y1"),
    )


def rings_bbox(rings: Column) -> Column:
    """Extent of all rings together."""
    return bbox(F.flatten(rings))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def vertex_mean(ring: Column) -> Column:
    """Mean of the vertices as stored, the closing one included."""
    n = F.size(ring)
    return F.struct((total(xs(ring)) / n).alias("x"), (total(ys(ring)) / n).alias("y"))


def _turned_left(ring: Column) -> Column:
    """Each vertex replaced by its successor (the first one follows the last)."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def _turned_right(ring: Column) -> Column:
    """Each vertex replaced by its predecessor."""
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area; a ring without vertices has area 0."""
    cross = F.zip_with(ring, _turned_left(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) == 0, F.lit(0.0)).otherwise(F.abs(total(cross)) / 2)


def rings_area(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + ring_area(r))


# Fixed value: guards the division of a horizontal edge.
TINY = 1e-12


def ring_edges(ring: Column) -> Column:
    """Edges of a closed walk over the ring: each vertex (xi, yi) with its predecessor (xj, yj)."""
    return F.zip_with(ring, _turned_right(ring), lambda cur, prev: F.struct(
        cur["x"].alias("xi"), cur["y"].alias("yi"), prev["x"].alias("xj"), prev["y"].alias("yj")))


def _odd_crossings(x: Column, y: Column, edges: Column, guard: str) -> Column:
    def crosses(e: Column) -> Column:
        rise = e["yj"] - e["yi"]
        divisor = rise + TINY if guard == "add" else F.when(rise == 0, F.lit(TINY)).otherwise(rise)
        at = (e["xj"] - e["xi"]) * (y - e["yi"]) / divisor + e["xi"]
        return ((e["yi"] > y) != (e["yj"] > y)) & (x < at)

    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != crosses(e))


def in_ring(x: Column, y: Column, ring: Column, guard: str = "add") -> Column:
    """Even-odd test of a point against one ring.

    The two data sets differ in how a horizontal edge is guarded: `add` adds a tiny value to every
    divisor, `replace` uses it only in place of a zero divisor. Crossing edges are never horizontal,
    so they only differ for points within rounding of an edge.
    """
    return _odd_crossings(x, y, ring_edges(ring), guard)


def prepared_rings(rings: Column) -> Column:
    """Rings with extent and edges worked out, so that testing many points costs one walk each."""
    return F.transform(rings, lambda r: F.struct(
        F.array_min(xs(r)).alias("x0"), F.array_min(ys(r)).alias("y0"),
        F.array_max(xs(r)).alias("x1"), F.array_max(ys(r)).alias("y1"),
        ring_edges(r).alias("edges")))


def holds(x: Column, y: Column, r: Column, guard: str = "add") -> Column:
    """Whether one of the `prepared_rings` holds the point; its extent is tried first."""
    return ((x >= r["x0"]) & (x <= r["x1"]) & (y >= r["y0"]) & (y <= r["y1"])
            & _odd_crossings(x, y, r["edges"], guard))


def in_any_ring(x: Column, y: Column, prepared: Column, guard: str = "add") -> Column:
    """True when one of the `prepared_rings` holds the point."""
    return F.coalesce(F.exists(prepared, lambda r: holds(x, y, r, guard)), F.lit(False))


def point_pairs(values: Column) -> Column:
    """`[[x, y], ...]` -> array<struct<x,y>>."""
    return F.transform(
        values, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    )
