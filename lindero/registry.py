"""Municipality registry: extent and grid figures that the location job needs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Municipality:
    """One entry. Urban grid figures are None where no paginated sheets exist; so is `snu_*`."""

    id_ine: int
    slug: str
    xmin: float
    ymin: float
    xmax: float
    ymax: float
    x0: float | None = None
    ymax_grid: float | None = None
    cell_w: float | None = None
    cell_h: float | None = None
    marg_x: float | None = None
    marg_y: float | None = None
    ns_thr: float = 0.5
    ew_thr: float = 0.5
    snu_x0: float | None = None
    snu_ymax: float | None = None
    snu_w: float | None = None
    snu_h: float | None = None
    snu_cols: int | None = None
    snu_rows: int | None = None
    snu_letters: str | None = None


# Extents, grid constants and rural grid of the two registered municipalities.
DEFAULT_REGISTRY: tuple[Municipality, ...] = (
    Municipality(
        id_ine=33044, slug="m33044",
        xmin=253000.0, ymin=4798000.0, xmax=278000.0, ymax=4815000.0,
        x0=253338.0196, ymax_grid=4812335.9516,
        cell_w=1036.1505, cell_h=695.3860, marg_x=12.5165, marg_y=10.9430,
        snu_x0=252290.93, snu_ymax=4811487.92, snu_w=29018.81, snu_h=16194.95,
        snu_cols=9, snu_rows=10, snu_letters="ABCDEFGHIJ",
    ),
    Municipality(
        id_ine=33024, slug="m33024",
        xmin=270921.0, ymin=4813038.0, xmax=292773.0, ymax=4829451.0,
    ),
)

# Compass corner of a cell -> quadrant numeral, and row letters.
QUADRANTS = {"NW": "I", "NE": "II", "SW": "III", "SE": "IV"}
ROW_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXY"

_DOUBLES = (
    "xmin", "ymin", "xmax", "ymax", "x0", "ymax_grid", "cell_w", "cell_h", "marg_x", "marg_y",
    "ns_thr", "ew_thr", "snu_x0", "snu_ymax", "snu_w", "snu_h",
)
_INTS = ("snu_cols", "snu_rows")


def town_keys(*tables: DataFrame) -> list[str]:
    """`id_ine`, to be joined or grouped on as well, where all the tables tell municipalities apart.

    Sheets, cells and quadrants have the same names in every gridded municipality.
    """
    return ["id_ine"] if all("id_ine" in t.columns for t in tables) else []


def as_struct(entry: Municipality) -> Column:
    """The entry as one struct literal, so expressions can read `m.cell_w` and the like."""
    parts = [F.lit(entry.id_ine).alias("id_ine"), F.lit(entry.slug).alias("slug")]
    parts += [F.lit(getattr(entry, n)).cast("double").alias(n) for n in _DOUBLES]
    parts += [F.lit(getattr(entry, n)).cast("int").alias(n) for n in _INTS]
    parts.append(F.lit(entry.snu_letters).cast("string").alias("snu_letters"))
    return F.struct(*parts)


def lookup_struct(id_col: Column, registry: Sequence[Municipality]) -> Column:
    """Struct of the entry with this `id_ine`, null when unknown. A projection, not a join."""
    out = None
    for entry in registry:
        hit = id_col == F.lit(entry.id_ine)
        out = F.when(hit, as_struct(entry)) if out is None else out.when(hit, as_struct(entry))
    return out


def first_containing(x: Column, y: Column, registry: Sequence[Municipality]) -> Column:
    """`id_ine` of the first entry, in registry order, whose extent holds the point; else null."""
    out = None
    for m in registry:
        inside = x.between(m.xmin, m.xmax) & y.between(m.ymin, m.ymax)
        out = F.when(inside, F.lit(m.id_ine)) if out is None else out.when(inside, F.lit(m.id_ine))
    return out
