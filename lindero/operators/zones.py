"""Which zones, layer features and parcels a point or box meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.functions import geometry as G
from lindero.operators.skew import first_per_key, last_per_key, salted_join
from lindero.operators.spatial import PLACE_ROWS, PlaceZones, box_join, first_in_zones, gathered, \
    point_box, points_in_zones
from lindero.session import settle

# Layers in order of inquiry, heritage layers, and the property names read from them.
LAYERS = (
    "n15_UNIDADES_GESTION",
    "n25_AREAS_MODIF_URBANISTICAS",
    "n22_INSTRUMENTOS_PLANEAMIENTO",
    "n12_USOS_PORMENORIZADOS",
    "n06_NUCLEOS_RURALES",
    "n07_SIST_GENERALES_AREAS",
)
HERITAGE_LAYERS = ("n23_ELEM_CATALOGADOS_AREAS", "n27_BICS")
AREA_NAME, LABEL = "Nombre_del_Area", "Etiqueta"
INSTRUMENT_NAME, OFFICIAL_NAME = "Denominación_Instrumento", "Nombre_Oficial"
ORDINANCE_NAME = "Nombre_de_Ordenanza"
USE, USE_DETAIL = "Uso_predominante", "Uso_Predominante"
FLOOR_RATIO, DENSITY = "Edificabilidad_(m.2/m.2)", "Densidad_(Viv./Ha.)"
ACTION_SYSTEM = "Sistema_de_Actuación"
HERITAGE_NAMES = ("Nombre_del_BIC", "Denominación_Elemento_Protegido", LABEL)
PROTECTION, HERITAGE_KIND = "Nivel_de_Protección", "Tipo_de_Patrimonio"
# Features returned per point and layer, and the reach of the heritage inquiry.
PER_LAYER, HERITAGE_REACH = 10, 50.0


def filled(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


# ---- zones ------------------------------------------------------------------------------------


def zone_hits(points: DataFrame, zones: DataFrame, point_id: str, **opts) -> DataFrame:
    """All zones that hold each point, with `area` of the zone and `rank` by area (1 = smallest).

    Zone columns: id, ficha_id, categoria, ficha_url, rings, ord. `ord` decides between equal areas.
    """
    sized = zones.select("id", "ficha_id", "categoria", "ficha_url", "rings", "ord",
                         G.rings_area(F.col("rings")).alias("area"))
    return points_in_zones(points, sized, point_id, **opts)


def main_zone(hits: DataFrame, point_id: str) -> DataFrame:
    """The most specific zone of each point: the smallest, then the earliest listed."""
    return first_per_key(hits, [point_id], [F.col("area"), F.col("ord")])


def main_zones(points: DataFrame, zones: DataFrame, point_id: str, **opts) -> DataFrame:
    """The most specific zone of each point, as `main_zone` of all its hits, without listing them."""
    sized = zones.select("id", "ficha_id", "categoria", "ficha_url", "rings", "ord",
                         G.rings_area(F.col("rings")).alias("area"))
    return main_zone(first_in_zones(points, sized, point_id, ["area", "ord"], **opts), point_id)


def overlapping_zones(hits: DataFrame, point_id: str) -> DataFrame:
    """The other zones of each point, by rank after the main one.

    One aggregate over the hits, so the join below it runs once; a point gathers its own zones only.
    """
    rest = [c for c in hits.columns if c not in (point_id, "area", "ord")]
    gathered = hits.groupBy(point_id).agg(
        F.array_sort(F.collect_list(F.struct("area", "ord", *rest))).alias("_all"))
    others = F.filter("_all", lambda z: z["id"] != F.col("_all")[0]["id"])
    return gathered.select(point_id, F.explode(others).alias("_z")).select(
        *[F.col(c) if c == point_id else F.col(f"_z.{c}") for c in hits.columns])


def all_zones(points: DataFrame, zones: DataFrame, point_id: str, **opts) -> DataFrame:
    """(point_id, id) for every zone that holds each point.

    A place is looked up once for all its points, which come back where the pairs are made: no pair is
    shuffled.
    """
    opts.setdefault("floor_rows", PLACE_ROWS)
    met = zone_hits(gathered(points, point_id), zones, "_place", **opts)
    return met.select(F.explode("_ids").alias(point_id), "id")


def other_zones(points: DataFrame, zones: DataFrame, point_id: str, **opts) -> DataFrame:
    """(point_id, id) for every zone that holds a point but its main one, as `overlapping_zones` of all hits.

    The zones of a place are put in order once for all its points, in one row, and no pair is shuffled.
    """
    places = gathered(points, point_id)
    ranked = zones_by_rank(places, zones, **opts).of(places)
    # The list is worked out once: as the one element of an array, and without the filter that `explode` adds.
    others = F.transform(F.array(F.transform("_all", lambda z: z["id"])),
                         lambda ids: F.filter(ids, lambda i: i != ids[0]))[0]
    return ranked.select("_ids", F.explode_outer(others).alias("id")).filter("id is not null").select(
        F.explode("_ids").alias(point_id), "id")


def zones_by_rank(places: DataFrame, zones: DataFrame, **opts) -> PlaceZones:
    """The zones of each place from small to large, as structs of area, ord and id."""
    return PlaceZones(places, zones.select("rings", G.rings_area(F.col("rings")).alias("area"), "ord", "id"),
                      ["area", "ord", "id"], **opts)


def keys_in_zones(points: DataFrame, zones: DataFrame, point_id: str, guard: str = "replace",
                  **opts) -> DataFrame:
    """Points that lie in any of the zones, each once."""
    inside = first_in_zones(
        points.select(point_id, "x", "y"), zones.select("rings"), point_id, [], guard=guard, **opts)
    return points.join(inside.select(point_id).distinct(), point_id, "left_semi")


def zone_summary(features: DataFrame) -> DataFrame:
    """Extent, mean of all vertices and their number per label; a later feature replaces an earlier.

    features(layer, categoria, layer_ord, ord, props, rings) with all rings, holes included.
    """
    p = F.col("props")
    label = F.trim(F.coalesce(filled(p[LABEL]), filled(p[AREA_NAME]), filled(p[INSTRUMENT_NAME]),
                              F.lit("")))
    pts = F.flatten("rings")
    box, mean = G.bbox(pts), G.vertex_mean(pts)
    each = features.filter(F.size(F.flatten("rings")) > 0).select(
        label.alias("etiqueta"), "categoria", "layer", "layer_ord", "ord",
        box["x0"].alias("xmin"), box["y0"].alias("ymin"), box["x1"].alias("xmax"),
        box["y1"].alias("ymax"), F.bround(mean["x"], 2).alias("cx"),
        F.bround(mean["y"], 2).alias("cy"), F.size(pts).alias("n_points"),
    ).filter(F.col("etiqueta") != "")
    return last_per_key(each, ["etiqueta"], [F.col("layer_ord"), F.col("ord")]).drop(
        "layer_ord", "ord")


# ---- layer features ---------------------------------------------------------------------------


def features_at(points: DataFrame, features: DataFrame, point_id: str, reach: float = 0.0,
                per_layer: int = PER_LAYER, **opts) -> DataFrame:
    """Features of the point's municipality at each point, at most ten per layer by `ord`.

    `resolve_names` reads the first of each layer only, so one per layer is enough for it.

    points(point_id, x, y, id_ine); features(layer, id_municipio, ord, props, rings), keyed by the
    first three. With a reach, a feature counts when its extent meets the square of that half-side around the point. The limit
    is applied in every task before the shuffle, so a crowded layer moves ten rows per point.
    """
    slim = ("layer", "ord", "id_municipio")
    at = points.select(point_id, "x", "y", "id_ine")
    pairs = first_in_zones(
        at, features.select(*slim, "rings"), point_id, ["ord"], ["id_municipio", "layer"], per_layer,
        reach if reach > 0 else None, **opts)
    own = pairs.filter(F.col("id_municipio") == F.col("id_ine")).select(point_id, *slim)
    order = Window.partitionBy(point_id, "layer").orderBy("ord")
    first = own.withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= per_layer).drop("_n")
    # Only keys are ranked; the properties join the few rows that are left. A feature that covers a
    # whole town has a row for every point there, so its rows are split.
    return salted_join(settle(first, "ranked"), features.drop("rings"), list(slim), [point_id])


def heritage_near(points: DataFrame, features: DataFrame, point_id: str, **opts) -> DataFrame:
    """Heritage features within 50 m of each point, with their first filled name."""
    near = features_at(points, features.filter(F.col("layer").isin(*HERITAGE_LAYERS)), point_id,
                       HERITAGE_REACH, **opts)
    p = F.col("props")
    return near.select(
        point_id, F.col("layer").alias("tipo"), "ord",
        F.coalesce(*[filled(p[n]) for n in HERITAGE_NAMES]).alias("nombre"),
        p[PROTECTION].alias("nivel_proteccion"), p[HERITAGE_KIND].alias("tipo_patrimonio"),
        p[LABEL].alias("etiqueta"),
    )


def resolve_names(found: DataFrame, point_id: str) -> DataFrame:
    """One row per point with features: the zone's name, where it came from, its label and figures.

    `found` is the result of `features_at`. Only the first feature of each layer is read.
    """
    names = (LABEL, AREA_NAME, INSTRUMENT_NAME, OFFICIAL_NAME, ORDINANCE_NAME, USE, USE_DETAIL,
             FLOOR_RATIO, DENSITY, ACTION_SYSTEM)
    row = F.struct(F.col("ord").alias("o"),
                   *[F.col("props")[n].alias(f"p{i}") for i, n in enumerate(names)])
    at = {n: f"p{i}" for i, n in enumerate(names)}
    first = found.groupBy(point_id).agg(*[
        F.min(F.when(F.col("layer") == layer, row)).alias(layer) for layer in LAYERS])

    def prop(layer: str, name: str) -> Column:
        return filled(F.col(layer)[at[name]])

    unit, changed, instrument, uses, hamlet, _ = LAYERS
    direct = F.coalesce(*[prop(layer, n) for layer in (unit, changed)
                          for n in (AREA_NAME, LABEL)])
    chain = (INSTRUMENT_NAME, OFFICIAL_NAME, ORDINANCE_NAME, LABEL)
    spare = F.coalesce(*[prop(layer, n) for layer in (instrument, hamlet, uses) for n in chain])
    label = F.coalesce(*[prop(layer, LABEL) for layer in (unit, changed, instrument)])
    real = F.col(unit).isNotNull() | F.col(changed).isNotNull() | F.col(instrument).isNotNull()
    return first.select(
        point_id, F.coalesce(direct, spare).alias("ambito"), label.alias("etiqueta"),
        real.alias("has_card_zone"),
        F.coalesce(prop(unit, USE), F.col(uses)[at[USE_DETAIL]]).alias("uso_predominante"),
        F.col(unit)[at[FLOOR_RATIO]].try_cast("double").alias("edificabilidad"),
        F.col(unit)[at[DENSITY]].try_cast("double").alias("densidad_viv_ha"),
        F.col(unit)[at[ACTION_SYSTEM]].alias("sistema_actuacion"),
    )


# ---- parcels ----------------------------------------------------------------------------------


def parcels_in_boxes(requests: DataFrame, parcels: DataFrame, chunks: DataFrame,
                     request_id: str, **opts) -> DataFrame:
    """Parcels whose extent meets each requested box, when the known chunks cover the box.

    requests(request_id, box); chunks(x1, y1, x2, y2). Covered means inside the rectangle around all
    chunks. A box that is not covered yields one row with `covered` false and no parcel. Equal boxes are
    looked up once; their requests come back where the pairs are made.
    """
    opts.setdefault("floor_rows", PLACE_ROWS)
    cover = chunks.agg(F.struct(
        F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x2").alias("x1"),
        F.max("y2").alias("y1")).alias("c")).scalar()
    b, c = F.col("box"), F.col("_c")
    inside = (c["x0"] <= b["x0"]) & (c["x1"] >= b["x1"]) & (c["y0"] <= b["y0"]) \
        & (c["y1"] >= b["y1"])
    marked = requests.withColumn("_c", cover).withColumn(
        "covered", F.coalesce(inside, F.lit(False))).drop("_c")
    boxed = parcels.filter(F.size("poly") > 0).withColumn("_box", G.bbox(F.col("poly")))
    row = F.struct(*[c for c in marked.columns if c != "box"]).alias("_row")
    same = gathered(marked.filter("covered").select(row, "box"), "_row", ["box"])
    met = box_join(same, boxed, "box", "_box", "_place", **opts)
    hits = met.select(F.explode("_ids").alias("_row"), "box", *parcels.columns).select(
        "_row.*", "box", *parcels.columns)
    open_boxes = marked.filter(~F.col("covered"))
    return hits.unionByName(open_boxes, allowMissingColumns=True)


def parcel_polygon(keys: DataFrame, own: DataFrame, index: DataFrame) -> DataFrame:
    """The key's own polygon record when there is one, else the record of the chunk index."""
    def shaped(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("refcat").alias("rc14"),
                         F.struct("label", "area_m2", "poly").alias(name))
    out = keys.join(shaped(own, "_own"), "rc14", "left").join(shaped(index, "_idx"), "rc14", "left")
    best = F.coalesce("_own", "_idx")
    return out.select(
        *keys.columns, best["label"].alias("label"), best["area_m2"].alias("area_m2"),
        best["poly"].alias("poly"),
        F.when(F.col("_own").isNotNull(), "own").when(F.col("_idx").isNotNull(), "index")
        .alias("tier"))


def surroundings(points: DataFrame, parcels: DataFrame, units: DataFrame, point_id: str,
                 reach: float = 80.0, **opts) -> DataFrame:
    """Parcels and units within the square of half-side `reach` around each point.

    Units are counted per parcel first, so only counts travel through the spatial join.
    """
    per = units.groupBy("rc14").agg(F.count(F.lit(1)).alias("_units"))
    counted = parcels.filter(F.size("poly") > 0).select(
        F.col("refcat"), G.bbox(F.col("poly")).alias("_box")
    ).join(per, F.col("refcat") == F.col("rc14"), "left").drop("rc14")
    around = points.select(point_id, point_box(F.col("x"), F.col("y"), reach).alias("_around"))
    hits = box_join(around, counted, "_around", "_box", point_id, **opts)
    sums = hits.groupBy(point_id).agg(
        F.count(F.lit(1)).alias("n_parcels"), F.sum(F.coalesce("_units", F.lit(0))).alias("n_units"))
    return points.join(sums, point_id, "left").withColumn(
        "n_parcels", F.coalesce("n_parcels", F.lit(0))).withColumn(
        "n_units", F.coalesce("n_units", F.lit(0)))


def build_coords(parcels: DataFrame, units: DataFrame, suffix: str) -> DataFrame:
    """Coordinates table: vertex mean of each parcel's first record, address of its first unit.

    parcels(file, pos, refcat, poly); units(rc14, pos, address).
    """
    from lindero.functions.text import registry_address

    placed = first_per_key(
        parcels.filter(F.size("poly") > 0).select("refcat", "file", "pos", "poly"),
        ["refcat"], [F.col("file"), F.col("pos")])
    mean = G.vertex_mean(F.col("poly"))
    first_unit = first_per_key(units.select("rc14", "pos", "address"), ["rc14"], [F.col("pos")])
    return placed.select(F.col("refcat").alias("rc14"), mean["x"].alias("x"), mean["y"].alias("y")) \
        .join(first_unit.select("rc14", "address"), "rc14", "left") \
        .withColumn("address", registry_address(F.coalesce("address", F.lit("")), suffix))


