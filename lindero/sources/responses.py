"""Parsing of landed responses. Each takes a DataFrame with the whole response in `body`.

Responses are bounded by the services' paging, so one response per row is safe; `read_texts` loads
them from a folder. Files of any size, as of a whole town's placemarks or parcels, are read element
by element with `read_elements`, whose rows suit the same parsers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero import schemas
from lindero.functions import geometry as G
from lindero.functions import grid, text
from lindero.functions.keys import strip
from lindero.operators.skew import first_per_key


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, body): one row per file below `path` (a glob is fine)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))


def read_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(file, at, body): one row per element of the name in the files below `path`.

    The closing tag ends a record, so Spark splits a large file between elements and many tasks read
    it; `at` orders the elements of a file. What stands between elements is left out. Elements of
    one name must not hold each other.
    """
    closing = f"</{tag}>"
    rows = spark.read.option("lineSep", closing).text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("at"), "value")
    start = F.locate(f"<{tag}", F.col("value"))
    return rows.filter(start > 0).select(
        "file", "at", F.concat(F.substr("value", start), F.lit(closing)).alias("body"))


def _group(body: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null when there is no match."""
    return F.when(body.rlike(pattern), F.regexp_extract(body, pattern, group))


# ---- parcels ----------------------------------------------------------------------------------

# Elements of a parcel response.
PARCEL = r'(?s)<cp:CadastralParcel[^>]*gml:id="([^"]+)".*?</cp:CadastralParcel>'
REFERENCE = r"<cp:nationalCadastralReference>([^<]+)</cp:nationalCadastralReference>"
PARCEL_LABEL = r"<cp:label>([^<]+)</cp:label>"
PARCEL_AREA = r"<cp:areaValue[^>]*>([0-9.]+)</cp:areaValue>"
POSITIONS = r"<gml:posList[^>]*>([^<]+)</gml:posList>"


def position_ring(text_col: Column) -> Column:
    """`x y x y ...` -> ring; an odd last number is left out."""
    v = F.transform(F.split(strip(text_col), r"\s+"), lambda t: t.cast("double"))
    pairs = F.floor(F.size(v) / 2).cast("int")
    ring = F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.struct(
        F.get(v, i * 2).alias("x"), F.get(v, i * 2 + 1).alias("y")))
    return F.when(pairs > 0, ring).otherwise(F.array().cast(schemas.RING))


def parse_parcels(responses: DataFrame) -> DataFrame:
    """Parcel rows of area responses: refcat, label ('' when absent), area_m2, poly.

    The first position list of each parcel counts; parcels without reference or positions are left
    out. Other columns of the input are kept, `pos` is the place in the response.
    """
    keep = [c for c in responses.columns if c != "body"]
    blocks = F.regexp_extract_all(F.col("body"), F.lit(PARCEL), F.lit(0))
    b = responses.select(*keep, F.posexplode(blocks).alias("pos", "_b"))
    out = b.select(
        *keep, "pos", _group(F.col("_b"), REFERENCE).alias("refcat"),
        F.coalesce(_group(F.col("_b"), PARCEL_LABEL), F.lit("")).alias("label"),
        _group(F.col("_b"), PARCEL_AREA).cast("double").alias("area_m2"),
        _group(F.col("_b"), POSITIONS).alias("_p"))
    return out.filter(F.col("refcat").isNotNull() & F.col("_p").isNotNull()).withColumn(
        "poly", position_ring(F.col("_p"))).drop("_p")


def parse_single_parcels(responses: DataFrame) -> DataFrame:
    """One polygon row per single-parcel response; responses without positions give none."""
    keep = [c for c in responses.columns if c != "body"]
    body = F.col("body")
    return responses.filter(body.rlike(POSITIONS)).select(
        *keep, _group(body, PARCEL_LABEL).alias("label"),
        _group(body, PARCEL_AREA).cast("double").alias("area_m2"),
        position_ring(_group(body, POSITIONS)).alias("poly"))


def parse_chunks(files: DataFrame) -> DataFrame:
    """Parcels of chunk files(file, body), the first file (by name) winning per reference.

    A malformed file is skipped.
    """
    parsed = files.select("file", F.from_json("body", schemas.CHUNK_PARCEL).alias("_p"))
    rows = parsed.select("file", F.posexplode("_p").alias("pos", "_p")).select(
        "file", "pos", "_p.refcat", F.coalesce("_p.label", F.lit("")).alias("label"),
        "_p.area_m2", G.point_pairs(F.col("_p.poly_utm")).alias("poly"))
    named = rows.filter(F.coalesce("refcat", F.lit("")) != "")
    return first_per_key(named, ["refcat"], [F.col("file"), F.col("pos")])


# ---- units ------------------------------------------------------------------------------------


def parse_units(responses: DataFrame) -> DataFrame:
    """Unit rows of registry responses(rc14, body): rc14, pos, rc, address, floor, door, stair,
    use, area_m2, year. The record list may be an array or a single object; without one the single
    property of the response counts."""
    parsed = responses.select(
        "rc14", F.from_json("body", schemas.UNIT_RESPONSE)["consulta_dnprcResult"].alias("_r"))
    listed = F.col("_r.lrcdnp.rcdnp")
    record = schemas.UNIT_RECORD
    many = F.when(listed.startswith("["), F.from_json(listed, f"array<{record}>"))
    one = F.when(listed.startswith("{"), F.array(F.from_json(listed, record)))
    single = F.when(F.col("_r.bico.bi").isNotNull(), F.array(F.col("_r.bico.bi")))
    filled = F.filter(F.coalesce(many, one, F.array().cast(f"array<{record}>")),
                      lambda r: r.isNotNull())
    records = F.when(F.size(filled) > 0, filled).otherwise(single)
    u = parsed.select("rc14", F.posexplode(records).alias("pos", "_u"))
    r, blank = F.col("_u"), F.lit("")
    key = F.coalesce(r["rc"], r["idbi"]["rc"])
    urban = r["dt"]["locs"]["lous"]["lourb"]
    year = r["debi"]["ant"]
    return u.select(
        "rc14", "pos",
        F.concat(*[F.coalesce(key[p], blank) for p in ("pc1", "pc2", "car", "cc1", "cc2")])
        .alias("rc"),
        text.urban_address(urban["dir"]["tv"], urban["dir"]["nv"], urban["dir"]["pnp"])
        .alias("address"),
        F.coalesce(urban["loint"]["pt"], blank).alias("floor"),
        F.coalesce(urban["loint"]["pu"], blank).alias("door"),
        F.coalesce(urban["loint"]["es"], blank).alias("stair"),
        F.coalesce(r["debi"]["luso"], blank).alias("use"),
        text.safe_int(r["debi"]["sfc"]).alias("area_m2"),
        F.when(year.rlike(r"^\d+$"), year.try_cast("int")).alias("year"))


def parse_rural_addresses(responses: DataFrame) -> DataFrame:
    """(rc14, address) composed from place, block, plot and town of the single property."""
    r = F.from_json("body", schemas.UNIT_RESPONSE)["consulta_dnprcResult"]["bico"]["bi"]["dt"]
    parsed = responses.select("rc14", r.alias("_d"))
    land = F.col("_d.locs.lors.lorus")
    return parsed.select("rc14", text.rural_address(
        land["npa"], land["cpp"]["cpo"], land["cpp"]["cpa"], F.col("_d.nm")).alias("address"))


# ---- layer features and zones -------------------------------------------------------------------


def outer_rings(geometry: Column) -> Column:
    """Outer rings of a Polygon or MultiPolygon; anything else has none. Holes are left out."""
    kind, raw = geometry["type"], geometry["coordinates"]
    polygon = F.from_json(raw, "array<array<array<double>>>")
    many = F.from_json(raw, "array<array<array<array<double>>>>")
    first = F.when(F.size(polygon) > 0, F.array(F.get(polygon, F.lit(0))))
    firsts = F.transform(F.filter(many, lambda p: F.size(p) > 0), lambda p: F.get(p, F.lit(0)))
    rings = F.when(kind == "Polygon", first).when(kind == "MultiPolygon", firsts)
    return F.coalesce(F.transform(rings, G.point_pairs), F.array().cast(schemas.RINGS))


def parse_features(pages: DataFrame) -> DataFrame:
    """Features of layer pages(layer, page, body): layer, page, pos, props, rings (outer only).

    All pages of a layer are taken.
    """
    parsed = pages.select(
        "layer", "page", F.from_json("body", schemas.FEATURE_PAGE)["features"].alias("_f"))
    return parsed.select("layer", "page", F.posexplode("_f").alias("pos", "_f")).select(
        "layer", "page", "pos", F.col("_f.properties").alias("props"),
        outer_rings(F.col("_f.geometry")).alias("rings"))


# Elements of a placemark.
PLACEMARK = (
    r"(?s)<Placemark>\s*<name>([^<]+)</name>\s*<description>(.*?)</description>.*?"
    r"(<MultiGeometry>.*?</MultiGeometry>|<Polygon>.*?</Polygon>)\s*</Placemark>"
)
PLACEMARK_POLYGON = r"(?s)<Polygon>.*?<coordinates>\s*(.*?)\s*</coordinates>"
CARD_ID = r'(?i)id=([A-Z0-9 _-]+?)(?:[>"]|$)'


def parse_zones(files: DataFrame, card_url: str) -> DataFrame:
    """Zones of placemark files(file, body): id, ficha_id, categoria, ficha_url, rings, file, pos.

    Rings need three valid points and are turned from longitude/latitude into ground metres;
    placemarks without a ring are left out.
    """
    marks = files.select("file", F.posexplode(
        F.regexp_extract_all(F.col("body"), F.lit(PLACEMARK), F.lit(0))).alias("pos", "_m"))
    m = F.col("_m")
    name = strip(F.regexp_extract(m, PLACEMARK, 1))
    given = _group(F.regexp_extract(m, PLACEMARK, 2), CARD_ID)
    lists = F.regexp_extract_all(
        F.regexp_extract(m, PLACEMARK, 3), F.lit(PLACEMARK_POLYGON), F.lit(1))

    def degrees(raw: Column) -> Column:
        parts = F.transform(F.split(raw, r"\s+"), lambda t: F.split(t, ","))
        pairs = F.transform(parts, lambda p: F.struct(
            text.to_double(F.get(p, F.lit(0))).alias("lon"),
            text.to_double(F.get(p, F.lit(1))).alias("lat")))
        return F.filter(pairs, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())

    rings = F.filter(F.transform(lists, degrees), lambda r: F.size(r) >= 3)
    raw = marks.select("file", "pos", name.alias("id"), F.translate(
        F.coalesce(strip(given), name), " ", "_").alias("ficha_id"), rings.alias("_r"))
    ground = F.transform(
        "_r", lambda r: F.transform(r, lambda p: grid.lonlat_to_utm30(p["lon"], p["lat"])))
    return raw.filter(F.size("_r") > 0).select(
        "id", "ficha_id", F.substring_index("id", "-", 1).alias("categoria"),
        F.concat(F.lit(card_url), "ficha_id").alias("ficha_url"), ground.alias("rings"),
        "file", "pos")
