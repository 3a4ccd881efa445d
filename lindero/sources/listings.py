"""Listings and cards in HTML pages. Each takes pages(page, body) in listing order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions.keys import strip
from lindero.functions.text import card_meta
from lindero.operators.skew import first_per_key

# Link forms of the three listings and of the index map.
URBAN_LINK = (
    r'href="(/documents/35127/[a-f0-9-]+)\?[^"]*"\s+class="card-title"[^>]*>\s*(PLANO[^\s<]+\.pdf)'
)
RURAL_LINK = (
    r'(?i)href="(/documents/35127/[^"]+)"\s*class="card-title"[^>]*>\s*PLANO_([A-J])_(\d+)\.pdf'
)
CARD_LINK = r'(?i)href="(/documents/35127/[^"]+)"\s*class="card-title"[^>]*>\s*([^<\s][^<]*?\.pdf)'
INDEX_MAP = r'(?i)href="(/documents/[^"]+MAPA[^"]*GUIA[^"]+\.pdf[^"]*)"'
# Fixed value: a complete urban listing has at least this many sheets.
MIN_SHEETS = 100


def strip_thumbnail(url: Column) -> Column:
    return F.regexp_replace(url, r"[?&]documentThumbnail=\d+", "")


def _links(pages: DataFrame, pattern: str, groups: int) -> DataFrame:
    """(page, pos, g1..gn) of every link."""
    found = F.arrays_zip(*[
        F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(i)).alias(f"g{i}")
        for i in range(1, groups + 1)])
    return pages.select("page", F.posexplode(found).alias("pos", "_l")).select(
        "page", "pos", "_l.*")


def _first_url(links: DataFrame, name: str) -> DataFrame:
    return first_per_key(links.select(name, "url", "page", "pos"), [name],
                         [F.col("page"), F.col("pos")])


def urban_sheets(pages: DataFrame, base: str, minimum: int = MIN_SHEETS) -> DataFrame:
    """(sheet_name, url), the first address of each normalised name.

    Fails at once when the listing is incomplete, an empty one too: the names are counted here, so
    the check does not hang on which columns or rows a caller reads later.
    """
    links = _links(pages, URBAN_LINK, 2)
    rest = F.regexp_replace("g2", r"^PLANO_+", "")
    name = F.concat(F.lit("PLANO_"), F.regexp_replace(rest, r"[-_]+", "_"))
    sheets = _first_url(links.select(
        name.alias("sheet_name"), F.concat(F.lit(base), "g1").alias("url"), "page", "pos"),
        "sheet_name")
    n = sheets.count()
    if n < minimum:
        raise ValueError(f"incomplete sheet listing: {n} < {minimum}")
    return sheets.select("sheet_name", "url")


def rural_sheets(pages: DataFrame, base: str) -> DataFrame:
    """(sheet_name, url, index_map): rural sheets, thumbnail parameters removed, and the address of
    the index map (the first one found, null without)."""
    links = _links(pages, RURAL_LINK, 3)
    name = F.concat(F.lit("PLANO_"), F.upper("g2"), F.lit("_"),
                    F.col("g3").cast("int").cast("string"), F.lit(".pdf"))
    sheets = _first_url(links.select(
        name.alias("sheet_name"), strip_thumbnail(F.concat(F.lit(base), "g1")).alias("url"),
        "page", "pos"), "sheet_name")
    found = pages.filter(F.col("body").rlike(INDEX_MAP)).agg(F.min_by(
        F.concat(F.lit(base), F.regexp_extract("body", INDEX_MAP, 1)), "page").alias("m"))
    return sheets.select("sheet_name", "url").withColumn("index_map", found.scalar())


def card_listing(pages: DataFrame, base: str) -> DataFrame:
    """(filename, url, tipo, codigo, num, ord): the first link of each record card; ord is
    (page, pos), in listing order."""
    links = _links(pages, CARD_LINK, 2).select(
        strip(F.col("g2")).alias("filename"), F.concat(F.lit(base), "g1").alias("url"), "page",
        "pos")
    return _first_url(links, "filename").withColumn("_m", card_meta(F.col("filename"))).select(
        "filename", "url", "_m.*",
        F.struct("page", "pos").alias("ord"))


# Layout of a zone card page.
CARD_HEAD = (
    r"(?s)<h3>\s*Clase:\s*([^<]+?)</h3>.*?<h4>\s*Categoría:\s*([^<]+?)</h4>.*?"
    r"<h4>\s*Plan de Desarrollo:\s*([^<]+?)</h4>.*?<h4>\s*Iniciativa:\s*([^<]+?)</h4>"
)
CARD_NAME = r"(?s)<h2>\s*([^<]+?)\s*</h2>\s*<h3>\s*Clase:"
CARD_PDF = r'href="(https://[^"/]+/doc/Urbanismo/PGO/Fichas/[^"]+\.pdf)'
PLAN_PDF = r'href="(https://[^"/]+/doc/Urbanismo/PGO/Planos/[^"]+\.pdf)'


def zone_cards(pages: DataFrame) -> DataFrame:
    """Card fields of pages(zone, body); cards with neither class nor category are left out."""
    body = F.col("body")

    def part(pattern: str, i: int = 1) -> Column:
        return F.nullif(strip(F.regexp_extract(body, pattern, i)), F.lit(""))

    out = pages.select(
        "zone", part(CARD_HEAD, 1).alias("clase"), part(CARD_HEAD, 2).alias("categoria"),
        part(CARD_HEAD, 3).alias("plan_desarrollo"), part(CARD_HEAD, 4).alias("iniciativa"),
        part(CARD_NAME).alias("nombre_largo"), part(CARD_PDF).alias("ficha_pdf_url"),
        part(PLAN_PDF).alias("plano_pdf_url"))
    return out.filter(F.col("clase").isNotNull() | F.col("categoria").isNotNull())
