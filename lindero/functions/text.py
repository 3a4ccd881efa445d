"""Names, numbers, glyphs and phrases."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lindero.functions.keys import strip

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def loose_name(text: Column) -> Column:
    """Upper case, dashes and underscores as blanks, Ñ as N. Runs of blanks stay as they are."""
    return F.translate(F.upper(F.coalesce(text, F.lit(""))), "-_Ñ", "  N")


def tight_name(text: Column) -> Column:
    """`loose_name` with runs of white space reduced to one blank and the ends stripped."""
    return strip(F.regexp_replace(loose_name(text), r"\s+", " "))


def squeezed(text: Column) -> Column:
    """Upper case with single blanks, as labels on a record card are compared."""
    return F.regexp_replace(F.upper(strip(text)), r"\s+", " ")


def to_double(text: Column) -> Column:
    """Plain decimal text -> double; anything else is null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


# Unit suffixes, in the order in which they are removed.
UNIT_SUFFIXES = ("m2c/m2", "m2/viv", "Viv/Ha", "m2", "Viv", "u.a.h.", "PLANTAS", "%")


def european_number(text: Column, units: Sequence[str] = UNIT_SUFFIXES) -> Column:
    """`1.234,5 m2` -> 1234.5. With no `units` only blanks and % signs are taken off."""
    out = F.regexp_replace(strip(text), r"\s*%+$", "")
    if units:
        out = F.regexp_replace(out, " ", "")
        # Each step reads the one before once, so the expression stays small.
        for unit in units:
            out = F.regexp_replace(out, rf"\s*{re.escape(unit)}$", "")
    # Most texts are plain numbers, of which nothing is taken off.
    plain = text.rlike(r"\A[0-9.,-]*\z")
    return to_double(F.translate(F.when(plain, text).otherwise(out), ",.", "."))


def european_int(text: Column, units: Sequence[str] = UNIT_SUFFIXES) -> Column:
    """As `european_number`, rounded half to even."""
    return F.bround(european_number(text, units), 0).cast("int")


def safe_int(text: Column) -> Column:
    """Decimal comma or point, rounded half to even; 0 when absent or not a number."""
    number = to_double(strip(F.translate(text, ",", ".")))
    return F.coalesce(F.bround(number, 0).cast("int"), F.lit(0))


# Glyphs of the card font that are not shifted capitals.
GLYPHS = {
    "Ϭ": "0", "ϭ": "1", "Ϯ": "2", "ϯ": "3", "ϰ": "4",
    "ϱ": "5", "ϲ": "6", "ϳ": "7", "ϴ": "8", "ϵ": "9",
    "͕": ",", "͘": ".", "й": "%", "͗": ":", "ͬ": "/",
    "Ͳ": "-", "Ï": "Ó", "Ò": "Ú",
}
_SHIFTED = [chr(c) for c in range(32, 91)]
# The form feed has no counterpart, so `translate` drops it.
GLYPH_FROM = "".join(_SHIFTED) + "\x03" + "".join(GLYPHS) + "\x0c"
GLYPH_TO = "".join(chr(ord(c) + 29) for c in _SHIFTED) + " " + "".join(GLYPHS.values())


def decode_glyphs(raw: Column) -> Column:
    """Readable text of a span set in the shifted card font."""
    return F.translate(raw, GLYPH_FROM, GLYPH_TO)


def phrase_pattern(phrase: str, bounded: bool = True) -> str:
    """Pattern for a phrase whose words may be separated by any white space."""
    body = r"\s+".join(re.escape(word) for word in phrase.split(" "))
    return rf"(?U)\b{body}\b" if bounded else f"(?U){body}"


def first_phrase(text: Column, phrases: Sequence[str], bounded: bool = True) -> Column:
    """First phrase, in list order, that the text contains; else null."""
    # A text without the phrase's longest word cannot match; that is found without a pattern.
    found = [F.when(text.contains(max(p.split(" "), key=len))
                    & text.rlike(phrase_pattern(p, bounded)), F.lit(p)) for p in phrases]
    return F.coalesce(*found)


# Canonical phrases of the second card layout.
USES = (
    "RESIDENCIAL VIVIENDA COLECTIVA",
    "RESIDENCIAL VIVIENDA UNIFAMILIAR",
    "RESIDENCIAL VIVIENDA",
    "PRODUCTIVO INDUSTRIAL/CIENTÍFICO TECNOLÓGICO",
    "PRODUCTIVO INDUSTRIAL / CIENTÍFICO TECNOLÓGICO",
    "PRODUCTIVO INDUSTRIAL",
    "PRODUCTIVO TERCIARIO COMERCIAL",
    "PRODUCTIVO TERCIARIO",
    "DOTACIONAL PRIVADO",
    "DOTACIONAL PÚBLICO",
    "DOTACIONAL SERVICIOS URBANOS",
    "DOTACIONAL",
    "TERCIARIO",
    "INDUSTRIAL",
)
SYSTEMS = ("COMPENSACIÓN", "COOPERACIÓN", "EXPROPIACIÓN")
INITIATIVES = ("PRIVADA", "PÚBLICA")
PLANNINGS = (
    "PLAN ESPECIAL DE REFORMA INTERIOR",
    "ESTUDIO DE DETALLE",
    "PLAN PARCIAL",
    "PLAN ESPECIAL",
    "NORMAS COMPLEMENTARIAS",
)
CATEGORIES = (
    "SUNC URBANO NO CONSOLIDADO",
    "SUC URBANO CONSOLIDADO",
    "SUR SUELO URBANIZABLE SECTORIZADO",
    "SUR SUELO URBANIZABLE",
    "URBANO NO CONSOLIDADO",
    "URBANO CONSOLIDADO",
    "URBANIZABLE SECTORIZADO",
    "URBANIZABLE",
)
CLASSES = ("SUELO URBANIZABLE", "SUELO URBANO", "SUELO NO URBANIZABLE")
INSTRUMENTS = (
    "PROYECTO DE COMPENSACIÓN",
    "PROYECTO DE URBANIZACIÓN",
    "PROYECTO DE ACTUACIÓN",
)


def land_category(text: Column) -> Column:
    """Category phrase, corrected by single tokens where the phrase is torn over several rows."""
    sunc, suc, sur = (text.contains(t) & text.rlike(rf"(?U)\b{t}\b") for t in ("SUNC", "SUC", "SUR"))
    word = text.contains("CONSOLIDADO")
    not_consolidated = word & text.rlike(r"(?U)NO\s+CONSOLIDADO")
    consolidated = word & text.rlike(r"(?U)\bCONSOLIDADO\b")
    sectorised = text.contains("SECTORIZADO")
    unc, uc, sectors, plain = CATEGORIES[:4]
    from_tokens = (
        F.when(sunc | (not_consolidated & ~consolidated), F.lit(unc))
        .when(suc | (consolidated & ~not_consolidated), F.lit(uc))
        .when(sur & sectorised, F.lit(sectors))
        .when(sur, F.lit(plain))
    )

    def corrected(phrase: Column) -> Column:
        return (
            F.when(phrase.isNull(), from_tokens)
            .when(text.contains("SUNC") & ~phrase.startswith("SUNC"), F.lit(unc))
            .when(
                text.contains("SUC") & ~phrase.startswith("SUC")
                & phrase.contains("URBANO CONSOLIDADO"),
                F.lit(uc),
            )
            .otherwise(phrase)
        )

    # One element, so that the phrase is looked for once.
    return F.transform(F.array(first_phrase(text, CATEGORIES)), corrected)[0]


# Kind, code and number inside a record card's file name.
CARD_KINDS = r"UG2?[E]?|UG1|AU[SE]?|AA|PE|PP|SUNC|API|SR|AM\d?|ASM"
CARD_TAIL = rf"_({CARD_KINDS})_([A-Z0-9]+(?:_\d+)?)_Ficha_n_(\d+)"


def card_meta(filename: Column) -> Column:
    """struct(tipo, codigo, num) of a record card; only `num` when the name is incomplete."""
    full = "(?i)" + CARD_TAIL
    found = filename.rlike(full)

    def group(i: int) -> Column:
        return F.when(found, F.regexp_extract(filename, full, i))

    spare = F.nullif(F.regexp_extract(filename, r"_Ficha_n_(\d+)", 1), F.lit(""))
    return F.struct(
        F.upper(group(1)).alias("tipo"), F.upper(group(2)).alias("codigo"),
        F.coalesce(group(3), spare).try_cast("int").alias("num"),
    )


def card_name_parts(stem: Column) -> Column:
    """struct(nombre, tipo, codigo) of a full card name read from its start; null otherwise."""
    full = "(?i)^(.+?)" + CARD_TAIL
    parts = F.struct(
        tight_name(F.regexp_extract(stem, full, 1)).alias("nombre"),
        F.upper(F.regexp_extract(stem, full, 2)).alias("tipo"),
        F.upper(F.regexp_extract(stem, full, 3)).alias("codigo"),
    )
    return F.when(stem.rlike(full), parts)


def pdf_stem(filename: Column) -> Column:
    """Part of the name before the last `.pdf`."""
    return F.regexp_replace(filename, r"(?s)^(.*)\.pdf.*$", "$1")


def plan_scale(text: Column) -> Column:
    """Denominator of the plan scale; 1000 when none is stated or it is out of 200..50000."""
    # Fixed value: how a plan states its scale.
    pattern = r"[Ee][Ss][Cc][Aa][Ll][Aa]\s*[:=]?\s*1\s*[:/]\s*(\d{3,5})"
    stated = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1).try_cast("int")
    return F.when(stated.between(200, 50000), stated).otherwise(F.lit(1000))


def safe_name(text: Column) -> Column:
    """File-safe identifier of at most 200 characters."""
    return F.left(F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_"), F.lit(200))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


# Street kinds of the unit registry and their printed forms.
STREET_KINDS = {
    "CL": "C/", "AV": "Av.", "PZ": "Pza.", "PJ": "Psje.",
    "GL": "Glta.", "RD": "Rda.", "TR": "Trav.",
}


def _mapped(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[value], value)


def urban_address(kind: Column, street: Column, number: Column) -> Column:
    """Printed street kind, street and number, each blank when absent."""
    blank = F.lit("")
    return strip(F.concat(
        _mapped(F.coalesce(kind, blank), STREET_KINDS), F.lit(" "),
        strip(F.coalesce(street, blank)), F.lit(" "), strip(F.coalesce(number, blank)),
    ))


def registry_address(address: Column, suffix: str) -> Column:
    """Back from the printed form to the registry's form, with the town appended; '' if empty."""
    words = F.split(strip(address), r"\s+")
    kinds = {printed: kind for kind, printed in STREET_KINDS.items()}
    first = _mapped(words[0], kinds)
    line = F.concat_ws(" ", first, F.array_join(F.slice(words, 2, F.size(words)), " "))
    back = F.when(F.size(words) > 1, line).otherwise(first)
    return F.when(F.coalesce(address, F.lit("")) == "", F.lit("")) \
        .otherwise(F.concat(back, F.lit(suffix)))


def rural_address(place: Column, block: Column, plot: Column, town: Column) -> Column:
    """`place · Pol b Parc p · town`, leaving out absent parts; null when all are absent."""
    blank = F.lit("")
    place, town = strip(F.coalesce(place, blank)), strip(F.coalesce(town, blank))
    block, plot = F.coalesce(block, blank), F.coalesce(plot, blank)
    middle = F.when(
        (block != "") | (plot != ""),
        F.concat(F.lit("Pol "), block, F.lit(" Parc "), plot),
    )
    line = F.concat_ws(" · ", F.nullif(place, blank), middle, F.nullif(town, blank))
    return F.nullif(line, blank)
