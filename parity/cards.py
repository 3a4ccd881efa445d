"""Record cards: text lines from documents, positioned spans from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lindero.functions import text as T
from lindero.operators import cards as C
from lindero.operators import worklists as W
from lindero.session import settle
from parity import derived as D
from parity.base import add, table
from parity.derived import with_sql

# ---- lines ----------------------------------------------------------------------------------

# Lines of a made card: `{d}` is the document number; a line may carry a condition on it, and is
# left out where the condition fails.
CARD = [
    ("CLAVE", ""), ("UG-RC{m9}", ""), ("NUMERO {d}", "d % 3 <> 0"), ("NUMERO", "d % 3 = 0"),
    ("{d}", "d % 3 = 0"), ("TIPO DE AMBITO", ""), ("", ""), ("UNIDAD DE GESTIÓN", ""),
    ("NOMBRE", ""), ("RODEO {m40}", "d % 4 <> 0"), ("HOJA", ""), ("15-J/", ""),
    ("ORIGEN AMBITO:  PGOU", ""), ("SISTEMA DE ACTUACION", ""), ("COMPENSACIÓN", "d % 5 <> 0"),
    ("INICIATIVA PRIVADA", ""), ("INSTRUMENTO DE PLANEAMIENTO", ""), ("INICIAL", ""),
    ("DEFINITIVA", ""), ("ESTUDIO DE DETALLE", "d % 2 = 0"), ("12/03/2001", ""),
    ("PLAN ESPECIAL", "d % 7 <> 0"), ("INFORMACION FASE DE EJECUCION", ""), ("EXPROPIACION", ""),
    ("NO", ""), ("CESIONES", ""), ("", ""), ("", ""), ("tarde", ""), ("URBANIZACION", ""),
    ("EDIFICACION", ""), ("CALIFICACION DE SUELOS PUBLICOS", ""), ("CODIGO", ""),
    ("CALIFICACION", ""), ("m2 de suelo", ""), ("m2 construible", ""), ("EL", ""),
    ("ESPACIOS LIBRES PUBLICOS", ""), ("", ""), ("1.284", ""), ("", ""), ("0", ""),
    ("ruido", "d % 2 = 1"), ("EX", ""), ("EQUIPAMIENTO", ""), ("1.946,5", ""), ("{m100} m2", ""),
    ("TOTAL SUELO PUBLICO", "d % 11 <> 0"), ("", ""), ("14.300 m2", ""), ("{m100} m2", ""),
    ("CALIFICACION DE SUELOS PRIVADOS", ""), ("CODIGO", ""), ("RC", ""), ("RESIDENCIAL", ""),
    ("{d}", ""), ("2.000,25", ""), ("TOTAL SUELO PRIVADO", ""), ("", ""), ("{d} m2", ""),
    ("APROVECHAMIENTO MEDIO: RC, 1,3001 u.a.h.", ""), ("SUPERFICIE TOTAL DEL AMBITO", ""),
    ("1.{m900} m2", ""), ("INDICE EDIF. BRUTA", ""), ("0,85 m2c/m2", ""),
    ("USO GLOBAL PREDOMINANTE", ""), ("RESIDENCIAL", "d % 6 <> 0"), ("ALTURA MAXIMA", ""),
    ("{m9} PLANTAS", ""), ("% PARA VIVIENDAS DE PROTECCION:", ""), ("30%", ""),
    ("Nº APROX. VIV. PROT.: {m9}", ""), ("SISTEMAS GENERALES", ""), ("VIARIO", ""), ("", ""),
    ("19,185%=34.{m900} m2", ""), ("ESPACIOS LIBRES", ""), ("nada", ""), ("nada", ""),
    ("EQUIPAMIENTOS0%={m9} m2", ""), ("VIVIENDAS CONSTRUIBLES TOTAL: 16 Viv", ""),
    ("DENSIDAD BRUTA: 130,{m9} Viv/Ha", ""), ("SUPERFICIE MEDIA", ""), ("99,5 m2/viv", ""),
]
# Numbers used in the lines, as `{name}` -> expression over the document number.
NUMS = {"{d}": "d", "{m9}": "(d % 9)", "{m40}": "(d % 40)", "{m100}": "(d % 100)",
        "{m900}": "(100 + d % 800)"}


def pieces(line: str) -> list[str]:
    """The line as SQL text pieces, numbers cast to text."""
    out = []
    rest = line
    while rest:
        at = min((rest.index(k), k) for k in NUMS if k in rest) if any(
            k in rest for k in NUMS) else None
        if at is None:
            out.append(f"'{rest}'")
            break
        if at[0]:
            out.append(f"'{rest[:at[0]]}'")
        out.append(f"cast({NUMS[at[1]]} AS {{text}})")
        rest = rest[at[0] + len(at[1]):]
    return out or ["''"]


def line_sql(line: str, cond: str, text: str) -> str:
    body = " || ".join(pieces(line)).format(text=text)
    return f"CASE WHEN {cond} THEN {body} END" if cond else body


# Page 0: plan figures for even documents, prose otherwise; page 1: the card; page 2: the text.
DUMP = ["'123.45'", "'II'", "'-I+VI'", "'77'", "'norte'", "cast(d AS {text})"]
PROSE = ["'plano de situación'", "'sin cotas'", "'12'"]
D.define("raw_lines", """
SELECT d AS doc, page, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no FROM (
 SELECT d, 0 AS page, CASE WHEN d % 2 = 0 THEN [{dump}] ELSE [{prose}] END AS ls FROM dd
 UNION ALL SELECT d, 1, list_filter([{card}], lambda t: t IS NOT NULL) FROM dd
 UNION ALL SELECT d, 2, string_split(text, chr(10)) FROM dd)""".format(
    dump=", ".join(s.format(text="VARCHAR") for s in DUMP), prose=", ".join(PROSE),
    card=", ".join(line_sql(t, c, "VARCHAR") for t, c in CARD)), "dd")
D.define("dd", "SELECT doc_id AS d, text FROM documents")


def raw_lines(spark, sf):
    dd = table(spark, sf, "documents", spread=True).select(F.col("doc_id").alias("d"), "text")

    def arr(items):
        return "array(" + ", ".join(items) + ")"
    dump = arr([s.format(text="STRING") for s in DUMP])
    card = arr([line_sql(t, c, "STRING") for t, c in CARD])
    pages = [
        F.expr(f"CASE WHEN d % 2 = 0 THEN {dump} ELSE {arr(PROSE)} END"),
        F.expr(f"array_compact({card})"), F.split("text", "\n")]
    return dd.select("d", F.posexplode(F.array(*pages)).alias("page", "ls")).select(
        F.col("d").alias("doc"), "page", F.posexplode("ls").alias("line_no", "text"))


PAGE_FLAGS = r"""
SELECT doc, page, count(*) AS n_lines, CASE WHEN count(*) FILTER (s <> '') = 0 THEN true ELSE
  count(*) FILTER (regexp_full_match(s, '-?\d+(?:\.\d+)?') OR regexp_full_match(s, '-?[IVXP]+\+?[IVXP]*')) / count(*) FILTER (s <> '') > 0.4::DOUBLE END AS is_dump
FROM (SELECT *, trim(text) AS s FROM raw_lines) GROUP BY doc, page"""
D.define("page_flags", PAGE_FLAGS, "raw_lines")
D.define("clines", r"""
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, line_no) - 1 AS pos, rtrim(text) AS text, trim(text) AS s,
  regexp_replace(upper(trim(text)), '\s+', ' ', 'g') AS u
FROM raw_lines JOIN page_flags USING (doc, page) WHERE NOT is_dump""", "raw_lines", "page_flags")


@add("sf6_coordinate_pages", with_sql("SELECT * FROM page_flags", "page_flags"))
def _(spark, sf):
    return C.coordinate_pages(raw_lines(spark, sf))


KNOWN = ", ".join(f"'{k}'" for k in C.KNOWN_LABELS)
LABELS = ", ".join(f"('{f}', '{lab}')" for f, lab in C.LABEL_FIELDS.items())
# Only lines that begin like some label are held against the labels, by equality of their start.
SIZES = sorted({len(lab) for lab in C.LABEL_FIELDS.values()})
STARTS = "left(u, {n}) IN ({heads})".format(
    n=min(SIZES), heads=", ".join(sorted({f"'{lab[:min(SIZES)]}'" for lab in C.LABEL_FIELDS.values()})))
D.define("label_values", f"""
SELECT doc, field, CASE WHEN regexp_replace(upper(v), '\\s+', ' ', 'g') NOT IN ({KNOWN}) THEN v END AS value FROM (
 SELECT h.doc, field, CASE WHEN exact THEN coalesce(nullif(a.s, ''), nullif(b.s, '')) ELSE rest END AS v
 FROM (SELECT *, u = lab AS exact FROM (SELECT doc, pos, u, field, lab, trim(regexp_replace(substr(s, length(lab) + 1), '^[: ]+', '')) AS rest
        FROM (SELECT *, unnest([{", ".join(map(str, SIZES))}]) AS size FROM clines WHERE {STARTS})
        JOIN (VALUES {LABELS}) t(field, lab) ON lab = left(u, size) AND length(lab) = size
        WHERE u = lab OR starts_with(u, lab || ' ') OR starts_with(u, lab || ':'))
      WHERE u = lab OR rest <> ''
      QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY pos) = 1) h
 LEFT JOIN clines a ON a.doc = h.doc AND a.pos = h.pos + 1 LEFT JOIN clines b ON b.doc = h.doc AND b.pos = h.pos + 2)""", "clines")
PATTERNS = ", ".join(f"('{f}', '(?i){p}')" for f, p in C.PATTERN_FIELDS.items())
D.define("pattern_values", f"""
SELECT h.doc, field, coalesce(nullif(inl, ''), nullif(a.s, ''), nullif(b.s, '')) AS value FROM (
  SELECT * FROM ({" UNION ALL ".join(
      f"SELECT doc, pos, '{f}' AS field, trim(regexp_extract(s, '(?i){p}', 1)) AS inl FROM clines WHERE regexp_matches(s, '(?i){p}')"
      for f, p in C.PATTERN_FIELDS.items())})
  QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY pos) = 1) h
LEFT JOIN clines a ON a.doc = h.doc AND a.pos = h.pos + 1 LEFT JOIN clines b ON b.doc = h.doc AND b.pos = h.pos + 2""", "clines")
SV = C.SYSTEM_VALUE
D.define("system_values", " UNION ALL ".join(f"""
SELECT doc, '{f}' AS field, arg_min(v, pos) AS value FROM (
  SELECT c.doc, c.pos, CASE WHEN regexp_matches(c.s, '(?i)^{lab}\\s*{SV}') THEN regexp_extract(c.s, '(?i)^{lab}\\s*{SV}', 2)
     WHEN upper(c.s) = '{lab}' THEN coalesce(nullif(regexp_extract(a.s, '(?i)^{SV}', 2), ''), nullif(regexp_extract(b.s, '(?i)^{SV}', 2), '')) END AS v
  FROM clines c LEFT JOIN clines a ON a.doc = c.doc AND a.pos = c.pos + 1 LEFT JOIN clines b ON b.doc = c.doc AND b.pos = c.pos + 2
  WHERE starts_with(upper(c.s), '{lab}')) WHERE v IS NOT NULL GROUP BY doc""" for f, lab in C.SYSTEM_FIELDS.items()), "clines")
D.define("right_values", f"""
SELECT doc, arg_min(trim(regexp_extract(s, '(?i){C.USE_RIGHT}', 1)), pos) AS code, arg_min(regexp_extract(s, '(?i){C.USE_RIGHT}', 2), pos) AS uah
FROM clines WHERE regexp_matches(s, '(?i){C.USE_RIGHT}') GROUP BY doc""", "clines")


@add("wn5_label_values", with_sql("SELECT * FROM label_values WHERE value IS NOT NULL", "label_values"))
def _(spark, sf):
    values = C.field_values(C.card_lines(raw_lines(spark, sf)))
    return values.filter(F.col("field").isin(*C.LABEL_FIELDS))


@add("sf10_pattern_fields", with_sql("""
SELECT * FROM pattern_values WHERE value IS NOT NULL UNION ALL SELECT * FROM system_values
UNION ALL SELECT doc, 'aprovechamiento_codigo', code FROM right_values
UNION ALL SELECT doc, 'aprovechamiento_uah', uah FROM right_values""", "pattern_values", "system_values", "right_values"))
def _(spark, sf):
    values = C.field_values(C.card_lines(raw_lines(spark, sf)))
    return values.filter(~F.col("field").isin(*C.LABEL_FIELDS))


def euro(v: str) -> str:
    """European number in SQL, with the unit suffixes removed in order."""
    out = f"regexp_replace(trim(regexp_replace(trim({v}), '%+$', '')), ' ', '', 'g')"
    for unit in T.UNIT_SUFFIXES:
        pat = unit.replace(".", "\\.")
        out = f"regexp_replace({out}, '{pat}$', '')"
    return f"TRY_CAST(replace(replace({out}, '.', ''), ',', '.') AS DOUBLE)"


BOUNDS = " UNION ALL ".join(f"""
SELECT doc, '{n}' AS section, start, min(pos) AS fin FROM (SELECT doc, min(pos) AS start FROM clines WHERE u = '{s}' GROUP BY doc)
JOIN clines USING (doc) WHERE u = '{e}' AND pos > start GROUP BY doc, start""" for n, (s, e) in C.TABLES.items())
D.define("bounds", BOUNDS, "clines")
TNUM = r"(-?\d{1,3}(\.\d{3})*(,\d+)?|-?\d+(,\d+)?)"
HEAD = "'CODIGO', 'CALIFICACION', 'M2 DE SUELO', 'M2 CONSTRUIBLE'"
D.define("land", f"""
WITH RECURSIVE b AS (SELECT doc, section, s, row_number() OVER (PARTITION BY doc, section ORDER BY pos)::INT AS i,
   regexp_full_match(trim(replace(s, ' m2', '')), '{TNUM}') AS num
  FROM clines JOIN bounds USING (doc) WHERE pos > start AND pos < fin AND s <> '' AND u NOT IN ({HEAD})),
w AS (SELECT x.doc, x.section, x.i, x.s AS c, y.s AS k, z.s AS m, q.s AS n, coalesce(z.num AND q.num, false) AS ok FROM b x
  LEFT JOIN b y ON y.doc = x.doc AND y.section = x.section AND y.i = x.i + 1
  LEFT JOIN b z ON z.doc = x.doc AND z.section = x.section AND z.i = x.i + 2
  LEFT JOIN b q ON q.doc = x.doc AND q.section = x.section AND q.i = x.i + 3),
r AS (SELECT * FROM w WHERE i = 1 UNION ALL
  SELECT w.* FROM r JOIN w ON w.doc = r.doc AND w.section = r.section AND w.i = r.i + CASE WHEN r.ok THEN 4 ELSE 1 END)
SELECT doc, section, i, c, k, {euro('m')} AS m, {euro('n')} AS n FROM r WHERE ok""", "clines", "bounds")
D.define("land_rows", """
SELECT doc, section, string_agg(c || '|' || k || '|' || m::VARCHAR || '|' || n::VARCHAR, ';' ORDER BY i) AS filas FROM land GROUP BY doc, section""", "land")
D.define("totals", f"""
SELECT doc, section, {euro('max(s) FILTER (r = 1)')} AS ts, {euro('max(s) FILTER (r = 2)')} AS tc FROM (
  SELECT doc, section, s, row_number() OVER (PARTITION BY doc, section ORDER BY pos) AS r FROM clines JOIN bounds USING (doc)
  WHERE pos > fin AND pos <= fin + 7 AND s <> '' AND u NOT IN ({HEAD})) GROUP BY doc, section HAVING count(*) >= 2""", "clines", "bounds")


def show_rows(col):
    return F.nullif(F.array_join(F.transform(col, lambda r: F.concat_ws(
        "|", r["codigo"], r["calificacion"], r["m2_suelo"].cast("string"),
        r["m2_construible"].cast("string"))), ";"), F.lit(""))


@add("wn6_land_tables", with_sql("""
SELECT b.doc, b.section, filas, ts AS total_suelo, tc AS total_construible FROM bounds b
LEFT JOIN land_rows l ON l.doc = b.doc AND l.section = b.section LEFT JOIN totals t ON t.doc = b.doc AND t.section = b.section""",
    "bounds", "land_rows", "totals"))
def _(spark, sf):
    body = C.card_lines(raw_lines(spark, sf))
    t = C.land_tables(C.section_lines(body, C.section_bounds(body)))
    return t.select("doc", "section", show_rows(F.col("filas")).alias("filas"), "total_suelo",
                    "total_construible")


D.define("instr", r"""
SELECT doc, CASE WHEN count(*) > 1 THEN max(s) FILTER (r = 1) END AS inicial,
  CASE WHEN count(*) > 1 THEN max(s) FILTER (r = 2) ELSE max(s) END AS definitiva FROM (
 SELECT c.doc, s, row_number() OVER (PARTITION BY c.doc ORDER BY pos) AS r FROM clines c JOIN (
   SELECT doc, start, min(pos) AS fin FROM (SELECT doc, min(pos) AS start FROM clines WHERE u = 'INSTRUMENTO DE PLANEAMIENTO' GROUP BY doc)
   JOIN clines USING (doc) WHERE contains(upper(text), 'INFORMACION FASE DE EJECUCION') AND pos > start GROUP BY doc, start) b ON b.doc = c.doc
 WHERE pos > start AND pos < fin AND s <> '' AND upper(s) NOT IN ('INICIAL', 'DEFINITIVA') AND NOT regexp_full_match(s, '\d{1,2}/\d{1,2}/\d{2,4}'))
GROUP BY doc""", "clines")


@add("wn7_instruments", with_sql("SELECT * FROM instr", "instr"))
def _(spark, sf):
    body = C.card_lines(raw_lines(spark, sf))
    return C.instruments(C.section_lines(body, C.section_bounds(body)))


def lv(field: str) -> str:
    return f"max(value) FILTER (field = '{field}')"


def rint(v: str) -> str:
    return f"round_even({v}, 0)::INT"


D.define("flat_a", f"""
SELECT doc AS filename, {lv('clave')} AS clave, {rint(euro(f"coalesce({lv('numero')}, {lv('numero_label')})"))} AS numero,
 {lv('tipo_ambito')} AS tipo_ambito, {lv('nombre')} AS nombre, {lv('hoja_pgou')} AS hoja_pgou, {lv('origen_ambito')} AS origen_ambito,
 {lv('sistema_actuacion')} AS sistema_actuacion, {lv('iniciativa')} AS iniciativa, {lv('expropiacion')} AS expropiacion,
 {lv('cesiones')} AS cesiones, {lv('urbanizacion')} AS urbanizacion, {lv('edificacion')} AS edificacion,
 {euro(lv('superficie_total_ambito_m2'))} AS superficie_total_ambito_m2, {euro(lv('indice_edif_bruta'))} AS indice_edif_bruta,
 {lv('uso_global_predominante')} AS uso_global_predominante, {rint(euro(lv('altura_maxima_plantas')))} AS altura_maxima_plantas,
 {euro(lv('viviendas_proteccion_pct'))} AS viviendas_proteccion_pct, {rint(euro(lv('n_aprox_viv_proteccion')))} AS n_aprox_viv_proteccion,
 {euro(lv('sg_viario_m2'))} AS sg_viario_m2, {euro(lv('sg_espacios_libres_m2'))} AS sg_espacios_libres_m2,
 {euro(lv('sg_equipamientos_m2'))} AS sg_equipamientos_m2, {rint(euro(lv('viviendas_construibles_total')))} AS viviendas_construibles_total,
 {euro(lv('densidad_bruta_viv_ha'))} AS densidad_bruta_viv_ha, {euro(lv('superficie_media_viv_m2'))} AS superficie_media_viv_m2
FROM (SELECT * FROM label_values UNION ALL SELECT * FROM pattern_values UNION ALL SELECT * FROM system_values) GROUP BY doc""",
         "label_values", "pattern_values", "system_values")
D.define("rec_a", f"""
SELECT f.*, inicial AS instrumento_planeamiento_inicial, definitiva AS instrumento_planeamiento_definitiva,
  lp.filas AS suelos_publicos, lq.filas AS suelos_privados, tp.ts AS total_suelo_publico_m2, tp.tc AS total_suelo_publico_construible_m2,
  tq.ts AS total_suelo_privado_m2, tq.tc AS total_suelo_privado_construible_m2, nullif(code, '') AS aprovechamiento_medio_codigo,
  {euro('uah')} AS aprovechamiento_medio_uah
FROM flat_a f LEFT JOIN instr i ON i.doc = filename LEFT JOIN right_values r ON r.doc = filename
LEFT JOIN land_rows lp ON lp.doc = filename AND lp.section = 'publico' LEFT JOIN land_rows lq ON lq.doc = filename AND lq.section = 'privado'
LEFT JOIN totals tp ON tp.doc = filename AND tp.section = 'publico' LEFT JOIN totals tq ON tq.doc = filename AND tq.section = 'privado'""",
         "flat_a", "instr", "right_values", "land_rows", "totals")


def records_a(spark, sf):
    return C.records_a(raw_lines(spark, sf))


@add("ex1_line_cards", with_sql("SELECT * FROM rec_a", "rec_a"))
def _(spark, sf):
    r = records_a(spark, sf)
    return r.withColumn("suelos_publicos", show_rows(F.col("suelos_publicos"))).withColumn(
        "suelos_privados", show_rows(F.col("suelos_privados")))


RATE_FIELDS = ["clave", "numero", "nombre", "cesiones", "suelos_publicos", "sistema_actuacion",
               "instrumento_planeamiento_inicial", "uso_global_predominante", "total_suelo_publico_m2"]


@add("ag12_fill_rates", with_sql(" UNION ALL ".join(
    f"SELECT '{f}' AS field, count({f}) AS filled, count(*) AS total, 100.0::DOUBLE * count({f}) / count(*) AS percent FROM rec_a"
    for f in RATE_FIELDS), "rec_a"))
def _(spark, sf):
    return W.fill_rates(records_a(spark, sf), RATE_FIELDS)


# ---- spans ----------------------------------------------------------------------------------

ANCHOR = {f: a[0] for f, a, *_ in (*C.NUMBER_ANCHORS, *C.COLUMN_ANCHORS)}
SPAN_LABELS = ["superficie_ambito_m2", "densidad_viv_ha", "altura_max_plantas", "ordenanza",
               "edificabilidad_m2m2", "sup_edificable_max_m2"]
PHRASES = ["RESIDENCIAL", "VIVIENDA COLECTIVA", "COMPENSACIÓN", "SUELO URBANO", "SUNC",
           "NO CONSOLIDADO", "PRIVADA", "ESTUDIO DE", "DETALLE", "PROYECTO DE URBANIZACIÓN"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Text -> raw glyphs: capitals are shifted back, digits and signs replaced.
BACK = {v: k for k, v in T.GLYPHS.items() if v in "0123456789,.%Ó"}
ENC_TO = "".join(chr(ord(c) - 29) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + "\x03" + "".join(BACK.values())
ENC_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + " " + "".join(BACK)

NUMBER_TEXT = {
    "sql": "(l_partkey % 900 + 1)::VARCHAR || CASE l_quantity::INT % 4 WHEN 0 THEN '.500,25' WHEN 1 THEN ',75' WHEN 2 THEN '' ELSE '.120' END",
    "small": "(l_partkey % 14)::VARCHAR", "ratio": "(l_partkey % 7)::VARCHAR || ',' || lpad((l_partkey % 100)::VARCHAR, 2, '0')",
}
D.define("spans", f"""
SELECT doc, page, x0, y0, x1, y1, CASE {" ".join(f"WHEN kind = {i} THEN {q(ANCHOR[f])}" for i, f in enumerate(SPAN_LABELS))}
   {" ".join(f"WHEN kind = {i + 6} THEN translate({q(p)}, {q(ENC_FROM)}, {q(ENC_TO)})" for i, p in enumerate(PHRASES))}
   WHEN kind < 22 THEN translate(small, {q(ENC_FROM)}, {q(ENC_TO)}) WHEN kind < 28 THEN translate(ratio, {q(ENC_FROM)}, {q(ENC_TO)})
   ELSE translate(num, {q(ENC_FROM)}, {q(ENC_TO)}) END AS raw
FROM (SELECT l_orderkey // 4 AS doc, (l_orderkey % 2)::INT AS page, (l_linenumber * 40 + l_partkey % 10)::DOUBLE AS x0,
   (l_partkey % 50 * 6 + l_suppkey % 3)::DOUBLE AS y0, (l_linenumber * 40 + l_partkey % 10 + 30)::DOUBLE AS x1,
   (l_partkey % 50 * 6 + l_suppkey % 3 + 8)::DOUBLE AS y1, (l_partkey * 7 + l_suppkey * 3 + l_quantity::INT) % 40 AS kind,
   {NUMBER_TEXT['small']} AS small, {NUMBER_TEXT['ratio']} AS ratio, {NUMBER_TEXT['sql']} AS num FROM lineitem)""")


def spans(spark, sf):
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    qty = F.col("l_quantity").cast("int")
    kind = (pk * 7 + sk * 3 + qty) % 40

    def enc(c):
        return F.translate(c, ENC_FROM, ENC_TO)
    txt = None
    for i, f in enumerate(SPAN_LABELS):
        txt = F.when(kind == i, F.lit(ANCHOR[f])) if txt is None else txt.when(
            kind == i, F.lit(ANCHOR[f]))
    for i, p in enumerate(PHRASES):
        txt = txt.when(kind == i + 6, enc(F.lit(p)))
    tail = F.when(qty % 4 == 0, ".500,25").when(qty % 4 == 1, ",75").when(qty % 4 == 2, "") \
        .otherwise(".120")
    num = F.concat((pk % 900 + 1).cast("string"), tail)
    ratio = F.concat((pk % 7).cast("string"), F.lit(","), F.lpad((pk % 100).cast("string"), 2, "0"))
    txt = txt.when(kind < 22, enc((pk % 14).cast("string"))).when(kind < 28, enc(ratio)) \
        .otherwise(enc(num))

    def d(c):
        return c.cast("double")
    return table(spark, sf, "lineitem", spread=True).select(
        F.floor(F.col("l_orderkey") / 4).alias("doc"),
        (F.col("l_orderkey") % 2).cast("int").alias("page"), d(ln * 40 + pk % 10).alias("x0"),
        d(pk % 50 * 6 + sk % 3).alias("y0"), d(ln * 40 + pk % 10 + 30).alias("x1"),
        d(pk % 50 * 6 + sk % 3 + 8).alias("y1"), txt.alias("raw"))


DEC = f"translate(raw, {q(T.GLYPH_FROM)}, {q(T.GLYPH_TO)})"
D.define("dspans", f"SELECT *, {DEC} AS decoded, trim({DEC}) AS d, round_even(y0, 1) AS ry FROM spans", "spans")


@add("sf5_decode_glyphs", with_sql("SELECT doc, page, x0, y0, decoded FROM dspans", "dspans"))
def _(spark, sf):
    return C.decoded_spans(spans(spark, sf)).select("doc", "page", "x0", "y0", "decoded")


@add("sf3_european_number", with_sql(f"""
SELECT doc, page, x0, y0, t, {euro('t')} AS number, round_even({euro('t')}, 0)::INT AS whole FROM (SELECT *, d ||
  CASE (y0::INT) % 6 WHEN 0 THEN ' m2' WHEN 1 THEN '%' WHEN 2 THEN ' Viv/Ha' WHEN 3 THEN ' PLANTAS' WHEN 4 THEN ' m2c/m2' ELSE '' END AS t FROM dspans)""", "dspans"))
def _(spark, sf):
    y = F.col("y0").cast("int") % 6
    tail = (F.when(y == 0, " m2").when(y == 1, "%").when(y == 2, " Viv/Ha").when(y == 3, " PLANTAS")
            .when(y == 4, " m2c/m2").otherwise(""))
    s = C.decoded_spans(spans(spark, sf)).withColumn("t", F.concat(F.trim("decoded"), tail))
    return s.select("doc", "page", "x0", "y0", "t", T.european_number(F.col("t")).alias("number"),
                    T.european_int(F.col("t")).alias("whole"))


SNUM = r"^(-?\d{1,3}(\.\d{3})*(,\d+)?|-?\d+(,\d+)?)$"
LAB = ", ".join(f"({q(f)}, {q(C._plain(ANCHOR[f]))})" for f in SPAN_LABELS)
PLAIN_NUM = "TRY_CAST(replace(replace(v.d, '.', ''), ',', '.') AS DOUBLE)"
D.define("span_labels", f"""
SELECT doc, field, page, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1 FROM dspans JOIN (VALUES {LAB}) t(field, lab)
  ON trim(replace(replace(raw, {q(chr(3))}, ' '), {q(chr(12))}, '')) = lab
QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY page, ry, x0, raw) = 1""", "dspans")
D.define("span_pairs", f"""
SELECT l.*, v.x0, v.y0, v.x1, v.y1, v.d, {PLAIN_NUM} AS num, regexp_matches(v.d, '{SNUM}') AS isnum,
  field IN ('superficie_ambito_m2', 'densidad_viv_ha') AS plain FROM span_labels l JOIN dspans v ON v.doc = l.doc AND v.page = l.page""",
         "span_labels", "dspans")
D.define("span_values", r"""
SELECT doc, field,
  arg_min(d, row(x0, d)) FILTER (plain AND isnum AND abs((y0 + y1) / 2 - (ly0 + ly1) / 2) <= 4 AND x0 >= lx1 + 5) AS row_value,
  arg_min(d, row(y0, d)) FILTER (plain AND isnum AND y0 > ly1 AND y0 - ly1 <= 80 AND (x0 + x1) / 2 BETWEEN lx0 - 30 AND lx1 + 30) AS below_value,
  arg_min(d, row(y0, CASE WHEN field <> 'ordenanza' THEN num END, d)) FILTER (y0 > ly1 AND CASE field
     WHEN 'ordenanza' THEN abs(x0 - lx0) <= 80 AND d <> '' AND length(d) <= 12 AND regexp_matches(d, '[A-Za-z0-9]')
     WHEN 'altura_max_plantas' THEN abs(x0 - lx0) <= 120 AND regexp_full_match(d, '\d{1,2}') AND num BETWEEN 1 AND 20
     WHEN 'edificabilidad_m2m2' THEN abs(x0 - lx0) <= 80 AND regexp_full_match(d, '\d{1,2},\d{2,3}') AND num BETWEEN 0.05 AND 5.0
     WHEN 'sup_edificable_max_m2' THEN abs(x0 - lx0) <= 80 AND isnum AND num > 0 ELSE false END) AS column_value
FROM span_pairs GROUP BY doc, field""", "span_pairs")


@add("jn22_row_values", with_sql(
    "SELECT doc, field, row_value FROM span_values WHERE row_value IS NOT NULL", "span_values"))
def _(spark, sf):
    v = C.anchored_values(settle(C.decoded_spans(spans(spark, sf))))
    return v.select("doc", "field", "row_value").filter(F.col("row_value").isNotNull())


@add("jn23_below_values", with_sql("""
SELECT doc, field, below_value, column_value FROM span_values WHERE below_value IS NOT NULL OR column_value IS NOT NULL""", "span_values"))
def _(spark, sf):
    v = C.anchored_values(settle(C.decoded_spans(spans(spark, sf))))
    return v.select("doc", "field", "below_value", "column_value").filter(
        F.col("below_value").isNotNull() | F.col("column_value").isNotNull())


D.define("col_texts", """
SELECT doc, page, round_even(x0 / 20, 0)::INT AS bucket, string_agg(decoded, ' ' ORDER BY y0, ry, x0, raw) AS text
FROM dspans GROUP BY doc, page, bucket""", "dspans")


@add("wn8_column_texts", with_sql("SELECT * FROM col_texts", "col_texts"))
def _(spark, sf):
    return C.column_texts(C.decoded_spans(spans(spark, sf)))


D.define("doc_texts", """
SELECT doc, by_row, by_row || chr(10) || by_col AS t FROM (SELECT doc, string_agg(decoded, chr(10) ORDER BY page, ry, x0, raw) AS by_row FROM dspans GROUP BY doc)
JOIN (SELECT doc, string_agg(text || ' |||', ' ' ORDER BY page, bucket) AS by_col FROM col_texts GROUP BY doc) USING (doc)""", "dspans", "col_texts")


def ph(phrases, bounded=True) -> str:
    arms = []
    for p in phrases:
        pat = "\\s+".join(w.replace("/", "/") for w in p.split(" "))
        pat = f"\\b{pat}\\b" if bounded else pat
        arms.append(f"WHEN regexp_matches(t, '{pat}') THEN '{p}'")
    return "CASE " + " ".join(arms) + " END"


CAT = f"""CASE WHEN cat IS NULL THEN CASE
   WHEN regexp_matches(t, '\\bSUNC\\b') OR (regexp_matches(t, 'NO\\s+CONSOLIDADO') AND NOT regexp_matches(t, '\\bCONSOLIDADO\\b')) THEN 'SUNC URBANO NO CONSOLIDADO'
   WHEN regexp_matches(t, '\\bSUC\\b') OR (regexp_matches(t, '\\bCONSOLIDADO\\b') AND NOT regexp_matches(t, 'NO\\s+CONSOLIDADO')) THEN 'SUC URBANO CONSOLIDADO'
   WHEN regexp_matches(t, '\\bSUR\\b') AND contains(t, 'SECTORIZADO') THEN 'SUR SUELO URBANIZABLE SECTORIZADO'
   WHEN regexp_matches(t, '\\bSUR\\b') THEN 'SUR SUELO URBANIZABLE' END
  WHEN contains(t, 'SUNC') AND NOT starts_with(cat, 'SUNC') THEN 'SUNC URBANO NO CONSOLIDADO'
  WHEN contains(t, 'SUC') AND NOT starts_with(cat, 'SUC') AND contains(cat, 'URBANO CONSOLIDADO') THEN 'SUC URBANO CONSOLIDADO' ELSE cat END"""
D.define("phrased", f"""
SELECT *, {CAT} AS categoria_suelo FROM (SELECT doc, by_row, t, {ph(T.USES)} AS uso_predominante, {ph(T.CATEGORIES)} AS cat, {ph(T.CLASSES)} AS clase_suelo,
  {ph(T.PLANNINGS)} AS planeamiento_desarrollo, {ph(T.INITIATIVES)} AS iniciativa, {ph(T.SYSTEMS)} AS sistema_actuacion,
  {ph(T.INSTRUMENTS, False)} AS instrumento_gestion FROM doc_texts)""", "doc_texts")


@add("sf7_phrases", with_sql("""
SELECT doc, uso_predominante, clase_suelo, planeamiento_desarrollo, iniciativa, sistema_actuacion, instrumento_gestion FROM phrased""", "phrased"))
def _(spark, sf):
    t = C.document_texts(C.decoded_spans(spans(spark, sf)))
    return t.select("doc", *C.phrase_fields(
        F.concat("by_row", F.lit("\n"), "by_column"))).drop("categoria_suelo")


@add("sf9_land_category", with_sql("SELECT doc, categoria_suelo FROM phrased", "phrased"))
def _(spark, sf):
    t = C.document_texts(C.decoded_spans(spans(spark, sf)))
    return t.select("doc", T.land_category(
        F.concat("by_row", F.lit("\n"), "by_column")).alias("categoria_suelo"))


EU = "TRY_CAST(replace(replace({}, '.', ''), ',', '.') AS DOUBLE)"


def sv(field: str) -> str:
    return f"max(coalesce(row_value, below_value, column_value)) FILTER (field = '{field}')"


D.define("rec_b", f"""
SELECT *, coalesce(given, CASE WHEN edif <> 0 AND superficie_ambito_m2 <> 0 THEN round_even(edif * superficie_ambito_m2, 2) END) AS sup_edificable_max_m2
FROM (SELECT doc AS ambito_id, {EU.format(sv('superficie_ambito_m2'))} AS superficie_ambito_m2, {rint(EU.format(sv('densidad_viv_ha')))} AS densidad_viv_ha,
   {sv('ordenanza')} AS ordenanza, {rint(EU.format(sv('altura_max_plantas')))} AS altura_max_plantas,
   coalesce({EU.format(sv('edificabilidad_m2m2'))}, any_value(ratio)) AS edif, {EU.format(sv('sup_edificable_max_m2'))} AS given
 FROM doc_texts LEFT JOIN span_values USING (doc) LEFT JOIN (SELECT doc, arg_min(num, row(page, ry, x0, raw)) AS ratio FROM (
    SELECT *, {EU.format('d')} AS num FROM dspans WHERE regexp_full_match(d, '\\d{{1,2}},\\d{{2,3}}')) WHERE num BETWEEN 0.05 AND 5.0 GROUP BY doc) USING (doc)
 GROUP BY doc)""", "doc_texts", "span_values", "dspans")


@add("sf11_derived_build", with_sql(
    "SELECT ambito_id, edif AS edificabilidad_m2m2, superficie_ambito_m2, sup_edificable_max_m2 FROM rec_b", "rec_b"))
def _(spark, sf):
    return C.records_b(spans(spark, sf)).select(
        "ambito_id", "edificabilidad_m2m2", "superficie_ambito_m2", "sup_edificable_max_m2")


@add("ex2_span_cards", with_sql("""
SELECT r.ambito_id, r.superficie_ambito_m2, r.densidad_viv_ha, r.ordenanza, r.altura_max_plantas, r.edif AS edificabilidad_m2m2,
  r.sup_edificable_max_m2, p.uso_predominante, p.categoria_suelo, p.clase_suelo, p.planeamiento_desarrollo, p.iniciativa, p.sistema_actuacion,
  p.instrumento_gestion, p.by_row AS raw_text_decoded, NULL::DOUBLE AS superficie_neta_m2, NULL::INT AS viviendas_estimadas,
  NULL::DOUBLE AS viviendas_protegidas_pct, NULL::DOUBLE AS sup_residencial_m2, NULL::DOUBLE AS sup_industrial_m2, NULL::DOUBLE AS sup_terciario_m2,
  NULL::DOUBLE AS sup_viario_m2, NULL::DOUBLE AS sup_espacios_libres_m2, NULL::DOUBLE AS sup_dotacional_publico_m2, NULL::DOUBLE AS sup_dotacional_privado_m2
FROM rec_b r JOIN phrased p ON p.doc = r.ambito_id""", "rec_b", "phrased"))
def _(spark, sf):
    return C.records_b(spans(spark, sf))
