import json
import random

import pytest
from pyspark.sql import functions as F

from lindero.functions import text as T
from lindero.operators import cards, linkage
from lindero.operators import worklists as W
from lindero.sources import files, listings, responses

CARD_A = """CLAVE
UG-RC4
NUMERO 120
TIPO DE AMBITO
UNIDAD DE GESTIÓN
NOMBRE
RODRIGUEZ CABEZAS 4
HOJA
15-J/
SISTEMA DE ACTUACION
COMPENSACIÓN
INICIATIVA PRIVADA
INSTRUMENTO DE PLANEAMIENTO
INICIAL
DEFINITIVA
ESTUDIO DE DETALLE
INFORMACION FASE DE EJECUCION
EXPROPIACION
CESIONES
CALIFICACION DE SUELOS PUBLICOS
CODIGO
CALIFICACION
m2 de suelo
m2 construible
EL
ESPACIOS LIBRES PUBLICOS

284

0
EX
EQUIPAMIENTO PÚBLICO SIN DEFINIR

1.946

0
TOTAL SUELO PUBLICO

14.300 m2

0 m2
APROVECHAMIENTO MEDIO: RC, 1,3001 u.a.h.
SUPERFICIE TOTAL DEL AMBITO
1.223 m2
ALTURA MAXIMA
4 PLANTAS
VIVIENDAS CONSTRUIBLES TOTAL: 16 Viv
DENSIDAD BRUTA: 130,83 Viv/Ha
VIARIO
19,185%=34.256 m2
EQUIPAMIENTOS0%=0 m2"""


def test_line_card(spark):
    plan = ["12.5", "II", "-I+VI", "7"]
    rows = [("a.pdf", 0, i, t) for i, t in enumerate(plan)]
    rows += [("a.pdf", 1, i, t) for i, t in enumerate(CARD_A.split("\n"))]
    rows += [("empty.pdf", 0, 0, "3")]
    df = spark.createDataFrame(rows, "doc string, page int, line_no int, text string")
    out = {r.filename: r for r in cards.records_a(df).collect()}
    a = out["a.pdf"]
    assert (a.clave, a.numero, a.tipo_ambito, a.nombre, a.hoja_pgou) == (
        "UG-RC4", 120, "UNIDAD DE GESTIÓN", "RODRIGUEZ CABEZAS 4", "15-J/")
    assert (a.sistema_actuacion, a.iniciativa) == ("COMPENSACIÓN", "PRIVADA")
    assert a.instrumento_planeamiento_definitiva == "ESTUDIO DE DETALLE"
    assert a.instrumento_planeamiento_inicial is None and a.expropiacion is None
    assert (a.aprovechamiento_medio_codigo, a.aprovechamiento_medio_uah) == ("RC", 1.3001)
    assert (a.superficie_total_ambito_m2, a.altura_maxima_plantas) == (1223.0, 4)
    assert (a.viviendas_construibles_total, a.densidad_bruta_viv_ha) == (16, 130.83)
    assert [tuple(r) for r in a.suelos_publicos] == [
        ("EL", "ESPACIOS LIBRES PUBLICOS", 284.0, 0.0),
        ("EX", "EQUIPAMIENTO PÚBLICO SIN DEFINIR", 1946.0, 0.0)]
    assert (a.total_suelo_publico_m2, a.sg_viario_m2, a.sg_equipamientos_m2) == (14300.0, 34256.0, 0.0)
    assert out["empty.pdf"].clave is None and out["empty.pdf"].suelos_publicos == []
    assert len(out["a.pdf"]) == 35


def raw(text):
    back = {v: k for k, v in T.GLYPHS.items()}
    return "".join("\x03" if c == " " else chr(ord(c) - 29) if "A" <= c <= "Z" else back.get(c, c)
                   for c in text)


def test_span_card(spark):
    anchors = {f: a[0] for f, a, *_ in (*cards.NUMBER_ANCHORS, *cards.COLUMN_ANCHORS)}
    spans = [
        (10, 10, anchors["superficie_ambito_m2"]), (120, 11, raw("5.342,31")),
        (10, 60, anchors["viviendas_estimadas"]), (14, 90, raw("50")),
        (200, 60, anchors["altura_max_plantas"]), (205, 90, raw("3")),
        (300, 60, anchors["edificabilidad_m2m2"]), (302, 90, raw("0,88")),
        (400, 60, anchors["ordenanza"]), (402, 90, raw("3")),
        (500, 10, raw("RESIDENCIAL VIVIENDA")), (500, 20, raw("COLECTIVA")),
        (600, 10, raw("SUNC")), (640, 10, raw("SUELO URBANO")), (700, 40, raw("COMPENSACIÓN"))]
    df = spark.createDataFrame(
        [("APP-10", 0, float(x), float(y), float(x + 30), float(y + 8), t) for x, y, t in spans],
        "doc string, page int, x0 double, y0 double, x1 double, y1 double, raw string")
    r = cards.records_b(df).first()
    assert (r.superficie_ambito_m2, r.viviendas_estimadas, r.altura_max_plantas) == (5342.31, 50, 3)
    assert (r.edificabilidad_m2m2, r.ordenanza) == (0.88, "3")
    assert r.uso_predominante == "RESIDENCIAL VIVIENDA COLECTIVA"
    assert (r.categoria_suelo, r.clase_suelo) == ("SUNC URBANO NO CONSOLIDADO", "SUELO URBANO")
    assert r.sistema_actuacion == "COMPENSACIÓN"
    assert r.sup_edificable_max_m2 == round(0.88 * 5342.31, 2) and len(r) == 25


def test_phrases_and_labels_are_looked_for_once(spark, capsys):
    texts = ["SUNC URBANO NO CONSOLIDADO", "URBANO\nCONSOLIDADO SUC", "SUC NO  CONSOLIDADO", "SUELO SUR X",
             "SUR SECTORIZADO", "URBANO NO CONSOLIDADO SUNC", "XSUNCX", "URBANIZABLEX", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.land_category(F.col("t")).alias("c"))
    full, solid, sector, land = T.CATEGORIES[:4]
    assert [r.c for r in got.collect()] == [full, solid, solid, land, sector, full, None, None, None, None]
    got.explain()
    assert capsys.readouterr().out.count("RLIKE") <= len(T.CATEGORIES) + 9
    spans = spark.createDataFrame([], "doc long, page int, x0 double, y0 double, x1 double, y1 double, raw string")
    cards.label_spans(cards.decoded_spans(spans)).explain()
    assert capsys.readouterr().out.count("translate(raw") <= 3


def test_glyphs_and_numbers(spark):
    df = spark.createDataFrame([("5(6,'(1&,$/", "1.234,5 m2"), ("\x0cϭϮ͕ϱй", "-"), ("", "12 %")],
                               "g string, n string")
    got = [tuple(r) for r in df.select(T.decode_glyphs(F.col("g")), T.european_number(F.col("n"))).collect()]
    assert got == [("RESIDENCIAL", 1234.5), ("12,5%", None), ("", 12.0)]


def brute_links(zones, names):
    out = {}
    norm = lambda s: s.upper().replace("-", " ").replace("_", " ").replace("Ñ", "N")
    for ambito, label in zones:
        raw_t = norm(ambito + " " + (label or "")).split()
        words = [t for t in raw_t if len(t) > 2]
        nums = [t for t in raw_t if t.isdigit()]
        codes = [f" {a} {b} " for a, b in zip(raw_t, raw_t[1:])
                 if len(a) <= 4 and (b.isdigit() or len(b) <= 4)] if not words else []
        hits = []
        for o, f in enumerate(names):
            n = " " + norm(f.rsplit(".pdf", 1)[0]) + " "
            if not words:
                c = sum(code in n for code in codes)
                if c:
                    hits.append((-10 * c, o, f))
                continue
            w = sum(t in n for t in words)
            if w >= max(1, len(words) // 2):
                hits.append((-(w + 5 * sum(f" {t} " in n for t in nums)), o, f))
        out[(ambito, label)] = [(f, -s) for s, o, f in sorted(hits)[:5]]
    return out


def test_card_matching_equals_brute_force_however_common_the_tokens(spark):
    names = [f"{a}_{b}_{i}_{k}_RC{i}_Ficha_n_{i:04d}_PGOU.pdf" for i, (a, b, k) in enumerate(
        (a, b, k) for a in ("RIO", "MONTE", "RIOALTO") for b in ("NORTE", "SUR") for k in ("UG", "PE"))]
    zones = [("RIO NORTE 3", None), ("PGOU", ""), ("MONTE", "UG-RC7"), ("PE-9", None),
             ("FICHA PGOU SUR", "X"), ("NADA", None), ("UG", "RC4"), ("RIO RIO 2", None)]
    z = spark.createDataFrame(zones, "ambito string, etiqueta string")
    c = spark.createDataFrame(list(enumerate(names)), "ord long, filename string")
    want = {k: v for k, v in brute_links(zones, names).items() if v}
    for common in (0, 3, 100):
        got = {}
        for r in linkage.match_cards(z, c, common).orderBy("rank").collect():
            got.setdefault((r.ambito, r.etiqueta), []).append((r.filename, r.score))
        assert got == want, common


def test_sources_from_files(spark, tmp_path):
    gml = ('<x><cp:CadastralParcel gml:id="a"><cp:areaValue uom="m2">12.5</cp:areaValue>'
           "<cp:nationalCadastralReference>R1</cp:nationalCadastralReference>"
           "<gml:posList>0 0 4 0 4 4</gml:posList><gml:posList>9 9</gml:posList>"
           '</cp:CadastralParcel><cp:CadastralParcel gml:id="b"></cp:CadastralParcel></x>')
    (tmp_path / "p1.gml").write_text(gml)
    rows = responses.parse_parcels(responses.read_texts(spark, f"{tmp_path}/*.gml")).collect()
    assert [(r.refcat, r.label, r.area_m2, len(r.poly)) for r in rows] == [("R1", "", 12.5, 3)]
    one = {"refcat": "R1", "label": "l", "area_m2": 1.0, "poly_utm": [[0, 0], [1, 0], [1, 1]]}
    (tmp_path / "bbox_1.json").write_text(json.dumps([one]))
    (tmp_path / "bbox_2.json").write_text(json.dumps([dict(one, label="late")]))
    (tmp_path / "bbox_0.json").write_text("{broken")
    chunk = responses.parse_chunks(responses.read_texts(spark, f"{tmp_path}/bbox_*.json")).collect()
    assert [(r.refcat, r.label, r.file) for r in chunk] == [("R1", "l", "bbox_1.json")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "good.pdf").write_bytes(b"%PDF-" + b"x" * 20000)
    (tmp_path / "f" / "small.png").write_bytes(b"\x89PNG")
    (tmp_path / "f" / "bad.pdf").write_bytes(b"<html>")
    (tmp_path / "f" / "wms_1_2_3_4_0.25.png").write_bytes(b"\x89PNG")
    want = spark.createDataFrame([("good.pdf", "pdf"), ("small.png", "png"), ("bad.pdf", "pdf"),
                                  ("none.pdf", "pdf")], "name string, kind string")
    st = files.integrity(want, files.heads(spark, f"{tmp_path}/f"))
    assert {r.name: r.status for r in st.collect()} == {
        "good.pdf": "ok", "small.png": "too_small", "bad.pdf": "bad_header", "none.pdf": "missing"}
    tiles = files.tile_catalog(files.catalog(spark, f"{tmp_path}/f")).collect()
    assert [(t.x1, t.y2, t.mpp, t.bytes) for t in tiles] == [(1, 4, 0.25, 4)]


def test_incomplete_listing_fails(spark):
    page = spark.createDataFrame(
        [(1, '<a href="/documents/35127/ab?x" class="card-title">PLANO__9-K__I.pdf</a>')],
        "page int, body string")
    assert listings.urban_sheets(page, "https://t", 1).first().sheet_name == "PLANO_9_K_I.pdf"
    dashes = page.select("page", F.regexp_replace("body", "PLANO__9", "PLANO-9").alias("body"))
    assert listings.urban_sheets(dashes, "https://t", 1).first().sheet_name == "PLANO_PLANO_9_K_I.pdf"
    for pages in (page, page.limit(0)):
        with pytest.raises(ValueError, match="incomplete sheet listing"):
            listings.urban_sheets(pages, "https://t")


def test_links_of_one_page_keep_their_order(spark):
    link = '<a href="/documents/35127/c{}" class="card-title"> UG_RC1_{}_PGOU.pdf</a>'
    pages = spark.createDataFrame([(2, link.format(1, "A")), (1, link.format(2, "B") + link.format(
        3, "A"))], "page int, body string")
    found = listings.card_listing(pages, "https://t").orderBy("ord").collect()
    assert [(r.url[-2:], r.ord.page, r.ord.pos) for r in found] == [("c2", 1, 0), ("c3", 1, 1)]


def test_a_very_long_value_is_kept_whole(spark):
    from lindero.operators import cards
    long = "A" * 1_100_000
    lines = spark.createDataFrame([(1, 0, f"CLAVE {long}")], "doc long, pos int, text string")
    assert cards.field_values(lines).filter("field = 'clave'").first().value == long


def test_common_tokens_never_crowd_out_cards(spark):
    names = [f"Q_3_X_4_Y_5_Z{i}.pdf" for i in range(8)] + [f"W_A_3_V{i}.pdf" for i in range(3)]
    pick = random.Random(9)
    part = ["A", "B", "3", "4", "5", "RIO", "PGOU", "77"]
    names += ["_".join(pick.choices(part, k=4)) + f"_N{i}.pdf" for i in range(25)]
    zones = [("A 3 B 4 C 5", None), ("A 3", "x"), ("3 4", None), ("RIO 3 A", ""), ("PGOU 77", None)]
    zones += [(" ".join(pick.choices(part, k=pick.randint(1, 4))), pick.choice([None, "", "B 4"]))
              for _ in range(25)]
    z = spark.createDataFrame(zones, "ambito string, etiqueta string")
    c = spark.createDataFrame(list(enumerate(names)), "ord long, filename string")
    want = {k: v for k, v in brute_links(zones, names).items() if v}
    for common in (0, 1, 3, 256):
        got = {}
        for r in linkage.match_cards(z, c, common).orderBy("rank").collect():
            got.setdefault((r.ambito, r.etiqueta), []).append((r.filename, r.score))
        assert got == want, common


def test_parts_and_latency(spark):
    w = spark.range(23).select(F.format_string("k%03d", "id").alias("key"))
    sizes = {r.part: r["count"] for r in W.split_parts(w, "key", 5).groupBy("part").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 4, 3: 4, 4: 7}
    ms = [float(v) for v in (5, 5, 5, 80, 20, 300, 1, 49.5, 50, 7)]
    df = spark.createDataFrame([(v,) for v in ms], "ms double")
    r = W.latency_profile(df).first()
    assert (r.n, r.median, r.p95, r.max) == (10, 13.5, 300.0, 300.0) and r.hit_share == 0.7


def test_a_file_without_a_head_is_never_ok(spark):
    from lindero.sources import files as FI
    expected = spark.createDataFrame([("a", "pdf"), ("b", "pdf"), ("c", "png")], "name string, kind string")
    files = spark.createDataFrame([("a", 1 << 31, None), ("b", 20000, bytearray(b"%PDF-1.4"))],
                                  "name string, bytes long, head binary")
    got = {r["name"]: r["status"] for r in FI.integrity(expected, files).collect()}
    assert got == {"a": "unread", "b": "ok", "c": "missing"}


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    from lindero.sources import responses as R
    marks = [f"<Placemark>\n<name>Z{i} á</name>\n<description>d</description><Polygon><coordinates>\n"
             f"-5.{i:05d},43.5,0 -5.1,43.6,0 -5.2,43.{i:05d},0\n</coordinates></Polygon>\n</Placemark>"
             for i in range(20000)]
    body = "<?xml?><kml><Document>" + "\n".join(marks) + "</Document></kml>"
    (tmp_path / "town.kml").write_text(body, encoding="utf-8")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    try:
        rows = R.read_elements(spark, str(tmp_path), "Placemark")
        assert rows.rdd.getNumPartitions() > 8
        split = R.parse_zones(rows, "u").select("id", "rings", "file").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    whole = R.parse_zones(R.read_texts(spark, str(tmp_path)), "u").select("id", "rings", "file").collect()
    assert len(split) == 20000 and sorted(map(repr, split)) == sorted(map(repr, whole))
    order = [r["body"].split("<name>")[1].split(" ")[0] for r in rows.orderBy("file", "at").collect()]
    assert order == [f"Z{i}" for i in range(20000)]


def test_cards_of_one_file_name_are_cards_of_their_own(spark):
    name = "ALFA_1_UG_RC1_Ficha_n_1080_PGOU.pdf"
    c = spark.createDataFrame([(name, 3), (name, 7), ("BETA_2_UG_RC2_Ficha_n_0002_PGOU.pdf", 5)],
                              "filename string, ord long")
    z = spark.createDataFrame([("alfa pgou", None)], "ambito string, etiqueta string")
    for common in (256, 1):
        got = [(r.filename, r.rank) for r in linkage.match_cards(z, c, common).orderBy("rank").collect()]
        assert got[:2] == [(name, 1), (name, 2)], common
    labels = spark.createDataFrame([("UG-RC1", 1)], "etiqueta string, ord long")
    got = sorted((r.filename, r.etiqueta, r.tier) for r in linkage.zone_of_card(c, labels).collect())
    assert [r[0] for r in got].count(name) == 2 and len(got) == 3
    assert got[0][1:] == ("UG-RC1", "exact")


def test_sets_of_common_tokens_do_not_meet_every_class(spark, monkeypatch):
    pick = random.Random(5)
    one, two = ["ROJO", "AZUL", "VERDE", "NEGRO"], ["RIO", "MONTE", "VALLE", "PRADO"]
    names = [f"{pick.choice(one)}_{pick.choice(two)}_{i % 7}_RC{i % 11}_N_{1000 + i}_PGOU.pdf" for i in range(300)]
    zones = [(f"PGOU {pick.choice(one)} {pick.choice(two)} {100 + i}", f"RC{i % 11}") for i in range(100)]
    zones.append(("PGOU RIO MONTE ROJO AZUL 1 2 3 4 5 6 RC1 RC2", None))  # more tokens than are taken apart
    z = spark.createDataFrame(zones, "ambito string, etiqueta string")
    c = spark.createDataFrame(list(enumerate(names)), "ord long, filename string")
    rows, settle = {}, linkage.settle

    def counted(df, name="settled"):
        out = settle(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(linkage, "settle", counted)
    got = {}
    for r in linkage.match_cards(z, c, common=0).orderBy("rank").collect():
        got.setdefault((r.ambito, r.etiqueta), []).append((r.filename, r.score))
    assert got == {k: v for k, v in brute_links(zones, names).items() if v}
    # No step holds more than a few rows a card, while nearly every set meets nearly every class.
    assert rows["sets"] * rows["classes"] > 20 * len(names) and 0 < rows["alike"] < 20 * len(names)


def test_a_number_that_the_name_cuts_is_the_listings(spark):
    c = spark.createDataFrame([("A_UG_RC1_Ficha_n_1080_PGOU.pdf", 10801), ("A_XX_RC1_Ficha_n_0012_PGOU.pdf", 7),
                               ("A_UG_RC1_Ficha_n_1080_PGOU.pdf", 2080)], "filename string, num int")
    assert [r.num for r in linkage.with_meta(c).collect()] == [10801, 12, 1080]
    assert [r.num for r in linkage.with_meta(c.drop("num")).collect()] == [1080, 12, 1080]


def test_contains_join_gathers_nothing_in_the_driver(spark):
    from lindero.operators.substring import contains_join
    texts = spark.range(9).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    plan = contains_join(texts.select(F.col("t").alias("n")), "n", texts, "t") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_a_small_file_of_many_rows_is_not_gathered_in_the_driver(spark, tmp_path):
    import os

    from lindero.session import tune
    session = spark.newSession()
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        session.conf.unset(key)  # Spark's own, 10 MB
    cards = session.range(300_000).select("id", F.concat(F.lit("a name that many cards have "), F.col("id") % 7).alias("name"))
    cards.coalesce(1).write.parquet(f"{tmp_path}/cards")
    size = sum(os.path.getsize(f"{tmp_path}/cards/{f}") for f in os.listdir(f"{tmp_path}/cards"))
    assert size < 3e6  # its rows take ten times as much
    cards = tune(session).read.parquet(f"{tmp_path}/cards")
    joined = cards.join(cards.withColumnRenamed("name", "other"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_names_of_zones_are_made_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("PGOU ROJO 12", "UG-RC1"), ("PE-3", None)], "ambito string, etiqueta string") \
        .write.parquet(f"{tmp_path}/zones")
    z = spark.read.parquet(f"{tmp_path}/zones")
    c = spark.createDataFrame([(1, "ROJO_12_UG_RC1_PGOU.pdf"), (2, "PE_3_UG_RC2_PGOU.pdf")], "ord long, filename string")
    plans, settle = [], linkage.settle

    def seen(df, name="settled"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df, name)

    monkeypatch.setattr(linkage, "settle", seen)
    out = linkage.match_cards(z, c)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert sum(" AS zid#" in p for p in plans) == 1
    assert [r.filename for r in out.filter("ambito = 'PGOU ROJO 12'").orderBy("rank").collect()] == [
        "ROJO_12_UG_RC1_PGOU.pdf", "PE_3_UG_RC2_PGOU.pdf"]


def test_card_lines_are_read_from_their_own_table(spark, tmp_path):
    rows = [(1, 0, i, t) for i, t in enumerate(
        ["CALIFICACION DE SUELOS PUBLICOS", "EL", "LIBRE", "1", "2", "TOTAL SUELO PUBLICO", "3", "4",
         "uno", "dos", "tres", "cuatro"])]
    spark.createDataFrame(rows, "doc long, page int, line_no int, text string").write.parquet(
        f"{tmp_path}/lines")
    body = cards.card_lines(spark.read.parquet(f"{tmp_path}/lines"))
    inside = cards.section_lines(body, cards.section_bounds(body))
    for table in (body, inside):
        assert not [f for f in table.inputFiles() if str(tmp_path) in f]
    assert [tuple(r) for r in cards.section_bounds(body).collect()] == [(1, "publico", 0, 5)]
    assert [r["pos"] for r in inside.orderBy("pos").collect()] == [1, 2, 3, 4, *range(6, 12)]


def test_lines_left_out_beforehand_answer_no_field(spark):
    lines = [*cards.LABEL_FIELDS.values(), *cards.SYSTEM_FIELDS.values(), "numero 7", "Iniciativa privada",
             "% para viviendas de proteccion: 3", "Nº aprox. viv. prot.: 4", "N APROX VIV PROT 4",
             "viviendas construibles total 5", "densidad bruta 6", "superficie media 7",
             "viario 1%=2 m2", "aprovechamiento medio: RC, 1,3 u.a.h."]
    frame = spark.createDataFrame([(i, 0, t.lower() if i % 2 else t) for i, t in enumerate(lines)]
                                  + [(i, 1, "x") for i in range(len(lines))],
                                  "doc long, pos int, text string")
    kept = frame.filter("pos = 0").filter(F.upper("text").rlike(cards.FIELD_WORDS))
    assert kept.count() == len(lines)
    answered = {r["doc"] for r in cards.field_values(frame).select("doc").collect()}
    systems = range(len(cards.LABEL_FIELDS), len(cards.LABEL_FIELDS) + len(cards.SYSTEM_FIELDS))
    assert answered == set(range(len(lines))) - set(systems)


def test_only_lines_that_begin_like_a_label_are_tidied(spark, monkeypatch):
    rows = [(1, 0, "  Clave:  ED 3 "), (1, 1, "the clave, numero and nombre are words of a sentence"),
            (1, 2, "\tNOMBRE"), (1, 3, "   "), (1, 4, " La Vega  "), (1, 5, "Nº Aprox. viv. prot.: 12"), (1, 6, "viario 4%=55 m2"),
            (1, 7, "%  PARA VIVIENDAS DE PROTECCION"), (1, 8, "30"), (1, 9, "no nombre"), (1, 10, "aprovechamiento medio: RC, 1,3 u.a.h.")]
    frame = spark.createDataFrame(rows, "doc long, pos int, text string")
    tidied, tidy = [], cards._tidied

    def seen(lines):
        tidied.extend(r["pos"] for r in lines.collect())
        return tidy(lines)

    monkeypatch.setattr(cards, "_tidied", seen)
    got = {r["field"]: r["value"] for r in cards.field_values(frame).collect()}
    assert got == {"clave": "ED 3", "nombre": "La Vega", "n_aprox_viv_proteccion": "12", "sg_viario_m2": "55",
                   "viviendas_proteccion_pct": "30", "aprovechamiento_codigo": "RC", "aprovechamiento_uah": "1,3"}
    assert sorted(tidied) == [0, 2, 5, 6, 7, 10]


def test_plain_and_other_european_numbers(spark):
    from lindero.functions import text as T
    want = {"12": 12.0, "1.234,5": 1234.5, "-3,5": -3.5, " 1.000 m2 ": 1000.0, "12\n": 12.0, "30 %": 30.0, "": None, "-": None,
            "1,2,3": None, "4 Viv/Ha": 4.0, "1 2": 12.0, "x": None, ".5": 5.0}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", T.european_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == want
