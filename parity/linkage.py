"""Names, record cards and their links to zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lindero.functions import text as T
from lindero.operators import linkage as K
from parity import derived as D
from parity.base import add, table
from parity.derived import with_sql

# Card file names from parts; zones from suppliers with the same name material.
D.define("cards", """
SELECT p_partkey AS ord, upper(replace(p_name, ' ', '_')) || '_' || (p_partkey % 40)::VARCHAR
  || CASE p_partkey % 6 WHEN 0 THEN '_UG_' WHEN 1 THEN '_AU_' WHEN 2 THEN '_PE_' WHEN 3 THEN '_UG2_'
       WHEN 4 THEN '_AA_' ELSE '_XX_' END
  || 'RC' || (p_partkey % 90)::VARCHAR || '_Ficha_n_' || lpad(p_partkey::VARCHAR, 4, '0') || '_PGOU.pdf' AS filename,
  CASE p_partkey % 6 WHEN 0 THEN 'UG' WHEN 1 THEN 'AU' WHEN 2 THEN 'PE' WHEN 3 THEN 'UG2' WHEN 4 THEN 'AA' END AS tipo,
  CASE WHEN p_partkey % 6 < 5 THEN 'RC' || (p_partkey % 90)::VARCHAR END AS codigo,
  p_partkey::INT AS num, upper(p_name) || ' ' || (p_partkey % 40)::VARCHAR AS nombre
FROM part""")


def cards(spark, sf):
    k = F.col("p_partkey")
    kind = k % 6
    mid = None
    for i, name in enumerate(("_UG_", "_AU_", "_PE_", "_UG2_", "_AA_")):
        mid = F.when(kind == i, name) if mid is None else mid.when(kind == i, name)
    name = F.concat(
        F.upper(F.translate("p_name", " ", "_")), F.lit("_"), (k % 40).cast("string"),
        mid.otherwise("_XX_"), F.lit("RC"), (k % 90).cast("string"), F.lit("_Ficha_n_"),
        F.lpad(k.cast("string"), 4, "0"), F.lit("_PGOU.pdf"))
    return table(spark, sf, "part").select(
        k.alias("ord"), name.alias("filename"),
        F.concat(F.lit("https://cards.example/"), k.cast("string")).alias("url"),
        k.cast("int").alias("num"))


D.define("named_zones", """
SELECT s_suppkey AS ord, CASE s_suppkey % 5 WHEN 0 THEN 'PE-' || (s_suppkey % 9)::VARCHAR
  WHEN 1 THEN p_name || ' ' || (s_suppkey % 40)::VARCHAR WHEN 2 THEN p_name
  WHEN 3 THEN 'PGOU ' || p_brand || ' ' || (s_suppkey * 7 % 2000)::VARCHAR ELSE 'FICHA ' || p_name || ' PGOU ' || p_type END AS ambito,
  CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'UG-RC' || (s_suppkey % 90)::VARCHAR ELSE '' END AS etiqueta
FROM supplier JOIN part ON p_partkey = s_suppkey * 37 % (SELECT max(p_partkey) + 1 FROM part)""")


def named_zones(spark, sf):
    s = F.col("s_suppkey")

    def txt(c):
        return c.cast("string")
    n, five, three = F.col("p_name"), s % 5, s % 3
    ambito = (F.when(five == 0, F.concat(F.lit("PE-"), txt(s % 9)))
              .when(five == 1, F.concat(n, F.lit(" "), txt(s % 40))).when(five == 2, n)
              .when(five == 3, F.concat(F.lit("PGOU "), "p_brand", F.lit(" "), txt(s * 7 % 2000)))
              .otherwise(F.concat(F.lit("FICHA "), n, F.lit(" PGOU "), F.col("p_type"))))
    etiqueta = F.when(three == 1, F.concat(F.lit("UG-RC"), txt(s % 90))).when(three == 2, "")
    return table(spark, sf, "supplier").join(
        table(spark, sf, "part"), F.col("p_partkey") == s * 37 % D.key_range(spark, sf, "part", "p_partkey")
    ).select(s.alias("ord"), ambito.alias("ambito"), etiqueta.alias("etiqueta"))


def link_pairs_sql(names: str) -> str:
    """Brute force over all (zone name, card) pairs."""
    return r"""
SELECT ambito, etiqueta, filename, ord, words, codes, nums, norm,
  list_sum(list_transform(words, lambda t: (contains(norm, t))::INT)) AS n_word,
  coalesce(list_sum(list_transform(nums, lambda t: (contains(norm, ' ' || t || ' '))::INT)), 0) AS n_num,
  coalesce(list_sum(list_transform(codes, lambda t: (contains(norm, ' ' || t || ' '))::INT)), 0) AS n_code
FROM (SELECT *, list_filter(raw, lambda t: length(t) > 2) AS words, list_filter(raw, lambda t: regexp_full_match(t, '\d+')) AS nums,
        list_filter(list_transform(range(1, len(raw)), lambda i: CASE WHEN length(raw[i]) <= 4
          AND (regexp_full_match(raw[i + 1], '\d+') OR length(raw[i + 1]) <= 4) THEN raw[i] || ' ' || raw[i + 1] END), lambda t: t IS NOT NULL) AS codes
      FROM (SELECT DISTINCT ambito, etiqueta, list_filter(string_split_regex(translate(upper(ambito || ' ' || coalesce(etiqueta, '')), '-_Ñ', '  N'), '\s+'),
              lambda t: t <> '') AS raw FROM """ + names + r""")),
     (SELECT filename, ord, ' ' || translate(upper(replace(filename, '.pdf', '')), '-_', '  ') || ' ' AS norm FROM cards)
"""


def links_sql(pairs: str) -> str:
    """The five best cards of each name."""
    return """
SELECT ambito, etiqueta, filename, score, tokens_matched, num_matched,
   row_number() OVER (PARTITION BY ambito, etiqueta ORDER BY score DESC, ord)::INT AS rank
FROM (SELECT ambito, etiqueta, filename, ord, CASE WHEN len(words) = 0 THEN 10 * n_code ELSE n_word + 5 * n_num END::BIGINT AS score,
        CASE WHEN len(words) = 0 THEN n_code ELSE n_word END::BIGINT AS tokens_matched,
        CASE WHEN len(words) = 0 THEN 0 ELSE n_num END::BIGINT AS num_matched
      FROM """ + pairs + """ WHERE (len(words) = 0 AND n_code > 0) OR (len(words) > 0 AND n_word >= greatest(1, len(words) // 2)))
QUALIFY row_number() OVER (PARTITION BY ambito, etiqueta ORDER BY score DESC, ord) <= 5"""


D.define("link_pairs", link_pairs_sql("named_zones"), "named_zones", "cards")
D.define("links", links_sql("link_pairs"), "link_pairs")


@add("jn17_zone_to_cards", with_sql("SELECT * FROM links", "links"))
def _(spark, sf):
    return K.match_cards(named_zones(spark, sf), cards(spark, sf))


@add("tk1_top_cards", with_sql(
    "SELECT ambito, etiqueta, string_agg(filename, '|' ORDER BY rank) AS top FROM links"
    " GROUP BY ambito, etiqueta", "links"))
def _(spark, sf):
    m = K.match_cards(named_zones(spark, sf), cards(spark, sf), common=50)
    return m.groupBy("ambito", "etiqueta").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "filename"))), lambda s: s["filename"]),
        "|").alias("top"))


# Labels of zones for the card -> zone direction.
D.define("label_zones", """
SELECT s_suppkey AS ord, CASE s_suppkey % 4
  WHEN 0 THEN 'UG-' || upper(p_name) || ' ' || (p_partkey % 40)::VARCHAR WHEN 1 THEN lower(p_name) || '  ' || (p_partkey % 40)::VARCHAR
  WHEN 2 THEN 'AU_RC' || (p_partkey % 90)::VARCHAR ELSE 'Zona ' || p_name || '-' || (p_partkey % 40)::VARCHAR || ' bis' END AS etiqueta
FROM supplier JOIN part ON p_partkey = s_suppkey * 71 % (SELECT max(p_partkey) + 1 FROM part)""")


def label_zones(spark, sf):
    s, k = F.col("s_suppkey"), F.col("p_partkey")

    def txt(c):
        return c.cast("string")
    four = s % 4
    e = (F.when(four == 0, F.concat(F.lit("UG-"), F.upper("p_name"), F.lit(" "), txt(k % 40)))
         .when(four == 1, F.concat(F.lower("p_name"), F.lit("  "), txt(k % 40)))
         .when(four == 2, F.concat(F.lit("AU_RC"), txt(k % 90)))
         .otherwise(F.concat(F.lit("Zona "), "p_name", F.lit("-"), txt(k % 40), F.lit(" bis"))))
    return table(spark, sf, "supplier").join(table(spark, sf, "part"), k == s * 71 % D.key_range(spark, sf, "part", "p_partkey")).select(
        s.alias("ord"), e.alias("etiqueta"))


NORM_B = "trim(regexp_replace(translate(upper({}), '-_Ñ', '  N'), '\\s+', ' ', 'g'))"


@add("jn18_card_to_zone", with_sql("""
WITHIN SELECT c.filename, coalesce(exact, part) AS etiqueta,
   CASE WHEN exact IS NOT NULL THEN 'exact' WHEN part IS NOT NULL THEN 'part' END AS tier
FROM cards c LEFT JOIN (SELECT filename, arg_min(etiqueta, z.ord) AS exact FROM cards c JOIN z
   ON n IN (tipo || ' ' || nombre, nombre, tipo || ' ' || codigo) WHERE tipo IS NOT NULL GROUP BY filename) e ON e.filename = c.filename
LEFT JOIN (SELECT filename, arg_min(etiqueta, z.ord) AS part FROM cards c JOIN z ON contains(n, nombre)
   WHERE tipo IS NOT NULL GROUP BY filename) p ON p.filename = c.filename""".replace(
    "WITHIN", ", z AS (SELECT *, " + NORM_B.format("etiqueta") + " AS n FROM label_zones)\n"),
    "cards", "label_zones"))
def _(spark, sf):
    return K.zone_of_card(cards(spark, sf), label_zones(spark, sf))


D.define("searches", """
SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN ' rc' || (c_custkey % 120)::VARCHAR || ' ' WHEN 1 THEN (c_custkey * 3)::VARCHAR
  WHEN 2 THEN lower(p_name) WHEN 3 THEN substr(replace(p_name, ' ', '_'), 2, 5) ELSE substr(p_name, 1, 2) END AS q
FROM customer JOIN part ON p_partkey = c_custkey % (SELECT max(p_partkey) + 1 FROM part)""")


def searches(spark, sf):
    c = F.col("c_custkey")
    five = c % 5
    q = (F.when(five == 0, F.concat(F.lit(" rc"), (c % 120).cast("string"), F.lit(" ")))
         .when(five == 1, (c * 3).cast("string")).when(five == 2, F.lower("p_name"))
         .when(five == 3, F.substring(F.translate("p_name", " ", "_"), 2, 5))
         .otherwise(F.substring("p_name", 1, 2)))
    return table(spark, sf, "customer").join(
        table(spark, sf, "part"), F.col("p_partkey") == c % D.key_range(spark, sf, "part", "p_partkey")).select(q.alias("q")).distinct()


@add("jn19_find_cards", with_sql(r"""
SELECT q, filename, tier, rank FROM (
 SELECT *, min(tier) OVER (PARTITION BY q) AS best, row_number() OVER (PARTITION BY q ORDER BY tier, ord)::INT AS rank FROM (
  SELECT q, filename, ord, CASE WHEN codigo = u THEN 1 WHEN regexp_full_match(u, '\d+') AND u::INT = num THEN 2
     WHEN contains(upper(filename), u) THEN 3 END AS tier
  FROM (SELECT q, upper(trim(q)) AS u FROM searches), cards) WHERE tier IS NOT NULL)
WHERE tier = best AND rank <= 50""", "searches", "cards"))
def _(spark, sf):
    return K.find_cards(searches(spark, sf), cards(spark, sf))


@add("jn27_card_record", with_sql("""
SELECT ord, filename, r.superficie FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN filename ELSE replace(filename, '.pdf', '.PDF') END AS f FROM cards) c
LEFT JOIN (SELECT replace(filename, '.pdf', '') AS key, (ord * 1.5)::DOUBLE AS superficie FROM cards WHERE ord % 3 <> 0) r
 ON r.key = replace(replace(f, '.pdf', ''), '.PDF', '')""".replace("SELECT ord, filename", "SELECT ord, f AS filename"), "cards"))
def _(spark, sf):
    c = cards(spark, sf)
    records = c.filter(F.col("ord") % 3 != 0).select(
        K.card_key(F.col("filename")).alias("key"), (F.col("ord") * 1.5).alias("superficie"))
    name = F.when(F.col("ord") % 2 == 0, F.col("filename")).otherwise(
        F.regexp_replace("filename", r"\.pdf", ".PDF"))
    return K.attach_card_records(c.select("ord", name.alias("filename")), records).select(
        "ord", "filename", "superficie")


@add("prj19_list_cards", with_sql("SELECT filename, ord, tipo, codigo, num FROM cards WHERE tipo = 'UG'", "cards"))
def _(spark, sf):
    return K.list_cards(cards(spark, sf), "ug")


@add("sf8_card_meta", with_sql("SELECT filename, tipo, codigo, num FROM cards", "cards"))
def _(spark, sf):
    return K.with_meta(cards(spark, sf)).select("filename", "tipo", "codigo", "num")


@add("sf1_loose_name", with_sql(
    "SELECT doc_id, translate(upper(replace(text, 'ß', 'SS')), '-_Ñ', '  N') AS name FROM documents"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.loose_name(F.col("text")).alias("name"))


@add("sf2_tight_name", with_sql(
    "SELECT doc_id, " + NORM_B.format("replace(text, 'ß', 'SS')") + " AS name FROM documents"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tight_name(F.col("text")).alias("name"))


@add("sf15_safe_name_hash", with_sql("""
SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 200) AS safe, sha256(html) AS sha FROM pages"""))
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", T.safe_name(F.col("url")).alias("safe"),
        T.content_hash(F.col("html").cast("binary")).alias("sha"))
