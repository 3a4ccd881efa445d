"""Functions of SQL text against the column builders of the same names."""

from pyspark.sql import functions as F

from lindero.functions import geometry, keys, sql, text


def test_text_functions(spark):
    sql.register(spark)
    texts = [None, "", " ", "1.234,5 m2", "12,5%", "3 Viv/Ha", "x", "-7", "0152067TP7005S", " 0152067tp7005s ",
             "0152067TP7005S0001AB", "15", "ñu-Ñ_x  y\t z ", "it's \\ q", "ϬϭϮ͕A", "1e3", "2.5", "3,5", "m2",
             "\x0c\x03Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    rows.createOrReplaceTempView("texts")
    got = spark.sql("SELECT t, loose_name(t) a, tight_name(t) b, european_number(t) c, safe_int(t) d,"
                    " decode_glyphs(t) e, key_error(t) f FROM texts").collect()
    t = F.col("t")
    want = rows.select("t", text.loose_name(t).alias("a"), text.tight_name(t).alias("b"),
                       text.european_number(t).alias("c"), text.safe_int(t).alias("d"),
                       text.decode_glyphs(t).alias("e"), keys.key_error(t).alias("f")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_in_ring(spark):
    sql.register(spark)
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    points = [(x / 2 + 0.1, y / 2 + 0.1, ring) for x in range(-2, 12) for y in range(-2, 12)]
    rows = spark.createDataFrame(points, f"x double, y double, ring {sql.RING}")
    rows.createOrReplaceTempView("places")
    got = spark.sql("SELECT x, y, in_ring(x, y, ring) AS i FROM places").collect()
    want = rows.select("x", "y", geometry.in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("i"))
    assert sorted(map(tuple, got)) == sorted((r[0], r[1], bool(r[2])) for r in want.collect())
    assert sum(r["i"] for r in got) > 10
    none = spark.sql(f"SELECT in_ring(1.0D, 1.0D, cast(array() AS {sql.RING})) AS i").first()
    assert none["i"] is False
