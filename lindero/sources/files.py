"""File catalogues and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.operators.skew import first_per_key

# Leading bytes and least sizes by kind of file, tile and rural sheet name forms.
MAGIC = {"pdf": (b"%PDF-", 10000), "png": (b"\x89PNG", 1000)}
# Bytes of the largest value that Spark can hold.
LARGEST = (1 << 31) - 1025
TILE_NAME = r"wms_(\d+)_(\d+)_(\d+)_(\d+)_([\d.]+)\.png$"
RURAL_NAME = r"^PLANO_[A-J]_\d+\.pdf$"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, bytes, mtime) without opening the files: only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path",
        F.col("length").alias("bytes"), F.unix_seconds("modificationTime").alias("mtime"))


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, head): size and first eight bytes of each file.

    A file above `LARGEST` bytes does not fit in one value; it is listed with a null head.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    opened = F.col("length") <= LARGEST
    size = F.col("length").alias("bytes")
    return files.filter(opened).select(
        name, size, F.substring("content", 1, 8).alias("head")).union(
        files.filter(~opened).select(name, size, F.lit(None).cast("binary").alias("head")))


def integrity(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status) of expected(name, kind) against files(name, bytes, head): ok, missing,
    unread (no head, so nothing is known of its content), bad_header or too_small."""
    one = first_per_key(files.select("name", "bytes", "head"), ["name"], [F.col("bytes")])
    joined = expected.join(one, "name", "left")
    status = F.when(F.col("bytes").isNull(), F.lit("missing")).when(
        F.col("kind").isin(*MAGIC) & F.col("head").isNull(), F.lit("unread"))
    for kind, (magic, _) in MAGIC.items():
        wrong = F.substring("head", 1, len(magic)) != F.lit(magic)
        status = status.when((F.col("kind") == kind) & wrong, F.lit("bad_header"))
    for kind, (_, least) in MAGIC.items():
        status = status.when((F.col("kind") == kind) & (F.col("bytes") < least),
                             F.lit("too_small"))
    return joined.select("name", "kind", status.otherwise(F.lit("ok")).alias("status"))


def tile_catalog(files: DataFrame) -> DataFrame:
    """Tiles among files(name, path, bytes): x1, y1, x2, y2, mpp, bytes, path."""
    def part(i: int) -> Column:
        return F.regexp_extract("name", TILE_NAME, i)
    return files.filter(F.col("name").rlike(TILE_NAME)).select(
        *[part(i).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 1)],
        part(5).cast("double").alias("mpp"), "bytes", "path")


def rural_sheet_files(files: DataFrame) -> DataFrame:
    """Names of rural sheets among the files, each once."""
    return files.filter(F.col("name").rlike(RURAL_NAME)).select(
        F.col("name").alias("sheet_name")).distinct()
