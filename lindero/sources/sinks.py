"""Result sinks: partitioned records, versioned tables, resumable appends, corrections."""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# What Spark says of files that are gone or are no Parquet.
BROKEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER",
          "is not a Parquet file")


def write_results(results: DataFrame, path: str, partition: str = "municipality") -> None:
    """Per-key records, one folder per municipality.

    A municipality with a large share of the keys is written by every task that holds some of it, in
    files of bounded length, so no repartitioning is needed.
    """
    results.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000) \
        .partitionBy(partition).parquet(path)


class VersionedTable:
    """A table replaced as a whole without readers ever seeing half of it.

    Each version is written to a folder of its own and becomes current when its number is added to
    the manifest, which a single small task does. Nothing that is being read is overwritten.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def versions(self) -> list[int]:
        """Published version numbers, newest first. The manifest holds one row per publication."""
        try:
            rows = self.spark.read.schema("version long").parquet(f"{self.base}/manifest")
            return [r.version for r in rows.distinct().orderBy(F.col("version").desc()).collect()]
        except AnalysisException:
            return []

    def path(self, version: int) -> str:
        return f"{self.base}/data/v{version:09d}"

    def publish(self, df: DataFrame) -> int:
        """Write the next version. A crashed attempt leaves no trace: its folder is written anew."""
        version = next(iter(self.versions()), 0) + 1
        df.write.mode("overwrite").parquet(self.path(version))
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1) \
            .write.mode("append").parquet(f"{self.base}/manifest")
        return version

    def current(self) -> DataFrame | None:
        """The newest readable version; with a broken one the version before, and a warning.

        Broken is a version whose files are gone or are no Parquet. Any other failure, such as
        missing rights or a lost network, is raised.
        """
        for version in self.versions():
            try:
                df = self.spark.read.parquet(self.path(version))
                df.limit(1).collect()
                return df
            except (PySparkException, Py4JJavaError) as error:
                if not any(sign in str(error) for sign in BROKEN):
                    raise
                warnings.warn(f"{self.path(version)} cannot be read; the version before is used",
                              stacklevel=2)
        return None


def read_done(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Records written by earlier runs; lines that do not parse are ignored."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return None


def append_new(results: DataFrame, path: str, key: str, schema: str) -> None:
    """Append the results whose key is not present yet, as JSON lines; safe to run again."""
    done = read_done(results.sparkSession, path, schema)
    fresh = results if done is None else results.join(
        done.select(key).distinct(), key, "left_anti")
    fresh.write.mode("append").json(path)


def corrections(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdicts joined to their candidates; for bad ones with a click, the correction in metres.

    verdicts(idx, verdict, cx, cy); candidates(idx, rc, px, py, m_per_px, ...).
    """
    joined = verdicts.join(candidates, "idx")
    clicked = (F.col("verdict") == "bad") & F.col("cx").isNotNull() & F.col("cy").isNotNull()

    def shift(at: str, predicted: str) -> Column:
        return F.when(clicked, (F.col(at) - F.col(predicted)) * F.col("m_per_px"))

    return joined.withColumn("correction_dx_m", shift("cx", "px")).withColumn(
        "correction_dy_m", shift("cy", "py"))
