"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time; the limits are low enough to act before a task spills.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # The size of a file says little about its rows: a few MB of Parquet may be millions of them, all gathered
    # in the driver for a broadcast. Sizes measured in a shuffle are true ones.
    "spark.sql.autoBroadcastJoinThreshold": "256KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method above 8000 bytes; long projections run faster split up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The text of a plan is made anew in the driver after each of its stages.
    "spark.sql.maxPlanStringLength": "65536",
}


def tune(spark: SparkSession) -> SparkSession:
    """The same settings on a session made elsewhere, as far as they can still be changed."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "lindero", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators are planned for; `extra` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder of its own machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="lindero-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one that no result reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


# Tables written while a table of `settle_alone` is made.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def settled(df: DataFrame, name: str = "settled") -> tuple[DataFrame, str]:
    """As `settle`, with the folder of the table, for `remove` once no result reads it any more."""
    path = fresh_path(df.sparkSession, name)
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Cut lineage reliably: the rows are written to the shared folder and read back.

    Used where a plan would work out the same rows several times, or must see one nondeterministic
    layout twice (`running_total`). The table survives the loss of executors, and its true size
    guides the joins that follow.
    """
    return settled(df, name)[0]


def settle_alone(make: Callable[[], DataFrame], name: str = "settled") -> DataFrame:
    """`settle(make())`, after which the tables that `make` wrote on its way are deleted.

    Nothing else that `make` worked out may be read afterwards.
    """
    token = _SCRATCH.set([])
    try:
        df = make()
        found, path = settled(df, name)
        written = _SCRATCH.get()
    finally:
        _SCRATCH.reset(token)
    outer = _SCRATCH.get()
    if outer is not None:
        outer.append(path)
    for scrap in written:
        if scrap != path:
            remove(df.sparkSession, scrap)
    return found
