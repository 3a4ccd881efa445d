"""Joins and ordered results that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.session import settle

# A key counts as hot above 1/SHARE of all rows, so there are fewer than SHARE hot keys:
# that is the proven bound of the broadcast in `salted_join`.
SHARE = 256
# Below this many rows a key is never worth splitting.
FLOOR_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = SHARE,
             floor_rows: int = FLOOR_ROWS) -> DataFrame:
    """Keys above the share, with the number of parts each should be split into.

    Counts are combined before the shuffle, so the hot key itself moves as a few rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    limit = F.greatest(
        counts.agg(F.sum("_rows").alias("n")).scalar() / F.lit(share), F.lit(float(floor_rows))
    )
    return (
        counts.filter(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts"))
    )


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str],
                how: str = "inner", share: int = SHARE, floor_rows: int = FLOOR_ROWS,
                deal_right: bool = False) -> DataFrame:
    """Equi-join where hot keys of `left` are split and the matching rows of `right` repeated.

    `spread` names left columns that tell the rows of one key apart. Every left row meets each
    matching right row exactly once, so this holds for inner, left, semi and anti joins alike.
    With `deal_right` the right side is dealt out by key before the join, for joins that do much
    work per pair: whichever side Spark then broadcasts, the work is spread over all tasks.
    """
    hot = hot_keys(left, keys, share, floor_rows)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted_left = (
        left.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int"))
        .drop("_parts")
    )
    salted_right = (
        right.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    if deal_right:
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted_right = salted_right.repartition(tasks, *keys, "_salt")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def join_known(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join on a key that many rows lack.

    A null key matches nothing, but all null keys meet in one task; here each such row gets a key of
    its own that no table row has.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col(key)),
                     F.concat(F.lit("?"), F.xxhash64(*rows.columns).cast("string")))
    known = table.withColumn("_known", F.concat(F.lit("="), F.col(key))).drop(key)
    return rows.withColumn("_known", own).join(known, "_known", "left").drop("_known")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given ascending order.

    An aggregate, not a window: each task reduces its own rows before the shuffle, so a key with
    a third of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given ascending order; see `first_per_key`."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def running_total(df: DataFrame, order: Sequence[str], weight: str | None = None,
                  out: str = "before") -> DataFrame:
    """Adds to each row the total weight (or number) of all rows ordered before it.

    A window without partition keys would pull the table into one task. Here rows are laid out by
    range, each range is summed on its own, and only one figure per range is accumulated.
    `order` must tell rows apart, so that a range can be cut anywhere. The layout is settled first
    because both passes must see the same ranges.
    """
    amount = F.col(weight) if weight else F.lit(1)
    laid = settle(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
        .withColumn("_amount", amount.cast("bigint"))
    )
    per_range = laid.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    # One row per range: its size is the number of shuffle partitions.
    offsets = per_range.withColumn(
        "_offset",
        F.coalesce(
            F.sum("_sum").over(
                Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("_sum")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        laid.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_range", "_amount", "_inside", "_offset")
    )
