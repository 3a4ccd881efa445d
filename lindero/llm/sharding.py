"""Shards of near-equal bytes by sampled splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.llm.common import ROW, pack, unit_hash, unpack
from lindero.session import settle

WIDTH = 16                # splitters of one level of the look-up
RANGES = WIDTH * WIDTH    # proven bound of the broadcast tables of ranges
SAMPLE = 64 * RANGES      # expected keys in the sample that fixes the splitters
PIECE_BYTES = 64 << 20    # a range above this is subdivided whatever its share


def draw_splitters(keyed: DataFrame, total: int, sample: int = SAMPLE) -> list[int]:
    """Quantile boundaries of the keys by bytes, from a size-weighted sample.

    A row is drawn with probability size * sample / total; a row with more than that counts by
    its whole weight. About `sample` keys reach the driver, whatever the size of the table.
    A boundary inside a text that was drawn several times cuts that text's copies; any other is
    moved to where its text starts, so that copies stay together.
    """
    rate = F.col("size") * F.lit(sample / max(total, 1))
    drawn = sorted(
        (r["key"], r["weight"]) for r in
        keyed.filter(unit_hash(F.col("th"), F.col("dh"), F.lit("splitters")) < rate)
        .select("key", F.greatest(F.lit(1.0), rate).alias("weight")).collect())
    whole = sum(w for _, w in drawn)
    bounds, done = [], 0.0
    for (key, weight), before in zip(drawn, [None, *drawn]):
        if len(bounds) < RANGES - 1 and done >= whole * (len(bounds) + 1) / RANGES:
            start = key & ~0xFFFFFF
            hot = before is not None and before[0] >= start
            bounds.append(key if hot else start)
        done += weight
    return bounds + [(1 << 63) - 1] * (RANGES - 1 - len(bounds))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of splitters at or below the key, by two short scans instead of one long one."""
    wall = F.array(*[F.lit(b).cast("bigint") for b in [*bounds, (1 << 63) - 1]])
    coarse = F.array(*[F.lit(b).cast("bigint") for b in bounds[WIDTH - 1::WIDTH]])
    first = F.size(F.filter(coarse, lambda b: b <= key))
    return first * WIDTH + F.size(
        F.filter(F.slice(wall, first * WIDTH + 1, F.lit(WIDTH)), lambda b: b <= key))


def shard(docs: DataFrame, shards: int = 16, keep_share: float = 0.005) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard) to all documents.

    Law: the shards have near-equal bytes, a row's size being the UTF-8 bytes of its text plus 1.
    Records are range-partitioned on (text hash, row hash) by sampled splitters; ranges that turn
    out overfull are subdivided evenly by key; exact sums of ranges and pieces then give every
    row its byte position in the whole order, and a shard is an equal part of all bytes. Copies
    of one text of at most `keep_share` of a shard stay in one shard; a larger group of copies is
    cut like any other rows. The sums and the shards are exact at every size: the sample decides
    only how the work is spread.

    Null text: as empty, size 1. Rows that are equal in all columns may swap places, which no
    reader can tell. An empty table gives an empty table. Input columns named shard or slot are
    replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        pack(docs), F.xxhash64(text).alias("th"), F.xxhash64(F.col("doc_id"), F.lit(7)).alias("dh"),
        F.col("doc_id").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("bigint")
        .alias("size"))
    low = F.lit(0xFFFFFF)
    base = base.withColumn(
        "key", F.col("th").bitwiseAND(F.lit(~0xFFFFFF)).bitwiseOR(F.col("dh").bitwiseAND(low)))
    total = base.agg(F.sum("size")).first()[0] or 0
    bounds = draw_splitters(base, total)
    ranged = base.withColumn("range", range_of(F.col("key"), bounds))
    limit = max(1, min(2 * total // RANGES, PIECE_BYTES))
    stats = ranged.groupBy("range").agg(
        F.sum("size").alias("r_bytes"), F.count(F.lit(1)).alias("r_rows"),
        F.min("key").alias("lo"), F.max("key").alias("hi"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    stats = settle(stats.select(  # at most RANGES rows
        "range", "lo", "hi", F.ceil(F.col("r_bytes") / limit).cast("int").alias("pieces"),
        F.coalesce(F.sum("r_bytes").over(before), F.lit(0)).alias("r_byte"),
        F.coalesce(F.sum("r_rows").over(before), F.lit(0)).alias("r_row")), "ranges")
    same = F.shiftright("lo", 24) == F.shiftright("hi", 24)
    at = F.when(same, F.col("key")).otherwise(F.shiftright("key", 24)).cast("double")
    lo = F.when(same, F.col("lo")).otherwise(F.shiftright("lo", 24)).cast("double")
    hi = F.when(same, F.col("hi")).otherwise(F.shiftright("hi", 24)).cast("double")
    cut = F.least(F.col("pieces") - 1,
                  F.floor((at - lo) / (hi - lo + 1.0) * F.col("pieces"))).cast("int")
    placed = (ranged.join(F.broadcast(stats), "range")
              .withColumn("piece", F.when(F.col("pieces") <= 1, 0).otherwise(cut)))
    sums = placed.groupBy("range", "piece").agg(
        F.sum("size").alias("p_bytes"), F.count(F.lit(1)).alias("p_rows"))
    earlier = Window.partitionBy("range").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.select(
        "range", "piece", F.coalesce(F.sum("p_bytes").over(earlier), F.lit(0)).alias("p_byte"),
        F.coalesce(F.sum("p_rows").over(earlier), F.lit(0)).alias("p_row"))
    inside = Window.partitionBy("range", "piece").orderBy("th", "dh", "doc_id")
    copies = Window.partitionBy("range", "piece", "th")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (
        placed.withColumn("i_row", F.row_number().over(inside) - 1)
        .withColumn("i_byte", F.sum("size").over(upto) - F.col("size"))
        .withColumn("c_byte", F.min("i_byte").over(copies))
        .withColumn("c_bytes", F.sum("size").over(copies))
        .join(sums, ["range", "piece"])
        .withColumn("row", F.col("r_row") + F.col("p_row") + F.col("i_row")))
    small = F.col("c_bytes") <= F.lit(keep_share * total / shards)
    middle = (F.col("r_byte") + F.col("p_byte")
              + F.when(small, F.col("c_byte") + F.col("c_bytes") / 2)
              .otherwise(F.col("i_byte") + F.col("size") / 2))
    ordered = settle(ordered.select(
        ROW, "row", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1))))
        .cast("int").alias("shard")), "ordered")
    first = ordered.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return (ordered.join(F.broadcast(first), "shard")
            .select(*unpack(docs.columns, ("shard", "slot")), "shard",
                    (F.col("row") - F.col("first")).cast("bigint").alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    (sharded.repartition("shard", F.floor(F.col("slot") / 100_000))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
