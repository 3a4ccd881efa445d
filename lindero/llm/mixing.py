"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import ROW, pack, unpack
from lindero.operators.skew import running_total
from lindero.session import settle

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3),
                   cap: int = 3) -> DataFrame:
    """Target of each source from (source, source_size), one row each.

    Sources in code point order, null last, weigh 1, 2, 3 and so on in turn and share the whole.
    A target stops at `cap` times its source; what is above is shared again by weight among the
    others until none is above. Ranks come from ranges of sources, not from one task, and each
    round of sharing is one aggregate over the table of sources: two sums reach the driver.
    Returns source, source_size, target.
    """
    ranked = running_total(sizes.withColumn("none", F.col("source").isNull()),
                           ["none", "source"], out="rank")
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    known = settle(ranked.select(
        "source", "source_size",
        F.get(wheel, (F.col("rank") % len(weights)).cast("int")).cast("bigint").alias("weight"),
        (F.col("source_size") * cap).alias("top")), "sources")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    full = F.lit(False)
    found = -1
    share = None
    while True:
        row = known.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("top")).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if row["n"] == found or not row["open"]:
            break
        found = row["n"]
        # weight * rest / open, in this order: the same floating point value in any engine
        share = (F.col("weight").cast("double") * F.lit(float(total - (row["taken"] or 0)))
                 / F.lit(float(row["open"])))
        full = F.col("top").cast("double") <= share
    top = F.col("top").cast("double")
    target = top if share is None else F.when(full, top).otherwise(share)
    return known.select("source", "source_size", target.alias("target"))


def plan_copies(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3,
                seed: str = "mix") -> DataFrame:
    """How often each document is taken so that every source comes near its target.

    Adds size (words of the text), source_size, target and copies; input columns of these names
    are replaced. The repetition rate of a source is target over source_size; a document is taken
    floor(rate) times plus once more when a number hashed from seed and doc_id is below the
    fraction, so reruns agree and no document is taken more than `cap` times.

    Null text: size 0. Null source: a source of its own. Rows with equal doc_id (null too) share
    one decision. A source without words has target 0 and its documents are not taken. An empty
    table gives an empty table. The text is read once for the sums and once for the rows; the
    join carries the small side only, and a hot source is split by the adaptive join.
    """
    base = docs.select(
        pack(docs), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"),
                                                              F.lit("null"))))
    chance = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    copies = F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)
    own = ("size", "source_size", "target", "copies")
    return (base.join(targets, F.col("source").eqNullSafe(F.col("of")))
            .select(*unpack(docs.columns, own), "size", "source_size", "target",
                    copies.cast("int").alias("copies")))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3,
        seed: str = "mix") -> DataFrame:
    """The mixture itself: each document as many times as `plan_copies` says, same columns.

    Null and empty texts have no words, so the mix takes none of them unless words beside them give
    their source a rate; equal rows are repeated alike; columns of any name are kept. Texts are
    carried, never cut. An empty table gives an empty table.
    """
    packed = docs.select(pack(docs), "doc_id", "source", "text")
    planned = plan_copies(packed, weights, cap, seed)
    return (planned.filter(F.col("copies") > 0)
            .withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*unpack(docs.columns)))
