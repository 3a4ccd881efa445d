"""Exact `haystack contains needle` join without comparing every needle with every haystack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """Distinct character runs of one size."""
    n = F.length(text)
    runs = F.transform(
        F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size))
    )
    return F.when(n >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def contains_join(needles: DataFrame, needle: str, haystacks: DataFrame, hay: str) -> DataFrame:
    """Distinct (needle, hay) pairs where the haystack contains the needle.

    Both sides are reduced to distinct texts first, so copies cost nothing. A needle is looked up by
    the one of its three-character runs that fewest haystacks have (needles shorter than that by
    themselves), and each candidate is then checked in full. Empty needles match nothing here. The
    runs are many times the size that Spark estimates from the files, so they are merged: a broadcast
    would gather all of them in the driver.
    """
    small = needles.select(F.col(needle)).filter(F.length(needle) > 0).distinct()
    big = haystacks.select(F.col(hay)).filter(F.length(hay) > 0).distinct()
    runs = F.concat(*[grams(F.col(hay), k) for k in range(1, GRAM + 1)])
    postings = big.select(hay, F.explode(runs).alias("_gram"))
    counts = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    own = F.when(F.length(needle) >= GRAM, grams(F.col(needle), GRAM)) \
        .otherwise(F.array(F.col(needle)))
    keyed = small.select(needle, F.explode(own).alias("_gram"))
    rarest = (
        keyed.join(counts.hint("merge"), "_gram")
        .groupBy(needle)
        .agg(F.min(F.struct("_df", "_gram"))["_gram"].alias("_gram"))
    )
    return (
        rarest.join(postings.hint("merge"), "_gram")
        .filter(F.col(hay).contains(F.col(needle)))
        .select(needle, hay)
    )
