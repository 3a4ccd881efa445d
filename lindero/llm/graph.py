"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.session import settle


class Forest:
    """Groups of rows joined so far; only a pair that joins two groups costs more than a look."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        new = la != lb
        if not new.any():
            return
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for x, y in set(zip(la[new].tolist(), lb[new].tolist())):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in parent:
            to[x] = root(x)
        self.label = to[self.label]


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest reachable node.

    Alternating stars: every node's larger neighbours are moved to its smallest one, then the
    smaller ones among themselves, until nothing changes. Each round is two aggregates with
    partial sums in the tasks and two equi-joins that the adaptive planner splits on hot nodes;
    each is written to the shared folder, so no lineage grows. Only a row count and a checksum
    reach the driver. Null nodes and loops are ignored. No links: no rows.
    """
    def tidy(edges):
        return (edges.filter(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(edges):
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = settle(tidy(links.select("a", "b")), "links")
    known = state(edges)
    while known[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = (both.filter(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = settle(tidy(large), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select("b", "m")
                 .union(least.select("a", "m")).toDF("a", "b"))
        edges = settle(tidy(small), "links")
        now = state(edges)
        if now == known:
            break
        known = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
