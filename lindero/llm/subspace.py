"""Near-duplicate vectors by a pigeonhole join over blocks of a rotated space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.llm.common import unit_hash
from lindero.llm.graph import Forest, components
from lindero.llm.vectors import as_matrix, cosines, stored, stored_as, unit, usable, widths
from lindero.session import settle

THRESHOLD = 0.9      # cosine from which two vectors are linked
BLOCK = 16           # dimensions of a block
SAMPLE = 8192        # vectors the cells of the blocks are fitted on, at most
CELL_ROWS = 1 << 14  # rows a cell is meant to hold
MAX_CUTS = 10        # so there are at most 2 ** MAX_CUTS cells a block
TILE = 1 << 13       # rows of one side compared in one task
STRIP = 512          # rows of them at a time
PAIRS_AT_ONCE = 20_000
# The rotated vectors are kept in 4 bytes a component; a budget has room for that rounding.
ROOM = 1e-5


@dataclass
class Blocks:
    """Rotation, blocks with their budgets, and each block's cells.

    For unit vectors cosine >= c means squared distance <= 2 - 2c. A rotation keeps distances, so
    at least one block's share of it is within that block's share of the dimensions. A cell is a
    box of the block: its first coordinates are cut at their medians.
    """

    rotation: np.ndarray
    edges: list[int]
    budgets: np.ndarray
    cuts: np.ndarray      # (blocks, cuts): coordinate k of a block is cut at cuts[block, k]

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return (unit(x) @ self.rotation).astype(np.float32)

    def cells(self, z: np.ndarray) -> tuple[np.ndarray, list[list[list[int]]]]:
        """Each row's own cell in every block, and the later cells its ball reaches."""
        own = np.zeros((len(z), len(self.budgets)), dtype=np.int32)
        n = self.cuts.shape[1]
        weights = 1 << np.arange(n)
        corners = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        reached = []
        for b, budget in enumerate(self.budgets):
            part = z[:, self.edges[b]:self.edges[b] + n].astype(np.float64)
            side = (part > self.cuts[b]).astype(np.int64)
            own[:, b] = side @ weights
            far = (part - self.cuts[b]) ** 2
            some = []
            for i in range(0, len(z), 256):
                crossed = side[i:i + 256, None, :] != corners[None]
                near = np.einsum("rck,rk->rc", crossed, far[i:i + 256]) <= budget
                near &= np.arange(1 << n)[None] > own[i:i + 256, b][:, None]
                some += [np.flatnonzero(r).tolist() for r in near]
            reached.append(some)
        return own, [list(x) for x in zip(*reached)]

    def shares(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distance of pairs of rotated rows in every block; equal pairs, equal values."""
        d = (x.astype(np.float64) - y.astype(np.float64)) ** 2
        return np.add.reduceat(d, self.edges[:-1], axis=1)


def plan(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, seed: int = 17) -> Blocks:
    d = sample.shape[1]
    rotation, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    rotation = rotation * np.sign(np.diag(upper))
    n = max(1, -(-d // BLOCK))
    edges = [d * k // n for k in range(n + 1)]
    budgets = (2 - 2 * threshold) * np.diff(edges) / d + ROOM
    n_cuts = int(np.clip(np.ceil(np.log2(max(rows, 1) / CELL_ROWS)), 0,
                         min(MAX_CUTS, min(np.diff(edges)))))
    z = (unit(sample) @ rotation).astype(np.float32)
    cuts = np.array([[np.median(z[:, e + k]) for k in range(n_cuts)] for e in edges[:-1]])
    return Blocks(rotation, edges, budgets, cuts.reshape(n, n_cuts))


def compare(block: int, blocks: Blocks, threshold: float, za, zb, va, vb, same: bool):
    """Linked pairs (rows of a, rows of b) that this block is the first to find, in portions."""
    low, high = blocks.edges[block], blocks.edges[block + 1]
    budget = blocks.budgets[block]

    def lifted(z, left):
        part = z[:, low:high].astype(np.float32)
        half = -0.5 * np.einsum("nd,nd->n", part, part)
        one = np.ones_like(half)
        return np.column_stack([part, half, one] if left else [part, one, half])

    a, b = lifted(za, True), lifted(zb, False).T.copy()
    for i in range(0, len(a), STRIP):
        start = i if same else 0
        close = (a[i:i + STRIP] @ b[:, start:]) >= np.float32(-0.5 * budget - ROOM)
        found = np.flatnonzero(close)
        if not len(found):
            continue
        x, y = np.divmod(found, close.shape[1])
        x, y = x + i, y + start
        if same:
            once = x < y
            x, y = x[once], y[once]
        for k in range(0, len(x), PAIRS_AT_ONCE):
            p, q = x[k:k + PAIRS_AT_ONCE], y[k:k + PAIRS_AT_ONCE]
            within = blocks.shares(za[p], zb[q]) <= blocks.budgets
            first = within[:, block] & ~within[:, :block].any(axis=1)
            p, q = p[first], q[first]
            linked = cosines(va[p], vb[q]) >= threshold
            yield p[linked], q[linked]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Linked are two vectors whose cosine in double precision is at least `threshold`; n_links is
    how many other rows a row is linked with, component_id the smallest vec_id reachable by links
    (itself included), kept is vec_id = component_id.

    Equal vectors are one node with a count, so copies cost nothing. Every node goes to its own
    cell of each block and to the later cells within reach of the block's budget. A cell's rows
    are dealt out to tiles, and each task compares two tiles: a pair that several blocks find
    belongs to the first of them. Pairs are counted in the task and never become rows: a task
    returns one row per linked node, with its count and one node it is connected to.

    Unusable vectors (see `usable`) are linked with nothing and kept. Vectors of different numbers
    of dimensions are never linked. Rows with a null vec_id take part; their component_id is the
    smallest id around, null if there is none. Extra columns are not looked at. Empty table: empty
    result.
    """
    kind, given = stored_as(vectors), usable(vectors.select("vec_id", "embedding"))
    out = given.filter(F.col("size").isNull()).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"))
    for size in widths(given):
        out = out.unionByName(_near_vectors(stored(given, size, kind), kind, threshold))
    return out


def _near_vectors(vectors: DataFrame, kind: str, threshold: float) -> DataFrame:
    """`near_vectors` of stored vectors of one size, of which there is one at least."""
    spark = vectors.sparkSession
    keyed = vectors.withColumn("key", F.unhex(F.md5("vec")))
    nodes = settle(keyed.groupBy("key").agg(
        F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("n"),
        F.min("vec_id").alias("least")), "vectors")
    rows = nodes.count()
    drawn = nodes.filter(unit_hash(F.col("key"), F.lit("cells")) < 2.0 * SAMPLE / rows).orderBy(
        F.xxhash64("key", F.lit("cells")), "key").limit(SAMPLE)
    blocks = plan(as_matrix([bytes(r["vec"]) for r in drawn.collect()] or
                            [bytes(nodes.first()["vec"])], kind), rows, threshold)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = blocks.rotate(as_matrix(batch.column("vec").to_pylist(), kind))
            own, reached = blocks.cells(z)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "vec": batch.column("vec"), "n": batch.column("n"),
                "z": pa.array([r.tobytes() for r in z], pa.binary()),
                "own": pa.array(own.tolist(), pa.list_(pa.int32())),
                "reached": pa.array(reached, pa.list_(pa.list_(pa.int32())))})

    placed = settle(nodes.select("key", "vec", "n").mapInArrow(
        place, "key binary, vec binary, n long, z binary, own array<int>, "
               "reached array<array<int>>"), "placed")
    spots = placed.select("key", "vec", "n", "z", F.posexplode(F.arrays_zip("own", "reached")).alias(
        "block", "spot")).select(
            "key", "vec", "n", "z", "block", F.explode(F.concat(
                F.array(F.struct(F.col("spot.own").alias("cell"), F.lit(True).alias("home"))),
                F.transform("spot.reached", lambda c: F.struct(c.alias("cell"),
                                                               F.lit(False).alias("home")))))
            .alias("spot")).select("key", "vec", "n", "z", "block", "spot.cell", "spot.home")
    # At most (blocks) * 2 ** MAX_CUTS * 2 counts reach the driver.
    tiles = {(r["block"], r["cell"], r["home"]): -(-r["n"] // TILE) for r in
             spots.groupBy("block", "cell", "home").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = spark.createDataFrame(
        [(b, c, n, tiles.get((b, c, False), 0)) for (b, c, home), n in tiles.items() if home],
        "block int, cell int, homes int, guests int")
    salt = F.xxhash64("key", F.lit("tile"))
    dealt = (spots.join(F.broadcast(cells), ["block", "cell"])
             .withColumn("tile", F.when(F.col("home"), F.pmod(salt, F.col("homes")))
                         .otherwise(F.col("homes") + F.pmod(salt, F.greatest("guests", F.lit(1)))))
             .withColumn("tile", F.col("tile").cast("int")))
    every = F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1)
    partners = F.when(F.col("home"), every).otherwise(F.sequence(F.lit(0), F.col("homes") - 1))
    dealt = (dealt.withColumn("other", F.explode(partners))
             .select("block", "cell", F.least("tile", "other").alias("i"),
                     F.greatest("tile", "other").alias("j"), "tile", "key", "vec", "n", "z"))

    def run(key, group):
        block, _, i, j = (k.as_py() for k in key)
        tile = np.asarray(group.column("tile"))
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        z = np.frombuffer(b"".join(group.column("z").to_pylist()), np.float32).reshape(len(tile), -1)
        v = as_matrix(group.column("vec").to_pylist(), kind)
        n = np.asarray(group.column("n"))
        count, joined = np.zeros(len(tile), dtype=np.int64), Forest(len(tile))
        for p, q in compare(block, blocks, threshold, z[left], z[right], v[left], v[right], i == j):
            p, q = left[p], right[q]
            np.add.at(count, p, n[q])
            np.add.at(count, q, n[p])
            joined.join(p, q)
        some = np.flatnonzero(count)
        keys = group.column("key")
        return pa.table({"key": keys.take(pa.array(some)),
                         "head": keys.take(pa.array(joined.label[some])),
                         "links": pa.array(count[some])})

    found = settle(dealt.groupBy("block", "cell", "i", "j").applyInArrow(
        run, "key binary, head binary, links long"), "links")
    labels = components(found.select(F.col("key").alias("a"), F.col("head").alias("b")))
    degree = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = settle(nodes.select("key", "n", "least").join(degree, "key", "left").join(
        labels.withColumnRenamed("node", "key"), "key", "left").select(
            "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least",
            F.coalesce("label", "key").alias("label")), "nodes")
    heads = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(heads, "label").select("key", "n_links", "component_id")
    return (keyed.select("vec_id", "key").join(known, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
