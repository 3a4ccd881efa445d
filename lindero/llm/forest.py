"""Approximate nearest neighbours with a forest of random-projection trees."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.llm.common import unit_hash
from lindero.llm.vectors import as_matrix, cosines, stored, stored_as, unit, usable, widths
from lindero.session import settle

TREES = 4
SAMPLE = 8192          # vectors the trees are fitted on, at most
LEAF_ROWS = 1500       # rows a leaf is meant to hold
MAX_DEPTH = 7          # as the sample fills 2 ** 7 leaves with 64 vectors each
CHUNK_ROWS = 8192      # rows of one leaf scored in one task; larger leaves go in several
QUERIES_AT_ONCE = 4096
# Leaves a query visits, as a share of all leaves of all trees. Vectors without any structure need
# this much for a recall of 0.9; see the README for the measured recall.
VISITED = 0.3


@dataclass
class Forest:
    """For each tree a complete binary tree of hyperplanes: directions and thresholds."""

    depth: int
    directions: np.ndarray   # (trees, 2 ** depth - 1, dimensions)
    thresholds: np.ndarray   # (trees, 2 ** depth - 1)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree, numbered over the whole forest."""
        out = np.zeros((len(x), len(self.directions)), dtype=np.int64)
        for t, (w, cut) in enumerate(zip(self.directions, self.thresholds)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                right = np.einsum("nd,nd->n", x, w[node]) > cut[node]
                node = 2 * node + 1 + right
            out[:, t] = t * self.leaves + node - (self.leaves - 1)
        return out

    def visit(self, x: np.ndarray, budget: int) -> list[int]:
        """Leaves for one query, nearest first over all trees by one priority queue.

        The key of a branch is the largest margin by which the query lies on the other side of a
        hyperplane on the way there.
        """
        inner = self.leaves - 1
        margins = self.directions @ x - self.thresholds
        queue = [(0.0, t, 0) for t in range(len(self.directions))]
        found: list[int] = []
        while queue and len(found) < budget:
            key, t, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[t, node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (max(key, abs(margin)), t, 4 * node + 3 - near))
                node = near
            found.append(t * self.leaves + int(node) - inner)
        return found


def fit(x: np.ndarray, rows: int, trees: int = TREES, seed: int = 11) -> Forest:
    """Trees over a sample of unit vectors, cut at the median of each projection.

    `rows` is the size of the whole table, from which the depth follows.
    """
    random = np.random.default_rng(seed)
    depth = int(np.clip(np.ceil(np.log2(max(rows, 1) / LEAF_ROWS)), 0, MAX_DEPTH))
    n, d = (1 << depth) - 1, x.shape[1] if x.size else 1
    w = random.standard_normal((trees, n, d))
    w /= np.linalg.norm(w, axis=2, keepdims=True)
    cuts = np.zeros((trees, n))
    for t in range(trees):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            for k in range((1 << level) - 1, (2 << level) - 1):
                here = np.flatnonzero(node == k)
                if len(here):
                    along = x[here] @ w[t, k]
                    cuts[t, k] = np.median(along)
                    node[here] = 2 * k + 1 + (along > cuts[t, k])
    return Forest(depth, w, cuts)


def search(vectors: DataFrame, is_query, k: int = 5, visited: float = VISITED,
           sample: int = SAMPLE) -> DataFrame:
    """The k nearest found for every row for which `is_query` holds, among all other rows.

    Returns query_id, rank (from 1), vec_id, score: largest cosine first, ties to the smaller
    vec_id. The trees are fitted on at most `sample` vectors drawn by a hash; every row is put
    into one leaf of each tree, every query visits the leaves its priority queue yields, and all
    rows of a visited leaf are scored exactly. A leaf above CHUNK_ROWS rows is dealt out to
    several tasks, and many queries of one leaf go in blocks, so no task holds an unbounded
    group. Each task returns k rows a query.

    Unusable vectors (see `usable`) take no part, and vectors of different numbers of dimensions do
    not meet. A query leaves out its own row only: equal vectors, rows of the same vec_id and rows
    with a null vec_id (last among ties) are candidates like all others, and each row of a repeated
    query id is a query. Extra columns are not looked at. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType
    given = usable(vectors.select("vec_id", "embedding"))
    out = spark.createDataFrame([], T.StructType([
        T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()),
        T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())]))
    for size in widths(given):
        out = out.unionByName(_search(stored(given, size, stored_as(vectors)), stored_as(vectors),
                                      is_query, k, visited, sample))
    return out


def _search(vectors: DataFrame, packed: str, is_query, k: int, visited: float,
            sample: int) -> DataFrame:
    """`search` among stored vectors of one size, of which there is one at least."""
    spark = vectors.sparkSession
    # Written before it is read again, so a row keeps its number.
    own = settle(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    rows = own.count()
    drawn = own.filter(unit_hash(F.col("row"), F.lit("forest")) < 2.0 * sample / rows).orderBy(
        F.xxhash64("row", F.lit("forest")), "row").limit(sample)
    forest = fit(unit(as_matrix([bytes(r["vec"]) for r in drawn.collect()], packed)), rows)
    budget = max(TREES, int(np.ceil(visited * TREES * forest.leaves)))

    def leaves(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(as_matrix(batch.column("vec").to_pylist(), packed))
                yield pa.RecordBatch.from_pydict({
                    "leaf": pa.array(forest.place(x).tolist(), pa.list_(pa.int64())),
                    **{c: batch.column(c) for c in ("row", "vec_id", "vec")}})

    def visits(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(as_matrix(batch.column("vec").to_pylist(), packed))
                yield pa.RecordBatch.from_pydict({
                    "leaf": pa.array([forest.visit(q, budget) for q in x],
                                     pa.list_(pa.int64())),
                    **{c: batch.column(c) for c in ("row", "vec_id", "vec")}})

    held = T.StructType([T.StructField("leaf", T.ArrayType(T.LongType())),
                         own.schema["row"], own.schema["vec_id"], own.schema["vec"]])
    placed = own.mapInArrow(leaves, held).withColumn("leaf", F.explode("leaf"))
    asked = own.filter(is_query).mapInArrow(visits, held).withColumn("leaf", F.explode("leaf"))
    # How many chunks a leaf has and how many blocks its queries: at most TREES * 2 ** MAX_DEPTH rows.
    n_rows = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n_asked = {r["leaf"]: r["n"] for r in asked.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    parts = {leaf: (-(-n_rows[leaf] // CHUNK_ROWS), -(-n_asked.get(leaf, 0) // QUERIES_AT_ONCE))
             for leaf in n_rows if n_asked.get(leaf)}
    chunks, blocks = (F.create_map(*[F.lit(x) for leaf, p in (parts or {-1: (0, 0)}).items()
                                     for x in (leaf, p[i])]) for i in (0, 1))
    n_chunks = F.coalesce(F.element_at(chunks, F.col("leaf")), F.lit(0))
    n_blocks = F.coalesce(F.element_at(blocks, F.col("leaf")), F.lit(0))
    salt = F.xxhash64("row")
    left = (placed.filter(n_chunks > 0)
            .withColumn("chunk", F.pmod(salt, n_chunks).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))))
    right = (asked.filter(n_chunks > 0)
             .withColumn("block", F.pmod(salt, n_blocks).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1))))
    keys = ["leaf", "chunk", "block"]

    def score(key, rows_table, query_table):
        names, ids = query_table.column("vec_id"), rows_table.column("vec_id")
        left, right, scores = [], [], []
        if rows_table.num_rows and query_table.num_rows:
            x = as_matrix(rows_table.column("vec").to_pylist(), packed)
            q = as_matrix(query_table.column("vec").to_pylist(), packed)
            row, own_row = (np.asarray(t.column("row")) for t in (rows_table, query_table))
            # order of the ids, null last
            listed = ids.to_pylist()
            order = sorted(range(len(listed)), key=lambda i: (
                listed[i] is None, 0 if listed[i] is None else listed[i], row[i]))
            place = np.empty(len(listed), dtype=np.int64)
            place[order] = np.arange(len(listed))
            ux, uq = unit(x), unit(q)
            for at in range(0, len(q), 256):
                near = uq[at:at + 256] @ ux.T
                near[own_row[at:at + 256, None] == row[None]] = -2.0
                keep = min(k, len(row))
                edge = np.partition(near, len(row) - keep, axis=1)[:, len(row) - keep]
                for i, line in enumerate(near):
                    some = np.flatnonzero((line >= edge[i] - 1e-9) & (line > -1.5))
                    exact = cosines(np.broadcast_to(q[at + i], (len(some), q.shape[1])), x[some])
                    best = np.lexsort((place[some], -exact))[:k]
                    left += [at + i] * len(best)
                    right += some[best].tolist()
                    scores += exact[best].tolist()
        left, right = pa.array(left, pa.int64()), pa.array(right, pa.int64())
        return pa.table({
            "query": query_table.column("row").take(left), "query_id": names.take(left),
            "row": rows_table.column("row").take(right), "vec_id": ids.take(right),
            "score": pa.array(scores, pa.float64())})

    kind = own.schema["vec_id"].dataType
    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, T.StructType([
        T.StructField("query", T.LongType()), T.StructField("query_id", kind),
        T.StructField("row", T.LongType()), T.StructField("vec_id", kind),
        T.StructField("score", T.DoubleType())])))
    # a candidate met in several trees counts once; then the k best of all leaves
    once = found.groupBy("query", "row").agg(
        F.max("score").alias("score"), F.first("query_id").alias("query_id"),
        F.first("vec_id").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
