"""Structured Streaming jobs over alignment labels.

Every job keeps its state in the shared folder: each micro-batch writes one folder named after its
query and its batch number, so a replayed batch overwrites its own rows, nothing is counted twice, and
a second query, whose numbers start again, never touches the rows of the first.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lindero import schemas
from lindero.operators import calibration as C
from lindero.operators.skew import last_per_key
from lindero.registry import DEFAULT_REGISTRY, Municipality
from lindero.sources.sinks import VersionedTable

# Batches of one query after which its store is folded into a snapshot.
FOLD_EVERY = 20


def query_id(spark: SparkSession) -> str:
    """The streaming query a micro-batch belongs to; it stays the same over restarts from one
    checkpoint. `batch` for rows that no stream brought."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


# Accepted labels per recalibration, seconds between polls.
RECAL_THRESHOLD, POLL_SECONDS = 30, 30


class LabelStore:
    """Labels by key, kept as the reduced rows of each micro-batch on top of a compacted snapshot.

    Writing a batch costs the batch, not the table. A row with `deleted` set takes its key out.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str = schemas.LABELS,
                 keys: Sequence[str] = ("rc",)):
        self.spark, self.base, self.keys = spark, base, list(keys)
        self.schema = f"{schema}, deleted boolean"
        self.snapshots = VersionedTable(spark, f"{base}/snapshot")

    @property
    def order(self) -> list[Column]:
        """Server time first, so a late old label never replaces a newer one."""
        return [F.col("ts"), F.col("seq")]

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Write the last row per key of one micro-batch; a replay overwrites the same folder."""
        if "deleted" not in batch.columns:
            batch = batch.withColumn("deleted", F.lit(False))
        names = [part.split()[0] for part in self.schema.split(", ")]
        last_per_key(batch.select(*names), self.keys, self.order).write.mode("overwrite").parquet(
            f"{self.base}/delta/query={query_id(self.spark)}/batch={batch_id}")
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            self.compact()

    def _deltas(self) -> DataFrame:
        """Batches that no snapshot holds; folders of older ones are pruned by their numbers."""
        schema = f"{self.schema}, query string, batch long"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.base}/delta")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        folded = self._folded()
        if not folded:
            return rows
        upto = F.create_map(*[F.lit(x) for q, b in sorted(folded.items()) for x in (q, b)])
        return rows.filter(F.col("batch") > F.coalesce(upto[F.col("query")], F.lit(-1)))

    def _folded(self) -> dict[str, int]:
        """Newest batch of each query in the current snapshot: one entry per streaming query."""
        snap = self.snapshots.current()
        head = None if snap is None else snap.select("folded").head()
        return dict(head["folded"]) if head else {}

    def _state(self) -> DataFrame:
        rows = self._deltas().drop("query", "batch")
        snap = self.snapshots.current()
        if snap is not None:
            rows = rows.unionByName(snap.drop("folded"))
        return last_per_key(rows, self.keys, self.order)

    def current(self) -> DataFrame:
        """The labels in force."""
        return self._state().filter(~F.col("deleted")).drop("deleted")

    def compact(self) -> int:
        """Fold all batches so far into a new snapshot; deletions stay as markers."""
        state = self._state()
        newest = self._folded() | {r["query"]: r["b"] for r in self._deltas().groupBy("query").agg(
            F.max("batch").alias("b")).collect()}
        if not newest:
            return 0
        folded = F.create_map(*[F.lit(x) for q, b in sorted(newest.items()) for x in (q, b)])
        return self.snapshots.publish(state.withColumn(
            "folded", folded.cast("map<string,long>")))


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
           continuous: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if continuous:
        return writer.trigger(processingTime=f"{POLL_SECONDS} seconds").start()
    return writer.trigger(availableNow=True).start()


def upsert_labels(stream: DataFrame, store: LabelStore, checkpoint: str,
                  continuous: bool = False) -> StreamingQuery:
    """Keep the last label of each key."""
    return _start(stream, store.append, checkpoint, continuous)


class AcceptCounter:
    """Accepted labels per batch and the recalibrations they trigger, one per threshold reached."""

    def __init__(self, spark: SparkSession, base: str, threshold: int = RECAL_THRESHOLD):
        self.spark, self.base, self.threshold = spark, base, threshold
        self.schema = "batch_id long, accepts long, fired long, carry long, total long, query string"

    def add(self, batch: DataFrame, batch_id: int) -> int:
        """Count one batch; returns how often the threshold was passed."""
        query = query_id(self.spark)
        ours = (F.col("query") == query) & (F.col("batch_id") >= batch_id)
        earlier = self.batches().filter(~ours).agg(
            F.coalesce(F.sum("accepts"), F.lit(0)).alias("n")).first().n
        accepts = batch.agg(F.count_if(F.col("action") == "accept").alias("n")).first().n
        total = earlier + accepts
        fired = total // self.threshold - earlier // self.threshold
        row = [(batch_id, accepts, fired, total % self.threshold, total, query)]
        self.spark.createDataFrame(row, self.schema).coalesce(1).write.mode("overwrite").parquet(
            f"{self.base}/{query}/b{batch_id}")
        return fired

    def batches(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).option(
                "recursiveFileLookup", "true").parquet(self.base)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)


def recalibrate_on_labels(stream: DataFrame, store: LabelStore, counter: AcceptCounter,
                          coords: DataFrame, calibration: VersionedTable, checkpoint: str,
                          entry: Municipality = DEFAULT_REGISTRY[0],
                          continuous: bool = False) -> StreamingQuery:
    """Upsert labels, and publish a new calibration whenever enough were accepted.

    The batch only counts as done after the calibration is published, so a failed run is repeated;
    recalibration is absolute, so repeating it is harmless.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            store.append(batch, batch_id)
            if counter.add(batch, batch_id) > 0:
                calibration.publish(C.recalibrate(
                    store.current(), coords, calibration.current(), entry))
        finally:
            batch.unpersist()

    return _start(stream, handle, checkpoint, continuous)


def apply_calibration(stream: DataFrame, calibration: VersionedTable, out: str, checkpoint: str,
                      continuous: bool = False) -> StreamingQuery:
    """Offsets and reliability for a stream of located keys(cell, sub, ...).

    The calibration is looked up anew in every micro-batch, so a new version takes effect without a
    restart; an unreadable one leaves the version before in force.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        current = calibration.current()
        if current is None:
            current = calibration.spark.createDataFrame([], schemas.CALIBRATION)
        C.attach_quality(C.attach_offsets(batch, current), current).write.mode(
            "overwrite").parquet(f"{out}/{query_id(batch.sparkSession)}/b{batch_id}")

    return _start(stream, handle, checkpoint, continuous)


# Outcomes of the refinement gates.
OUTCOMES = ("applied", "fb_few_matches", "fb_no_homog", "fb_low_ratio", "fb_big_offset")
STATS = "batch_id bigint, outcome string, n bigint, rows bigint, seconds double"


def gate_stream(stream: DataFrame, out: str, checkpoint: str,
                continuous: bool = False) -> StreamingQuery:
    """Resumable refinement: matcher records pass the gates, with counts per outcome and batch.

    The counts are observed while a batch is written, so its rows are worked out and read once; with
    the seconds the batch took they give the rates of the running job (`gate_rates`). A stopped run
    goes on where its checkpoint stands.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, query, began = batch.sparkSession, query_id(batch.sparkSession), time.monotonic()
        seen = Observation()
        counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
        C.gate_matches(batch).observe(seen, *counts).write.mode("overwrite").parquet(
            f"{out}/results/{query}/b{batch_id}")
        found, took = seen.get, time.monotonic() - began
        rows = [(batch_id, o, found[o], sum(found.values()), took) for o in OUTCOMES if found[o]]
        spark.createDataFrame(rows, STATS).coalesce(1).write.mode("overwrite").parquet(
            f"{out}/stats/{query}/b{batch_id}")

    return _start(stream, handle, checkpoint, continuous)


def gate_rates(stats: DataFrame) -> DataFrame:
    """outcome, n, share, batches, rows_per_second over all batches so far, from what was observed."""
    batches = stats.select("batch_id", "rows", "seconds").distinct()
    total = batches.agg(F.struct(
        F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"),
        F.count(F.lit(1)).alias("batches")).alias("t")).scalar()
    return stats.groupBy("outcome").agg(F.sum("n").alias("n")).withColumn("_t", total).select(
        "outcome", "n", (F.col("n") / F.col("_t.rows")).alias("share"),
        F.col("_t.batches").alias("batches"),
        (F.col("_t.rows") / F.col("_t.seconds")).alias("rows_per_second"))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows a job wrote below `path`, whatever the batch."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)
