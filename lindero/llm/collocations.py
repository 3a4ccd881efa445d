"""Collocations by dynamic itemset counting: phrases of all lengths counted in cyclic shard scans."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lindero.llm.common import FACTOR, SPACES, mix64, small_batches, word_hashes
from lindero.session import fresh_path, remove, settle

LONGEST = 5            # words of a phrase
FREQUENT = 100         # occurrences of a phrase
TOP = 2000             # phrases of each language
SHARDS = 3             # parts of the table; each phrase is counted over every one of them once
BITS = 22              # of a phrase's place in the table of activations, whatever the input's size
NEVER = 255            # no phrase of that place has reached the threshold
BUFFER = 8 << 20       # bytes of text worked on at once
PART = 1 << 20         # bytes of a stored row; longer texts are cut between pieces
GATHERED = 32 << 20    # bytes of phrases counted at once
TOGETHER = 1 << 16     # phrases gathered at once
UNKNOWN = "und"
# A to Z small, all ends of pieces as line feeds, tabs as spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09",
                       b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
SPACED = re.compile(rb" {2,}")
COUNTS = "lang string, k int, since int, phrase string, place int, n bigint"


# --- inside tasks

def parts_of(text: str | None) -> list[bytes]:
    """The folded text, cut at ends of pieces into parts of about PART bytes."""
    data = SPACED.sub(b" ", (text or "").encode("utf-8").translate(FOLD))
    out, at = [], 0
    while len(data) - at > PART:
        stop = data.find(b"\n", at + PART)
        if stop < 0:
            break
        out.append(data[at:stop])
        at = stop + 1
    out.append(data[at:])
    return [p for p in out if p]


def places_of(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) >> np.uint64(64 - BITS)).astype(np.int32)


def tally(data: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray):
    """Distinct stretches data[low:high] with their numbers and places; exact, by bytes."""
    sizes = high - low
    total = np.cumsum(sizes)
    at = 0
    while at < len(low):
        base = total[at] - sizes[at]
        stop = max(at + 1, int(np.searchsorted(total, base + GATHERED, "right")))
        n = sizes[at:stop]
        offsets = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=offsets[1:])
        chars = np.empty(offsets[-1], dtype=np.uint8)
        for a in range(0, len(n), TOGETHER):  # indices take many times the bytes they gather
            z = min(len(n), a + TOGETHER)
            first, last = offsets[a], offsets[z]
            chars[first:last] = data[np.arange(first, last) + np.repeat(
                low[at + a:at + z] - offsets[a:z], n[a:z])]
        phrases = pa.Array.from_buffers(pa.large_string(), len(n), [
            None, pa.py_buffer(offsets), pa.py_buffer(chars)])
        coded = phrases.dictionary_encode()
        which = coded.indices.to_numpy()
        first = np.zeros(len(coded.dictionary), dtype=np.int32)
        first[which] = places[at:stop]
        yield (coded.dictionary.cast(pa.string()), first,
               np.bincount(which, minlength=len(coded.dictionary)))
        at = stop


def scan(data: np.ndarray, seed: int, reached: np.ndarray, step: int, shards: int):
    """(k, since, phrases, places, counts) of all phrases counted in this step.

    A longer phrase is counted from the step after both its subphrases' places were reached, over
    `shards` steps, and never before its subphrases are: their places may have been reached earlier
    by other phrases. Only the first and last position of a piece are looked at where no longer
    phrase fits.
    """
    starts, hashes = word_hashes(data)
    if not len(starts):
        return
    space = SPACES[data]
    after = np.append(space[1:], True)
    ends = np.flatnonzero(~space & after) + 1
    piece = np.searchsorted(np.flatnonzero(data == 10), starts)
    hashes = hashes ^ mix64(np.array([seed], dtype=np.uint64))[0]
    index = np.arange(len(starts))
    total, places = hashes, places_of(hashes)
    since = np.zeros(len(starts), dtype=np.int64)
    for k in range(1, LONGEST + 1):
        for begun in np.unique(since).tolist():
            if step - shards < begun <= step:
                pick = since == begun
                own = index[pick]
                for found in tally(data, starts[own], ends[own + k - 1], places[pick]):
                    yield (k, begun, *found)
        if k == LONGEST:
            return
        known = np.full(len(starts) + 1, NEVER, dtype=np.uint8)
        known[index] = reached[k - 1][places]
        both = np.maximum(known[index], known[index + 1])
        begins = np.zeros(len(starts) + 1, dtype=np.int64)
        begins[index] = since
        begins = np.maximum(begins[index], begins[index + 1])
        fits = (both != NEVER)
        nxt = np.minimum(index + k, len(starts) - 1)
        fits &= (index + k < len(starts)) & (piece[nxt] == piece[index])
        total = total[fits] * np.uint64(FACTOR) + hashes[nxt[fits]]
        index, since = index[fits], np.maximum(both[fits].astype(np.int64) + 1, begins[fits])
        places = places_of(total)
        if not len(index):
            return


# --- jobs

def store(docs: DataFrame, shards: int) -> str:
    """Write the folded texts, dealt to shards in turn, and return the path."""
    small_batches(docs.sparkSession)

    def run(batches):
        turn = 0
        for batch in batches:
            rows = [(lang, part) for lang, text in zip(batch.column("lang").to_pylist(),
                                                       batch.column("text").to_pylist())
                    for part in parts_of(text)]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([r[0] for r in rows], pa.string()),
                "data": pa.array([r[1] for r in rows], pa.binary()),
                "shard": pa.array((turn + np.arange(len(rows))) % shards, pa.int32())})
            turn += len(rows)

    path = fresh_path(docs.sparkSession, "shards")
    (docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
     .mapInArrow(run, "lang string, data binary, shard int")
     .write.option("compression", "zstd").partitionBy("shard").parquet(path))
    return path


def count_shard(shard: DataFrame, reached: np.ndarray, step: int, shards: int) -> DataFrame:
    """Counts of the phrases of this step, added up within each task's stretches of text."""
    packed = zstandard.compress(reached.tobytes())

    def run(batches):
        table = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(LONGEST - 1, -1)
        held: dict[str, list[bytes]] = {}
        size = 0

        def counted():
            for lang, parts in held.items():
                data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
                for k, since, phrases, places, n in scan(data, zlib.crc32(lang.encode()), table,
                                                         step, shards):
                    m = len(phrases)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(m, int))),
                        "k": pa.array(np.full(m, k), pa.int32()),
                        "since": pa.array(np.full(m, since), pa.int32()), "phrase": phrases,
                        "place": pa.array(places, pa.int32()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(),
                                  batch.column("data").to_pylist()):
                held.setdefault(lang, []).append(data)
                size += len(data)
                if size > BUFFER:
                    yield from counted()
                    held, size = {}, 0
        yield from counted()

    return shard.select("lang", "data").mapInArrow(run, COUNTS)


def newly_reached(counts: DataFrame, frequent: int) -> DataFrame:
    """Places of the phrases that have reached the threshold, as bitmaps: 128 rows for each length."""
    place = F.col("place") + 1
    return (counts.filter((F.col("n") >= frequent) & (F.col("k") < LONGEST))
            .groupBy("k", F.bitmap_bucket_number(place).alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")))


def count_phrases(docs: DataFrame, frequent: int = FREQUENT, shards: int = SHARDS,
                  ) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, a) of all phrases of 1 to LONGEST words with a >= `frequent` occurrences,
    and (lang, n), the words of each language.

    The texts are stored in shards, which are scanned in turn, again and again. Single words are
    counted from the first step. After each step the places of the phrases that have reached the
    threshold so far are noted with the step, and a phrase is counted from the step after both
    its subphrases' places are noted, until it has seen every shard once. Places are hashes into a
    table of fixed size, so a phrase may be counted needlessly but none is missed; the counts
    themselves are by text and exact.
    """
    spark = docs.sparkSession
    path = store(docs, shards)
    reached = np.full((LONGEST - 1, 1 << BITS), NEVER, dtype=np.uint8)
    stored = spark.read.schema("lang string, data binary, shard int").parquet(path)
    live, live_path, finished = None, None, []
    step, last = 0, 0
    while step < shards or step <= last + shards:
        counts = count_shard(stored.filter(F.col("shard") == step % shards), reached, step, shards)
        if live is not None:
            counts = counts.unionByName(live)
        done = F.col("since") <= step - shards + 1
        merged = (counts.groupBy("lang", "k", "since", "phrase")
                  .agg(F.max("place").alias("place"), F.sum("n").alias("n"))
                  .withColumn("done", done)
                  .filter(~F.col("done") | (F.col("k") == 1) | (F.col("n") >= frequent)))
        at = fresh_path(spark, "phrases")
        merged.write.option("compression", "zstd").partitionBy("done").parquet(at)
        whole = spark.read.schema(COUNTS + ", done boolean").parquet(at)
        for row in newly_reached(whole, frequent).collect():
            own = reached[row["k"] - 1]
            low = (row["block"] - 1) * 32768
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
            new = low + np.flatnonzero(bits)
            new = new[own[new] == NEVER]
            own[new] = step
            if len(new):
                last = step
        finished.append(whole.filter("done").drop("done"))
        if live_path:
            remove(spark, f"{live_path}/done=false")
        live, live_path = whole.filter("NOT done").drop("done"), at
        step += 1
    remove(spark, path)
    every = finished[0]
    for more in finished[1:]:
        every = every.unionByName(more)
    words = every.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return (settle(every.filter(F.col("n") >= frequent).select(
        "lang", "k", "phrase", F.col("n").alias("a")), "frequent"), words)


def score(frequent: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score): the cut of lowest score of each phrase of two words or
    more.

    Products have up to 38 digits and the quotient is an integer, so nothing is rounded.
    """
    word = F.split("phrase", " ", -1)
    cuts = (frequent.filter("k > 1").withColumn("w", word)
            .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " "))
            .withColumn("rest", F.array_join(
                F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ")).drop("w"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(words, "lang")
              .withColumn("score", F.expr(
                  "(cast(1000 AS decimal(4,0)) * cast(a AS decimal(14,0)) * cast(n AS decimal(18,0)))"
                  " DIV (cast(l AS decimal(19,0)) * cast(r AS decimal(18,0)))")))
    return (scored.groupBy("lang", "k", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
            .select("lang", "k", "phrase", "a", "b.l", "b.r", "n", "b.score"))


def collocations(docs: DataFrame, frequent: int = FREQUENT, top: int = TOP,
                 shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language.

    Phrases have 2 to LONGEST words within a piece of text and `frequent` occurrences. A phrase goes
    when a longer one that holds it occurs as often; then one of the phrases a word longer does,
    so only those are compared. Null texts are empty, a null language is `und`; repeated rows
    count each time; an empty table gives an empty result. Texts of any length are cut between pieces
    only.
    """
    found, words = count_phrases(docs.select("lang", "text"), frequent, shards)
    word = F.split("phrase", " ", -1)
    inside = found.filter("k > 2").withColumn("w", word).select("lang", F.explode(F.array(
        F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " "),
        F.array_join(F.slice("w", F.lit(2), F.col("k") - 1), " "))).alias("phrase"), "a")
    kept = score(found, words).join(inside, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
