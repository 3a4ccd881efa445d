"""Token ids in blocks of canonical length-limited Huffman code, with a table of bit offsets."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.llm.common import small_batches
from lindero.llm.words import Words
from lindero.session import fresh_path

END = 0                # id that closes each document
LONGEST = 18           # bits of a code
BLOCK = 1 << 16        # ids after which a block is closed
EVERY = 256            # ids between two checkpoints
DECODED_AT_ONCE = 8    # blocks


# --- tokens

@lru_cache(maxsize=2)
def tokens(path: str) -> Words:
    """The tokenizers library and the words it has met, for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
    from tokenizers import Tokenizer
    return Words(Tokenizer.from_file(path))


# --- codes

def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Best code lengths of at most `longest` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.float64)
    weights, taken = single, []
    for _ in range(longest - 1):
        pairs = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([single, pairs])
        place = np.argsort(merged, kind="stable")
        taken.append(place < len(single))       # which items of this level are single ids
        weights = merged[place]
    # The cheapest 2n - 2 items of the last level; each pair among them asks for two items below.
    bits = np.zeros(len(order), dtype=np.int64)
    ask = 2 * len(order) - 2
    for own in reversed(taken):
        n_single = int(own[:ask].sum())
        bits[:n_single] += 1
        ask = 2 * (ask - n_single)
    bits[:ask] += 1
    lengths[order] = bits
    return lengths


@dataclass
class Book:
    """Canonical codes: by length, then by id. Only the lengths need to be stored."""

    lengths: np.ndarray
    codes: np.ndarray
    table: np.ndarray        # for each run of `width` bits: the id it starts with << 5 | its length
    width: int


def book(lengths: np.ndarray) -> Book:
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = int(lengths.max()) if len(used) else 1
    spans = (np.int64(1) << (width - lengths[order].astype(np.int64)))
    starts = np.cumsum(spans) - spans
    codes = np.zeros(len(lengths), dtype=np.uint32)
    codes[order] = starts >> (width - lengths[order].astype(np.int64))
    table = np.ones(1 << width, dtype=np.int64)
    table[:int(spans.sum())] = np.repeat(order << 5 | lengths[order].astype(np.int64), spans)
    return Book(lengths, codes, table, width)


def pack_block(ids: np.ndarray, own: Book) -> tuple[bytes, bytes]:
    """(payload, bit offsets of every EVERY-th id) of one block."""
    bits = own.lengths[ids].astype(np.int64)
    if (bits == 0).any():
        raise ValueError("an id that was not counted")
    ends = np.cumsum(bits)
    at = ends - bits
    value = own.codes[ids].astype(np.uint64) << (64 - (at & 31) - bits).astype(np.uint64)
    word = at >> 5
    edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    merged = np.bitwise_or.reduceat(value, edge)
    words = np.zeros(int(word[-1]) + 2, dtype=np.uint32)
    where = word[edge]
    words[where] |= (merged >> np.uint64(32)).astype(np.uint32)
    words[where + 1] |= merged.astype(np.uint32)
    size = -(-int(ends[-1]) // 8)
    return words.astype(">u4").tobytes()[:size], at[::EVERY].astype("<u4").tobytes()


def unpack_blocks(payloads: list[bytes], checkpoints: list[bytes], counts: list[int],
                  own: Book) -> list[np.ndarray]:
    """The ids of several blocks; all stretches between checkpoints are read side by side."""
    if not payloads:
        return []
    bases = np.cumsum([0] + [len(p) for p in payloads])
    data = np.frombuffer(b"".join(payloads) + bytes(8), dtype=np.uint8)
    position, left = [], []
    for base, marks, n in zip(bases, checkpoints, counts):
        position.append(np.frombuffer(marks, "<u4").astype(np.int64) + 8 * base)
        left.append(np.minimum(EVERY, n - EVERY * np.arange(len(position[-1]))))
    position, left = np.concatenate(position), np.concatenate(left)
    out = np.zeros((len(position), EVERY), dtype=np.uint32)
    lanes = np.argsort(-left, kind="stable")
    at, rest = position[lanes], left[lanes]
    # any 4 bytes from any byte on, as one big-endian number
    joined = (data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16
              | data[2:-1].astype(np.uint32) << 8 | data[3:])
    joined = joined.astype(np.int64)
    shift, mask = 32 - own.width, (1 << own.width) - 1
    turned = np.zeros((EVERY, len(position)), dtype=np.uint32)
    live = len(at)
    for k in range(EVERY):
        while live and rest[live - 1] <= k:
            live -= 1
        if not live:
            break
        here = at[:live]
        run = joined.take(here >> 3)
        run >>= shift - (here & 7)
        run &= mask
        entry = own.table.take(run)
        turned[k, :live] = entry >> 5
        here += entry & 31
    out[lanes] = turned.T
    found, lane = [], 0
    for marks, n in zip(checkpoints, counts):
        rows = len(marks) // 4
        found.append(out[lane:lane + rows].reshape(-1)[:n])
        lane += rows
    return found


# --- jobs

COUNTS = T.ArrayType(T.StructType([T.StructField("id", T.LongType()),
                                   T.StructField("n", T.LongType())]))


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """Every document's ids in ascending doc_id order: part, row, start (ids of the part before),
    doc_id, n, ids; and counts, on one row of each part: how often each id occurs in it.

    The order is a range partitioning on (doc_id, text hash), so many rows with one doc_id spread
    over several parts; only rows equal in both meet in one.
    """
    small_batches(docs.sparkSession)
    ordered = (docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
               .withColumn("part", F.spark_partition_id()).drop("tie"))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()),
        T.StructField("start", T.LongType()), ordered.schema["doc_id"],
        T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("counts", COUNTS)])

    def run(batches):
        own = tokens(path)
        end = np.array([END], dtype=own.kind).tobytes()
        row = start = 0
        total = np.zeros(own.library.get_vocab_size(), dtype=np.int64)
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                yield closed(last, None)
            ids = [x + end for x in own.ids(batch.column("text").to_pylist())]
            n = np.array([len(x) // own.kind.itemsize for x in ids], dtype=np.int64)
            total += np.bincount(np.frombuffer(b"".join(ids), own.kind), minlength=len(total))
            last = {
                "part": batch.column("part"), "row": pa.array(row + np.arange(len(ids))),
                "start": pa.array(start + np.cumsum(n) - n), "doc_id": batch.column("doc_id"),
                "n": pa.array(n), "ids": pa.array(ids, pa.binary())}
            row, start = row + len(ids), start + int(n.sum())
        if last is not None:
            used = np.flatnonzero(total)
            yield closed(last, [{"id": i, "n": k} for i, k in zip(used.tolist(),
                                                                  total[used].tolist())])

    def closed(columns, counts):
        """The batch, with the part's counts on its last row."""
        kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
        rows = [None] * (len(columns["n"]) - 1) + [counts]
        return pa.RecordBatch.from_pydict({**columns, "counts": pa.array(rows, kind)})

    return ordered.mapInArrow(run, schema)


def id_counts(tokenized: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; at most one row for each id of the vocabulary reaches the driver."""
    rows = (tokenized.filter(F.col("counts").isNotNull())
            .select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(size, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Write all documents' ids below `path`: `book` (id, length), `parts` (part, before) and
    `blocks`.

    A block holds whole documents: part, its first row and first id, the documents' doc_ids and
    sizes, the payload and its checkpoints; it can be decoded by itself with the book. Null and
    empty texts are the end id alone. An empty table writes empty tables.
    """
    spark = docs.sparkSession
    staged_at = fresh_path(spark, "tokenized")
    tokenized = tokenize(docs, tokenizer_path)
    tokenized.write.option("compression", "zstd").parquet(staged_at)
    tokenized = spark.read.schema(tokenized.schema).parquet(staged_at)
    known = tokens(tokenizer_path)
    kind, size = known.kind, known.library.get_vocab_size()
    lengths = code_lengths(id_counts(tokenized, size))
    used = np.flatnonzero(lengths).tolist()
    spark.createDataFrame([(i, int(lengths[i])) for i in used], "id int, length int").coalesce(
        1).write.parquet(f"{path}/book")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part: as many as the shuffle has partitions
    (tokenized.groupBy("part").agg(F.sum("n").alias("n"))
     .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
     .write.parquet(f"{path}/parts"))
    own = tokenized.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("doc_ids", T.ArrayType(own)),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()), T.StructField("checkpoints", T.BinaryType())])

    def blocks(batches):
        codes = book(lengths)
        held: list[dict] = []

        def close():
            payload, marks = pack_block(
                np.frombuffer(b"".join(r["ids"] for r in held), kind), codes)
            out = {"part": held[0]["part"], "row": held[0]["row"], "start": held[0]["start"],
                   "doc_ids": [r["doc_id"] for r in held], "sizes": [r["n"] for r in held],
                   "payload": payload, "checkpoints": marks}
            held.clear()
            return out

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            arrow = pa.schema([
                ("part", pa.int32()), ("row", pa.int64()), ("start", pa.int64()),
                ("doc_ids", pa.list_(batch.schema.field("doc_id").type)),
                ("sizes", pa.list_(pa.int64())), ("payload", pa.binary()),
                ("checkpoints", pa.binary())])
            done = []
            for r in batch.to_pylist():
                follows = held and held[-1]["part"] == r["part"] and held[-1]["row"] + 1 == r["row"]
                if held and (not follows or sum_of + r["n"] > BLOCK):
                    done.append(close())
                sum_of = r["n"] + (sum_of if held else 0)
                held.append(r)
            if done:
                yield batch_of(done)
        if held:
            yield batch_of([close()])

    tokenized.drop("counts").mapInArrow(blocks, schema).write.option("compression", "none").parquet(
        f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of every document."""
    lengths = np.zeros(1 << 20, dtype=np.uint8)
    top = 0
    for r in spark.read.parquet(f"{path}/book").collect():  # bounded by the vocabulary
        lengths[r["id"]] = r["length"]
        top = max(top, r["id"] + 1)
    lengths = lengths[:top]
    stored = spark.read.parquet(f"{path}/blocks").join(
        spark.read.parquet(f"{path}/parts"), "part")
    own = stored.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_id", own), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    small_batches(spark, DECODED_AT_ONCE)

    def run(batches):
        codes = book(lengths)
        for batch in batches:
            sizes = batch.column("sizes").to_pylist()
            found = unpack_blocks(batch.column("payload").to_pylist(),
                                  batch.column("checkpoints").to_pylist(),
                                  [sum(s) for s in sizes], codes)
            doc_ids, starts, counts, ids = [], [], [], []
            for names, own_sizes, first, before, every in zip(
                    batch.column("doc_ids").to_pylist(), sizes,
                    batch.column("start").to_pylist(), batch.column("before").to_pylist(), found):
                edges = np.cumsum([0] + own_sizes)
                doc_ids += names
                counts += own_sizes
                starts += (before + first + edges[:-1]).tolist()
                raw = every.astype("<u4").tobytes()
                ids += [raw[4 * a:4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, batch.schema.field("doc_ids").type.value_type),
                "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                "ids": pa.array(ids, pa.binary())})

    return stored.select("doc_ids", "sizes", "start", "before", "payload", "checkpoints").mapInArrow(
        run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Written to a new folder of the shared place and read back."""
    path = fresh_path(docs.sparkSession, "huffman")
    write(docs, tokenizer_path, path)
    return read(docs.sparkSession, path)
