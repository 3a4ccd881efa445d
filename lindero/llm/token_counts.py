"""Token counts of whole texts: huge ones in overlapping chunks, spliced where both sides agree."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.llm.common import ROW, pack, small_batches, unpack
from lindero.llm.words import Words
from lindero.session import settle

CHUNK = 1 << 14        # characters of a chunk; texts of more than two chunks count as huge
OVERLAP = 1 << 9       # characters a chunk shares with the next one
WIDER = 4              # times the lengths grow when two chunks do not agree


class TokenCounter:
    """The tokenizers library with its own defaults: special strings in a text are special tokens.

    A byte-level tokenizer cuts the text into words before any merge, and where a word starts, the
    rest of the text alone decides what follows. So a word start that two overlapping chunks share
    is a place where their counts can be joined.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        added = self.library.get_added_tokens_decoder()
        names = [self.library.id_to_token(i) or "" for i in range(size)]
        # ordinary tokens are spelt with one character a byte
        self.bytes_of = np.array([len(added[i].content.encode()) if i in added else len(names[i])
                                  for i in range(size)], dtype=np.int64)
        # A word start this far before a chunk's end does not depend on what follows: a match looks
        # two characters ahead, and no special string from before it can reach over it.
        self.margin = 4 + max([len(t.content) for t in added.values()], default=0)
        self.words = Words(self.library)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each whole text; null and empty texts have none."""
        return self.words.counts(texts)

    def chunk(self, text: str, length: int, overlap: int) -> dict:
        """Tokens of a chunk, and its word starts near both ends as (byte, tokens before it).

        Bytes count from the start of the chunk at its head, and from the start of the next chunk,
        `length` characters on, at its tail.
        """
        found = self.library.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.int64)
        words = np.array([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
        ends = np.cumsum(self.bytes_of[ids])
        if len(ids) and ends[-1] != len(text.encode("utf-8")):
            raise ValueError("the tokenizer drops or adds bytes")
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(ids) else ids
        starts = (ends - self.bytes_of[ids])[first]
        shared = len(text[:overlap].encode("utf-8"))
        seam = len(text[:length].encode("utf-8"))
        sure = len(text[:max(length, len(text) - self.margin)].encode("utf-8"))
        head, tail = starts < shared, (starts >= seam) & (starts < sure)
        return {"n": len(ids), "head": starts[head], "head_at": first[head],
                "tail": starts[tail] - seam, "tail_at": first[tail]}


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
    return TokenCounter(path)


CHUNKS = "digest string, part int, last boolean, text string"
ENCODED = ("digest string, part int, last boolean, n bigint, head array<bigint>, "
           "head_at array<bigint>, tail array<bigint>, tail_at array<bigint>")


def cut(texts: DataFrame, length: int, overlap: int) -> DataFrame:
    """(digest, part, last, text): each text in chunks of `length` characters and the overlap."""
    def run(batches):
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(),
                                    batch.column("text").to_pylist()):
                n = max(1, -(-(len(text) - overlap) // length))
                for low in range(0, n, 64):
                    parts = range(low, min(n, low + 64))
                    yield pa.RecordBatch.from_pydict({
                        "digest": pa.array([digest] * len(parts), pa.string()),
                        "part": pa.array(parts, pa.int32()),
                        "last": pa.array([k == n - 1 for k in parts], pa.bool_()),
                        "text": pa.array([text[k * length:] if k == n - 1 else
                                          text[k * length:(k + 1) * length + overlap]
                                          for k in parts], pa.string())})

    return texts.select("digest", "text").mapInArrow(run, CHUNKS)


def encode_chunks(chunks: DataFrame, path: str, length: int, overlap: int) -> DataFrame:
    """Count and word starts near both ends of each chunk."""
    def run(batches):
        own = counter(path)
        for batch in batches:
            rows = [own.chunk(t, length, overlap) for t in batch.column("text").to_pylist()]
            places = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("digest", "part", "last")},
                "n": pa.array([r["n"] for r in rows], pa.int64()),
                **{c: pa.array([r[c] for r in rows], places)
                   for c in ("head", "head_at", "tail", "tail_at")}})

    return chunks.mapInArrow(run, ENCODED)


def splice(encoded: DataFrame) -> DataFrame:
    """(digest, n_tokens, apart): total of each text, and how many seams have no common word start.

    A chunk counts from the place where its predecessor hands over to the place where it does so
    itself, so each seam adds the tokens the left chunk has before the common place and takes off
    those the right chunk has before it; the last chunk adds all it has.
    """
    left = encoded.filter(~F.col("last")).select(
        "digest", (F.col("part") + 1).alias("part"), "tail", "tail_at")
    right = encoded.filter(F.col("part") > 0).select("digest", "part", "head", "head_at")
    place = F.get(F.array_intersect("tail", "head"), F.lit(0))

    def before(at: str, places: str):
        return F.get(F.col(at), (F.array_position(F.col(places), F.col("place")) - 1).cast("int"))

    seams = (left.join(right, ["digest", "part"]).withColumn("place", place)
             .select("digest", (before("tail_at", "tail") - before("head_at", "head")).alias("n")))
    ends = encoded.filter("last").select("digest", "n")
    return seams.unionByName(ends).groupBy("digest").agg(
        F.sum("n").alias("n_tokens"), F.sum(F.col("n").isNull().cast("int")).alias("apart"))


def count_huge(texts: DataFrame, path: str, length: int, overlap: int) -> DataFrame:
    """(digest, n_tokens) of distinct texts of any length; chunks are dealt over all tasks.

    A text some of whose seams have no common word start is cut anew with lengths and overlaps
    four times as long, until it agrees; at the latest as a single chunk.
    """
    if length <= overlap:
        raise ValueError("a chunk must be longer than its overlap")
    done = None
    while True:
        chunks = cut(texts, length, overlap).repartition("digest", "part")
        # three parts of the splice read the encoded chunks: a few hundred numbers each
        encoded = settle(encode_chunks(chunks, path, length, overlap), "chunks")
        found = settle(splice(encoded), "spliced")
        good = found.filter("apart = 0").select("digest", "n_tokens")
        done = good if done is None else done.unionByName(good)
        apart = found.filter("apart > 0").select("digest")
        if apart.isEmpty():
            return done
        texts = texts.join(apart, "digest", "left_semi")
        length, overlap = WIDER * length, WIDER * overlap


def count_tokens(docs: DataFrame, path: str, length: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens to every row; replaces input columns of these names.

    Texts of up to two chunks are counted in place, without a shuffle. Longer ones are cut, each
    distinct text once, and the chunks dealt over all tasks; rows with equal texts share the
    result. Null and empty texts count 0. Equal rows stay equal rows, an empty table gives an empty
    table, other columns are kept whatever their names.
    """
    small_batches(docs.sparkSession)
    added = ("n_bytes", "n_tokens")
    packed = docs.select(pack(docs), F.col("text").alias("text"))
    huge = F.coalesce(F.length("text") > 2 * length, F.lit(False))
    short = packed.filter(~huge)
    schema = T.StructType([short.schema[ROW], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                ROW: batch.column(ROW),
                "n_bytes": pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()),
                "n_tokens": pa.array(own.counts(texts), pa.int64())})

    long = packed.filter(huge).withColumn("digest", F.sha2("text", 256))
    distinct = long.groupBy("digest").agg(F.first("text").alias("text"))
    totals = count_huge(distinct, path, length, overlap)
    spliced = (long.select(ROW, "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
               .join(totals, "digest").select(ROW, *added))
    return short.mapInArrow(run, schema).unionByName(spliced).select(
        *unpack(docs.columns, added), *added)
