"""What several of the operators share: row packing, word hashes, Arrow batch limits."""

from __future__ import annotations

import os
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"
# ASCII white space: space and U+0009 to U+000D, the word separators of every operator here.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pack(df: DataFrame) -> Column:
    """All columns as one struct, so that no helper column can clash with a column of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def unpack(columns: list[str], replaced: tuple[str, ...] = ()) -> list[Column]:
    """The packed columns again, without those that the operator's own results replace."""
    names = {r.lower() for r in replaced}
    return [F.col(f"{ROW}.`{c}`").alias(c) for c in columns if c.lower() not in names]


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch: texts may be very long and a task must not hold many.

    Also names this library's folder to Python workers on the same machines; where it is shipped
    with --py-files the workers find it there.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    home = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, *paths]))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the given values, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (finaliser with multiply and shift steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _table(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


def powers(n: int) -> np.ndarray:
    """FACTOR ** 0 ... n - 1 modulo 2**64."""
    return _table(FACTOR, n)


def inverse_powers(n: int) -> np.ndarray:
    return _table(pow(FACTOR, -1, 1 << 64), n)


# Bytes hashed in one go; longer texts are cut between words and give the same hashes. The powers
# and prefix sums take 8 bytes for each of them.
STRETCH = 1 << 18


def join_texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one space after each, and where each text starts (null: empty)."""
    parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    return data, starts


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of the joined bytes.

    The hash of a word is a difference of prefix sums of byte times power, brought to a common
    exponent with the inverse power, so the whole batch costs a few passes over its bytes.
    """
    space = SPACES[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty_like(space)
    after[-1] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    out = np.zeros(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        stop = int(np.searchsorted(ends, starts[done] + STRETCH, "right"))
        stop = max(stop, done + 1)
        low, high = starts[done], ends[stop - 1]
        n = int(high - low)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
        s, e = starts[done:stop] - low, ends[done:stop] - low
        raw = (prefix[e] - prefix[s]) * inverse_powers(n)[s]
        out[done:stop] = mix64(raw + (e - s).astype(np.uint64))
        done = stop
    return starts, out
