"""Vectors as rows of matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.llm.common import small_batches


def stored_as(vectors: DataFrame, column: str = "embedding") -> str:
    """How components are stored: 4 bytes where the input has no more, else 8."""
    return "<f4" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "<f8"


def as_matrix(values: list[bytes], kind: str) -> np.ndarray:
    """Stored vectors of one size as rows of doubles."""
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v, size): size is the number of dimensions, null where a vector cannot be used.

    Unusable are vectors that are null, empty or zero or hold null or non-finite components.
    """
    good = (F.col("v").isNotNull() & F.exists("v", lambda c: c != 0) & F.forall(
        "v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))))
    return vectors.select("vec_id", F.col(column).alias("v")).withColumn(
        "size", F.when(good, F.size("v")))


def widths(vectors: DataFrame) -> list[int]:
    """The numbers of dimensions that occur among usable vectors; vectors of different ones are never
    compared, so each has a job of its own."""
    return sorted(r["size"] for r in vectors.filter(F.col("size").isNotNull())
                  .select("size").distinct().collect())


def stored(vectors: DataFrame, size: int, kind: str) -> DataFrame:
    """(vec_id, vec): the usable vectors of one size, in binary."""
    small_batches(vectors.sparkSession, 2048)
    own = vectors.filter(F.col("size") == size).select("vec_id", "v")

    def run(batches):
        width = size * int(kind[-1])
        for batch in batches:
            data = np.asarray(batch.column("v").flatten(), kind).tobytes()
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"),
                "vec": pa.array([data[i * width:(i + 1) * width] for i in range(batch.num_rows)],
                                pa.binary())})

    return own.mapInArrow(run, T.StructType([own.schema["vec_id"],
                                             T.StructField("vec", T.BinaryType())]))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large and very small ones work too."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in one fixed order of operations: equal pairs, equal values."""
    top = np.einsum("nd,nd->n", x, y)
    below = np.sqrt(np.einsum("nd,nd->n", x, x)) * np.sqrt(np.einsum("nd,nd->n", y, y))
    return np.clip(top / below, -1.0, 1.0)
