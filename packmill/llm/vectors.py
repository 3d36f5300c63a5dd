"""What the operators on embeddings share: which vectors take part, columns as arrays."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def usual_length(df: DataFrame, vector: Column) -> int:
    """The most frequent length (of equally frequent ones the longest) of finite vectors; 0 if there are none."""
    lengths = df.where(finite(vector)).groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("rows"))
    found = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    return found.length if found else 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix of its rows."""
    return np.asarray(column.flatten()).reshape(-1, length) if length else np.zeros((len(column), 0))


def binaries(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def from_binaries(column: pa.Array, kind: str, length: int) -> np.ndarray:
    """The matrix of a column of `binaries`."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, length) if length else np.zeros((len(column), 0), kind)
