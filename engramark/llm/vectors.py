"""Vectors as integers: the rows whose vector can be used, each as the bytes of its little-endian 64-bit integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramark.llm.bytetext import column_bytes

#: An entry becomes floor(SCALE * entry).
SCALE = 1024
#: Integers are below this in size, so that squared differences of 2**8 dimensions and more sum up in 64 bits; larger ones are an error.
LARGEST = 1 << 26
#: Values that one row of partial sums holds.
WIDTH = 16


def usable(table: DataFrame, vector: str, keep: list[str]) -> tuple[DataFrame, int]:
    """(the columns ``keep`` and ``_vector`` of rows with a whole, finite vector, its length).

    A null or empty vector and one with a null or non-finite entry go. The length is
    that of most vectors, the smaller of two equally frequent ones; vectors of
    another length are of another space and go too. Without rows it is 0.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = table.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select(*keep, F.col(vector).alias("_vector"))
    most = whole.groupBy(F.size("_vector").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").first()
    length = most["k"] if most else 0
    return whole.where(F.size("_vector") == length), length


def packed(rows: DataFrame, length: int, add: int = 0) -> DataFrame:
    """usable()'s rows with ``_x``, the bytes of floor(SCALE * entry) + add, in place of the vector."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(SCALE * values)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"vector entries must be below {LARGEST // SCALE} in size")
            data = pa.py_buffer((x.astype("<i8") + add).tobytes())
            offsets = pa.py_buffer((np.arange(batch.num_rows + 1, dtype=np.int32) * (8 * length)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, data])], [*names, "_x"])

    return rows.mapInArrow(run, rows.drop("_vector").schema.add("_x", "binary"))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The integers of a ``_x`` column, a row for each."""
    return column_bytes(column)[0].view("<i8").reshape(-1, length)


def summed(parts: DataFrame, kind: str) -> DataFrame:
    """(key, at, s) with the sums of rows (key, at, s): an array of WIDTH values of ``kind`` for each key and place, added up entry by entry."""
    sums = [F.sum(F.col("s")[k]).cast(kind).alias(f"s{k}") for k in range(WIDTH)]
    return parts.groupBy("key", "at").agg(*sums).select("key", "at", F.array(*(f"s{k}" for k in range(WIDTH))).alias("s"))


def rows_of(values: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """A matrix, a row for each of ``keys``, as rows (key, at, s), cut into pieces of WIDTH columns filled up with zeros."""
    n, width = values.shape
    pieces = max(1, -(-width // WIDTH))
    full = np.zeros((n, pieces * WIDTH), values.dtype)
    full[:, :width] = values
    lists = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), WIDTH).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, pieces).astype(np.int64)), pa.array(np.tile(np.arange(pieces), n).astype(np.int64)), lists], ["key", "at", "s"])


def collected(sums: DataFrame, keys: int, width: int, kind: type) -> np.ndarray:
    """summed()'s rows as a matrix of ``keys`` x ``width``; keys without a row are zeros. Its size is the model's, not the data's."""
    pieces = max(1, -(-width // WIDTH))
    out = np.zeros((keys, pieces * WIDTH), kind)
    for r in sums.collect():
        out[r["key"], r["at"] * WIDTH : (r["at"] + 1) * WIDTH] = r["s"]
    return out[:, :width]
