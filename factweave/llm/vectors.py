"""Distinct usable vectors of a table, and cuts of an ordered sequence into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _usable(batches):
    for batch in batches:
        ids, raw = batch.column(0), batch.column(1).to_pylist()
        key = []
        for v in raw:
            x = np.array([np.nan if e is None else e for e in v], np.float64) if v else np.zeros(0)
            key.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(key, pa.binary())], names=["vec_id", "key"])


def usable(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, key) of every row: key holds the vector's doubles, null if it is null, empty, zero, or holds a
    null or non-finite component, or if the row has no id."""
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    out = rows.mapInArrow(_usable, "vec_id long, key binary")
    return out.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key")))


def matrix(col) -> np.ndarray:
    """Rows of equal length from a binary column of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(x.as_buffer() for x in col), np.float64).reshape(len(col), -1)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index connected with each of 0..n-1 by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(old, root):
            return root
