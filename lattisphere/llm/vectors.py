"""What both vector searches share: valid vectors, Arrow to numpy, merging of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = "array<struct<neg:{kind},id:bigint>>"


def valid_vectors(df: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """(id long, v array<double or float>) of the rows that take part, all of one length.

    Left out: null ids, null vectors, vectors with a null, NaN or infinite component, and with nonzero also those without
    a component other than zero. Shorter vectors are filled up with zeros to the longest one's length.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    out = out.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    if nonzero:
        out = out.where(F.exists("v", lambda x: x != 0))
    low, high = out.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low == high:
        return out
    kind = out.schema["v"].dataType.elementType
    return out.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(kind), F.lit(high) - F.size("v"))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long lists as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def merge_tops(parts: DataFrame, query: str, group: Column | None, k: int) -> DataFrame:
    """One (query[, group]) row of the k first entries of all its lists; an entry sorts by -score, then id."""
    keys = [query] if group is None else [query, group.alias("part")]
    return parts.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))


def tops(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise k best of (n x m) scores and ids: largest score first, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def lists(neg: np.ndarray, ids: np.ndarray, keep: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Row-wise lists of struct<neg, id> of the kept cells."""
    offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
    cells = pa.StructArray.from_arrays([pa.array(neg[keep], kind), pa.array(ids[keep], pa.int64())], names=["neg", "id"])
    return pa.ListArray.from_arrays(pa.array(offsets), cells)
