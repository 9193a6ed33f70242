"""Shared helpers of the training-data operators: shared-folder tables, gapless ranks, bounded array sums."""

from __future__ import annotations

import math
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import release_tables, stored as materialize

__all__ = ["BATCH_ROWS", "Bounded", "materialize", "ranked", "read_table", "release_tables", "shuffle_width", "sum_arrays"]

#: Rows in a batch that a Python worker gets at once. Texts are long: 10,000 of them, Spark's default, can be 100 MB.
BATCH_ROWS = 2_000
#: Bytes in such a batch; Spark's default, 64 MB, is copied several times on the way through a worker.
BATCH_BYTES = "16m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. The queries begin here, so this also sets what batches of texts for Python workers may hold."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "0")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, key: str, counts: DataFrame, rank: str, order: list[str], spread: int) -> DataFrame:
    """Gapless ranks from 0 within each key, without a task that holds a whole key.

    counts: (key, n) with a bounded number of keys. A key's rows are dealt over about n * spread / total
    salts, each salt is ranked alone, and prefix sums over the salts' counts make the ranks gapless.
    `order` must identify a row within its key; copies of a row get different ranks all the same.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    each = max(1, math.ceil(total / max(1, spread)))
    salts = counts.select(key, F.ceil(F.col("n") / each).cast("int").alias("__salts"))
    dealt = df.join(F.broadcast(salts), key).withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__salts")).cast("int"))
    sizes = dealt.groupBy(key, "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy(key, "__salt").orderBy(*order)
    return (
        dealt.withColumn("__own", F.row_number().over(own) - 1)
        .join(bases, [key, "__salt"])
        .withColumn(rank, (F.col("__base") + F.col("__own")).cast("long"))
        .drop("__salts", "__salt", "__own", "__base")
    )


def sum_arrays(parts: DataFrame, width: int, chunks: int = 32) -> np.ndarray:
    """Sum of many equally long int64 arrays, a bounded result of `width` numbers.

    parts: rows (chunk int, counts binary), where counts is the int32 little-endian slice of that chunk.
    Every chunk is added up by one task over at most one row for each map task; the driver gets width numbers.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = None, 0
        for batch in batches:
            for c, raw in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
                row = np.frombuffer(raw, "<i4").astype(np.int64)
                total, chunk = (row, c) if total is None else (total + row, c)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(width, np.int64)
    step = width // chunks
    for row in parts.groupBy("chunk").applyInArrow(add, "chunk int, total binary").collect():
        out[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(row.total, np.int64)
    return out


class Bounded(dict):
    """A cache of at most about 2 * size entries: the older half goes when the newer one is full.

    Spark uses a Python worker again for the next operator. Caches of one `use` go when one of another use grows, so a
    worker holds those of one operator at a time.
    """

    every: weakref.WeakSet = weakref.WeakSet()
    growing = ""
    __hash__ = object.__hash__

    def __init__(self, make, size: int, use: str):
        super().__init__()
        self.make, self.size, self.use, self.old = make, size, use, {}
        Bounded.every.add(self)

    def __missing__(self, key):
        if Bounded.growing != self.use:
            Bounded.growing = self.use
            for cache in Bounded.every:
                if cache.use != self.use:
                    cache.clear()
                    cache.old = {}
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
