"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging.

Components become floor(64 * x) with x as double; scores are integer inner products, exact in double precision as long
as they stay below 2^53 (checked; beyond it the tile is multiplied in 64-bit integers).

Queries are taken in blocks of about QUERY_BLOCK rows. A block's bound is known (rows x dimensions x 8 bytes), so it is
broadcast, and one pass over the candidates multiplies it with every shard, tile by tile. A task keeps one running list of
k for each query; the tasks' lists meet in a tree of fan-in FAN. Nothing but these lists is shuffled.

Defined results: rows without an id, null vectors, and vectors with a null or non-finite component take no
part; an empty vector and shorter ones count as if filled up with zeros to the longest. A query never finds rows of its own id. Ties go to the smaller id. A
repeated query id is answered once, for the smallest of its vectors; a repeated candidate counts as often as it occurs.
Fewer than k candidates: all of them. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import TOP, lists, matrix, merge_tops, tops, valid_vectors

QUERY_BLOCK, QUERY_TILE, SHARD_TILE, FAN = 16_384, 512, 4096, 16
_NONE = -(2.0**62)


def _tile(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of one tile for each query; x is in order of ids. Missing places hold the score _NONE."""
    bound = float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(x).max(initial=0))
    if bound >= 2.0**53:
        scores = (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.float64)
    else:
        scores = q @ x.T
    low, high = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    for r in np.flatnonzero(low < high):
        scores[r, low[r] : high[r]] = _NONE
    m = len(ids)
    if m > k:
        if bound * m < 2.0**51:  # score and place in one number: a partial selection is then exact at ties
            place = np.arange(m, dtype=np.float64)
            key = np.where(scores == _NONE, _NONE, scores * m - place)
            at = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(scores, at, 1), ids[at]
    return scores, np.broadcast_to(ids, scores.shape)


def _pass(candidates: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast((q_ids, q))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        best_s, best_i = np.full((len(q), k), _NONE), np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            all_ids, all_x = batch["id"].to_numpy(zero_copy_only=False), np.floor(64 * matrix(batch["v"]))
            for a in range(0, len(all_ids), SHARD_TILE):
                order = np.argsort(all_ids[a : a + SHARD_TILE], kind="stable")
                ids, x = all_ids[a : a + SHARD_TILE][order], all_x[a : a + SHARD_TILE][order]
                for b in range(0, len(q), QUERY_TILE):
                    rows = slice(b, b + QUERY_TILE)
                    s, i = _tile(q[rows], q_ids[rows], x, ids, k)
                    best_s[rows], best_i[rows] = tops(np.hstack([best_s[rows], s]), np.hstack([best_i[rows], i]), k)
        keep = best_s > _NONE
        some = keep.any(1)
        neg = np.where(keep, -best_s, 0).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_ids[some]), lists(neg[some], best_i[some], keep[some], pa.int64()), pa.array(np.full(some.sum(), TaskContext.get().partitionId(), np.int32))],
            names=["query_id", "top", "task"],
        )

    parts = candidates.mapInArrow(search, f"query_id bigint, top {TOP.format(kind='bigint')}, task int")
    tasks = candidates.rdd.getNumPartitions()
    while tasks > FAN:
        parts = merge_tops(parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")), "query_id", F.col("task"), k).withColumnRenamed("part", "task")
        tasks = math.ceil(tasks / FAN)
    return merge_tops(parts, "query_id", None, k)


def exact_top_k(candidates: DataFrame, is_query: Callable[[Column], Column], k: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row for whose id is_query holds."""
    rows = valid_vectors(candidates.withColumn(vector, F.col(vector).cast("array<double>")), key, vector, nonzero=False)
    asked = rows.where(is_query(F.col("id")))
    blocks = max(1, math.ceil(asked.count() / block))
    found = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else asked
        table = own.toArrow()  # about `block` rows
        if table.num_rows == 0:
            continue
        q_ids, q = table["id"].to_numpy(), np.floor(64 * matrix(table["v"]))
        order = np.lexsort((*q.T[::-1], q_ids))
        q_ids, first = np.unique(q_ids[order], return_index=True)
        found.append(_pass(rows, q_ids, q[order][first], k))
    if not found:
        return candidates.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    merged = reduce(DataFrame.union, found)
    return merged.select("query_id", F.posexplode("top").alias("rank", "e")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.neg")).alias("score"))
