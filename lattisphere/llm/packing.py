"""Best-fit packing of documents into token sequences of a fixed capacity, by large-item matching.

A document's ids and one end id are its tokens; only a document above the capacity is cut, into full pieces, of which the
first may be shorter. Piece lengths are small whole numbers, so the packing is decided on the histogram of lengths, which
has at most `capacity` entries whatever the data's size:

- pieces above one third of the capacity share a sequence with at most one other such piece: from the longest down, each
  is matched with the longest that still fits;
- smaller pieces, from the longest down, go to the tightest gap that holds them; new sequences open only when none does.

All sequences with one gap are alike, so the plan is made in runs: (length, ranks) -> (first sequence, pieces in each,
offset). Pieces get a gapless rank within their length, without a task that holds a whole length, and look their run up.

Defined results: null and empty texts have the end id alone. Repeated rows are packed as often as they occur. An empty
table gives no rows. Null keys are kept. `cut_documents` reads the key and the text alone; `pack` carries all columns along
and replaces those named `sequence_id` or `offset`.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_tokens import vocabulary
from .common import materialize, ranked, shuffle_width

CAPACITY = 2048


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, piece int, start long, length long, ids_crc32 long[, ids array<int>]): one row for each piece."""
    fields = [("piece", pa.int32(), T.IntegerType()), ("start", pa.int64(), T.LongType()), ("length", pa.int64(), T.LongType()), ("ids_crc32", pa.int64(), T.LongType())]
    fields += [("ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))] * keep_ids
    kind = pa.list_(pa.struct([(n, a) for n, a, _ in fields]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, t) for n, _, t in fields])))
    def cut(texts: pa.Array) -> pa.Array:
        own, out = vocabulary(path), []
        for t in texts.to_pylist():
            ids = np.array([*own.ids(t), end_id], "<u4")
            first = len(ids) % capacity or capacity
            edges = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
            row = []
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                row.append({"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())})
                if keep_ids:
                    row[-1]["ids"] = ids[a:b].tolist()
            out.append(row)
        return pa.array(out, kind)

    return docs.select(F.col(key), F.explode(cut(F.col(text))).alias("p")).select(key, "p.*")


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, pieces in each sequence, offset) by length and rank; and the number of sequences."""
    left = {n: c for n, c in lengths.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a piece is empty or longer than the capacity")
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    order: list[int] = []  # gaps that have sequences, ascending
    opened = 0

    def put(length: int, first: int, sequences: int, each: int, gap: int) -> None:
        """`each` pieces of a length into each of so many sequences that have this gap."""
        runs.append((length, rank[length], first, each, capacity - gap))
        rank[length] += sequences * each
        left[length] -= sequences * each
        rest = gap - each * length
        if rest not in gaps:
            gaps[rest] = []
            insort(order, rest)
        gaps[rest].append((first, sequences))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if n <= min(a, capacity - a) and left[n] > (n == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            first, opened = opened, opened + n
            if b is None:
                put(a, first, n, 1, capacity)
            elif b == a:
                put(a, first, n, 2, capacity)
            else:
                put(a, first, n, 1, capacity)
                gaps[capacity - a].pop()  # the run just added goes on to its partner
                if not gaps[capacity - a]:
                    del gaps[capacity - a]
                    order.remove(capacity - a)
                put(b, first, n, 1, capacity - a)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                first, sequences = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first, sequences = capacity, opened, max(1, left[n] // (capacity // n))
                opened += sequences
            each = gap // n
            full = min(sequences, left[n] // each)
            used = full
            if full:
                put(n, first, full, each, gap)
            if used < sequences and left[n]:
                put(n, first + used, 1, left[n], gap)
                used += 1
            if used < sequences:
                if gap not in gaps:
                    gaps[gap] = []
                    insort(order, gap)
                gaps[gap].append((first + used, sequences - used))
    return np.array(sorted(runs), np.int64).reshape(-1, 5), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces with sequence_id and offset (long). order: the columns that tell pieces of one length apart."""
    spark = pieces.sparkSession
    stored = materialize(pieces, "pieces")
    counts = stored.groupBy(length).agg(F.count("*").alias("n"))
    histogram = {int(r[length]): r.n for r in counts.collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(runs)  # bounded by the capacity, not by the data
    sizes = spark.createDataFrame(list(histogram.items()), f"{length} {dict(stored.dtypes)[length]}, n bigint")
    rows = ranked(stored, length, sizes, "__rank", list(order), 4 * shuffle_width(spark))
    rows = rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        starts = (runs[:, 0] << 44) + runs[:, 1]
        for b in batches:
            n, rank = b[length].to_numpy(), b["__rank"].to_numpy()
            run = runs[np.searchsorted(starts, (n << 44) + rank, "right") - 1]
            within = rank - run[:, 1]
            place = {"sequence_id": run[:, 2] + within // run[:, 3], "offset": run[:, 4] + within % run[:, 3] * n}
            yield pa.RecordBatch.from_arrays([pa.array(place[f.name], pa.int64()) if f.name in place else b[f.name] for f in b.schema], schema=b.schema)

    return rows.mapInArrow(look_up, rows.schema).drop("__rank")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, for pieces cut with keep_ids; each holds at most the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
