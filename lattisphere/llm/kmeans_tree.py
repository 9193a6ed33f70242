"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest norm of all rows (0 for a
query). The tree has two levels of centres and grows with the table: as many leaves as hold LEAF rows each, up to
MOST_LEAVES, and the square root of that in each level. The upper level is fitted on at most SAMPLE distinct vectors, taken by
hash; the lower one by a task for each upper node, on at most FIT of the node's vectors for each of its leaves. Every row is then
indexed, by descending to its leaf. The centres are broadcast: at most MOST_LEAVES of them, however large the table is.

A query visits leaves in the order in which they leave a priority queue that starts with the upper nodes and gets a node's
leaves when the node leaves it. In this order a leaf's key is the larger one of its own distance and its node's, so a
query is known by the key of its last leaf, and no queue is sent anywhere (leaves whose keys tie are visited together). How many leaves it visits is calibrated on the whole
index: for sample queries, whose neighbours among all rows are found by one exact pass, visits are widened until the recall
reaches `recall`; beyond that, a query goes on until its leaves hold more than k candidates.

Leaves that follow each other are stored in blocks of about BLOCK rows (a larger leaf in parts), and a query is sent once to
each block in which it visits leaves; blocks of rows and of QUERIES queries meet in a task, so none holds a hot leaf. Equal
vectors are indexed once, with their k + 1 smallest ids: more than those can't be among anyone's k nearest, so a vector that a
third of all rows share costs as much as one.

Defined results: rows without an id, null, empty and zero vectors, and vectors with a null or non-finite component take no
part; shorter vectors count as if filled up with zeros to the longest. Ties go to the smaller id; rows of the query's own id
are not found. A repeated candidate counts as often as it occurs; a repeated query id is answered once, for the smallest
of its vectors. Fewer than k candidates: all that the visited leaves hold. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .vectors import matrix, merge_tops, tops, valid_vectors

#: The documented bounds of what the tree is fitted on: distinct vectors for the upper level, and for each leaf of the lower.
SAMPLE, FIT = 20_000, 64
#: Rows of a leaf, and the most leaves; rows of a block and queries that meet in a task; queries for the calibration.
LEAF, MOST_LEAVES, BLOCK, QUERIES, TRIED = 32, 65_536, 16_384, 16_384, 200
#: Leaves of a block that are multiplied at once.
TILE = 4
_TOP = "array<struct<neg:double,id:bigint,n:int>>"
_CELL = pa.struct([("neg", pa.float64()), ("id", pa.int64()), ("n", pa.int32())])


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, but for the part that depends on x alone."""
    return (centres**2).sum(1) - 2 * (x @ centres.T)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centres; fewer if there are fewer distinct vectors."""
    centres = np.unique(x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        label = np.concatenate([_near(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])
        order = np.argsort(label, kind="stable")
        used, first = np.unique(label[order], return_index=True)
        centres = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def branches(rows: int) -> int:
    """Nodes of the upper level, and leaves under one of them at most."""
    return max(1, math.ceil(math.sqrt(min(rows / LEAF, MOST_LEAVES))))


class Tree:
    """Upper centres, and the centres of their leaves one after the other: those of node i are first[i] to first[i + 1]."""

    def __init__(self, upper: np.ndarray, lower: list[np.ndarray]):
        self.upper, self.lower = upper, np.concatenate(lower)
        self.first = np.cumsum([0, *map(len, lower)])
        self.node = np.repeat(np.arange(len(lower)), [len(c) for c in lower])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = _near(x, self.upper).argmin(1) if len(x) else np.zeros(0, np.int64)
        out = np.empty(len(x), np.int64)
        for i in np.unique(node):
            rows = np.flatnonzero(node == i)
            out[rows] = self.first[i] + _near(x[rows], self.lower[self.first[i] : self.first[i + 1]]).argmin(1)
        return out

    def keys(self, q: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        """(queries x leaves a to b): the priority with which each leaf leaves the queue."""
        b = len(self.lower) if b is None else b
        low, high = self.node[a], self.node[b - 1] + 1
        above = _near(q, self.upper[low:high])
        return np.maximum(_near(q, self.lower[a:b]), above[:, self.node[a:b] - low])

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves of one query in best-bin-first order: the queue itself, which `keys` stands for."""
        heap = [(float(d), -1, i) for i, d in enumerate(_near(q[None, :], self.upper)[0])]
        heapq.heapify(heap)
        while heap:
            _, is_leaf, i = heapq.heappop(heap)
            if is_leaf >= 0:
                yield i
                continue
            a, b = int(self.first[i]), int(self.first[i + 1])
            for leaf, d in zip(range(a, b), _near(q[None, :], self.lower[a:b])[0]):
                heapq.heappush(heap, (float(d), leaf, leaf))


def widened(x: np.ndarray, m: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, m * m - (x * x).sum(1)))[:, None]])


def asking(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))])


def cutoffs(tree: Tree, q: np.ndarray, visits: int, held: np.ndarray, k: int) -> np.ndarray:
    """The key of the last leaf that each query visits: number `visits`, or the first at which it has met more than k rows."""
    out, step = np.empty(len(q)), max(1, 4_000_000 // len(held))
    for a in range(0, len(q), step):
        keys = tree.keys(q[a : a + step])
        last = np.partition(keys, visits - 1, axis=1)[:, visits - 1]
        for r in np.flatnonzero((keys <= last[:, None]).astype(np.float32) @ held.astype(np.float32) <= k):
            order = np.argsort(keys[r], kind="stable")
            enough = np.flatnonzero(np.cumsum(held[order]) > k)
            last[r] = keys[r][order[enough[0] if len(enough) else -1]]
        out[a : a + step] = last + 1e-9 * (1 + np.abs(last))  # the last leaf stays in where products are rounded otherwise
    return out


def _lists(neg: np.ndarray, ids: np.ndarray, n: np.ndarray, keep: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
    cells = pa.StructArray.from_arrays([pa.array(neg[keep]), pa.array(ids[keep]), pa.array(n[keep].astype(np.int32))], fields=list(_CELL))
    return pa.ListArray.from_arrays(pa.array(offsets), cells)


def _fit(distinct: DataFrame, n: int, m: float, sample: int) -> Tree:
    """Both levels; no task and not the driver see more than a bounded number of rows."""
    spark, wide = distinct.sparkSession, branches(n)
    share = lambda rate: F.pmod(F.xxhash64("u", F.lit(3)), F.lit(1 << 30)) < F.floor(rate * (1 << 30))
    taken = distinct.where(share(F.lit(0.97 * sample / n))) if n > sample else distinct
    upper = kmeans(widened(matrix(taken.select("u", "v").orderBy("u").toArrow()["v"])[:sample], m), wide)
    shared = spark.sparkContext.broadcast(upper)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = _near(widened(matrix(b["v"]), m), shared.value).argmin(1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), b["u"]], names=["node", "u"])

    nodes = materialize(distinct.select("u", "v").mapInArrow(settle, "node int, u bigint"), "nodes")
    sizes = nodes.groupBy("node").agg(F.count("*").alias("rows"))  # at most as many rows as there are upper nodes
    sizes = sizes.withColumn("k", F.least(F.lit(wide), F.ceil(F.col("rows") / LEAF)).cast("int"))
    chosen = nodes.join(F.broadcast(sizes), "node").where(share(F.col("k") * FIT / F.col("rows"))).select("node", "k", "u")

    def lower(table: pa.Table) -> pa.Table:
        table = table.sort_by("u")
        centres = kmeans(widened(matrix(table["v"]), m), table["k"][0].as_py()).astype(np.float32)
        return pa.table({"node": table["node"].slice(0, 1), "centres": pa.array([centres.tobytes()], pa.binary())})

    found = chosen.join(distinct.select("u", "v"), "u").groupBy("node").applyInArrow(lower, "node int, centres binary").collect()
    by_node = {r.node: np.frombuffer(r.centres, np.float32).astype(np.float64).reshape(-1, upper.shape[1]) for r in found}
    return Tree(upper, [by_node.get(i, upper[i : i + 1]) for i in range(len(upper))])


def calibrate(tree: Tree, placed: DataFrame, tried: list[tuple[int, np.ndarray]], k: int, recall: float) -> int:
    """Leaf visits with which the sample queries (u, vector) meet this share of their k nearest vectors among all rows."""
    own, q = np.array([u for u, _ in tried]), np.stack([v for _, v in tried])
    shared = placed.sparkSession.sparkContext.broadcast((own, q))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                s = q @ matrix(part["v"]).T
                s[own[:, None] == part["u"].to_numpy()[None, :]] = -np.inf
                some = np.flatnonzero((s >= best_s[:, -1:]).any(0))
                leaf = np.broadcast_to(part["leaf"].to_numpy()[some], (len(q), len(some)))
                best_s, best_i = tops(np.hstack([best_s, s[:, some]]), np.hstack([best_i, leaf]), k)
        keep = best_s > -np.inf
        some = np.flatnonzero(keep.any(1))
        lists = _lists(-best_s[some], best_i[some], np.ones((len(some), k)), keep[some])
        yield pa.RecordBatch.from_arrays([pa.array(some), lists, pa.array(some % 16, pa.int32())], names=["query", "top", "part"])

    parts = placed.select("u", "leaf", "v").mapInArrow(exact, f"query bigint, top {_TOP}, part int").withColumn("part", F.spark_partition_id() % 64)
    best = merge_tops(merge_tops(parts, "query", F.col("part"), k), "query", None, k).collect()  # TRIED x k numbers
    ranks = []
    for r in best:
        keys = tree.keys(asking(q[r["query"]][None, :]))[0]
        ranks += [int((keys < keys[e["id"]]).sum()) for e in r["top"]]
    ranks.sort()
    return min(len(tree.lower), ranks[math.ceil(recall * len(ranks)) - 1] + 1) if ranks else 1


def _better(best_s: np.ndarray, best_i: np.ndarray, rows: np.ndarray, s: np.ndarray, place: np.ndarray) -> None:
    """Put the scores s (rows x places) that are good enough among the best of their rows; ties to the smaller place."""
    r, c = np.nonzero((s >= best_s[rows, -1][:, None]) & (s > -np.inf))
    if not len(r):
        return
    hit, n = np.unique(r, return_counts=True)
    new_s, new_i = np.full((len(hit), n.max()), -np.inf), np.full((len(hit), n.max()), np.iinfo(np.int64).max)
    row, column = np.repeat(np.arange(len(hit)), n), np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
    new_s[row, column], new_i[row, column] = s[r, c], place[c]
    at = rows[hit]
    best_s[at], best_i[at] = tops(np.hstack([best_s[at], new_s]), np.hstack([best_i[at], new_i]), best_s.shape[1])


def _search(tree: Tree, table: pa.Table, asked: pa.Table, k: int) -> tuple[list[int], pa.Array]:
    """The k + 1 best ids for each query among the rows of a block, in the leaves that it visits."""
    table = table.sort_by([("leaf", "ascending"), ("u", "ascending")]).combine_chunks()
    leaf, u, x = table["leaf"].to_numpy(), table["u"].to_numpy(), matrix(table["v"])
    ids = table["ids"].combine_chunks()
    alone = np.diff(ids.offsets.to_numpy()) == 1
    q, cut, own = matrix(asked["v"]), asked["cut"].to_numpy(), asked["own"].to_pylist()
    place = np.empty(len(u), np.int64)
    place[np.argsort(u, kind="stable")] = np.arange(len(u))  # the rows' order by their smallest id
    skips = [(i, np.flatnonzero((u == o) & alone)) for i, o in enumerate(own) if o is not None]
    used, first = np.unique(leaf, return_index=True)
    ends = np.append(first, len(leaf))[1:]
    best_s, best_i = np.full((len(q), k + 1), -np.inf), np.full((len(q), k + 1), np.iinfo(np.int64).max)
    step = max(1, 4_000_000 // max(1, int(used[-1] - used[0]) + 1))
    for c in range(0, len(q), step):
        wants = tree.keys(asking(q[c : c + step]), int(used[0]), int(used[-1]) + 1)[:, used - used[0]] <= cut[c : c + step, None]
        for t in range(0, len(used), TILE):
            mine, a, b = wants[:, t : t + TILE], first[t], ends[min(t + TILE, len(used)) - 1]
            rows = np.flatnonzero(mine.any(1))
            if not len(rows):
                continue
            s = q[rows + c] @ x[a:b].T
            s[~np.repeat(mine[rows], ends[t : t + TILE] - first[t : t + TILE], axis=1)] = -np.inf
            for i, gone in skips:
                at = np.searchsorted(rows, i - c)
                if at < len(rows) and rows[at] == i - c:
                    s[at, gone[(gone >= a) & (gone < b)] - a] = -np.inf
            _better(best_s, best_i, rows + c, s, place[a:b])
    keep = best_s > -np.inf
    some = np.flatnonzero(keep.any(1))
    names, row = asked["query"].to_numpy()[some].tolist(), np.argsort(place)
    if alone.all():
        at = row[np.minimum(best_i[some], len(u) - 1)]
        return names, _lists(-best_s[some], u[at], ids.flatten().field("n").to_numpy()[at], keep[some])
    listed, cells = ids.to_pylist(), []
    for r in some:
        mine = [{"neg": -float(s), "id": e["id"], "n": e["n"]} for s, i in zip(best_s[r], best_i[r]) if s > -np.inf for e in listed[row[i]] if e["id"] != own[r]]
        cells.append(sorted(mine, key=lambda e: (e["neg"], e["id"]))[: k + 1])
    return names, pa.array(cells, pa.list_(_CELL))


def nearest(rows: DataFrame, is_query: Callable[[Column], Column], k: int = 20, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row for whose id is_query holds."""
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    own = valid_vectors(rows, key, vector, nonzero=True)
    # equal vectors once: Spark keeps k + 1 ids of each in every map task before the shuffle
    counted = own.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = first.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("ids")).withColumn("u", F.col("ids")[0]["id"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    distinct = materialize(distinct.withColumn("norm", norm), "vectors")
    n, m = distinct.agg(F.count("*"), F.max("norm")).first()
    if not n:
        return nothing
    tree = _fit(distinct, n, m, sample)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.place(widened(matrix(b["v"]), m)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), b["u"], b["ids"], b["v"]], names=["leaf", "u", "ids", "v"])

    item = distinct.schema["v"].dataType.elementType.simpleString()
    placed = materialize(distinct.select("u", "ids", "v").mapInArrow(place, f"leaf bigint, u bigint, ids array<struct<id:bigint,n:int>>, v array<{item}>"), "leaves")
    held = np.zeros(len(tree.lower), np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # at most MOST_LEAVES numbers
        held[r.leaf] = r.n
    tried = [(r.u, np.array(r.v, np.float64)) for r in placed.select("u", "v", F.xxhash64("u", F.lit(5)).alias("h")).orderBy("h", "u").limit(TRIED).collect()]
    visits = calibrate(tree, placed, tried, k, recall)

    # leaves that follow each other share a block of about `block` rows; one that is larger has parts
    begins = np.cumsum(held) - held
    of_leaf = np.unique(begins // block, return_inverse=True)[1]
    parts = np.ones(int(of_leaf[-1]) + 1, np.int64)
    np.maximum.at(parts, of_leaf, -(-held // block))
    grid = spark.createDataFrame([(int(l), int(of_leaf[l]), int(parts[of_leaf[l]])) for l in np.flatnonzero(held)], "leaf bigint, block bigint, parts int")
    starts, guard = np.searchsorted(of_leaf, np.arange(len(parts))), spark.sparkContext.broadcast(held)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = shared.value, guard.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b["v"])
            cut, wanted = cutoffs(tree, asking(q), visits, held, k), []
            step = max(1, 4_000_000 // len(held))
            for a in range(0, len(q), step):
                near = (tree.keys(asking(q[a : a + step])) <= cut[a : a + step, None]) & (held > 0)
                wanted += [np.flatnonzero(w).tolist() for w in np.logical_or.reduceat(near, starts, axis=1)]
            yield pa.RecordBatch.from_arrays([b["query"], b["v"], b["own"], pa.array(cut), pa.array(wanted, pa.list_(pa.int64()))], names=["query", "v", "own", "cut", "blocks"])

    # equal questions once; an id with several vectors asks alone, and none of them is among its answers
    asked = counted.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("vectors"))
    asked = asked.withColumn("alone", F.col("vectors") > 1).withColumn("own", F.when(F.col("alone"), F.col("id")).otherwise(0)).drop("vectors")
    questions = asked.groupBy("v", "alone", "own").agg(F.min("id").alias("query")).select("query", "v", F.when(F.col("alone"), F.col("own")).alias("own"))
    probes = materialize(questions.mapInArrow(ask, f"query bigint, v array<{item}>, own bigint, cut double, blocks array<bigint>"), "probes")
    sent = probes.select("query", "v", "own", "cut", F.explode("blocks").alias("block"))
    asks = {r.block: r.n for r in sent.groupBy("block").agg(F.count("*").alias("n")).collect()}  # at most MOST_LEAVES numbers
    if not asks:
        return nothing
    width = spark.createDataFrame([(b, int(parts[b]), math.ceil(n / queries)) for b, n in asks.items()], "block bigint, parts int, nq int")
    deal = lambda col, of: F.pmod(F.xxhash64(col), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = placed.join(F.broadcast(grid.drop("parts")), "leaf").join(F.broadcast(width), "block").withColumn("part", deal("u", "parts")).withColumn("bq", every("nq"))
    right = sent.join(F.broadcast(width), "block").withColumn("bq", deal("query", "nq")).withColumn("part", every("parts"))

    def search(key, a: pa.Table, b: pa.Table) -> pa.Table:
        names, top = _search(shared.value, a, b, k) if a.num_rows and b.num_rows else ([], pa.array([], pa.list_(_CELL)))
        return pa.table({"query": pa.array(names, pa.int64()), "top": top, "part": pa.array([key[0].as_py() % 16] * len(names), pa.int32())})

    keys = ["block", "part", "bq"]
    found = left.select(*keys, "leaf", "u", "ids", "v").groupBy(*keys).cogroup(right.select(*keys, "query", "v", "own", "cut").groupBy(*keys)).applyInArrow(search, f"query bigint, top {_TOP}, part int")
    merged = merge_tops(merge_tops(found, "query", F.col("part"), k + 1), "query", None, k + 1)
    answers = merged.join(probes.select("query", "v", F.col("own").isNotNull().alias("alone"), F.coalesce("own", F.lit(0)).alias("own")), "query").drop("query")
    others = F.flatten(F.transform(F.filter("top", lambda e: e["id"] != F.col("id")), lambda e: F.array_repeat(e, e["n"])))
    each = asked.join(answers, ["v", "alone", "own"]).select(F.col("id").alias("query_id"), F.slice(others, 1, k).alias("top"))
    return each.select("query_id", F.posexplode("top").alias("rank", "e")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.neg")).alias("score"))
