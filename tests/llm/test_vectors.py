"""The two vector searches: the tree beyond its sample, in small blocks, and rows that repeat."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lattisphere.llm import kmeans_tree as K
from lattisphere.llm.exact_topk import exact_top_k

SCHEMA = "vec_id long, embedding array<double>"


def every20(c):
    return c % 20 == 0


def brute(table, queries, k, change=lambda x: x):
    """For each query (id, vector) the k best (score, id) among the rows of other ids, repeated rows as often as they occur."""
    out = {}
    for q, v in queries.items():
        scored = sorted((-float(np.dot(change(np.array(x)), change(np.array(v)))), i) for i, x in table if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_keys_are_the_order_of_the_queue():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6))
    upper = K.kmeans(x, 9)
    tree = K.Tree(upper, [K.kmeans(x[i * 100 : i * 100 + 100], 3 + i) for i in range(len(upper))])
    for q in rng.normal(size=(40, 6)):
        order = list(tree.visits(q))
        keys = tree.keys(q[None, :])[0]
        assert sorted(order) == list(range(len(tree.lower)))
        assert np.all(np.diff(keys[order]) >= -1e-9)
        for visits in (1, 7, 20):
            cut = K.cutoffs(tree, q[None, :], visits, np.full(len(keys), 100), 5)[0]
            visited = set(np.flatnonzero(keys <= cut).tolist())  # leaves that leave the queue together with their node tie
            assert len(visited) >= visits and visited == set(order[: len(visited)])


def test_tree_beyond_its_sample(spark):
    """6,000 rows, a tree fitted on 500, small blocks of rows and queries; clustered vectors, one of them on a third of the rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 12))
    x = (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 12))).round(3)
    x[rng.random(6000) < 0.33] = x[17]
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame(table, SCHEMA).repartition(5)
    found = K.nearest(docs, every20, k=10, sample=500, block=256, queries=64).toPandas()
    want = brute(table, {i: v for i, v in table if i % 20 == 0}, 10)
    assert set(found.query_id) == set(want) and (found.groupby("query_id").size() == 10).all()
    hits = 0
    for q, own in found.sort_values("rank").groupby("query_id"):
        pairs = list(zip(own.vec_id, own.score))
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0])) and np.allclose(own.score, [x[i] @ x[q] for i in own.vec_id], rtol=1e-12)
        hits += len({i for i, _ in want[q]} & set(own.vec_id))
    assert hits >= 0.9 * 10 * len(want)


def test_share_of_rows_falls_with_the_table():
    """Visits that find 95 % of the neighbours, as a share of the leaves, which hold some LEAF rows each at any size."""
    rng = np.random.default_rng(6)
    shares = []
    for n in (1000, 20000):
        x = rng.normal(size=(n, 8))
        wide = K.branches(n)
        upper = K.kmeans(x[:2000], wide)
        node = K._near(x, upper).argmin(1)
        tree = K.Tree(upper, [K.kmeans(x[node == i], min(wide, -(-int((node == i).sum()) // K.LEAF))) for i in range(len(upper))])
        leaf, ranks = tree.place(x), []
        for t in range(0, n, n // 50):
            s = ((x - x[t]) ** 2).sum(1)
            keys = tree.keys(x[t][None, :])[0]
            ranks += [int((keys < keys[leaf[i]]).sum()) for i in np.argsort(s)[1:11]]
        shares.append((np.quantile(ranks, 0.95) + 1) / len(tree.lower))
        assert np.bincount(leaf, minlength=len(tree.lower)).mean() < 1.5 * K.LEAF
    assert shares[1] < 0.6 * shares[0]


def test_repeated_rows_and_ids(spark):
    table = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [0.25]), (20, [0.0, 1.0]), (20, [2.0, 0.0]), (40, [1.0, 0.0]), (60, [3.0, 0.0])]
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in table], SCHEMA + ", ids string, leaf int, u double")
    flat = [(i, [*v, *[0.0] * (2 - len(v))]) for i, v in table]
    asked = {0: [1.0, 0.0], 20: [0.0, 1.0], 40: [1.0, 0.0], 60: [3.0, 0.0]}  # 20: the smaller of its vectors
    for k in (3, 20):
        got = K.nearest(docs, every20, k=k, recall=1.0).toPandas().sort_values("rank")
        want = brute(flat, asked, k)
        assert {q: list(zip(own.vec_id, own.score)) for q, own in got.groupby("query_id")} == want
        got = exact_top_k(docs, every20, k=k).toPandas().sort_values("rank")
        want = brute(flat, asked, k, lambda x: np.floor(64 * x))
        assert {q: list(zip(own.vec_id, own.score)) for q, own in got.groupby("query_id")} == want
    assert Counter(i for i, _ in brute(flat, asked, 20)[0])[1] == 3


def test_no_queries_and_no_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (3, [2.0, 1.0])], SCHEMA)
    empty = spark.createDataFrame([(20, None), (40, []), (None, [1.0])], SCHEMA)
    for search in (K.nearest, exact_top_k):
        assert search(docs, every20).count() == 0
        assert search(empty, every20).where(F.col("score") != 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0])], SCHEMA)
    assert K.nearest(one, every20).count() == 0 and exact_top_k(one, every20).count() == 0
