"""The n-gram join where its groups, blocks and buffers are small, and over rows that repeat."""

import numpy as np

from lattisphere.llm import ngram_join as N
from lattisphere.llm.common import Bounded

from .test_queries import brute_components


def families(rng):
    """Chains, stars, a passage that unrelated texts share, and copies, in one table."""
    base, docs, chain = [f"b{k}" for k in range(80)], {}, [f"b{k}" for k in range(80)]
    for i in range(40):
        chain = list(chain)
        chain[int(rng.integers(0, 80))] = f"c{i}"
        docs[i] = " ".join(chain)
    for i in range(40, 120):
        own = list(base)
        for k in rng.integers(0, 80, 2):
            own[int(k)] = f"s{i}_{k}"
        docs[i] = " ".join(own)
    for i in range(120, 200):
        docs[i] = " ".join(base[:60] + [f"u{i}_{k}" for k in range(int(rng.integers(3, 40)))])
    for i in range(200, 260):
        docs[i] = docs[int(rng.integers(0, 200))]
    return docs


def test_small_groups_lose_no_link(spark, monkeypatch):
    for name, value in (("OWNERS", 7), ("HELD", 50), ("GROUP_BYTES", 20_000), ("TOGETHER", 5), ("PARTS", 16)):
        monkeypatch.setattr(N, name, value)
    docs = families(np.random.default_rng(1))
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(table).collect()}
    assert found == brute_components(docs)


def test_repeated_rows_null_keys_and_clashing_columns(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(5, words), (5, words), (3, words + " end"), (None, words), (7, None), (7, ""), (8, " \n "), (9, "one two"), (9, "ONE\ttwo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS `set`", "1 AS comp", "2 AS component_id", "'t' AS token")
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.jaccard_components(docs).collect())
    assert found == sorted([("5", 36, "3"), ("5", 36, "3"), ("3", 37, "3"), ("None", 36, "None"), ("7", 0, "7"), ("7", 0, "7"), ("8", 0, "8"), ("9", 1, "9"), ("9", 1, "9")])
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("3", words + " end"), ("8", " \n "), *[("9", t) for t in {r.text for r in kept.collect()} & {"one two", "ONE\ttwo"}], ("None", words)]
    assert N.jaccard_components(docs.limit(0)).count() == 0 and N.one_of_each(docs.limit(0)).count() == 0


def test_sketch_follows_the_text():
    assert N.sketch_bits(0, 1) == 14 and N.sketch_bits(10**13, 10**6) == 20 and N.sketch_bits(10**13, 10) == 22
    assert N.sketch_bits(80_000_000, 32) == 18


def test_caches_of_one_use_at_a_time():
    a, b = Bounded(str, 3, "a"), Bounded(str, 3, "b")
    assert [a[i] for i in range(8)] == [str(i) for i in range(8)] and len(a) + len(a.old) <= 6
    assert b[1] == "1" and not a and not a.old and a[1] == "1" and not b
