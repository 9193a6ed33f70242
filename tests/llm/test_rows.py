"""Repeated and null ids, and columns with clashing names, for the operators that read texts row by row; plain FTRL."""

import math
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from lattisphere.llm.byte_tokens import count_tokens  # noqa: E402
from lattisphere.llm.packing import cut_documents, pack, sequences  # noqa: E402
from lattisphere.llm.toxicity import drop_toxic, ftrl, score_toxicity  # noqa: E402

TEXTS = [(1, "one text"), (1, "one text"), (1, "another text"), (None, "no id"), (2, None), (3, ""), (4, "word " * 5000), (5, "you fool"), (5, "you fool")]
NAMES = "piece start length ids_crc32 sequence_id offset n_tokens over_limit score predicted held_out toxic set token shard slot p d y key row".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in TEXTS], "doc_id long, text string, n_chars long").selectExpr("*", *[f"'x' AS `{n}`" for n in NAMES])


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    reader = Tokenizer.from_file(path)
    count = lambda t: len(reader.encode(t or "", add_special_tokens=False).ids)
    found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, path, limit=1024).collect())
    assert found == sorted((str(i), len((t or "").encode()), count(t), count(t) > 1024) for i, t in TEXTS)


def test_packing(docs, spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    reader = Tokenizer.from_file(path)
    pieces = cut_documents(docs, path, keep_ids=True).selectExpr("*", "'x' AS sequence_id", "'x' AS offset", "'x' AS n")
    packed = pack(pieces)
    rows = packed.toPandas()
    assert len(rows) == len(TEXTS) + 2 and set(rows.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "n"}
    whole = sorted(tuple([*reader.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in TEXTS if len(t or "") < 100)
    assert sorted(tuple(i) for i, k, n in zip(rows.ids, rows.doc_id, rows.length) if k != 4) == whole
    held = {r.sequence_id: list(r.ids) for r in sequences(packed).collect()}
    for sequence, own in rows.sort_values("offset").groupby("sequence_id"):
        assert held[sequence] == [t for ids in own.ids for t in ids] and len(held[sequence]) <= 2048
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]]
    assert pack(pieces.limit(0)).count() == 0


def test_toxicity(docs, spark):
    rows = [(i, f"you utter fool number {i}" if i % 2 else f"a calm remark number {i}") for i in range(100, 400)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("*", "'x' AS score", "'x' AS held_out", "1 AS toxic", "'x' AS y")
    labels = spark.createDataFrame([(i, i % 2, "x") for i, _ in rows] + [(1, None, "x"), (None, 1, "x"), (5, 1, "x"), (5, 0, "x"), (5, 1, "x")], "doc_id long, toxic int, text string")
    found = score_toxicity(more, labels).toPandas()
    assert list(found.columns) == ["doc_id", "held_out", "score", "predicted"] and len(found) == len(TEXTS) + len(rows)
    assert found[found.doc_id == 5].score.nunique() == 1 and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    assert all(h == (zlib.crc32(("" if math.isnan(i) else str(int(i))).encode()) % 5 == 0) for i, h in zip(found.doc_id, found.held_out))
    assert found[found.doc_id >= 100].groupby(found.doc_id % 2).predicted.mean().tolist() == [0.0, 1.0]
    kept = drop_toxic(more, labels)
    assert kept.columns == more.columns and kept.where("doc_id >= 100").count() == 150


def plain_ftrl(rows, labels, epochs=6, alpha=3.0, beta=1.0, l1=4.0, l2=0.1):
    """Coordinate by coordinate, in dictionaries, over the coordinates of at least two rows."""
    seen = {}
    for r in rows:
        for x in r:
            seen[x] = seen.get(x, 0) + 1
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(x):
        zx = z.get(x, 0.0)
        return 0.0 if abs(zx) <= l1 else -(zx - math.copysign(l1, zx)) / ((beta + math.sqrt(n.get(x, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for r, y in zip(rows, labels):
            own = [x for x in r if seen[x] > 1]
            w = {x: weight(x) for x in own}
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + b)))) - y
            for x in own:
                step = (math.sqrt(n.get(x, 0.0) + g * g) - math.sqrt(n.get(x, 0.0))) / alpha
                z[x], n[x] = z.get(x, 0.0) + g - step * w[x], n.get(x, 0.0) + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b, nb + g * g
    return {x: weight(x) for x in z if weight(x)}, -zb / ((beta + math.sqrt(nb)) / alpha)


def test_ftrl_is_that_of_plain_python():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, 12)).astype("<u4") for _ in range(300)]
    labels = [int(3 in r or (7 in r and rng.random() < 0.8)) for r in rows]
    model = ftrl(rows, labels)
    weights, bias = plain_ftrl([r.tolist() for r in rows], labels)
    assert model.bias == pytest.approx(bias, rel=1e-9) and dict(zip(model.keys.tolist(), model.values.tolist())) == pytest.approx(weights, rel=1e-9)
    assert 0 < len(weights) < 60 and weights[3] == max(weights.values())
