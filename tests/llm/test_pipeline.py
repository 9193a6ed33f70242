"""The pipeline, stage by stage and whole, against plain Python over the same rows."""

import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402

from lattisphere.llm.secrets import KINDS, find_secrets, ordinary_statistics  # noqa: E402
from lattisphere.llm.toxicity import fit  # noqa: E402

from .test_queries import TEXTS, brute_components, sf  # noqa: E402, F401
from .test_secrets import weighted_bh  # noqa: E402


def redacted(text, limit):
    if not text:
        return text
    out, at = "", 0
    for start, end, kind in find_secrets(text, limit, ordinary_statistics()):
        if start >= at:
            out += text[at:start] + f"[{KINDS[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def expected(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    clean = {i: t for i, t in enumerate(TEXTS) if model.score(t) < 0.5}
    found = brute_components(clean)
    return clean, {i: t for i, t in clean.items() if found[i][1] == i}


def test_stages(spark, sf):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet").drop("spans")
    clean, kept = expected(spark, sf)
    steps = dict(C.STAGES)
    one = steps["toxicity"](spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == set(clean) and one.columns == docs.columns
    two = steps["n-gram join"](spark, one, sf)
    assert {r.doc_id: r.text for r in two.collect()} == kept and sorted(two.columns) == sorted(docs.columns)
    three = steps["secrets"](spark, two, sf)
    texts = {r.doc_id: (r.text, r.n_chars) for r in three.collect()}
    limit = weighted_bh(kept.values())
    assert texts == {i: (redacted(t, limit), None if t is None else len(redacted(t, limit))) for i, t in kept.items()}
    assert sorted(three.columns) == sorted(docs.columns) and "[HEX]" in texts[4][0] and "[RANDOM]" in texts[5][0]


def test_run(spark, sf):  # noqa: F811
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    _, kept = expected(spark, sf)
    rows = C.run(spark, sf).toPandas()
    assert set(rows.doc_id) == set(kept)
    limit = weighted_bh(kept.values())
    for i, text in kept.items():
        ids = np.array([*reader.encode(redacted(text, limit) or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert list(group.offset) == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 2048
