"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct 30-bit hashes of its words, of neighbouring words, and of words with one word
between them. Training runs FTRL-proximal over at most MAX_ROWS labelled rows: each coordinate has its own rate from
its own gradients, and L1 keeps all but a few thousand weights at exactly 0. What is left, sorted coordinates and
weights, is broadcast; scoring covers every word of every text.

Defined results: null or empty text has no features and gets the bias alone. A doc_id with several labels counts as
toxic if at least half of them are; null labels are left out. A null doc_id hashes as the empty text. Without any label,
all scores are 0.5 or below it: the bias is 0 and predicted is 1 by the rule "score >= 0.5", so `fit` then uses a bias of
-1. Repeated rows get equal scores. Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Bounded

#: The documented bound of the labelled sample, in rows. Beyond it, rows are taken by the hash of doc_id.
MAX_ROWS = 6_000
_WORD = re.compile(r"\w+")
_MASK = (1 << 30) - 1


@lru_cache(1)
def _hashes() -> Bounded:
    return Bounded(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")), 100_000, "toxicity")


def features(text: str | None) -> np.ndarray:
    """30-bit hashes of the words, word pairs and skip pairs of a text, repeats included."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(0x27D4EB2F165667C5)
    one = h * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([one, pair, skip]) >> np.uint64(33)).astype(np.int64) & _MASK


@dataclass
class Weights:
    """A fitted model: sorted coordinates with a weight other than 0, the weights, the bias."""

    keys: np.ndarray
    values: np.ndarray
    bias: float

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)  # by the low bits: rules out nearly all other coordinates
        self.seen[self.keys & 0xFFFFF] = True

    def score(self, text: str | None) -> float:
        found = features(text)
        found = np.unique(found[self.seen[found & 0xFFFFF]])
        total = self.bias
        if len(found) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            total += float(self.values[at[self.keys[at] == found]].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def compacted(rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The coordinates that at least two rows have (L1 would hold any other at 0), and the rows as places in them."""
    every = np.sort(np.concatenate(rows))
    keys = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    out = []
    for r in rows:
        at = np.searchsorted(keys, r)
        at[at == len(keys)] = 0
        out.append(at[keys[at] == r].astype(np.int32) if len(keys) else at[:0].astype(np.int32))
    return keys, out


def ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = 6, alpha: float = 3.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1) -> Weights:
    """FTRL-proximal over sparse rows of distinct coordinates, in the given order."""
    if not rows:
        return Weights(np.zeros(0, np.int64), np.zeros(0), -1.0)
    keys, split = compacted(rows)
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    zb = nb = 0.0
    for _ in range(epochs):
        for x, y in zip(split, labels):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            b = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.flatnonzero(w)
    return Weights(keys[kept].astype(np.int64), w[kept], -zb / ((beta + nb**0.5) / alpha))


def held_out(key: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the key as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Weights:
    """Learn from the labelled rows that are not held out, at most max_rows of them."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    rows = known.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    taken = known.where(place < int(min(1.0, 0.97 * max_rows / max(1, rows)) * (1 << 30)) if rows > max_rows else F.lit(True))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.unique(features(t)).astype("<u4").tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], b["y"], pa.array(out, pa.binary())], names=["key", "y", "x"])

    # broadcast: at most max_rows pairs of numbers
    sample = docs.select(F.col(key), F.col(text)).join(F.broadcast(taken), key).select(F.col(key).cast("string").alias("key"), F.col("__y").alias("y"), F.col(text).alias("text"))
    found = sample.mapInArrow(hashed, "key string, y int, x binary").toArrow()
    keys = found["key"].to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (zlib.crc32(keys[i].encode()), keys[i], len(found["x"][i].as_buffer())))[:max_rows]
    return ftrl([np.frombuffer(found["x"][i].as_buffer(), "<u4") for i in order], [found["y"][i].as_py() for i in order])


def toxicity(text: Column, model: Weights) -> Column:
    """double: the score of a text column under a fitted model, whose sparse weights go to each executor once."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast((model.keys, model.values, model.bias))
    own: list[Weights] = []

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        if not own:
            own.append(Weights(*shared.value))
        return pa.array([own[0].score(t) for t in texts.to_pylist()], pa.float64())

    return run(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs."""
    model = fit(docs, labels, max_rows, key, text)
    out = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), toxicity(F.col(text), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns."""
    model = fit(docs, labels, max_rows, key, text)
    return docs.where(toxicity(F.col(text), model) < 0.5)
