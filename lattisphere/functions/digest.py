"""Digests and string folds. BLAKE2b is no built-in, so it is an Arrow function; md5 stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b, md5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blake(text: str, size: int = 64) -> str:
    return blake2b(text.encode(), digest_size=size).hexdigest()


def md5_text(text: str, size: int = 16) -> str:
    """As `blake`, for engines that lack BLAKE2b; the size is always 16 bytes."""
    return md5(text.encode()).hexdigest()


#: name -> digest of a text and a size.
TEXT_HASHES: dict[str, Callable[..., str]] = {"blake2b": blake, "md5": md5_text}


def blake2b_hex(text: Column, size: int = 64) -> Column:
    """Lowercase hex of BLAKE2b with a digest of `size` bytes; null stays null."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else blake(t, size) for t in texts.to_pylist()], pa.string())

    return run(text)


def fold_blake(levels: Column) -> Column:
    """h <- blake(h + "-" + level) over an array, from h = ""."""

    @F.arrow_udf(T.StringType())
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            h = ""
            for level in row or ():
                h = blake(f"{h}-{level}")
            out.append(None if row is None else h)
        return pa.array(out, pa.string())

    return run(levels)


def fold_md5(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(""), lambda h, s: F.md5(F.concat(h, F.lit("-"), s).cast("binary")))


#: name -> (digest of a string column, fold of levels)
HASHES = {
    "blake2b": (blake2b_hex, fold_blake),
    "md5": (lambda c, size=16: F.md5(c.cast("binary")), fold_md5),
}


def joined_sorted(values: Column, by: str) -> Column:
    return F.array_join(F.array_sort(values), by)


def gcd_of(counts: Column) -> Column:
    """Greatest common divisor of an array of positive numbers, by Euclid's steps over a bounded sequence."""

    def step(a: Column, b: Column) -> Column:
        pair = F.struct(a.alias("p"), b.alias("q"))
        run = F.aggregate(F.sequence(F.lit(1), F.lit(48)), pair, lambda s, _: F.when(s["q"] == 0, s).otherwise(F.struct(s["q"].alias("p"), F.pmod(s["p"], F.when(s["q"] == 0, F.lit(1)).otherwise(s["q"])).alias("q"))))
        return run["p"]

    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda g, n: step(n.cast("bigint"), g))
