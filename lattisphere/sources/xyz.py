"""Molecules from XYZ text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATOM = T.StructType([T.StructField("species", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in "xyz"]])


def parse(text: str) -> list[dict]:
    """Atoms of one XYZ frame: a count, a comment, then a symbol and three numbers a line."""
    lines = text.splitlines()
    rows = [line.split() for line in lines[2 : 2 + int(lines[0])]]
    return [{"species": r[0], "x": float(r[1]), "y": float(r[2]), "z": float(r[3])} for r in rows]


def atoms(text: Column) -> Column:
    """array<struct<species, x, y, z>>; null where the text can't be read."""

    @F.arrow_udf(T.ArrayType(_ATOM))
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(parse(t))
            except (AttributeError, IndexError, ValueError):
                out.append(None)
        return pa.array(out, pa.list_(pa.struct([("species", pa.string()), *[(c, pa.float64()) for c in "xyz"]])))

    return run(text)


def molecules(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(structure_id, site_i, species, x, y, z) from a column of XYZ text."""
    each = rows.select(F.col(key).alias("structure_id"), F.posexplode(atoms(F.col(text))).alias("site_i", "a"))
    return each.select("structure_id", "site_i", "a.*", F.lit(None).cast("double").alias("oxi"))


def unboxed(sites: DataFrame) -> DataFrame:
    """structures of molecules without a cell: an identity lattice and no periodic axis."""
    unit = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    return sites.groupBy("structure_id").agg(F.count("*").cast("int").alias("n_sites")).select("structure_id", unit.alias("lattice"), F.array(*[F.lit(False)] * 3).alias("pbc"), "n_sites")
