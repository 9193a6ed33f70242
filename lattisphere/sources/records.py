"""Datasets of JSON records that hold a structure as CIF text beside their other fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import stored
from . import cif


def read(spark: SparkSession, path: str, text: str = "structure", lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(structures, sites, records): records are the other fields by structure_id.

    path: files of JSON arrays, or with `lines` of one record a line. structure_id is a hash of the text:
    equal texts are one structure with several records.
    """
    rows = spark.read.json(path, multiLine=not lines)
    rows = stored(rows.withColumn("structure_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), "records")
    structures, sites = cif.tables(rows.select("structure_id", text).dropDuplicates(["structure_id"]), "structure_id", text)
    return structures, sites, rows.drop(text)
