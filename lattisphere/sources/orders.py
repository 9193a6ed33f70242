"""Crystals derived from order tables: an order is a crystal, its line items are sites of a cubic cell of edge 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGE_LENGTH = 10.0


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "structure_id")  # before the shuffle, so that later ones by it are dropped
    order = Window.partitionBy("structure_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return items.select(
        "structure_id",
        (F.row_number().over(order) - 1).alias("site_i"),
        F.concat("l_returnflag", "l_linestatus").alias("species"),
        (EDGE_LENGTH * (F.col("l_quantity") / 51)).alias("x"),
        (EDGE_LENGTH * (F.col("l_discount") * 9)).alias("y"),
        (EDGE_LENGTH * (F.col("l_tax") * 11)).alias("z"),
        F.lit(None).cast("double").alias("oxi"),
    )


def structures(of: DataFrame) -> DataFrame:
    """One cubic cell for each structure of a sites table."""
    cell = F.array(*[F.array(*[F.lit(EDGE_LENGTH if i == j else 0.0) for j in range(3)]) for i in range(3)])
    return of.groupBy("structure_id").agg(F.count("*").cast("int").alias("n_sites")).select("structure_id", cell.alias("lattice"), F.array(*[F.lit(True)] * 3).alias("pbc"), "n_sites")
