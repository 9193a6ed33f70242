"""Where results go: CSV, Parquet, the console, and tables whose key stays unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def show(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def cached(df: DataFrame, path: str) -> DataFrame:
    """df from its Parquet cache at path, which is written if it is not there."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        df.write.parquet(path)
    return spark.read.parquet(path)


def absent(new: DataFrame, existing: DataFrame, key: str = "graph_id", order: str = "structure_id") -> DataFrame:
    """The rows of `new` to insert: keys that `existing` lacks, the first row of each by `order`."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("row")).select("row.*")
    return first.join(existing.select(key), key, "left_anti").select(*new.columns)


def insert_if_absent(new: DataFrame, path: str, key: str = "graph_id", order: str = "structure_id") -> None:
    """Append to the Parquet table at path what it lacks."""
    spark: SparkSession = new.sparkSession
    absent(new, spark.read.parquet(path), key, order).write.mode("append").parquet(path)
