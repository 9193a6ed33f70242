"""Session settings and tables that cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def tuned(spark: SparkSession) -> SparkSession:
    """Let joins on (structure_id, ...) reuse a partitioning by structure_id alone, so a whole plan shuffles once."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, `spark.checkpoint.dir`.

    Where none is named, a temporary one serves a session whose driver is its only executor; on a cluster that is an error,
    as executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lattisphere-")
        found = _own[app]
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the folder's owner then clears it
        pass


@atexit.register
def release_tables() -> None:
    """Delete the tables that `stored` wrote; call it once the results that read them are kept elsewhere."""
    while _written:
        _delete(*_written.pop())


def stored(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    A lost executor then costs at most a reread, never the stages before. codec: how Parquet compresses, the session's if None.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattisphere-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str = "structure_id") -> DataFrame:
    """df dealt by key over at least all cores, for rows that are few in bytes but long to work on: adaptive execution
    would put them into one task. Dealt by a hash of the key, as a repartition by the key itself is dropped where a join has
    already dealt by it."""
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(width, F.xxhash64(key))
