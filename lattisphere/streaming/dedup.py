"""Keep-first deduplication of identifiers on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_seen(ids: DataFrame, time: str, key: str = "graph_id", late: str = "1 hour") -> DataFrame:
    """The first row of each id within the watermark; state older than that is dropped."""
    return ids.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def into_table(ids: DataFrame, path: str, checkpoint: str, key: str = "graph_id"):
    """Append ids that the Parquet table at path lacks, batch by batch. Returns the running query."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        new.join(batch.sparkSession.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns).write.mode("append").parquet(path)

    return ids.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
