"""Deliveries of files as a stream: each batch is merged into the table of current files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.lookup import first_of
from graphlens.operators.snapshots import plain_hash, plain_path

KEYS = ["repo_id", "path"]


def current_files(deliveries: DataFrame) -> DataFrame:
    """repo_id, path, content_hash, loaded_at: the last delivered row of each path (ties: greater hash)."""
    rows = deliveries.select("repo_id", plain_path(F.col("path")).alias("path"), plain_hash(F.col("content_hash")).alias("content_hash"), "loaded_at").filter("path is not null")
    return first_of(rows, KEYS, [F.col("loaded_at").desc_nulls_last(), F.col("content_hash").desc_nulls_last()])


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 16) -> None:
    """Reads what `source` holds, in batches, and keeps `target` (one folder per version) at the current files.

    A batch writes version n + 1 from version n and its own rows; a batch that is run again after a failure writes the same version."""

    def merge(batch: DataFrame, n: int) -> None:
        new = current_files(batch)
        if n:
            new = first_of(spark.read.parquet(f"{target}/v={n - 1}").unionByName(new), KEYS, [F.col("loaded_at").desc_nulls_last(), F.col("content_hash").desc_nulls_last()])
        new.write.mode("overwrite").parquet(f"{target}/v={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
