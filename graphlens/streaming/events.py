"""Structured Streaming over the event table: windowed counters with a watermark, and a keyed rate limiter."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.tables import shared_dir


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """The files at `path` (a file or a folder) as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("at", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, mode: str, schema: str) -> DataFrame:
    """Runs a stream over what is there to its end; every batch is written to a table in the shared folder."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema + ", _batch long").parquet(f"{at}/out")


def daily_counters(spark: SparkSession, path: str, late: str = "2 days") -> DataFrame:
    """day, event_type, n. Counts per day, kept until the watermark passes; each batch emits what changed, the last wins."""
    counted = _stream(spark, path).withWatermark("at", late).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    out = _run(counted.select(F.col("window.start").alias("day"), "event_type", "n"), "update", "day timestamp, event_type string, n long")
    last = out.groupBy("day", "event_type").agg(F.max_by("n", "_batch").alias("n"))
    return last.withColumn("day", F.col("day").cast("timestamp_ntz"))


def limited(spark: SparkSession, path: str, limit: int, window_s: int) -> DataFrame:
    """user_id, windows, accepted, rejected: fixed windows that begin with a key's first request; the state of a key is the
    begin of its window, the requests in it, and its totals."""

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begin, n, windows, accepted, rejected = state.get if state.exists else (-1, 0, 0, 0, 0)
        times = sorted(t for b in batches for t in b["us"])
        for t in times:
            if windows == 0 or t >= begin + window_s * 1_000_000:
                begin, n, windows = t, 0, windows + 1
            n += 1
            accepted, rejected = accepted + (n <= limit), rejected + (n > limit)
        state.update((int(begin), int(n), int(windows), int(accepted), int(rejected)))
        yield pd.DataFrame({"user_id": [key[0]], "windows": [windows], "accepted": [accepted], "rejected": [rejected]})

    schema = "user_id long, windows long, accepted long, rejected long"
    rows = _stream(spark, path).select("user_id", F.unix_micros("at").alias("us"))
    told = rows.groupBy("user_id").applyInPandasWithState(update, schema, "begin long, n long, windows long, accepted long, rejected long", "update", "NoTimeout")
    out = _run(told, "update", schema)
    return out.groupBy("user_id").agg(F.max(F.struct("_batch", "windows", "accepted", "rejected")).alias("m")).select("user_id", "m.windows", "m.accepted", "m.rejected")
