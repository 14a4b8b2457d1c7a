"""Positions in an order, previous rows and running values, also where one key holds much of the data.

A window over a key passes all its rows through one task. Here rows are spread by range over keys and order, so that a key is
as many parts as it needs; windows run within a part, and what each part hands on is put in order in a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.tables import cut


def _placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` written once, with the range (_part) that each is in: ranges follow keys and order, rows that agree in both are
    spread by their other values."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64(*[F.col(c) for c in rows.columns])
    placed = rows.withColumn("_spread", spread).repartitionByRange(n, *keys, *order, "_spread")
    return cut(placed.withColumn("_part", F.spark_partition_id()), "placed")


def _joined(placed: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """`placed` with the columns of a table of one row per part and key (null keys meet)."""
    own = [c for c in small.columns if c not in ("_part", *keys)]
    same = [F.col(f"_placed.{c}").eqNullSafe(F.col(f"_small.{c}")) for c in ("_part", *keys)]
    return placed.alias("_placed").join(small.alias("_small"), same, "left").select("_placed.*", *[F.col(f"_small.{c}") for c in own])


def _within(keys: list[str], order: list[str]):
    return Window.partitionBy("_part", *keys).orderBy(*order, "_spread")


def _across(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_part")


def positioned(rows: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """`rows` with their 1-based position within their key in the given order (ascending columns; ties by a hash of the row)."""
    placed = _placed(rows, keys, order)
    sizes = placed.groupBy("_part", *keys).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.withColumn("_shift", F.coalesce(before, F.lit(0))).drop("_size")
    both = _joined(placed, shift, keys).withColumn(name, F.row_number().over(_within(keys, order)) + F.col("_shift"))
    return both.select(*rows.columns, name)


def _carried(placed: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    at = F.struct(*order, "_spread")
    last = placed.filter(F.col(value).isNotNull()).groupBy("_part", *keys).agg(F.max_by(value, at).alias("_last"))
    parts = placed.select("_part", *keys).distinct()
    known = _joined(parts, last, keys)
    handed = known.withColumn("_handed", F.last("_last", ignorenulls=True).over(_across(keys).rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    local = F.last(value, ignorenulls=True).over(_within(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return _joined(placed, handed, keys).withColumn(name, F.coalesce(local, "_handed")).drop("_handed")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`rows` with the last `value` that is not null before the row in its key (null: none)."""
    return _carried(_placed(rows, keys, order), keys, order, value, name).drop("_part", "_spread")


def sessions(rows: DataFrame, key: str, at: str, tie: str, gap_s: float) -> DataFrame:
    """`rows` with `previous` (the time before in the key) and `session` (1-based; a new one begins after gap_s seconds or
    more without a row). Rows with a null time are left out."""
    x = rows.filter(F.col(at).isNotNull()).withColumn("_s", F.unix_micros(F.col(at).cast("timestamp")))
    order = ["_s", tie]
    x = _carried(_placed(x, [key], order), [key], order, "_s", "_prev")
    x = x.withColumn("_new", (F.col("_prev").isNull() | (F.col("_s") - F.col("_prev") >= F.lit(int(gap_s * 1_000_000)))).cast("int"))
    offset = x.groupBy("_part", key).agg(F.sum("_new").alias("_n"))
    offset = offset.withColumn("_off", F.coalesce(F.sum("_n").over(_across([key]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    running = F.sum("_new").over(_within([key], order).rowsBetween(Window.unboundedPreceding, 0))
    x = _joined(x, offset, [key]).withColumn("session", running + F.col("_off")).withColumn("previous", F.timestamp_micros("_prev"))
    return x.drop("_s", "_prev", "_new", "_off", "_part", "_spread")


def nearest_rank(rows: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Of each key the values at index round((n - 1) q), half to even, one column per quantile. Null values are left out.
    Equal values are counted first, so that they are one row."""
    x = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_k"))
    n = x.groupBy(key).agg(F.sum("_k").alias("_n"))
    placed = _placed(x, [key], [value])
    sizes = placed.groupBy("_part", key).agg(F.sum("_k").alias("_size"))
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(_across([key]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    upto = F.sum("_k").over(_within([key], [value]).rowsBetween(Window.unboundedPreceding, 0))
    at = _joined(placed, shift, [key]).withColumn("_to", upto + F.col("_shift"))
    at = at.alias("_at").join(n.alias("_of"), F.col(f"_at.{key}").eqNullSafe(F.col(f"_of.{key}"))).select("_at.*", "_n")
    place = lambda q: F.bround((F.col("_n") - 1) * F.lit(q)) + 1
    hit: list[Column] = [F.max(F.when((place(q) <= F.col("_to")) & (place(q) > F.col("_to") - F.col("_k")), F.col(value))).alias(name) for name, q in quantiles.items()]
    return at.groupBy(key).agg(*hit)
