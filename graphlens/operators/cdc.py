"""Incremental builds: what is reused, parsed or gone, and tables kept per repo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_status(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: `reused` (same hash), `parsed` (new or changed; a null hash is a change), `deleted`."""
    p = previous.select(*keys, F.struct("content_hash").alias("_p"))
    c = current.select(*keys, F.struct("content_hash").alias("_c"))
    status = F.when(F.col("_c").isNull(), "deleted").when(F.col("_p.content_hash") == F.col("_c.content_hash"), "reused").otherwise("parsed")
    return p.join(c, keys, "full_outer").select(*keys, status.alias("status"))


def build_stats(status: DataFrame, keys: list[str]) -> DataFrame:
    """keys, parsed, reused, deleted, scanned."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.groupBy(*keys).agg(count("parsed"), count("reused"), count("deleted"), F.count_if(F.col("status") != "deleted").alias("scanned"))


def stale_ids(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of objects that were there and are not any more."""
    return previous.select(*keys).distinct().join(current.select(*keys), keys, "left_anti")


def paths_to_build(previous: DataFrame, scanned: DataFrame, deleted: DataFrame) -> DataFrame:
    """Paths of a build that scanned only what changed: earlier and scanned ones without deleted ones."""
    return previous.select("path").unionByName(scanned.select("path")).distinct().join(deleted.select("path"), "path", "left_anti")


def replace_repo(df: DataFrame, path: str) -> None:
    """Writes rows so that they replace those of the repos they belong to and leave other repos alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `stored` whose key `new` does not hold, and of `new` the greatest row of each key (columns in order)."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(one, allowMissingColumns=True)


def with_ids(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids as the graph builds them: files F_<stem>_<hash of path>, symbols S_<module>.<name>_<hash of path:name>."""
    from graphlens.functions import text as X

    f = files.withColumn("id", X.file_id(F.col("path"))).withColumn("module_id", F.concat(F.lit("M_"), F.element_at(F.split("path", "/"), 1)))
    q = F.col("qualified_name")
    s = symbols.withColumn("id", F.concat(F.lit("S_"), F.element_at(F.split("path", "/"), 1), F.lit("."), F.replace(q, F.lit("/"), F.lit(".")), F.lit("_"), X.sha8(F.concat("path", F.lit(":"), q))))
    return f, s
