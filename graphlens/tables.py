"""Reading the given tables, and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REPOS = "repo_id string, repo_path string, branch string, commit_hash string, scan_time timestamp"
MODULES = "repo_id string, id string, name string, path string, summary string, metadata map<string,string>"
FILES = (
    "repo_id string, id string, name string, path string, module_id string, summary string, content_hash string, "
    "language string, start_line int, end_line int, commit_hash string, loaded_at timestamp"
)
SYMBOLS = (
    "repo_id string, id string, name string, qualified_name string, type string, signature string, file_id string, "
    "module_id string, summary string, start_line int, end_line int, visibility string, doc string, indexed_at timestamp"
)
RELATIONS = (
    "repo_id string, id string, relation_type string, source_id string, target_id string, source_type string, "
    "target_type string, source_module_id string, target_module_id string, summary string"
)
SPANS = (
    "repo_id string, file_path string, line_start int, line_end int, module_id string, file_id string, "
    "symbol_id string, node_type string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session whose master is local (tests) may name none, and
    gets a temporary one; on a cluster that would be another folder on each machine, so that it raises there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-graphlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that cut() wrote in this process.
_CUTS: list[str] = []


def forget_cuts(spark: SparkSession) -> int:
    """Deletes what cut() wrote in this process, and says how many folders these were. To be called once the results that
    read them are written: what was cut is read lazily, so that no earlier moment is safe."""
    n = 0
    while _CUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` written once to the shared folder and read back: no later stage recomputes it, and a lost executor
    costs only a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts a model of bounded size; the result, called in a worker, gives it back (classes travel by value)."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def missing_tables(spark: SparkSession, required: list[str]) -> DataFrame:
    """Names in `required` that the catalog does not list (readiness check), sorted."""
    have = [t.name for t in spark.catalog.listTables()]
    return spark.createDataFrame([(n,) for n in sorted(set(required) - set(have))], T.StructType([T.StructField("table_name", T.StringType())]))
