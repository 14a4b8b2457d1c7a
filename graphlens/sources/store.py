"""Tables that are kept between runs: per-repo replacement, upserts, documents, summaries, and files for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.lookup import first_of

#: Tables that hold a summary, by kind of object.
SUMMARY_TABLES = {"module": "modules", "file": "files", "symbol": "symbols", "relation": "relations"}


def append_documents(documents: DataFrame, path: str) -> None:
    """Adds generated documents (document_id, repo_id, title, document_json, generated_at); nothing is replaced."""
    documents.write.mode("append").parquet(path)


def latest_documents(spark: SparkSession, path: str) -> DataFrame:
    """Of each repo the document that was generated last (ties: greater id)."""
    return first_of(spark.read.parquet(path), ["repo_id"], [F.col("generated_at").desc_nulls_last(), F.col("document_id").desc()])


def summaries(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """repo_id, id, summary of one kind of object; raises for an unknown kind."""
    if kind not in SUMMARY_TABLES:
        raise ValueError(f"unknown object type {kind}")
    return tables[SUMMARY_TABLES[kind]].select("repo_id", "id", "summary")


def with_summaries(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Objects with new summaries (repo_id, id, summary) where there are some."""
    n = new.select("repo_id", "id", F.col("summary").alias("_s")).dropDuplicates(["repo_id", "id"])
    columns = objects.columns
    return objects.join(n, ["repo_id", "id"], "left").withColumn("summary", F.coalesce("_s", "summary")).select(*columns)


def markdown(sections: DataFrame) -> DataFrame:
    """document_id, text: the sections (document_id, position, content) of each document in order, a blank line between them."""
    lists = sections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("l"))
    return lists.select("document_id", F.concat(F.array_join(F.transform("l", lambda x: F.rtrim(F.coalesce(x["content"], F.lit("")))), "\n\n"), F.lit("\n")).alias("text"))


def write_markdown(sections: DataFrame, path: str) -> None:
    """One folder per document with its text."""
    markdown(sections).write.mode("overwrite").partitionBy("document_id").text(path)
