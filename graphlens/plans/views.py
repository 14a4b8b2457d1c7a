"""The given tables as graph tables: the code graph as delivered, and a denser graph on the order tables.

SQL texts beside the functions say the same for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.tables import table

KIND = "lower(trim({0}))"


def modules(spark: SparkSession, d: str) -> DataFrame:
    """One row per (repo_id, id)."""
    return table(spark, d, "modules").groupBy("repo_id", "id").agg(F.min("name").alias("name"), F.min("path").alias("path"), F.max("summary").alias("summary"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """The last delivered row per (repo_id, id)."""
    order = [F.col(c).desc_nulls_last() for c in ("loaded_at", "content_hash", "path", "language", "end_line", "summary", "commit_hash")]
    last = Window.partitionBy("repo_id", "id").orderBy(*order)
    return table(spark, d, "files").withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """The last indexed row per (repo_id, id), its type in plain form."""
    order = [F.col(c).desc_nulls_last() for c in ("indexed_at", "summary", "doc", "signature", "type", "visibility", "start_line", "end_line")]
    last = Window.partitionBy("repo_id", "id").orderBy(*order)
    rows = table(spark, d, "symbols").withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return rows.withColumn("type", F.lower(F.trim("type")))


CODE = """
m AS (SELECT repo_id, id, min(name) AS name, min(path) AS path, max(summary) AS summary FROM modules GROUP BY repo_id, id),
f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY repo_id, id ORDER BY loaded_at DESC NULLS LAST, content_hash DESC NULLS LAST,
      path DESC NULLS LAST, language DESC NULLS LAST, end_line DESC NULLS LAST, summary DESC NULLS LAST, commit_hash DESC NULLS LAST) = 1),
s AS (SELECT * REPLACE (lower(trim(type)) AS type) FROM (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY repo_id, id ORDER BY
      indexed_at DESC NULLS LAST, summary DESC NULLS LAST, doc DESC NULLS LAST, signature DESC NULLS LAST, type DESC NULLS LAST,
      visibility DESC NULLS LAST, start_line DESC NULLS LAST, end_line DESC NULLS LAST) = 1))
"""


# -- the graph on the order tables -------------------------------------------------------------------------------------


def g_modules(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.concat(F.lit("M_"), "n_nationkey").alias("id"), F.concat(F.lit("repo_"), "n_regionkey").alias("repo_id"), F.lower("n_name").alias("name"), F.lower("n_name").alias("path"))


def g_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")), F.lit(".py"))
    return c.select(
        F.concat(F.lit("F_"), "c_custkey").alias("id"),
        F.concat(F.lit("M_"), "c_nationkey").alias("module_id"),
        name.alias("name"),
        F.concat(F.lit("nation_"), "c_nationkey", F.lit("/"), name).alias("path"),
    )


def g_symbols(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    verb = F.element_at(F.array(*[F.lit(v) for v in ("get", "find", "create", "update", "delete", "validate")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    name = F.concat(verb, F.lit("_"), (F.col("o_orderkey") % 97).cast("string"))
    start = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.concat(F.lit("S_"), "o_orderkey").alias("id"),
        F.concat(F.lit("F_"), "o_custkey").alias("file_id"),
        F.concat(F.lit("M_"), "c_nationkey").alias("module_id"),
        name.alias("name"),
        F.concat(F.lit("c"), "o_custkey", F.lit("."), name).alias("qualified_name"),
        F.when(F.col("o_orderstatus") == "F", "function").when(F.col("o_orderstatus") == "O", "class").otherwise("method").alias("type"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "private").otherwise("public").alias("visibility"),
        start.alias("start_line"),
        (start + 3 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("end_line"),
    )


def g_relations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") % 5 + 1).alias("kind")).distinct()
    kinds = F.array(*[F.lit(v) for v in ("calls", "depends_on", "references", "inherits", "implements")])
    return li.select(
        F.concat(F.lit("S_"), "l_orderkey").alias("source_id"),
        F.concat(F.lit("S_"), "l_partkey").alias("target_id"),
        F.element_at(kinds, F.col("kind")).alias("relation_type"),
    )


GRAPH = """
gm AS (SELECT 'M_' || n_nationkey AS id, 'repo_' || n_regionkey AS repo_id, lower(n_name) AS name, lower(n_name) AS path FROM nation),
gf AS (SELECT 'F_' || c_custkey AS id, 'M_' || c_nationkey AS module_id, replace(lower(c_name), '#', '_') || '.py' AS name,
       'nation_' || c_nationkey || '/' || replace(lower(c_name), '#', '_') || '.py' AS path FROM customer),
gs0 AS (SELECT *, list_extract(['get', 'find', 'create', 'update', 'delete', 'validate'], (o_orderkey % 6 + 1)::int) || '_' || (o_orderkey % 97) AS nm,
       date_diff('day', date '1995-01-01', o_orderdate::date)::int AS sl FROM orders JOIN customer ON o_custkey = c_custkey),
gs AS (SELECT 'S_' || o_orderkey AS id, 'F_' || o_custkey AS file_id, 'M_' || c_nationkey AS module_id, nm AS name,
       'c' || o_custkey || '.' || nm AS qualified_name,
       CASE o_orderstatus WHEN 'F' THEN 'function' WHEN 'O' THEN 'class' ELSE 'method' END AS type,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'private' ELSE 'public' END AS visibility,
       sl AS start_line, sl + 3 * substr(o_orderpriority, 1, 1)::int AS end_line FROM gs0),
gr AS (SELECT DISTINCT 'S_' || l_orderkey AS source_id, 'S_' || l_partkey AS target_id,
       list_extract(['calls', 'depends_on', 'references', 'inherits', 'implements'], l_linenumber % 5 + 1) AS relation_type FROM lineitem)
"""
