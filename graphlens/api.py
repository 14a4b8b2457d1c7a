"""Entry points: index a source tree, answer questions, plan and review documents, read metrics. Each composes operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import cdc, docs, rank, resolve, retrieve, review, state
from graphlens.operators.lookup import objects
from graphlens.sources.extract import extract
from graphlens.sources.scan import scan_tree
from graphlens.tables import cut


def index(spark: SparkSession, root: str, repo_id: str, previous: DataFrame | None = None, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """modules, files, symbols, relations, spans, rows and, against `previous` files (path, content_hash), the build's status.

    With the `rows` of the build that `previous` came from, only new and changed files are parsed; rows of unchanged ones are
    taken over. Files and symbols get ids from their paths and names; ends of relations are resolved within their file, then
    among exports and all symbols, with a file's import aliases, and numbered."""
    tree = cut(scan_tree(spark, root).withColumn("repo_id", F.lit(repo_id)), "index-files")
    status = cut(cdc.file_status(previous, tree, ["path"]), "index-status") if previous is not None else None
    to_parse = tree
    if status is not None and rows is not None:
        to_parse = tree.join(status.filter("status = 'parsed'").select("path"), "path", "left_semi")
    raw = extract(to_parse.select("repo_id", F.col("path").alias("file_id"), "path", "content"))
    if status is not None and rows is not None:
        raw = raw.unionByName(rows.join(status.filter("status = 'reused'").select(F.col("path").alias("file_id")), "file_id", "left_semi"))
    raw = cut(raw, "index-rows")
    files, symbols = cdc.with_ids(tree.drop("content"), raw.filter("part = 'symbol'").withColumnRenamed("file_id", "path"))
    symbols = symbols.join(files.select("path", F.col("id").alias("file_id"), "module_id"), "path").drop("part", "target")
    modules = files.select("repo_id", F.col("module_id").alias("id"), F.element_at(F.split("path", "/"), 1).alias("name")).distinct().withColumn("path", F.col("name"))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    own = symbols.select(F.col("repo_id").alias("scope"), "id", "name", "qualified_name", "file_id", "path")
    keys = resolve.unique_keys(resolve.symbol_keys(own.drop("path"), files.select(F.col("repo_id").alias("scope"), "id", "path")))
    local = resolve.local_keys(own.drop("file_id").withColumnRenamed("path", "file_id"))
    exports = raw.filter("part = 'relation' and type = 'exports'").select(F.col("repo_id").alias("scope"), "file_id", F.col("file_id").alias("path"), F.col("target").alias("export"), F.col("qualified_name").alias("raw_id"))
    keys = resolve.with_exports(keys, resolve.export_keys(exports, keys, local, own))
    aliases = raw.filter("part = 'alias'").groupBy("file_id", "name").agg(F.max("target").alias("target"))
    aliases = aliases.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "target"))).alias("aliases"))
    rel = raw.filter("part = 'relation' and type <> 'exports' and qualified_name is not null").join(aliases, "file_id", "left")
    rel = rel.select(F.col("repo_id").alias("scope"), "file_id", "qualified_name", F.col("type").alias("relation_type"), "start_line", F.col("target").alias("raw_id"), resolve.imported_name(F.col("target"), F.coalesce("aliases", F.create_map().cast("map<string,string>"))).alias("imported"))
    ends = resolve.resolve(rel, keys, local).withColumnRenamed("object_id", "target_id").drop("raw_id", "imported")
    sources = symbols.groupBy(F.col("path").alias("file_id"), "qualified_name").agg(F.min("id").alias("source_id"))
    relations = resolve.renumbered(ends.join(sources, ["file_id", "qualified_name"]).withColumnRenamed("scope", "repo_id"), ["file_id", "start_line", "source_id", "target_id"])
    spans = symbols.select("repo_id", F.col("path").alias("file_path"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), "module_id", "file_id", F.col("id").alias("symbol_id"), F.col("type").alias("node_type"))
    whole = files.select("repo_id", F.col("path").alias("file_path"), F.lit(1).alias("line_start"), F.col("n_lines").alias("line_end"), "module_id", F.col("id").alias("file_id"), F.lit(None).cast("string").alias("symbol_id"), F.lit("file").alias("node_type"))
    out = {"modules": modules, "files": files, "symbols": symbols, "relations": relations, "spans": spans.unionByName(whole), "rows": raw}
    if status is not None:
        out["status"] = status
    return out


def located(graph: dict[str, DataFrame]) -> DataFrame:
    """id, kind, name, other, type, file_id, module_id of all objects of a graph."""
    return objects(graph["modules"], graph["files"], graph["symbols"]).drop("repo_id").dropDuplicates(["id", "kind"])


def ranked_objects(graph: dict[str, DataFrame], questions: DataFrame, hits: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """seed, id, kind, distance, file_id, module_id, rank, score: the best objects for questions (seed, question, level, id,
    confidence) by structure, vector hits (seed, id, kind, similarity), names, types and memory (seed, id)."""
    recalled = retrieve.hybrid(retrieve.structured_recall(questions, graph["modules"], graph["files"], graph["symbols"], graph["relations"]), hits)
    return rank.ranked(retrieve.fused_candidates(recalled, located(graph), questions, memory))


def ask(graph: dict[str, DataFrame], questions: DataFrame, hits: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """Metrics, strategy and answer mode of each question; see ranked_objects and retrieve.answered."""
    return retrieve.answered(cut(ranked_objects(graph, questions, hits, memory), "ranked"), questions)


def answer(graph: dict[str, DataFrame], questions: DataFrame, hits: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """The objects that each question is answered from, after its strategy was carried out; see retrieve.executed."""
    ranked = cut(ranked_objects(graph, questions, hits, memory), "ranked")
    routed = cut(retrieve.answered(ranked, questions).select("seed", "strategy"), "routed")
    return retrieve.executed(ranked, routed, questions, graph, located(graph), memory)


def plan(modules: DataFrame, files: DataFrame, symbols: DataFrame, cross: DataFrame) -> DataFrame:
    """The first SECTION_CAP sections of each repo's document."""
    return docs.capped(docs.skeleton(modules, files, symbols, cross))


def reviewed(planned: DataFrame, generated: DataFrame) -> DataFrame:
    """Issues of generated sections (repo_id, section_id) against their plan."""
    return review.missing_sections(planned, generated, ["repo_id", "section_id"])


def metrics_snapshot(counters: DataFrame, values: DataFrame) -> DataFrame:
    """kind, name, stat, value of all counters (name, value) and histograms (name, value)."""
    c = counters.groupBy("name").agg(F.sum("value").cast("double").alias("value")).select(F.lit("counter").alias("kind"), "name", F.lit("sum").alias("stat"), "value")
    h = state.histogram_stats(values, "name", "value")
    stats = ["min", "max", "avg", "count", "p50", "p99"]
    return c.unionByName(h.select(F.lit("histogram").alias("kind"), "name", F.explode(F.create_map(*[x for s in stats for x in (F.lit(s), F.col(s).cast("double"))])).alias("stat", "value")))

