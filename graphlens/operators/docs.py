"""Plans of design documents, what each section is made from, prompts within a budget, and generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.operators.lookup import first_of

FILES_PER_MODULE, SYMBOLS_PER_TARGET, RELATIONS_PER_SECTION = 3, 8, 10


def api_symbol() -> Column:
    """Whether a symbol (type, qualified_name) belongs to an interface to the outside."""
    return F.lower("type").isin(*C.API_TYPES) | F.lower("qualified_name").rlike("|".join(C.API_TYPES))


def skeleton(modules: DataFrame, files: DataFrame, symbols: DataFrame, cross: DataFrame) -> DataFrame:
    """repo_id, position, section_id, title, level, section_type: the sections of each repo's design document.

    overview, architecture, every module with its three files of most symbols (a summary counts as one more), a dependency
    section where `cross` (repo_id) has an edge between modules, an api section where there are such symbols, summary.
    modules: repo_id, id, name; files: repo_id, module_id, id, name, path, summary."""
    repos = modules.select("repo_id").distinct()
    fixed = lambda df, place, name, kind: df.select("repo_id", F.lit(place).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"), F.lit(name).alias("section_id"), F.lit(name).alias("title"), F.lit(1).alias("level"), F.lit(kind).alias("section_type"))
    n = symbols.groupBy("repo_id", F.col("file_id").alias("id")).agg(F.count("*").alias("_n"))
    weight = F.coalesce("_n", F.lit(0)) + F.when(F.coalesce(F.length("summary"), F.lit(0)) > 0, 1).otherwise(0)
    best = first_of(files.join(n, ["repo_id", "id"], "left").withColumn("_w", weight), ["repo_id", "module_id"], [F.col("_w").desc(), "path", "id"], FILES_PER_MODULE, "_k")
    best = best.join(modules.select("repo_id", F.col("id").alias("module_id")), ["repo_id", "module_id"], "left_semi")
    parts = [
        fixed(repos, 0, "overview", "overview"),
        fixed(repos, 1, "architecture", "architecture"),
        modules.select("repo_id", F.lit(2).alias("a"), F.col("id").alias("b"), F.lit(0).alias("c"), F.concat(F.lit("module-"), "id").alias("section_id"), F.col("name").alias("title"), F.lit(2).alias("level"), F.lit("module").alias("section_type")),
        best.select("repo_id", F.lit(2).alias("a"), F.col("module_id").alias("b"), F.col("_k").alias("c"), F.concat(F.lit("file-"), "id").alias("section_id"), F.col("name").alias("title"), F.lit(3).alias("level"), F.lit("module").alias("section_type")),
        fixed(cross.select("repo_id").distinct().join(repos, "repo_id", "left_semi"), 3, "dependency-analysis", "dependency"),
        fixed(symbols.filter(api_symbol()).select("repo_id").distinct().join(repos, "repo_id", "left_semi"), 4, "api", "api"),
        fixed(repos, 5, "summary", "summary"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = Window.partitionBy("repo_id").orderBy("a", "b", "c", "section_id")
    return rows.withColumn("position", F.row_number().over(order)).drop("a", "b", "c")


def capped(sections: DataFrame, cap: int = C.SECTION_CAP) -> DataFrame:
    return sections.filter(F.col("position") <= cap)


def module_recall(modules: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """module_id, id, kind, distance: what a module's section is made from: itself, its files, its first symbols by qualified name."""
    few = first_of(symbols, ["module_id"], ["qualified_name", "id"], SYMBOLS_PER_TARGET)
    return (
        modules.select(F.col("id").alias("module_id"), "id", F.lit("module").alias("kind"), F.lit(0).alias("distance"))
        .unionByName(files.select("module_id", "id", F.lit("file").alias("kind"), F.lit(1).alias("distance")))
        .unionByName(few.select("module_id", "id", F.lit("symbol").alias("kind"), F.lit(2).alias("distance")))
    )


def file_recall(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, id, kind, distance: a file, its module, and its first symbols by line."""
    few = first_of(symbols, ["file_id"], ["start_line", "qualified_name", "id"], SYMBOLS_PER_TARGET)
    return (
        files.select(F.col("id").alias("file_id"), "id", F.lit("file").alias("kind"), F.lit(0).alias("distance"))
        .unionByName(files.select(F.col("id").alias("file_id"), F.col("module_id").alias("id"), F.lit("module").alias("kind"), F.lit(1).alias("distance")))
        .unionByName(few.select("file_id", "id", F.lit("symbol").alias("kind"), F.lit(1).alias("distance")))
    )


def api_recall(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """id, distance: interface symbols (0) and what a call or dependency joins to them (1)."""
    from graphlens.operators.lookup import directed

    api = symbols.filter(api_symbol()).select("id").distinct()
    near = directed(relations.filter(F.lower("relation_type").isin("calls", "depends_on"))).join(api, "id").select(F.col("other").alias("id")).distinct().join(symbols.select("id"), "id", "left_semi")
    return api.withColumn("distance", F.lit(0)).unionByName(near.withColumn("distance", F.lit(1))).groupBy("id").agg(F.min("distance").alias("distance"))


def budget_prefix(lines: DataFrame, budget: int = C.PROMPT_BUDGET, fixed: int = 0) -> DataFrame:
    """Of each prompt (seed) the lines that fit: relations are dropped from the end first, then objects.

    lines: seed, part (0 objects, 1 relations), rank, line. A token is two characters; `fixed` characters are always there; every
    line takes a line end. Once a line does not fit, none after it is kept."""
    room = 2 * budget + 1 - fixed
    used = F.sum(F.length("line") + 1).over(Window.partitionBy("seed").orderBy("part", "rank").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).filter(F.col("used") <= room)


def section_confidence(scored: DataFrame) -> DataFrame:
    """seed, confidence: mean of the three best scores (of fewer where there are fewer), 4 digits."""
    best = first_of(scored, ["seed"], [F.col("score").desc(), "id"], 3)
    return best.groupBy("seed").agg(F.round(F.avg(F.col("score").cast("decimal(12,4)")).cast("double"), 4).alias("confidence"))


def with_heading(text: Column, title: Column, level: Column) -> Column:
    """A section's text that begins with a heading of its level; CRLF becomes LF; a text that has one is given the right level."""
    body = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")))
    mark = F.repeat(F.lit("#"), level)
    plain = F.concat(mark, F.lit(" "), title, F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(F.lit("")))
    return F.when(body.startswith("#"), F.concat(mark, F.regexp_replace(body, r"^#+", ""))).otherwise(plain)


def with_banner(text: Column, confidence: Column) -> Column:
    """A text that stands on little says so in its first line."""
    return F.when(confidence < C.LOW_CONFIDENCE, F.concat(F.lit("> Low confidence: little evidence was found for this section.\n\n"), text)).otherwise(text)


def section_text(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """seed, content: the deterministic text of a section: how many objects and relations it has, the first of them, and the kinds
    of relation. objects: seed, rank, name; relations: seed, relation_type."""
    first = objects.filter(F.col("rank") <= 5).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("l"))
    n = objects.groupBy("seed").agg(F.count("*").alias("n"))
    r = relations.groupBy("seed").agg(F.count("*").alias("m"), F.array_join(F.array_sort(F.collect_set("relation_type")), ", ").alias("kinds"))
    both = n.join(first, "seed", "left").join(r, "seed", "left")
    names = F.array_join(F.transform("l", lambda x: F.concat(F.lit("`"), x["name"], F.lit("`"))), ", ")
    tail = F.when(F.col("m") > 0, F.concat(F.lit(" Relations: "), F.col("m").cast("string"), F.lit(" ("), F.col("kinds"), F.lit(")."))).otherwise("")
    return both.select("seed", F.concat(F.lit("Objects: "), F.col("n").cast("string"), F.lit(", among them "), names, F.lit("."), tail).alias("content"))


def json_text(summary: Column) -> Column:
    """The first non-empty text among a JSON summary's telling keys; other texts as they are; null for JSON without one."""
    keys = ("summary", "description", "responsibility", "responsibility_label", "name", "module_path")
    parts = [F.nullif(F.get_json_object(summary, f"$.{k}"), F.lit("")) for k in keys]
    return F.when(F.trim(summary).startswith("{"), F.coalesce(*parts)).otherwise(F.nullif(F.trim(summary), F.lit("")))


def latest_document(documents: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    return first_of(documents, [key], [F.col(at).desc_nulls_last(), F.col(tie).desc()])


def prompt(question: Column, anchor: Column, lines: Column, budget: int = C.PROMPT_BUDGET) -> Column:
    """Question, anchor and context lines as one text, and what it costs in tokens."""
    text = F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.concat(F.lit("Anchor: "), anchor), F.lit("Context:"), F.array_join(lines, "\n"))
    return F.struct(text.alias("text"), X.token_estimate(text).alias("tokens"), (X.token_estimate(text) <= budget).alias("fits"))
