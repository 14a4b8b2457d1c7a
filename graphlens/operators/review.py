"""Checks of documents against plans and graph, one issue per row: severity, category, where, what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^(#{1,6})[ \t]+\S"
#: Words of a diagram's own language.
DIAGRAM_WORDS = (
    "startuml enduml actor agent artifact as class component database enum folder frame interface left node note of package participant queue rectangle right together "
    "skinparam componentstyle autonumber hide empty members title end alt else opt loop group activate deactivate"
).split()


def _issues(rows: DataFrame, severity: str, category: str, where: str, what) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col(where).cast("string").alias("place"), what.alias("message"))


def missing_sections(planned: DataFrame, generated: DataFrame, keys: list[str]) -> DataFrame:
    """Planned sections that were not generated (error) and generated ones that nobody planned (warning); keys and `severity`."""
    p, g = planned.select(*keys).distinct(), generated.select(*keys).distinct()
    return p.join(g, keys, "left_anti").withColumn("severity", F.lit("error")).unionByName(g.join(p, keys, "left_anti").withColumn("severity", F.lit("warning")))


def headings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, level of every markdown heading outside code blocks."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)```.*?(```|$)", "")
    lines = texts.select(key, F.posexplode(F.split(clean, "\n")).alias("line", "_t"))
    return lines.filter(F.col("_t").rlike(HEADING)).select(key, "line", F.length(F.regexp_extract("_t", HEADING, 1)).alias("level"))


def level_jumps(sections: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, previous, level where a heading is more than one level below the one before it."""
    before = F.lag("level").over(Window.partitionBy(key).orderBy(order))
    return sections.withColumn("previous", before).filter(F.col("level") > F.col("previous") + 1).select(key, order, "previous", "level")


def bad_links(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, target: section links `(#target)` that lead nowhere. known: target."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\(#([a-zA-Z0-9_-]+)\)"), F.lit(1)))).alias("target"))
    return found.join(known.select("target").distinct(), "target", "left_anti").select(key, "target")


def unknown_terms(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, term: terms in back-ticks that are no known name (case apart). names: name."""
    clean = F.regexp_replace(F.col(text), r"(?s)```.*?(```|$)", "")
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(r"`([^`\n]+)`"), F.lit(1)))).alias("term")).withColumn("_l", F.lower(F.trim("term")))
    found = found.filter(~F.col("_l").startswith("section ") & (F.col("_l") != ""))
    return found.join(names.select(F.lower("name").alias("_l")).distinct(), "_l", "left_anti").select(key, "term")


def unknown_objects(used: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Used object ids that are no known object."""
    return used.select(*keys).distinct().join(objects.select(*keys), keys, "left_anti")


def missing_types(sections: DataFrame, key: str) -> DataFrame:
    """key, missing: documents without an overview or architecture section, or without a summary."""
    has = lambda *kinds: F.max(F.col("section_type").isin(*kinds).cast("int"))
    told = sections.groupBy(key).agg(has("overview", "architecture").alias("o"), has("summary").alias("s"))
    missing = F.array(F.when(F.coalesce("o", F.lit(0)) == 0, F.lit("overview")), F.when(F.coalesce("s", F.lit(0)) == 0, F.lit("summary")))
    return told.select(key, F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("missing"))


def diagram_terms(texts: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """key, term: entities of a document's diagrams, without the diagram language's words and plain capitals, and without those
    that `known` (term, lower case) holds."""
    blocks = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?s)(@startuml.*?@enduml)"), F.lit(1))
    tokens = F.regexp_extract_all(F.array_join(blocks, "\n"), F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0))
    plain = F.filter(F.array_distinct(tokens), lambda t: ~F.lower(t).isin(*DIAGRAM_WORDS) & ~(t.rlike(r"^[A-Z0-9_]+$")) & ~F.lower(t).startswith("node_"))
    told = texts.select(key, F.explode(plain).alias("term"))
    return told if known is None else told.join(known.select(F.col("term").alias("_known")).distinct(), F.lower("term") == F.col("_known"), "left_anti")


def passed(issues: DataFrame, key: str) -> DataFrame:
    """key, passed: no issue is an error."""
    return issues.groupBy(key).agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))


def auto_fixed(planned: DataFrame, generated: DataFrame, keys: list[str], used: str, known: DataFrame) -> DataFrame:
    """What an automatic repair leaves: planned sections in place of missing ones (`regenerated`), and of each section's used
    objects only the known ones. generated: keys, used (array<string>); known: id."""
    rows = planned.select(*keys).join(generated.select(*keys, used), keys, "left").withColumn("regenerated", F.col(used).isNull())
    ids = rows.select(*keys, F.posexplode_outer(used).alias("_p", "id")).join(known.select("id").distinct(), "id", "left_semi")
    kept = ids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "id"))).alias("_k")).select(*keys, F.transform("_k", lambda x: x["id"]).alias(used))
    return rows.drop(used).join(kept, keys, "left").withColumn(used, F.coalesce(used, F.array().cast("array<string>")))
