"""Component, class and sequence diagrams as text, one per group, from the graph's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrows of a class diagram by relation type.
ARROWS = {"inherits": "<|--", "extends": "<|--", "implements": "<|..", "realizes": "<|..", "association": "-->", "associates": "-->", "uses": "-->", "depends_on": "..>"}


def node(id_: Column) -> Column:
    return F.concat(F.lit("node_"), F.regexp_replace(id_, r"(?U)[^\p{Alnum}]", "_"))


def label(text: Column) -> Column:
    return F.trim(F.translate(text, '"\n', "' "))


def _assembled(lines: DataFrame, key: str, head: str) -> DataFrame:
    """key, diagram: head, lines in order (part, order, line), end."""
    body = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "order", "line"))).alias("_l"))
    text = F.concat(F.lit(f"@startuml\n{head}\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n@enduml"))
    return body.select(key, text.alias("diagram"))


def component(modules: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """A diagram per key of its modules (key, id, name) and the edges between them (key, source_module, target_module,
    relation_type, distinct): at most the square of a key's modules for each type."""
    a = modules.select(key, F.lit(0).alias("part"), F.struct(F.col("name").alias("x"), F.col("id").alias("y"), F.lit("").alias("z")).alias("order"), F.concat(F.lit('component "'), "name", F.lit('" as '), node(F.col("id"))).alias("line"))
    e = edges.filter("source_module <> target_module").select(key, "source_module", "target_module", "relation_type").distinct()
    line = F.concat(node(F.col("source_module")), F.lit(" --> "), node(F.col("target_module")), F.lit(" : "), label(F.col("relation_type")))
    b = e.select(key, F.lit(1).alias("part"), F.struct(F.col("source_module").alias("x"), F.col("target_module").alias("y"), F.col("relation_type").alias("z")).alias("order"), line.alias("line"))
    return _assembled(a.unionByName(b), key, "skinparam componentStyle rectangle")


def classes(symbols: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """A diagram per key (a file) of its classes, structs and interfaces, and of the relations among them."""
    own = symbols.filter(F.col("type").isin("class", "interface", "struct")).select(key, "id", "qualified_name", "type")
    word = F.when(F.col("type") == "interface", "interface").otherwise("class")
    a = own.select(key, F.lit(0).alias("part"), F.struct(F.col("qualified_name").alias("x"), F.col("id").alias("y"), F.lit("").alias("z")).alias("order"), F.concat(word, F.lit(' "'), "qualified_name", F.lit('" as '), node(F.col("id"))).alias("line"))
    ids = own.select(key, "id")
    inside = relations.join(ids.withColumnRenamed("id", "source_id"), "source_id").join(ids.withColumnsRenamed({"id": "target_id"}), ["target_id", key])
    arrow = F.coalesce(F.create_map(*[F.lit(x) for p in ARROWS.items() for x in p])[F.lower("relation_type")], F.lit("-->"))
    line = F.concat(node(F.col("target_id")), F.lit(" "), arrow, F.lit(" "), node(F.col("source_id")), F.lit(" : "), label(F.col("relation_type")))
    b = inside.select(key, F.lit(1).alias("part"), F.struct(F.col("source_id").alias("x"), F.col("target_id").alias("y"), F.col("relation_type").alias("z")).alias("order"), line.alias("line"))
    return _assembled(a.unionByName(b), key, "hide empty members")


def sequence(chain: DataFrame) -> DataFrame:
    """A diagram per seed of its call chain (seed, source_id, target_id, depth): participants in order of first appearance."""
    ends = chain.select("seed", "depth", F.posexplode(F.array("source_id", "target_id")).alias("_e", "id"))
    who = ends.groupBy("seed", "id").agg(F.min("depth").alias("depth"))
    a = who.select("seed", F.lit(0).alias("part"), F.struct(F.lpad(F.col("depth").cast("string"), 3, "0").alias("x"), F.col("id").alias("y"), F.lit("").alias("z")).alias("order"), F.concat(F.lit('participant "'), "id", F.lit('" as '), node(F.col("id"))).alias("line"))
    line = F.concat(node(F.col("source_id")), F.lit(" -> "), node(F.col("target_id")), F.lit(" : calls"))
    b = chain.select("seed", F.lit(1).alias("part"), F.struct(F.lpad(F.col("depth").cast("string"), 3, "0").alias("x"), F.col("source_id").alias("y"), F.col("target_id").alias("z")).alias("order"), line.alias("line"))
    return _assembled(a.unionByName(b), "seed", "autonumber")


def entry_symbols(ranked: DataFrame, relations: DataFrame) -> DataFrame:
    """seed, id: the first ranked symbol that calls something, else the first."""
    from graphlens.operators.lookup import first_of

    callers = relations.filter(F.lower("relation_type") == "calls").select(F.col("source_id").alias("id")).distinct().withColumn("_c", F.lit(0))
    both = ranked.join(callers, "id", "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    return first_of(both, ["seed"], ["_c", "rank", "id"]).select("seed", "id")
