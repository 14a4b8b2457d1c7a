"""Bounded expansion of many seeds at once over a relation graph.

Each hop is one equi-join of the frontier with the edges; what a hop finds is made distinct, the edges are not. A seed's
reach can be a large part of the graph, so that results stay in long form (seed, id) and no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.operators.lookup import directed

#: Parts of a question that ask for one way of expansion, by mode.
MODE_HINTS = {
    "callers": ("谁调用", "谁在调用", "caller", "callers", "调用方"),
    "callees": ("调用了谁", "调用哪些", "callee", "callees", "依次调用"),
    "depends_on": ("依赖", "depends on", "depend on"),
    "reverse_depends_on": ("谁依赖", "被谁依赖", "reverse depends", "dependents"),
    "references": ("引用", "references", "reference", "谁用到"),
}


def expansion_modes(question: Column) -> Column:
    """The modes that a question (lower-cased) asks for; all where it asks for none."""
    low = F.lower(question)
    asked = F.array(*[F.when(F.greatest(*[low.contains(h).cast("int") for h in [*hints, hints[0]]]) == 1, F.lit(mode)) for mode, hints in MODE_HINTS.items()])
    asked = F.filter(asked, lambda m: m.isNotNull())
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(*[F.lit(m) for m in MODE_HINTS]))


def mode_of(relation_type: Column, direction: Column) -> Column:
    """The mode under which a relation is followed from one of its ends; null for types that are never followed."""
    kind = F.lower(relation_type)
    out = direction == "out"
    return (
        F.when(kind == "calls", F.when(out, "callees").otherwise("callers"))
        .when(kind == "depends_on", F.when(out, "depends_on").otherwise("reverse_depends_on"))
        .when(kind.isin("references", "reference"), "references")
    )


def expand(seeds: DataFrame, relations: DataFrame, depth: int = 2, known: DataFrame | None = None) -> DataFrame:
    """seed, id, distance: what each seed reaches within `depth` hops, at its smallest distance; not the seed itself.

    Only relations that have a mode are followed (calls, depends_on, references); inheritance is not. seeds: seed, and
    optionally modes (array<string>): then only relations of these modes are followed. known: ids that exist; ends that are
    none of them are neither reached nor passed through. Null seeds reach nothing. What is reached already is not followed again.
    A column `start` (several rows per seed) names where a seed begins; these ids count as reached from the outset.
    """
    edges = directed(relations).withColumn("mode", mode_of(F.col("relation_type"), F.col("direction"))).filter("mode is not null")
    if known is not None:
        edges = edges.join(known.select(F.col("id").alias("other")).distinct(), "other", "left_semi")
    with_modes = "modes" in seeds.columns
    edges = edges.select("id", "other", *(["mode"] if with_modes else []))
    carried = ["modes"] if with_modes else []
    several = "start" in seeds.columns
    frontier = seeds.filter("seed is not null").withColumn("id", F.col("start" if several else "seed")).drop("start").distinct()
    begun = frontier.select("seed", "id") if several else None
    reached = None
    for hop in range(1, depth + 1):
        met = frontier.join(edges, "id")
        if with_modes:
            met = met.filter(F.array_contains("modes", F.col("mode")))
        frontier = met.select("seed", F.col("other").alias("id"), *carried).distinct()
        frontier = frontier.join(begun, ["seed", "id"], "left_anti") if several else frontier.filter("seed <> id")
        if 1 < hop < depth:
            frontier = frontier.join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
        step = frontier.select("seed", "id", F.lit(hop).alias("distance"))
        reached = step if reached is None else reached.unionByName(step)
    return reached.groupBy("seed", "id").agg(F.min("distance").alias("distance"))


def with_containers(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """seed, id, kind, distance: reached symbols with the files and modules that hold them, each at its smallest distance."""
    rows = reached.join(symbols.select("id", "file_id", "module_id"), "id")
    parts = F.array(*[F.struct(F.col(c).alias("id"), F.lit(kind).alias("kind")) for c, kind in (("id", "symbol"), ("file_id", "file"), ("module_id", "module"))])
    return rows.select("seed", "distance", F.inline(parts)).filter("id is not null").groupBy("seed", "id", "kind").agg(F.min("distance").alias("distance"))


def expansion_gain(reached: DataFrame, questions: DataFrame, names: DataFrame, distance: int = 2) -> DataFrame:
    """seed, found, relevant, gain: share of the objects at `distance` whose name or qualified name has one of the question's
    terms as a part. questions: seed, terms (array<string>); names: id, name, qualified_name. Without terms every object counts."""
    at = reached.filter(F.col("distance") == distance).join(names.select("id", F.lower("name").alias("n"), F.lower("qualified_name").alias("q")), "id").join(questions, "seed")
    hit = (F.size("terms") == 0) | F.exists("terms", lambda t: F.contains(F.col("n"), t) | F.contains(F.col("q"), t))
    told = at.groupBy("seed").agg(F.count("*").alias("found"), F.count_if(hit).alias("relevant"))
    return told.withColumn("gain", F.round(F.col("relevant") / F.col("found"), 4))


def gated(reached: DataFrame, gain: DataFrame, least: float = C.EXPANSION_GAIN) -> DataFrame:
    """What was reached, without objects of the second hop where these gained too little."""
    weak = gain.filter(F.col("gain") < least).select("seed", F.lit(2).alias("distance"))
    return reached.join(weak, ["seed", "distance"], "left_anti").select(*reached.columns)


def call_chain(seeds: DataFrame, relations: DataFrame, depth: int = 3) -> DataFrame:
    """seed, source_id, target_id, depth: the call edges on the way from each seed, each at its smallest depth (0-based)."""
    calls = relations.filter(F.lower("relation_type") == "calls").select("source_id", "target_id").distinct()
    frontier, found = seeds.select("seed", F.col("seed").alias("source_id")).distinct(), None
    for level in range(depth):
        edges = frontier.join(calls, "source_id").select("seed", "source_id", "target_id")
        step = edges.withColumn("depth", F.lit(level))
        found = step if found is None else found.unionByName(step)
        frontier = edges.select("seed", F.col("target_id").alias("source_id")).distinct()
    return found.groupBy("seed", "source_id", "target_id").agg(F.min("depth").alias("depth"))
