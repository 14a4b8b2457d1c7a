"""Scores of candidates and their order: several factors fused, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.operators.lookup import first_of

#: Parts of a question that ask for a type of object.
TYPE_HINTS = {
    "module": ("module", "模块", "package"),
    "file": ("file", "文件"),
    "class": ("class", "类"),
    "function": ("function", "func", "函数"),
    "method": ("method", "方法"),
}


def anchor_proximity(id_: Column, file_id: Column, module_id: Column, anchor_id: Column, anchor_file: Column, anchor_module: Column) -> Column:
    """10 the anchor itself, 7 its file, 4 its module, 1 elsewhere or without an anchor (tenths)."""
    return F.when(anchor_id.isNull(), 1).when(id_ == anchor_id, 10).when(file_id == anchor_file, 7).when(module_id == anchor_module, 4).otherwise(1)


def name_hit(name: Column, other: Column, terms: Column) -> Column:
    """10 a term equals a name, 5 a term is part of one, else 0 (tenths)."""
    n, o = F.lower(name), F.lower(other)
    return F.when(F.exists(terms, lambda t: (t == n) | (t == o)), 10).when(F.exists(terms, lambda t: F.contains(n, t) | F.contains(o, t)), 5).otherwise(0)


def type_match(kind: Column, question: Column) -> Column:
    """10 where the question asks for the candidate's type (function and method stand for each other, interface for class)."""
    low = F.lower(question)
    asked = {k: F.greatest(*[low.contains(h).cast("int") for h in [*hints, hints[0]]]) == 1 for k, hints in TYPE_HINTS.items()}
    hit = (kind.isin("function", "method") & (asked["function"] | asked["method"])) | (kind.isin("class", "interface") & asked["class"])
    for k in ("module", "file"):
        hit = hit | ((kind == k) & asked[k])
    return F.when(F.coalesce(hit, F.lit(False)), 10).otherwise(0)


def distance_score(distance: Column) -> Column:
    """10, 8, 4 for no, one, two hops, 1 beyond, 0 where none is known (tenths)."""
    return F.when(distance.isNull(), 0).when(distance <= 0, 10).when(distance == 1, 8).when(distance == 2, 4).otherwise(1)


def fused(anchor: Column, name: Column, kind: Column, similarity: Column, distance: Column, memory: Column) -> Column:
    """The weighted sum of all factors (tenths; similarity 0..1), at most 1, rounded half up to 4 digits.

    Computed in whole units of 1e-11 (the similarity to 1e-9), so that equal factors give equal scores in any engine."""
    wa, wn, wt, ws, wd, wm = C.FUSION
    s = F.floor(F.greatest(F.least(similarity, F.lit(1.0)), F.lit(0.0)) * 1_000_000_000 + 0.5)
    parts = (wa * anchor + wn * name + wt * kind + wd * distance + wm * 10 * memory.cast("int")).cast("long")
    total = F.least(parts * 100_000_000 + ws * s, F.lit(100_000_000_000))
    return F.floor((total + 5_000_000) / 10_000_000) / 10_000


def ranked(scored: DataFrame, top: int = C.RANK_TOP_K, keys: tuple[str, ...] = ("seed",)) -> DataFrame:
    """The best `top` candidates of each question by score, ties by id, with `rank`."""
    return first_of(scored, list(keys), [F.col("score").desc(), "id"], top, "rank")


def baseline(kind: Column, distance: Column) -> Column:
    """What structure alone gives a candidate: by its kind and its distance; 0 where no distance is known."""
    near = distance <= 1
    return (
        F.when(distance.isNull(), 0.0)
        .when(kind == "symbol", F.when(near, 0.85).otherwise(0.65))
        .when(kind == "file", F.when(near, 0.7).otherwise(0.55))
        .otherwise(F.when(near, 0.6).otherwise(0.45))
    )


def context_order(scored: DataFrame, cap: int = 8) -> DataFrame:
    """Candidates as a prompt lists them: by score, modules before files before symbols, id; at most `cap` of a question."""
    priority = F.when(F.col("kind") == "module", 0).when(F.col("kind") == "file", 1).otherwise(2)
    return first_of(scored.withColumn("_p", priority), ["seed"], [F.col("score").desc(), "_p", "id"], cap, "rank").drop("_p")


def relations_for_context(relations: DataFrame, chosen: DataFrame, cap: int = 6) -> DataFrame:
    """Of each question (seed) the first `cap` relations (by id) that touch a chosen object; all its relations where none does.

    relations: seed, id, source_id, target_id; chosen: seed, id."""
    c = chosen.select("seed", F.col("id").alias("_c")).distinct()
    ends = relations.select("seed", F.col("id"), F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("_c"))
    touching = ends.join(c, ["seed", "_c"], "left_semi").select("seed", "id").distinct().withColumn("_hit", F.lit(1))
    both = relations.join(touching, ["seed", "id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    any_hit = touching.select("seed").distinct().withColumn("_any", F.lit(1))
    both = both.join(any_hit, "seed", "left").filter("_hit = 1 or _any is null")
    return first_of(both, ["seed"], ["id"], cap, "rank").drop("_hit", "_any")
