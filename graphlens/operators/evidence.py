"""Metrics of what was retrieved for each question, the strategy they lead to, and answers that are less than full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.operators.lookup import first_of


def concentration(ranked: DataFrame, top: int = C.METRICS_TOP_K) -> DataFrame:
    """seed, c: the largest share that one module or one file has among the best `top` objects.

    ranked: seed, rank, file_id, module_id (null where an object has none)."""
    best = ranked.filter(F.col("rank") <= top)
    total = best.groupBy("seed").agg(F.count("*").alias("n"))
    shares = []
    for c in ("module_id", "file_id"):
        shares.append(best.filter(F.col(c).isNotNull()).groupBy("seed", c).agg(F.count("*").alias("k")).select("seed", "k"))
    most = shares[0].unionByName(shares[1]).groupBy("seed").agg(F.max("k").alias("k"))
    return total.join(most, "seed", "left").select("seed", F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 4).alias("c"))


def evidence(ranked: DataFrame) -> DataFrame:
    """seed, e: relevant objects times the mean score, over what is required; at most 1, 0 without a relevant one."""
    told = ranked.groupBy("seed").agg(F.count_if(F.col("score") >= C.EVIDENCE_RELEVANT).alias("m"), F.sum(F.col("score").cast("decimal(12,4)")).alias("s"), F.count("*").alias("n"))
    value = F.least(F.lit(1.0), F.col("m") * F.col("s").cast("double") / F.col("n") / C.EVIDENCE_REQUIRED)
    return told.select("seed", F.when(F.col("m") == 0, 0.0).otherwise(F.round(value, 4)).alias("e"))


def gain(expanded: DataFrame, initial: DataFrame, scores: DataFrame) -> DataFrame:
    """seed, g: share of the expanded objects that are new and relevant. Questions without expanded objects have no row (1.0)."""
    new = expanded.select("seed", "id").distinct().join(initial.select("seed", "id", F.lit(1).alias("_old")).distinct(), ["seed", "id"], "left")
    both = new.join(scores.select("seed", "id", "score"), ["seed", "id"], "left")
    good = F.count_if(F.col("_old").isNull() & (F.coalesce("score", F.lit(0.0)) >= C.EVIDENCE_RELEVANT))
    return both.groupBy("seed").agg(F.round(good / F.count("*"), 4).alias("g"))


def consistency(ranked: DataFrame) -> DataFrame:
    """seed, r: 1 minus the entropy of modules over its largest value; 1 for one object or one module."""
    n = ranked.filter("module_id is not null").groupBy("seed", "module_id").agg(F.count("*").alias("k"))
    total = n.groupBy("seed").agg(F.sum("k").alias("n"), F.count("*").alias("m"), F.sum(F.col("k") * F.log2("k")).alias("kl"))
    entropy = F.log2("n") - F.col("kl") / F.col("n")
    return total.select("seed", F.when(F.col("m") <= 1, 1.0).otherwise(F.round(F.greatest(1 - entropy / F.log2("m"), F.lit(0.0)), 4)).alias("r"))


def should_degrade():
    """Whether metrics a, c, e, g, r (columns) forbid a full answer."""
    a, c, e, g, r = (F.col(x) for x in "acegr")
    strong = (a >= C.ANCHOR_STRONG) & (c >= C.CONCENTRATION) & (e >= C.EVIDENCE_SUFFICIENT) & (g >= C.EXPANSION_GAIN)
    weak = (a < C.ANCHOR_DEGRADE) | (c < C.CONCENTRATION_DEGRADE) | (e < C.EVIDENCE_ENHANCEMENT) | (r < C.CONSISTENCY) | (g < C.EXPANSION_GAIN)
    return ~strong & weak


def strategy():
    """S1 answer, S2 expand first, S3 look for another anchor, S4 ask back: by metrics a, c, e, g, r."""
    a, c, e = F.col("a"), F.col("c"), F.col("e")
    return (
        F.when(should_degrade(), "S4")
        .when((a >= C.ANCHOR_STRONG) & (e >= C.EVIDENCE_SUFFICIENT), "S1")
        .when((a >= C.ANCHOR_WEAK) & (e >= C.EVIDENCE_SUFFICIENT) & (c >= C.CONCENTRATION), "S1")
        .when((a >= C.ANCHOR_WEAK) & (e < C.EVIDENCE_SUFFICIENT) & (c >= C.CONCENTRATION_ENHANCED), "S2")
        .when((a < C.ANCHOR_WEAK) & (c >= C.CONCENTRATION), "S3")
        .otherwise("S4")
    )


def inferred_anchor(ranked: DataFrame) -> DataFrame:
    """seed, level, anchor_id, confidence: the file, else the module, that holds CONCENTRATION of the objects or more.

    Ties go to what was seen first (smallest rank). Questions for which neither does have no row."""
    total = ranked.groupBy("seed").agg(F.count("*").alias("n"))
    out = None
    for level, c, confidence in (("file", "file_id", 0.60), ("module", "module_id", 0.55)):
        n = ranked.filter(F.col(c).isNotNull()).groupBy("seed", F.col(c).alias("anchor_id")).agg(F.count("*").alias("k"), F.min("rank").alias("first"))
        best = first_of(n, ["seed"], [F.col("k").desc(), "first", "anchor_id"]).join(total, "seed").filter(F.col("k") / F.col("n") >= C.CONCENTRATION)
        part = best.select("seed", F.lit(level).alias("level"), "anchor_id", F.lit(confidence).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return first_of(out, ["seed"], ["level"])


def degraded_mode(ranked: DataFrame, metrics: DataFrame) -> DataFrame:
    """seed, mode, sure, unsure: how an incomplete answer is given, with the first 5 ids of either kind.

    `partial` with scores on both sides of DEGRADED_SPLIT, `candidates` where c < .5 and two objects or more, else
    `guided_module`, `guided_file`, `guided_symbol` by the anchor's level (metrics: seed, c, level), else `generic`."""
    side = F.when(F.col("score") >= C.DEGRADED_SPLIT, "sure").otherwise("unsure")
    few = first_of(ranked.withColumn("side", side), ["seed", "side"], ["rank"], 5, "_k")
    lists = few.groupBy("seed").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("rank", "id")))).alias(s) for s in ("sure", "unsure")])
    n = ranked.groupBy("seed").agg(F.count("*").alias("n"))
    out = metrics.select("seed", "c", "level").join(lists, "seed", "left").join(n, "seed", "left")
    has = lambda s: F.coalesce(F.size(s), F.lit(0)) > 0
    some = F.coalesce("n", F.lit(0)) > 0
    mode = (
        F.when(has("sure") & has("unsure"), "partial")
        .when((F.col("c") < 0.5) & (F.col("n") >= 2), "candidates")
        .when(F.col("level") == "module", "guided_module")
        .when(F.col("level") == "file", "guided_file")
        .when((F.col("level") == "symbol") & some, "guided_symbol")
        .otherwise("generic")
    )
    ids = lambda s: F.array_join(F.transform(s, lambda x: x["id"]), ",")
    return out.select("seed", mode.alias("mode"), F.coalesce(ids("sure"), F.lit("")).alias("sure"), F.coalesce(ids("unsure"), F.lit("")).alias("unsure"))


def evidence_line(ranked: DataFrame, top: int = 5) -> DataFrame:
    """seed, line: the best ids with their scores, `id:0.85` with two digits, separated by `, `."""
    best = ranked.filter(F.col("rank") <= top).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("l"))
    return best.select("seed", F.array_join(F.transform("l", lambda x: F.concat(x["id"], F.lit(":"), F.round(x["score"].cast("decimal(12,4)"), 2).cast("string"))), ", ").alias("line"))
