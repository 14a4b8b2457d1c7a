"""Recall for many anchors at once, from structure and from vectors, and what is answered with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.operators import evidence as E
from graphlens.operators import rank as R
from graphlens.operators import traverse as T
from graphlens.operators.lookup import directed

Encoder = Callable[[list[str]], list[list[float]]]
BATCH = 32


def structured_recall(anchors: DataFrame, modules: DataFrame, files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """seed, id, kind, distance: what structure offers for each anchor (seed, level, id).

    symbol: its file and module (1) and the symbols that a relation joins to it (no distance); file: its module and
    symbols (1); module: its files (1). Level none, and anchors that are not there, offer nothing. An object that is offered
    twice has its smallest distance."""
    of = lambda level: anchors.filter(F.col("level") == level).select("seed", "id")
    s = of("symbol").join(symbols.select("id", "file_id", "module_id"), "id")
    f = of("file").join(files.select("id", "module_id"), "id")
    m = of("module").join(modules.select("id"), "id")
    known = symbols.select(F.col("id").alias("other"))
    near = s.select("seed", "id").join(directed(relations).select("id", "other").distinct(), "id").filter("other <> id").join(known, "other", "left_semi")
    row = lambda df, c, kind, distance: df.select("seed", F.col(c).alias("id"), F.lit(kind).alias("kind"), F.lit(distance).cast("int").alias("distance"))
    parts = [
        row(s, "file_id", "file", 1),
        row(s, "module_id", "module", 1),
        row(near, "other", "symbol", None),
        row(f, "module_id", "module", 1),
        row(f.select("seed", F.col("id").alias("file_id")).join(symbols.select(F.col("id").alias("own"), "file_id"), "file_id"), "own", "symbol", 1),
        row(m.select("seed", F.col("id").alias("module_id")).join(files.select(F.col("id").alias("own"), "module_id"), "module_id"), "own", "file", 1),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("seed", "id", "kind").agg(F.min("distance").alias("distance"))


def hybrid(structured: DataFrame, hits: DataFrame) -> DataFrame:
    """seed, id, kind, distance, similarity: both recalls by object; repeated hits count with their best similarity."""
    best = hits.groupBy("seed", "id", "kind").agg(F.max("similarity").alias("similarity"))
    both = structured.join(best, ["seed", "id", "kind"], "full_outer")
    return both.select("seed", "id", "kind", "distance", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def answered(ranked: DataFrame, anchors: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """seed, a, c, e, g, r, strategy, mode: metrics of each question's objects (ranked: seed, id, rank, score, file_id, module_id), the
    strategy they lead to, and, for S4, how an incomplete answer is given. anchors: seed, level, confidence. A question without
    objects has metrics 0, with g = 1 where nothing was expanded."""
    m = anchors.select("seed", "level", F.col("confidence").alias("a")).join(E.concentration(ranked), "seed", "left").join(E.evidence(ranked), "seed", "left").join(E.consistency(ranked), "seed", "left")
    m = m.join(E.gain(expanded, ranked.limit(0), ranked), "seed", "left") if expanded is not None else m.withColumn("g", F.lit(None).cast("double"))
    m = m.select("seed", "level", "a", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in "cer"], F.coalesce("g", F.lit(1.0)).alias("g"))
    m = m.withColumn("strategy", E.strategy())
    mode = E.degraded_mode(ranked, m.select("seed", "c", "level")).select("seed", "mode")
    return m.join(mode, "seed", "left").select("seed", "a", "c", "e", "g", "r", "strategy", F.when(F.col("strategy") == "S4", F.col("mode")).alias("mode"))


def with_baseline(scored: DataFrame) -> DataFrame:
    """Scores raised to what structure alone gives (kind, distance)."""
    return scored.withColumn("score", F.greatest("score", R.baseline(F.col("kind"), F.col("distance"))))


def fused_candidates(candidates: DataFrame, where: DataFrame, questions: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """seed, id, kind, distance, file_id, module_id, score: candidates with all factors fused and raised to the baseline.

    candidates: seed, id, kind, distance, similarity; where: id, kind, name, other, type, file_id, module_id; questions: seed, question
    and its anchor's id (null: none); memory: seed, id of what the session dealt with. The anchor itself is no candidate, and
    objects that are not there drop out."""
    target = where.select(F.col("id").alias("anchor_id"), F.col("file_id").alias("anchor_file"), F.col("module_id").alias("anchor_module"))
    asked = questions.select("seed", "question", F.col("id").alias("anchor_id")).join(target, "anchor_id", "left").withColumn("terms", X.identifiers(F.col("question")))
    c = candidates.join(where, ["id", "kind"]).join(asked, "seed").filter("anchor_id is null or id <> anchor_id")
    if memory is not None:
        c = c.join(memory.select("seed", "id", F.lit(True).alias("_kept")).distinct(), ["seed", "id"], "left")
    else:
        c = c.withColumn("_kept", F.lit(False))
    score = R.fused(
        R.anchor_proximity(F.col("id"), F.col("file_id"), F.col("module_id"), F.col("anchor_id"), F.col("anchor_file"), F.col("anchor_module")),
        R.name_hit(F.col("name"), F.col("other"), F.col("terms")),
        R.type_match(F.col("type"), F.col("question")),
        F.col("similarity"),
        R.distance_score(F.col("distance")),
        F.coalesce("_kept", F.lit(False)),
    )
    return with_baseline(c.select("seed", "id", "kind", "distance", "file_id", "module_id", score.alias("score")))


def expanded(ranked: DataFrame, questions: DataFrame, relations: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """seed, id, kind, distance: what expansion adds to ranked objects: from the anchor and every ranked symbol, by the modes that
    the question asks for, the second hop only where it gains enough, each symbol with its file and module.

    questions: seed, question, id, level; ranked: seed, id, kind."""
    modes = questions.select("seed", T.expansion_modes(F.col("question")).alias("modes"))
    starts = ranked.filter("kind = 'symbol'").select("seed", F.col("id").alias("start")).unionByName(questions.filter("level = 'symbol'").select("seed", F.col("id").alias("start")))
    reached = T.expand(starts.distinct().join(modes, "seed"), relations, depth, symbols.select("id"))
    gain = T.expansion_gain(reached, questions.select("seed", X.identifiers(F.col("question")).alias("terms")), symbols)
    return T.with_containers(T.gated(reached, gain), symbols)


def executed(ranked: DataFrame, routed: DataFrame, questions: DataFrame, graph: dict[str, DataFrame], where: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """seed, strategy, id, rank, score, added: the objects that a question is answered from once its strategy was carried out.

    S1 keeps what was ranked. S2 adds what expansion finds (objects known before count as one hop away) and ranks all again;
    `added` marks what is new. S3 looks again from another anchor: the question's own where it has one (what it finds is the
    same), else the file or module that holds most of what was ranked; without such a one it becomes S4. S4 keeps what was ranked,
    for an answer that asks back. ranked: seed, id, kind, distance, file_id, module_id, rank, score; routed: seed, strategy."""
    told = questions.join(routed.select("seed", "strategy"), "seed")
    old = ranked.join(told.select("seed", "strategy"), "seed")
    second = told.filter("strategy = 'S2'")
    mine = ranked.join(second.select("seed"), "seed", "left_semi")
    more = expanded(mine, second, graph["relations"], graph["symbols"])
    known = mine.select("seed", "id", "kind", F.lit(1).alias("distance"), F.lit(False).alias("added"))
    both = known.unionByName(more.withColumn("added", F.lit(True))).groupBy("seed", "id", "kind").agg(F.min("distance").alias("distance"), F.min("added").alias("added"))
    again = fused_candidates(both.withColumn("similarity", F.lit(0.0)), where, second, memory)
    again = R.ranked(again).join(both.select("seed", "id", "kind", "added"), ["seed", "id", "kind"]).withColumn("strategy", F.lit("S2"))
    guess = E.inferred_anchor(ranked.join(told.filter("strategy = 'S3' and id is null").select("seed"), "seed", "left_semi"))
    third = guess.select("seed", F.col("anchor_id").alias("id"), "level").join(told.select("seed", "question"), "seed")
    found = structured_recall(third, graph["modules"], graph["files"], graph["symbols"], graph["relations"])
    other = R.ranked(fused_candidates(found.withColumn("similarity", F.lit(0.0)), where, third, memory)).withColumn("strategy", F.lit("S3")).withColumn("added", F.lit(False))
    kept = old.filter("strategy <> 'S2'").join(third.select("seed"), "seed", "left_anti").join(told.select("seed", F.col("id").alias("_anchor")), "seed")
    kept = kept.withColumn("strategy", F.when((F.col("strategy") == "S3") & F.col("_anchor").isNull(), "S4").otherwise(F.col("strategy"))).withColumn("added", F.lit(False))
    columns = ["seed", "strategy", "id", "rank", "score", "added"]
    return kept.select(*columns).unionByName(again.select(*columns)).unionByName(other.select(*columns))


# -- embeddings ------------------------------------------------------------------------------------------------------------


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic encoder without a model: each word adds a sign at a place that its hash names."""
    import zlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        return out.tolist()

    return encode


def build_embeddings(candidates: DataFrame, encoder: Encoder | None = None, batch: int = BATCH) -> DataFrame:
    """repo_id, object_id, object_type, embedding (unit length; a zero vector stays) of objects with a summary that is not blank.

    Each distinct summary is encoded once. A batch that fails is tried item by item, and items that fail are left out."""
    encode = encoder or hashing_encoder()
    rows = candidates.filter(F.trim("summary") != "").select("repo_id", F.col("id").alias("object_id"), F.col("kind").alias("object_type"), F.trim("summary").alias("summary"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["summary"])
            told: list[tuple[str, list[float]]] = []
            for i in range(0, len(texts), batch):
                own = texts[i : i + batch]
                try:
                    told += zip(own, encode(own), strict=True)
                except Exception:  # noqa: BLE001
                    for t in own:
                        try:
                            told.append((t, encode([t])[0]))
                        except Exception:  # noqa: BLE001, S112
                            continue
            unit = [(t, (np.asarray(v, float) / (np.linalg.norm(v) or 1.0)).tolist()) for t, v in told]
            yield pd.DataFrame(unit, columns=["summary", "embedding"])

    vectors = rows.select("summary").distinct().mapInPandas(run, "summary string, embedding array<double>")
    return rows.join(vectors, "summary").select("repo_id", "object_id", "object_type", "embedding")


def generated(prompts: DataFrame, text: str, generate: Callable[[list[str]], list[str]], fallback: str, retries: int = C.MAX_RETRIES) -> DataFrame:
    """`prompts` with `answer` and `failed`: an injected text generator over batches, each tried `retries` times, then its items one by
    one; where even that fails the `fallback` column answers."""
    fields = prompts.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tried(own: list[str]) -> list[str] | None:
            for _ in range(retries):
                try:
                    return list(generate(own))
                except Exception:  # noqa: BLE001, S112
                    continue
            return None

        for b in batches:
            told: list[str | None] = tried(list(b[text])) or [(tried([t]) or [None])[0] for t in b[text]]
            failed = [t is None for t in told]
            yield b.assign(answer=[f if t is None else t for t, f in zip(told, b[fallback])], failed=failed)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", answer string, failed boolean"
    return prompts.mapInPandas(run, schema)
