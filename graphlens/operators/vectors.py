"""Nearest neighbours of stated query vectors, and the embeddings table: upsert, delete, merge of hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.operators.lookup import first_of

#: Query vectors that one pass over the rows answers; more are answered in further passes.
QUERIES_AT_ONCE = 20_000


def _similarity(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return q @ x.T
    nq, nx = (q * q).sum(1), (x * x).sum(1)
    if metric == "l2":
        return 1 / (1 + np.sqrt(np.maximum(nq[:, None] + nx[None] - 2 * q @ x.T, 0)))
    if metric == "cosine":
        n = np.sqrt(nq)[:, None] * np.sqrt(nx)[None]
        return np.where(n > 0, q @ x.T / np.where(n > 0, n, 1), 0.0)
    raise ValueError(f"unknown metric {metric}")


def nearest(rows: DataFrame, queries: DataFrame, metric: str = "cosine", top: int | dict[str, int] = 10, least: float | None = C.MIN_SIMILARITY) -> DataFrame:
    """query_id, id, kind, similarity, rank: of each query the most similar rows, per kind, ties by smaller id.

    rows, queries: id, kind, vector. A query meets only rows of the kinds in `top` (a number: k of every kind together with
    the row's own kind), never itself. Vectors of another length than the query's, null ones and ones with a null are left
    out; a zero vector has cosine 0. Similarities below `least` are dropped. Every task keeps its k best of each query
    and kind over all its batches, so that only those are shuffled. metric: cosine, l2 (1 / (1 + distance)) or ip; others raise.
    """
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric {metric}")
    out = "query_id long, id long, kind string, similarity double"
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    found = None
    for k in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select("id", "vector").toPandas().dropna()
        own = own[np.array([len(v) > 0 and not any(x is None for x in v) for v in own["vector"]], bool)]
        sets = {n: (g["id"].to_numpy(), np.array([np.asarray(v, float) for v in g["vector"]])) for n, g in own.groupby(own["vector"].map(len))}
        sent = rows.sparkSession.sparkContext.broadcast(sets)

        def best(batches, sent=sent):
            kept: dict = {}  # (length, kind): similarities and ids of the best rows of each query so far
            for b in batches:
                ok = [v is not None and len(v) in sent.value and not any(x is None for x in v) for v in b["vector"]]
                b = b[np.array(ok, bool)]
                for (size, kind), g in b.groupby([b["vector"].map(len), "kind"]):
                    limit = top if isinstance(top, int) else top.get(kind, 0)
                    if not limit:
                        continue
                    ids, q = sent.value[size]
                    x, rid = np.stack(list(g["vector"])).astype(float), g["id"].to_numpy()
                    own_s, own_i = kept.setdefault((size, kind), (np.full((len(ids), limit), -np.inf), np.full((len(ids), limit), np.iinfo(np.int64).max)))
                    for lo in range(0, len(ids), 512):
                        s = np.round(_similarity(q[lo : lo + 512], x, metric), 9)
                        s[(ids[lo : lo + 512, None] == rid[None]) | ~np.isfinite(s)] = -np.inf
                        # what cannot be among the best so far (ties may) is not sorted
                        rows_, new = np.nonzero(s >= np.maximum(own_s[lo : lo + 512, -1:], -1e300 if least is None else least))
                        if not len(rows_):
                            continue
                        open_ = np.unique(rows_)
                        for r in open_:
                            at = new[np.searchsorted(rows_, r) : np.searchsorted(rows_, r, "right")]
                            every, ident = np.r_[own_s[lo + r], s[r, at]], np.r_[own_i[lo + r], rid[at]]
                            first = np.lexsort((ident, -every))[:limit]
                            own_s[lo + r], own_i[lo + r] = every[first], ident[first]
            for (size, kind), (own_s, own_i) in kept.items():
                r, c = np.nonzero(np.isfinite(own_s))
                yield pd.DataFrame({"query_id": sent.value[size][0][r], "id": own_i[r, c], "kind": kind, "similarity": own_s[r, c]})

        part = rows.select("id", "kind", "vector").mapInPandas(best, out)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", "kind").orderBy(F.col("similarity").desc(), "id")
    limit = F.lit(top) if isinstance(top, int) else F.create_map(*[F.lit(x) for pair in top.items() for x in pair])[F.col("kind")]
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of both; of each (repo_id, object_id) the latest by created_at (ties: greater id)."""
    return first_of(stored.unionByName(new), ["repo_id", "object_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()])


def deleted(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose (repo_id, object_id) is not in `gone`; an empty `gone` deletes nothing."""
    return stored.join(gone.select("repo_id", "object_id").distinct(), ["repo_id", "object_id"], "left_anti")


def merged_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of repeated hits the greatest similarity."""
    return hits.groupBy(*keys).agg(F.max("similarity").alias("similarity"))
