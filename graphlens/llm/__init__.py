"""Operators on training data; nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphlens.llm.docpairs import p4_found, p4_pairs
from graphlens.llm.handwritten import p5_found
from graphlens.llm.langlabels import p8_found
from graphlens.llm.leaks import p7_found, p7_paraphrases
from graphlens.llm.natural import p3_found
from graphlens.llm.similar import p1_found
from graphlens.llm.tokens import p6_ids


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_pairs, p5_found, p6_ids, p7_found, p7_paraphrases, p8_found)}


#: Exact pairs; the operator's index finds all of them at this size.
P1_SQL = """
WITH l AS (SELECT id, lower(trim(object_type)) AS t, embedding::double[] AS v FROM object_embeddings
  QUALIFY row_number() OVER (PARTITION BY repo_id, object_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
e AS (SELECT id, t, v, sqrt(list_dot_product(v, v)) AS n FROM l WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS s FROM e a JOIN e b ON a.t IS NOT DISTINCT FROM b.t AND a.id <> b.id),
k AS (SELECT * FROM p WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL}
