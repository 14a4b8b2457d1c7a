"""Queries on expansion, ranking, metrics and strategies. Every hundredth symbol is a question's anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import text as X
from graphlens.operators import evidence as E
from graphlens.operators import rank as R
from graphlens.operators import retrieve as Q
from graphlens.operators import traverse as T
from graphlens.plans import views as V
from graphlens.plans.registry import query
from graphlens.tables import cut, table


def _number(id_: str):
    return F.substring(id_, 3, 20).cast("long")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return V.g_symbols(spark, d).select(F.col("id").alias("seed")).filter(_number("seed") % 100 == 0)


def _reached(spark: SparkSession, d: str) -> DataFrame:
    return T.expand(_seeds(spark, d), V.g_relations(spark, d), 2, V.g_symbols(spark, d).select("id"))


_N = "substr({0}, 3)::bigint"
_BFS = f"""WITH {V.GRAPH}, ge AS (SELECT * FROM gr WHERE relation_type IN ('calls', 'depends_on', 'references')),
e AS (SELECT source_id AS id, target_id AS other FROM ge UNION SELECT target_id, source_id FROM ge),
k AS (SELECT e.* FROM e JOIN gs ON e.other = gs.id),
h0 AS (SELECT id AS seed FROM gs WHERE {_N.format("id")} % 100 = 0),
h1 AS (SELECT DISTINCT seed, other AS id FROM h0 JOIN k ON seed = k.id),
h2 AS (SELECT DISTINCT seed, other AS id FROM h1 JOIN k USING (id)),
b AS (SELECT seed, id, min(dd) AS distance FROM (SELECT seed, id, 1 AS dd FROM h1 UNION ALL SELECT seed, id, 2 FROM h2) WHERE seed <> id GROUP BY ALL)
"""


@query("bfs_two_hop", _BFS + "SELECT seed, id, distance FROM b")
def bfs_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d)


@query(
    "expansion_containers",
    _BFS + """SELECT seed, id, kind, min(distance) AS distance FROM (SELECT seed, b.id, 'symbol' AS kind, distance FROM b JOIN gs USING (id) UNION ALL SELECT seed, file_id, 'file', distance FROM b JOIN gs USING (id)
    UNION ALL SELECT seed, module_id, 'module', distance FROM b JOIN gs USING (id)) GROUP BY ALL""",
)
def expansion_containers(spark: SparkSession, d: str) -> DataFrame:
    return T.with_containers(_reached(spark, d), V.g_symbols(spark, d))


_MODES = [["callers"], ["callees", "depends_on"], ["reverse_depends_on", "references"]]


@query(
    "bfs_mode_filtered",
    f"""WITH {V.GRAPH}, e AS (SELECT DISTINCT id, other, mode FROM (
      SELECT source_id AS id, target_id AS other, CASE relation_type WHEN 'calls' THEN 'callees' WHEN 'depends_on' THEN 'depends_on' WHEN 'references' THEN 'references' END AS mode FROM gr
      UNION ALL SELECT target_id, source_id, CASE relation_type WHEN 'calls' THEN 'callers' WHEN 'depends_on' THEN 'reverse_depends_on' WHEN 'references' THEN 'references' END FROM gr)
      WHERE mode IS NOT NULL AND other IN (SELECT id FROM gs)),
    h0 AS (SELECT id AS seed, list_extract([['callers'], ['callees', 'depends_on'], ['reverse_depends_on', 'references']], ({_N.format("id")} // 100 % 3 + 1)::int) AS modes FROM gs WHERE {_N.format("id")} % 100 = 0),
    h1 AS (SELECT DISTINCT seed, modes, other AS id FROM h0 JOIN e ON seed = e.id AND list_contains(modes, mode)),
    h2 AS (SELECT DISTINCT seed, modes, other AS id FROM h1 JOIN e ON h1.id = e.id AND list_contains(modes, mode))
    SELECT seed, id, min(dd) AS distance FROM (SELECT seed, id, 1 AS dd FROM h1 UNION ALL SELECT seed, id, 2 FROM h2) WHERE seed <> id GROUP BY ALL""",
)
def bfs_mode_filtered(spark: SparkSession, d: str) -> DataFrame:
    modes = F.array(*[F.array(*[F.lit(m) for m in ms]) for ms in _MODES])
    seeds = _seeds(spark, d).withColumn("modes", F.element_at(modes, (F.floor(_number("seed") / 100) % 3 + 1).cast("int")))
    return T.expand(seeds, V.g_relations(spark, d), 2, V.g_symbols(spark, d).select("id"))


_GAIN = """, qn AS (SELECT id AS seed, split_part(name, '_', 1) AS term FROM gs),
g AS (SELECT b.seed, count(*) AS found, count(*) FILTER (WHERE contains(gs.name, term) OR contains(gs.qualified_name, term)) AS relevant FROM b JOIN gs USING (id) JOIN qn USING (seed) WHERE distance = 2 GROUP BY ALL)
"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    s = V.g_symbols(spark, d)
    return s.select(F.col("id").alias("seed"), F.array(F.substring_index("name", "_", 1)).alias("terms"))


@query("expansion_gain", _BFS + _GAIN + "SELECT seed, found, relevant, round(relevant / found, 4) AS gain FROM g")
def expansion_gain(spark: SparkSession, d: str) -> DataFrame:
    return T.expansion_gain(_reached(spark, d), _terms(spark, d), V.g_symbols(spark, d))


@query(
    "expansion_gated",
    _BFS + _GAIN + "SELECT b.seed, count(*) AS objects FROM b LEFT JOIN g USING (seed) WHERE distance = 1 OR round(relevant / found, 4) >= 0.25 GROUP BY ALL",
)
def expansion_gated(spark: SparkSession, d: str) -> DataFrame:
    reached = _reached(spark, d)
    gain = T.expansion_gain(reached, _terms(spark, d), V.g_symbols(spark, d))
    return T.gated(reached, gain).groupBy("seed").agg(F.count("*").alias("objects"))


@query(
    "call_chain_edges",
    f"""WITH {V.GRAPH}, c AS (SELECT DISTINCT source_id, target_id FROM gr WHERE relation_type = 'calls'), h0 AS (SELECT id AS seed FROM gs WHERE {_N.format("id")} % 100 = 0),
    e0 AS (SELECT seed, source_id, target_id, 0 AS dd FROM h0 JOIN c ON seed = source_id),
    e1 AS (SELECT seed, c.source_id, c.target_id, 1 AS dd FROM (SELECT DISTINCT seed, target_id AS t FROM e0) JOIN c ON t = c.source_id),
    e2 AS (SELECT seed, c.source_id, c.target_id, 2 AS dd FROM (SELECT DISTINCT seed, target_id AS t FROM e1) JOIN c ON t = c.source_id)
    SELECT seed, source_id, target_id, min(dd) AS depth FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY ALL""",
)
def call_chain_edges(spark: SparkSession, d: str) -> DataFrame:
    return T.call_chain(_seeds(spark, d), V.g_relations(spark, d))


@query(
    "expansion_modes",
    "WITH t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, list_filter(["
    + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{h}')" for h in hints) + f" THEN '{mode}' END" for mode, hints in T.MODE_HINTS.items())
    + "], lambda x: x IS NOT NULL) AS m FROM t) SELECT doc_id, CASE WHEN len(m) > 0 THEN m ELSE ['callers', 'callees', 'depends_on', 'reverse_depends_on', 'references'] END AS modes FROM a",
)
def expansion_modes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", T.expansion_modes(F.col("text")).alias("modes"))


# -- ranking -----------------------------------------------------------------------------------------------------------

_Q = "'where is the ' || CASE WHEN a.type = 'class' THEN 'class' ELSE 'function' END || ' ' || a.name || ' used'"
_RANK = (
    _BFS
    + f""", q AS (SELECT a.*, {_Q} AS question, list_distinct(['where', 'is', 'the', CASE WHEN a.type = 'class' THEN 'class' ELSE 'function' END, a.name, 'used']) AS terms FROM gs a),
c AS (SELECT b.seed, s.id, s.file_id, s.module_id, s.name, s.type, distance,
  CASE WHEN s.id = b.seed THEN 10 WHEN s.file_id = q.file_id THEN 7 WHEN s.module_id = q.module_id THEN 4 ELSE 1 END AS ap,
  CASE WHEN list_contains(terms, s.name) OR list_contains(terms, s.qualified_name) THEN 10 WHEN len(list_filter(terms, lambda t: contains(s.name, t) OR contains(s.qualified_name, t))) > 0 THEN 5 ELSE 0 END AS nh,
  CASE WHEN (q.type = 'class' AND s.type = 'class') OR (q.type <> 'class' AND s.type IN ('function', 'method')) THEN 10 ELSE 0 END AS tm,
  (({_N.format("b.seed")} * 31 + {_N.format("s.id")} * 17) % 99991) / 99991 AS sim, CASE distance WHEN 1 THEN 8 ELSE 4 END AS dg, ({_N.format("s.id")} % 10 = 0)::int AS mem
  FROM b JOIN gs s USING (id) JOIN q ON b.seed = q.id),
sc AS (SELECT *, ((least(100000000 * (30 * ap + 15 * nh + 10 * tm + 10 * dg + 100 * mem)::bigint + 25 * floor(sim * 1000000000 + 0.5)::bigint, 100000000000) + 5000000) // 10000000) / 10000 AS score FROM c),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10)
"""
)


def scored(spark: SparkSession, d: str, reached: DataFrame | None = None) -> DataFrame:
    """Every candidate within two hops of every question's anchor with its fused score."""
    reached = _reached(spark, d) if reached is None else reached
    s = V.g_symbols(spark, d)
    q = s.select(
        F.col("id").alias("seed"),
        F.col("file_id").alias("anchor_file"),
        F.col("module_id").alias("anchor_module"),
        F.concat(F.lit("where is the "), F.when(F.col("type") == "class", "class").otherwise("function"), F.lit(" "), "name", F.lit(" used")).alias("question"),
    ).withColumn("terms", X.identifiers(F.col("question")))
    c = reached.join(s.select("id", "file_id", "module_id", "name", "qualified_name", "type"), "id").join(q, "seed")
    similarity = ((_number("seed") * 31 + _number("id") * 17) % 99991) / 99991
    score = R.fused(
        R.anchor_proximity(F.col("id"), F.col("file_id"), F.col("module_id"), F.col("seed"), F.col("anchor_file"), F.col("anchor_module")),
        R.name_hit(F.col("name"), F.col("qualified_name"), F.col("terms")),
        R.type_match(F.col("type"), F.col("question")),
        similarity,
        R.distance_score(F.col("distance")),
        _number("id") % 10 == 0,
    )
    return c.select("seed", "id", "file_id", "module_id", "type", "distance", score.alias("score"))


def top_ranked(spark: SparkSession, d: str, reached: DataFrame | None = None) -> DataFrame:
    """The ten best of every question, written once: what follows reads them several times."""
    return cut(R.ranked(scored(spark, d, reached)), "ranked")


@query("rank_fusion", _RANK + "SELECT seed, id, score, rank FROM r")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(scored(spark, d)).select("seed", "id", "score", "rank")


@query("baseline_boost", _RANK + "SELECT seed, id, greatest(score, CASE WHEN distance <= 1 THEN 0.85 ELSE 0.65 END)::double AS score FROM r")
def baseline_boost(spark: SparkSession, d: str) -> DataFrame:
    r = top_ranked(spark, d)
    return r.select("seed", "id", F.greatest("score", R.baseline(F.lit("symbol"), F.col("distance"))).alias("score"))


_METRICS = """, n AS (SELECT seed, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL),
mk AS (SELECT seed, max(k) AS k FROM (SELECT seed, count(*) AS k FROM r WHERE rank <= 5 GROUP BY seed, module_id UNION ALL SELECT seed, count(*) FROM r WHERE rank <= 5 GROUP BY seed, file_id) GROUP BY ALL),
mc AS (SELECT seed, round(k / n, 4) AS c FROM n JOIN mk USING (seed)),
me AS (SELECT seed, CASE WHEN count(*) FILTER (WHERE score >= 0.55) = 0 THEN 0.0 ELSE round(least(1.0, count(*) FILTER (WHERE score >= 0.55) * sum(score::decimal(12,4))::double / count(*) / 2.0) + 1e-9, 4) END AS e FROM r GROUP BY ALL),
mo AS (SELECT seed, module_id, count(*) AS k FROM r GROUP BY ALL),
mr AS (SELECT seed, CASE WHEN count(*) <= 1 THEN 1.0 ELSE round(greatest(1 - (log2(sum(k)) - sum(k * log2(k)) / sum(k)) / log2(count(*)), 0.0), 4) END AS r FROM mo GROUP BY ALL),
mg AS (SELECT b.seed, round(count(*) FILTER (WHERE b.distance = 2 AND coalesce(r.score, 0) >= 0.55) / count(*), 4) AS g FROM b LEFT JOIN r USING (seed, id) GROUP BY b.seed),
mm AS (SELECT seed, (40 + seed_n % 60) / 100 AS a, c, e, g, r FROM (SELECT *, substr(seed, 3)::bigint // 100 AS seed_n FROM mc) JOIN me USING (seed) JOIN mr USING (seed) JOIN mg USING (seed))
"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """seed, a, c, e, g, r of every question; the anchor's confidence is spread over .40 to .99."""
    reached = cut(_reached(spark, d), "reached")
    ranked = top_ranked(spark, d, reached)
    g = E.gain(reached, reached.filter("distance = 1"), ranked)
    c = E.concentration(ranked)
    a = ((F.lit(40) + F.floor(_number("seed") / 100) % 60) / 100).alias("a")
    return c.select("seed", a, "c").join(E.evidence(ranked), "seed").join(g, "seed").join(E.consistency(ranked), "seed")


@query("retrieval_metrics", _RANK + _METRICS + "SELECT seed, a, c, e, g, r FROM mm")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d)


@query(
    "strategy_route",
    _RANK
    + _METRICS
    + """, x AS (SELECT *, NOT (a >= 0.8 AND c >= 0.55 AND e >= 0.6 AND g >= 0.25) AND (a < 0.4 OR c < 0.35 OR e < 0.4 OR r < 0.4 OR g < 0.25) AS dg FROM mm)
    SELECT seed, CASE WHEN dg THEN 'S4' WHEN a >= 0.8 AND e >= 0.6 THEN 'S1' WHEN a >= 0.6 AND e >= 0.6 AND c >= 0.55 THEN 'S1' WHEN a >= 0.6 AND e < 0.6 AND c >= 0.45 THEN 'S2'
    WHEN a < 0.6 AND c >= 0.55 THEN 'S3' ELSE 'S4' END AS strategy FROM x""",
)
def strategy_route(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("seed", E.strategy().alias("strategy"))


@query(
    "infer_anchor",
    _RANK
    + """, t AS (SELECT seed, count(*) AS n FROM r GROUP BY ALL), fl AS (SELECT seed, file_id AS anchor_id, count(*) AS k, min(rank) AS f FROM r GROUP BY ALL),
    mo AS (SELECT seed, module_id AS anchor_id, count(*) AS k, min(rank) AS f FROM r GROUP BY ALL),
    u AS (SELECT seed, 'file' AS level, anchor_id, 0.60::double AS confidence FROM (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY seed ORDER BY k DESC, f, anchor_id) = 1) JOIN t USING (seed) WHERE k / n >= 0.55
      UNION ALL SELECT seed, 'module', anchor_id, 0.55 FROM (SELECT * FROM mo QUALIFY row_number() OVER (PARTITION BY seed ORDER BY k DESC, f, anchor_id) = 1) JOIN t USING (seed) WHERE k / n >= 0.55)
    SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY seed ORDER BY level) = 1""",
)
def infer_anchor(spark: SparkSession, d: str) -> DataFrame:
    return E.inferred_anchor(top_ranked(spark, d))


@query(
    "degraded_answer_mode",
    _RANK
    + """, n AS (SELECT seed, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL),
    mk AS (SELECT seed, max(k) AS k FROM (SELECT seed, count(*) AS k FROM r WHERE rank <= 5 GROUP BY seed, module_id UNION ALL SELECT seed, count(*) FROM r WHERE rank <= 5 GROUP BY seed, file_id) GROUP BY ALL),
    l AS (SELECT seed, coalesce(array_to_string((list(id ORDER BY rank) FILTER (WHERE score >= 0.6))[1:5], ','), '') AS sure, coalesce(array_to_string((list(id ORDER BY rank) FILTER (WHERE score < 0.6))[1:5], ','), '') AS unsure, count(*) AS m FROM r GROUP BY ALL)
    SELECT seed, CASE WHEN sure <> '' AND unsure <> '' THEN 'partial' WHEN round(k / n, 4) < 0.5 AND m >= 2 THEN 'candidates' ELSE 'guided_symbol' END AS mode, sure, unsure FROM l JOIN n USING (seed) JOIN mk USING (seed)""",
)
def degraded_answer_mode(spark: SparkSession, d: str) -> DataFrame:
    ranked = top_ranked(spark, d)
    return E.degraded_mode(ranked, E.concentration(ranked).withColumn("level", F.lit("symbol")))


@query("evidence_summary", _RANK + "SELECT seed, array_to_string(list(id || ':' || round(score::decimal(12, 4), 2)::decimal(12, 2)::varchar ORDER BY rank), ', ') AS line FROM r WHERE rank <= 5 GROUP BY ALL")
def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.evidence_line(top_ranked(spark, d))


@query(
    "context_objects",
    _RANK + ", cx AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rank FROM sc) SELECT seed, id, rank FROM cx WHERE rank <= 8",
)
def context_objects(spark: SparkSession, d: str) -> DataFrame:
    return R.context_order(scored(spark, d).withColumn("kind", F.lit("symbol"))).select("seed", "id", "rank")


@query(
    "context_relations",
    _RANK
    + """, ch AS (SELECT seed, id FROM r WHERE rank <= 3),
    rel AS (SELECT DISTINCT seed, source_id || '>' || target_id || ':' || relation_type AS id, source_id, target_id FROM (SELECT DISTINCT seed FROM r) JOIN gr ON seed = source_id OR seed = target_id),
    hit AS (SELECT DISTINCT rel.seed, rel.id FROM rel JOIN ch ON rel.seed = ch.seed AND (ch.id = source_id OR ch.id = target_id)),
    kept AS (SELECT rel.seed, rel.id FROM rel WHERE (rel.seed, rel.id) IN (SELECT (seed, id) FROM hit) OR rel.seed NOT IN (SELECT seed FROM hit))
    SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY id) AS rank FROM kept QUALIFY rank <= 6""",
)
def context_relations(spark: SparkSession, d: str) -> DataFrame:
    ranked = top_ranked(spark, d)
    seeds = ranked.select("seed").distinct()
    r = V.g_relations(spark, d).withColumn("id", F.concat("source_id", F.lit(">"), "target_id", F.lit(":"), "relation_type"))
    of = r.withColumn("seed", F.explode(F.array_distinct(F.array("source_id", "target_id")))).join(seeds, "seed", "left_semi").select("seed", "id", "source_id", "target_id")
    return R.relations_for_context(of, ranked.filter("rank <= 3")).select("seed", "id", "rank")


# -- recall ------------------------------------------------------------------------------------------------------------

_RECALL = f"""WITH {V.GRAPH}, an AS (SELECT id AS seed, 'symbol' AS level FROM gs WHERE {_N.format("id")} % 100 = 0 UNION ALL SELECT id, 'file' FROM gf WHERE {_N.format("id")} % 100 = 0 UNION ALL SELECT id, 'module' FROM gm),
e AS (SELECT source_id AS id, target_id AS other FROM gr UNION SELECT target_id, source_id FROM gr),
sy AS (SELECT seed, gs.* FROM an JOIN gs ON seed = gs.id),
st AS (SELECT seed, id, kind, min(distance) AS distance FROM (
  SELECT seed, file_id AS id, 'file' AS kind, 1 AS distance FROM sy UNION ALL SELECT seed, module_id, 'module', 1 FROM sy
  UNION ALL SELECT seed, other, 'symbol', NULL FROM sy JOIN e ON sy.id = e.id WHERE other <> e.id AND other IN (SELECT id FROM gs)
  UNION ALL SELECT seed, module_id, 'module', 1 FROM an JOIN gf ON seed = gf.id UNION ALL SELECT seed, gs.id, 'symbol', 1 FROM an JOIN gs ON seed = gs.file_id
  UNION ALL SELECT seed, gf.id, 'file', 1 FROM an JOIN gf ON seed = gf.module_id) GROUP BY ALL)
"""


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    s, f, m = V.g_symbols(spark, d), V.g_files(spark, d), V.g_modules(spark, d)
    pick = lambda df, level: df.select(F.col("id").alias("seed"), "id", F.lit(level).alias("level"))
    return pick(s.filter(_number("id") % 100 == 0), "symbol").unionByName(pick(f.filter(_number("id") % 100 == 0), "file")).unionByName(pick(m, "module"))


def _structured(spark: SparkSession, d: str) -> DataFrame:
    return Q.structured_recall(_anchors(spark, d), V.g_modules(spark, d), V.g_files(spark, d), V.g_symbols(spark, d), V.g_relations(spark, d))


@query("structured_recall", _RECALL + "SELECT seed, id, kind, distance FROM st")
def structured_recall(spark: SparkSession, d: str) -> DataFrame:
    return _structured(spark, d)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of every hundredth one, as hits on the symbols of the same numbers."""
    from graphlens.operators.vectors import nearest

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("symbol").alias("kind"), F.col("embedding").alias("vector"))
    near = nearest(rows, rows.filter("id % 100 = 0"), "cosine", 20, 0.0)
    return near.select(F.concat(F.lit("S_"), "query_id").alias("seed"), F.concat(F.lit("S_"), "id").alias("id"), "kind", "similarity")


_HYBRID = (
    _RECALL
    + """, ve AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings), vp AS (SELECT a.id AS q, b.id AS i, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS s FROM ve a, ve b WHERE a.id % 100 = 0 AND a.id <> b.id),
vh AS (SELECT 'S_' || q AS seed, 'S_' || i AS id, 'symbol' AS kind, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, i) AS rn FROM vp WHERE s >= 0) WHERE rn <= 20),
hy AS (SELECT coalesce(st.seed, vh.seed) AS seed, coalesce(st.id, vh.id) AS id, coalesce(st.kind, vh.kind) AS kind, distance, coalesce(similarity, 0.0) AS similarity FROM st FULL JOIN vh ON st.seed = vh.seed AND st.id = vh.id AND st.kind = vh.kind)
"""
)


@query("hybrid_recall", _HYBRID + "SELECT seed, id, kind, distance, round(similarity, 6)::double AS similarity FROM hy")
def hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    return Q.hybrid(_structured(spark, d), _hits(spark, d)).withColumn("similarity", F.round("similarity", 6))


_ANSWER = (
    _HYBRID
    + r""", ob AS (SELECT id, 'symbol' AS kind, name, qualified_name AS other, type, file_id, module_id FROM gs UNION ALL SELECT id, 'file', name, path, 'file', id, module_id FROM gf UNION ALL SELECT id, 'module', name, path, 'module', NULL, id FROM gm),
q0 AS (SELECT seed, level, substr(seed, 3)::bigint AS nr, 'where is the ' || CASE WHEN level = 'symbol' THEN CASE WHEN type = 'class' THEN 'class' ELSE 'function' END ELSE level END || ' ' || name || ' used' AS question, file_id AS af, module_id AS am FROM an JOIN ob ON seed = id),
q AS (SELECT *, (40 + nr % 60) / 100 AS a, list_filter(list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z_][\p{L}\p{N}_./:-]*'), lambda t: lower(regexp_replace(t, '^[.,:;()\[\]{}<>]+|[.,:;()\[\]{}<>]+$', '', 'g')))), lambda t: length(t) > 1) AS terms FROM q0),
cd AS (SELECT seed, id, kind, distance, similarity, false AS added FROM hy),
fx AS (SELECT cd.seed, cd.id, cd.kind, distance, ob.file_id, ob.module_id, added,
  CASE WHEN ob.file_id = af THEN 7 WHEN ob.module_id = am THEN 4 ELSE 1 END AS ap,
  CASE WHEN list_contains(terms, lower(name)) OR list_contains(terms, lower(other)) THEN 10 WHEN len(list_filter(terms, lambda t: contains(lower(name), t) OR contains(lower(other), t))) > 0 THEN 5 ELSE 0 END AS nh,
  CASE WHEN (contains(question, ' class ') AND type = 'class') OR (contains(question, ' function ') AND type IN ('function', 'method')) OR (contains(question, ' file ') AND type = 'file') OR (contains(question, ' module ') AND type = 'module') THEN 10 ELSE 0 END AS tm,
  floor(least(greatest(similarity, 0.0), 1.0) * 1000000000 + 0.5)::bigint AS sim, CASE WHEN distance IS NULL THEN 0 WHEN distance <= 0 THEN 10 WHEN distance = 1 THEN 8 WHEN distance = 2 THEN 4 ELSE 1 END AS dg
  FROM cd JOIN ob ON cd.id = ob.id AND cd.kind = ob.kind JOIN q ON cd.seed = q.seed WHERE cd.id <> cd.seed),
sc AS (SELECT *, greatest(((least(100000000 * (30 * ap + 15 * nh + 10 * tm + 10 * dg)::bigint + 25 * sim, 100000000000) + 5000000) // 10000000) / 10000,
  CASE WHEN distance IS NULL THEN 0.0 WHEN kind = 'symbol' THEN CASE WHEN distance <= 1 THEN 0.85 ELSE 0.65 END WHEN kind = 'file' THEN CASE WHEN distance <= 1 THEN 0.7 ELSE 0.55 END ELSE CASE WHEN distance <= 1 THEN 0.6 ELSE 0.45 END END)::double AS score FROM fx),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 10),
n AS (SELECT seed, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL),
mk AS (SELECT seed, max(k) AS k FROM (SELECT seed, count(*) AS k FROM r WHERE rank <= 5 AND module_id IS NOT NULL GROUP BY seed, module_id UNION ALL SELECT seed, count(*) FROM r WHERE rank <= 5 AND file_id IS NOT NULL GROUP BY seed, file_id) GROUP BY ALL),
mc AS (SELECT seed, round(coalesce(k, 0) / n, 4) AS c FROM n LEFT JOIN mk USING (seed)),
me AS (SELECT seed, CASE WHEN count(*) FILTER (WHERE score >= 0.55) = 0 THEN 0.0 ELSE round(least(1.0, count(*) FILTER (WHERE score >= 0.55) * sum(score::decimal(12,4))::double / count(*) / 2.0) + 1e-9, 4) END AS e FROM r GROUP BY ALL),
mo AS (SELECT seed, module_id, count(*) AS k FROM r WHERE module_id IS NOT NULL GROUP BY ALL),
mr AS (SELECT seed, CASE WHEN count(*) <= 1 THEN 1.0 ELSE round(greatest(1 - (log2(sum(k)) - sum(k * log2(k)) / sum(k)) / log2(count(*)), 0.0), 4) END AS r FROM mo GROUP BY ALL),
mm AS (SELECT q.seed, q.level, a, coalesce(c, 0) AS c, coalesce(e, 0) AS e, 1.0 AS g, coalesce(r, 0) AS r FROM q LEFT JOIN mc USING (seed) LEFT JOIN me USING (seed) LEFT JOIN mr USING (seed)),
st2 AS (SELECT *, NOT (a >= 0.8 AND c >= 0.55 AND e >= 0.6 AND g >= 0.25) AND (a < 0.4 OR c < 0.35 OR e < 0.4 OR r < 0.4 OR g < 0.25) AS dgr FROM mm),
ro AS (SELECT seed, level, a, c, e, g, r, CASE WHEN dgr THEN 'S4' WHEN a >= 0.8 AND e >= 0.6 THEN 'S1' WHEN a >= 0.6 AND e >= 0.6 AND c >= 0.55 THEN 'S1' WHEN a >= 0.6 AND e < 0.6 AND c >= 0.45 THEN 'S2' WHEN a < 0.6 AND c >= 0.55 THEN 'S3' ELSE 'S4' END AS strategy FROM st2)
"""
)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A question about every anchor; confidences are spread over .40 to .99."""
    from graphlens.api import located

    o = located(_graph(spark, d)).select("id", F.col("kind").alias("level"), "name", "type")
    what = F.when(F.col("level") != "symbol", F.col("level")).when(F.col("type") == "class", "class").otherwise("function")
    asked = _anchors(spark, d).join(o, ["id", "level"])
    return asked.select("seed", "id", "level", F.concat(F.lit("where is the "), what, F.lit(" "), "name", F.lit(" used")).alias("question"), ((40 + _number("id") % 60) / 100).alias("confidence"))


def _graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"modules": V.g_modules(spark, d), "files": V.g_files(spark, d).withColumn("repo_id", F.lit("r")), "symbols": V.g_symbols(spark, d).withColumn("repo_id", F.lit("r")), "relations": V.g_relations(spark, d)}


@query(
    "answer_modes",
    _ANSWER
    + """, l AS (SELECT seed, count(*) FILTER (WHERE score >= 0.6) AS su, count(*) FILTER (WHERE score < 0.6) AS un, count(*) AS m FROM r GROUP BY ALL)
    SELECT seed, a::double AS a, c::double AS c, e::double AS e, g::double AS g, r::double AS r, strategy, CASE WHEN strategy = 'S4' THEN CASE WHEN su > 0 AND un > 0 THEN 'partial' WHEN c < 0.5 AND m >= 2 THEN 'candidates' WHEN level = 'module' THEN 'guided_module' WHEN level = 'file' THEN 'guided_file' WHEN m > 0 THEN 'guided_symbol' ELSE 'generic' END END AS mode
    FROM ro LEFT JOIN l USING (seed)""",
)
def answer_modes(spark: SparkSession, d: str) -> DataFrame:
    """All questions through recall, fusion, metrics and strategy."""
    from graphlens.api import ask

    return ask(_graph(spark, d), _questions(spark, d), _hits(spark, d))


@query(
    "strategy_execute",
    _ANSWER
    + """, s2 AS (SELECT seed FROM ro WHERE strategy = 'S2'),
    b0 AS (SELECT DISTINCT seed, id FROM (SELECT r.seed, id FROM r JOIN s2 USING (seed) WHERE kind = 'symbol' UNION ALL SELECT seed, seed FROM an JOIN s2 USING (seed) WHERE level = 'symbol')),
    ke AS (SELECT source_id AS id, target_id AS other FROM gr WHERE relation_type IN ('calls', 'depends_on', 'references') AND target_id IN (SELECT id FROM gs) UNION SELECT target_id, source_id FROM gr WHERE relation_type IN ('calls', 'depends_on', 'references') AND source_id IN (SELECT id FROM gs)),
    b1 AS (SELECT DISTINCT seed, other AS id FROM b0 JOIN ke USING (id) EXCEPT SELECT * FROM b0),
    b2 AS (SELECT DISTINCT seed, other AS id FROM b1 JOIN ke USING (id) EXCEPT SELECT * FROM b0 EXCEPT SELECT * FROM b1),
    gn AS (SELECT seed, count(*) FILTER (WHERE len(list_filter(terms, lambda t: contains(gs.name, t) OR contains(qualified_name, t))) > 0) / count(*) AS gain FROM b2 JOIN gs USING (id) JOIN q USING (seed) GROUP BY ALL),
    bb AS (SELECT seed, id, 1 AS distance FROM b1 UNION ALL SELECT seed, id, 2 FROM b2 JOIN gn USING (seed) WHERE round(gain, 4) >= 0.25),
    ex AS (SELECT seed, id, 'symbol' AS kind, distance, true AS added FROM bb UNION ALL SELECT seed, file_id, 'file', distance, true FROM bb JOIN gs USING (id) UNION ALL SELECT seed, module_id, 'module', distance, true FROM bb JOIN gs USING (id)
      UNION ALL SELECT r.seed, id, kind, 1, false FROM r JOIN s2 USING (seed)),
    cd2 AS (SELECT seed, id, kind, min(distance) AS distance, 0.0 AS similarity, bool_and(added) AS added FROM ex GROUP BY ALL),
    """
    + _ANSWER[_ANSWER.index("fx AS (SELECT") : _ANSWER.index("n AS (SELECT seed, count(*) AS n FROM r WHERE rank <= 5")].replace("fx ", "fx2 ").replace("FROM fx)", "FROM fx2)").replace("sc AS (", "sc2 AS (").replace("FROM sc QUALIFY", "FROM sc2 QUALIFY").replace("r AS (SELECT *, row", "r2 AS (SELECT *, row").replace("cd.", "cd2.").replace("FROM cd JOIN", "FROM cd2 JOIN").rstrip().rstrip(",")
    + """
    SELECT seed, strategy, id, rank, score, false AS added FROM r JOIN ro USING (seed) WHERE strategy <> 'S2' UNION ALL SELECT seed, 'S2', id, rank, score, added FROM r2""",
)
def strategy_execute(spark: SparkSession, d: str) -> DataFrame:
    """All questions with the objects that their strategies end with."""
    from graphlens.api import answer

    return answer(_graph(spark, d), _questions(spark, d), _hits(spark, d))


@query("embedding_build")
def embedding_build(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all objects with a summary."""
    rows = [df.select("repo_id", "id", F.lit(kind).alias("kind"), "summary") for kind, df in (("module", V.modules(spark, d)), ("file", V.files(spark, d)), ("symbol", V.symbols(spark, d)))]
    return Q.build_embeddings(rows[0].unionByName(rows[1]).unionByName(rows[2]))
