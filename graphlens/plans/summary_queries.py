"""Queries on summaries, vectors and resolution of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.functions import vector as VF
from graphlens.operators import lookup as L
from graphlens.operators import resolve as R
from graphlens.operators import summarize as S
from graphlens.operators import vectors as E
from graphlens.plans import views as V
from graphlens.plans.lookup_queries import _ENDS
from graphlens.plans.registry import query
from graphlens.tables import table


def _case(target: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({target}, '{k}') THEN '{v}'" for k, v in rules) + f" ELSE {default} END"


_MODULE = _case("lower(name || '/' || path)", C.MODULE_RULES, "'Module'")
_FILE = _case("lower(name)", C.FILE_RULES, "CASE lower(language) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGE_LABELS.items()) + " ELSE 'Source File' END")
_SYMBOL = _case("lower(name)", C.SYMBOL_RULES, "upper(type[1:1]) || type[2:]")


@query(
    "core_files_top5",
    f"""WITH {V.CODE}, n AS (SELECT repo_id, file_id AS id, count(*) AS n_symbols FROM s GROUP BY ALL)
    SELECT repo_id, module_id, id, coalesce(n_symbols, 0) AS n_symbols, row_number() OVER (PARTITION BY repo_id, module_id ORDER BY coalesce(n_symbols, 0) DESC, path, id) AS rank
    FROM f LEFT JOIN n USING (repo_id, id) QUALIFY rank <= 5""",
)
def core_files_top5(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("repo_id", "module_id", "id", "path")
    return S.core_files(f, V.symbols(spark, d).select("repo_id", "file_id"), ["repo_id", "module_id"]).drop("path")


@query(
    "core_symbols_top10",
    f"""WITH {V.CODE} SELECT repo_id, module_id, id, qualified_name, row_number() OVER (PARTITION BY repo_id, module_id ORDER BY qualified_name, id) AS rank
    FROM s WHERE visibility = 'public' AND type IN ('class', 'function', 'method') QUALIFY rank <= 10""",
)
def core_symbols_top10(spark: SparkSession, d: str) -> DataFrame:
    return S.core_symbols(V.symbols(spark, d), ["repo_id", "module_id"]).select("repo_id", "module_id", "id", "qualified_name", "rank")


@query(
    "adjacent_modules",
    _ENDS + "SELECT DISTINCT module_id, other FROM (SELECT source_module AS module_id, target_module AS other FROM x UNION ALL SELECT target_module, source_module FROM x) WHERE module_id <> other",
)
def adjacent_modules(spark: SparkSession, d: str) -> DataFrame:
    return S.adjacent_modules(V.g_relations(spark, d), V.g_symbols(spark, d))


@query(
    "file_dependencies",
    f"""WITH {V.GRAPH}, e AS (SELECT source_id AS id, target_id AS other FROM gr UNION SELECT target_id, source_id FROM gr)
    SELECT DISTINCT a.file_id, b.qualified_name AS dependency FROM e JOIN gs a ON e.id = a.id JOIN gs b ON e.other = b.id WHERE a.file_id <> b.file_id""",
)
def file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return S.file_dependencies(V.g_relations(spark, d), V.g_symbols(spark, d))


@query(
    "callers_callees",
    f"""WITH {V.GRAPH}, e AS (SELECT source_id AS id, target_id AS other, 'callee' AS role FROM gr UNION ALL SELECT target_id, source_id, 'caller' FROM gr),
    j AS (SELECT e.id, role, coalesce(b.qualified_name, other) AS name, a.module_id AS am, b.module_id AS bm FROM e JOIN gs a ON e.id = a.id LEFT JOIN gs b ON e.other = b.id)
    SELECT DISTINCT id, role, name FROM j UNION SELECT DISTINCT id, 'external', name FROM j WHERE am IS DISTINCT FROM bm""",
)
def callers_callees(spark: SparkSession, d: str) -> DataFrame:
    return S.related_names(V.g_relations(spark, d), V.g_symbols(spark, d))


@query(
    "responsibility_labels",
    f"""WITH {V.CODE} SELECT repo_id, id, 'module' AS kind, {_MODULE} AS label FROM m UNION ALL SELECT repo_id, id, 'file', {_FILE} FROM f
    UNION ALL SELECT repo_id, id, 'symbol', {_SYMBOL} FROM s""",
)
def responsibility_labels(spark: SparkSession, d: str) -> DataFrame:
    m = V.modules(spark, d).select("repo_id", "id", F.lit("module").alias("kind"), S.module_label().alias("label"))
    f = V.files(spark, d).select("repo_id", "id", F.lit("file").alias("kind"), X.file_label(F.col("name"), F.col("language")).alias("label"))
    s = V.symbols(spark, d).select("repo_id", "id", F.lit("symbol").alias("kind"), S.symbol_label().alias("label"))
    return m.unionByName(f).unionByName(s)


@query(
    "signature_parse",
    f"""WITH {V.CODE} SELECT repo_id, id,
    list_filter(list_transform(str_split(regexp_extract(trim(signature), '^[^(]+\\(([^)]*)\\)\\s*(?:->\\s*(.+))?$', 1), ','), lambda p: trim(p)), lambda p: p <> '') AS parameters,
    nullif(trim(regexp_extract(trim(signature), '^[^(]+\\(([^)]*)\\)\\s*(?:->\\s*(.+))?$', 2)), '') AS return_value FROM s WHERE signature IS NOT NULL""",
)
def signature_parse(spark: SparkSession, d: str) -> DataFrame:
    s = V.symbols(spark, d).filter("signature is not null")
    return s.select("repo_id", "id", X.parameters(F.col("signature")).alias("parameters"), X.return_type(F.col("signature")).alias("return_value"))


@query(
    "module_summaries",
    _ENDS
    + f""", n AS (SELECT file_id AS id, count(*) AS c FROM gs GROUP BY ALL),
    cf AS (SELECT module_id AS id, list(path ORDER BY rank) AS core_files FROM (SELECT module_id, path, row_number() OVER (PARTITION BY module_id ORDER BY coalesce(c, 0) DESC, path, gf.id) AS rank
           FROM gf LEFT JOIN n USING (id)) WHERE rank <= 5 GROUP BY ALL),
    cs AS (SELECT module_id AS id, list(qualified_name ORDER BY rank) AS core_symbols FROM (SELECT module_id, qualified_name, row_number() OVER (PARTITION BY module_id ORDER BY qualified_name, id) AS rank
           FROM gs WHERE visibility = 'public') WHERE rank <= 10 GROUP BY ALL),
    am AS (SELECT module_id AS id, list_sort(list(DISTINCT other)) AS adjacent_modules FROM (SELECT source_module AS module_id, target_module AS other FROM x UNION ALL SELECT target_module, source_module FROM x)
           WHERE module_id <> other GROUP BY ALL)
    SELECT id, to_json(struct_pack(adjacent_modules := coalesce(adjacent_modules, []), core_files := coalesce(core_files, []), core_symbols := coalesce(core_symbols, []), module_path := path,
           responsibility_label := {_MODULE}))::varchar AS summary FROM gm LEFT JOIN cf USING (id) LEFT JOIN cs USING (id) LEFT JOIN am USING (id)""",
)
def module_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = V.g_symbols(spark, d)
    return S.module_summaries(V.g_modules(spark, d), V.g_files(spark, d), s, S.adjacent_modules(V.g_relations(spark, d), s))


_PARTS = f"""WITH {V.GRAPH}, e2 AS (SELECT source_id AS id, target_id AS other FROM gr UNION SELECT target_id, source_id FROM gr),
fd AS (SELECT DISTINCT a.file_id AS id, 'dependencies' AS role, coalesce(b.qualified_name, other) AS name FROM e2 JOIN gs a ON e2.id = a.id LEFT JOIN gs b ON other = b.id WHERE b.file_id IS NULL OR a.file_id <> b.file_id
  UNION SELECT file_id, 'main_symbols', qualified_name FROM gs WHERE visibility = 'public'),
sd AS (SELECT DISTINCT x.id, unnest(list_filter([CASE dir WHEN 'in' THEN 'callers' ELSE 'callees' END, CASE WHEN a.module_id IS DISTINCT FROM b.module_id THEN 'external_dependencies' END], lambda r: r IS NOT NULL)) AS role, coalesce(b.qualified_name, other) AS name
  FROM (SELECT source_id AS id, target_id AS other, 'out' AS dir FROM gr UNION SELECT target_id, source_id, 'in' FROM gr) x JOIN gs a ON x.id = a.id LEFT JOIN gs b ON other = b.id),
"""


def _listed(of: str, roles: tuple[str, ...]) -> str:
    lists = ", ".join(f"list(name ORDER BY name) FILTER (WHERE role = '{r}') AS {r}" for r in roles)
    return f"num AS (SELECT *, (row_number() OVER (PARTITION BY id, role ORDER BY name) - 1) // 1000 AS part FROM {of}), li AS (SELECT id, part, {lists} FROM num GROUP BY ALL)"


@query(
    "file_summaries",
    _PARTS
    + _listed("fd", ("dependencies", "main_symbols"))
    + f""", g AS (SELECT gf.*, 'python' AS language FROM gf) SELECT g.id, coalesce(part, 0)::int AS part, to_json(struct_pack(dependencies := coalesce(dependencies, []), file_path := g.path, main_symbols := coalesce(main_symbols, []), module := coalesce(gm.path, g.module_id),
      responsibility_label := {_FILE.replace("lower(name)", "lower(g.name)")}))::varchar AS summary FROM g LEFT JOIN gm ON g.module_id = gm.id LEFT JOIN li ON g.id = li.id""",
)
def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    return S.file_summaries(V.g_modules(spark, d), V.g_files(spark, d).withColumn("language", F.lit("python")), V.g_symbols(spark, d), V.g_relations(spark, d))


@query(
    "symbol_summaries",
    _PARTS
    + _listed("sd", ("callees", "callers", "external_dependencies"))
    + f""" SELECT gs.id, coalesce(part, 0)::int AS part, to_json(struct_pack(callees := coalesce(callees, []), callers := coalesce(callers, []), external_dependencies := coalesce(external_dependencies, []), file := coalesce(gf.path, file_id), module := coalesce(gm.path, gs.module_id),
      name := gs.name, responsibility_label := {_SYMBOL.replace("lower(name)", "lower(gs.name)")}))::varchar AS summary FROM gs LEFT JOIN gf ON file_id = gf.id LEFT JOIN gm ON gs.module_id = gm.id LEFT JOIN li ON gs.id = li.id""",
)
def symbol_summaries(spark: SparkSession, d: str) -> DataFrame:
    return S.symbol_summaries(V.g_modules(spark, d), V.g_files(spark, d), V.g_symbols(spark, d), V.g_relations(spark, d))


@query(
    "relation_summaries",
    f"""WITH {V.GRAPH} SELECT source_id, target_id, relation_type, to_json(struct_pack(relation_type := relation_type, relationship_label := a.qualified_name || ' ' || CASE relation_type WHEN 'calls' THEN 'calls' WHEN 'implements' THEN 'implements'
    WHEN 'depends_on' THEN 'depends on' WHEN 'references' THEN 'references' ELSE 'relates to' END || ' ' || b.qualified_name, source_module := a.module_id, source_name := a.qualified_name, source_type := a.type,
    target_module := b.module_id, target_name := b.qualified_name, target_type := b.type))::varchar AS summary FROM gr JOIN gs a ON source_id = a.id JOIN gs b ON target_id = b.id""",
)
def relation_summaries(spark: SparkSession, d: str) -> DataFrame:
    return S.relation_summaries(V.g_relations(spark, d), V.g_symbols(spark, d))


@query(
    "relation_labels",
    f"""WITH {V.GRAPH} SELECT source_id, target_id, relation_type, a.qualified_name || ' ' || CASE relation_type WHEN 'calls' THEN 'calls' WHEN 'implements' THEN 'implements'
    WHEN 'depends_on' THEN 'depends on' WHEN 'references' THEN 'references' ELSE 'relates to' END || ' ' || b.qualified_name AS label FROM gr JOIN gs a ON source_id = a.id JOIN gs b ON target_id = b.id""",
)
def relation_labels(spark: SparkSession, d: str) -> DataFrame:
    s = V.g_symbols(spark, d).select("id", "qualified_name")
    r = V.g_relations(spark, d).join(s.withColumnsRenamed({"id": "source_id", "qualified_name": "a"}), "source_id").join(s.withColumnsRenamed({"id": "target_id", "qualified_name": "b"}), "target_id")
    return r.select("source_id", "target_id", "relation_type", X.relation_text(F.col("a"), F.col("relation_type"), F.col("b")).alias("label"))


# -- vectors -----------------------------------------------------------------------------------------------------------

_KNN = """WITH e AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings), q AS (SELECT id AS query_id, v AS w FROM e WHERE id % 100 = 0),
p AS (SELECT query_id, id, round({0}, 9) AS similarity FROM q, e WHERE id <> query_id)
SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p {1}) WHERE rank <= 10"""
_COS = "CASE WHEN list_dot_product(w, w) * list_dot_product(v, v) > 0 THEN list_dot_product(w, v) / (sqrt(list_dot_product(w, w)) * sqrt(list_dot_product(v, v))) ELSE 0 END"


def _knn(spark: SparkSession, d: str, metric: str, least: float | None) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("kind"), F.col("embedding").alias("vector"))
    return E.nearest(rows, rows.filter("id % 100 = 0"), metric, 10, least).select("query_id", "id", "similarity", "rank")


@query("knn_cosine", _KNN.format(_COS, "WHERE similarity >= 0.0"))
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cosine", 0.0)


@query("knn_l2", _KNN.format("1 / (1 + list_distance(w, v))", ""))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "l2", None)


@query("knn_ip", _KNN.format("list_dot_product(w, v)", ""))
def knn_ip(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "ip", None)


@query(
    "knn_bucketed",
    """WITH e AS (SELECT DISTINCT ON (id) id, lower(trim(object_type)) AS kind, embedding::double[] AS v FROM object_embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
    n AS (SELECT *, len(v) AS l, sqrt(list_dot_product(v, v)) AS z FROM e),
    p AS (SELECT q.id AS query_id, r.id, r.kind, round(CASE WHEN q.z * r.z > 0 THEN list_dot_product(q.v, r.v) / (q.z * r.z) ELSE 0 END, 9) AS similarity FROM n q JOIN n r ON q.l = r.l AND q.id <> r.id WHERE q.id % 100 = 0)
    SELECT query_id, id, kind, similarity, row_number() OVER (PARTITION BY query_id, kind ORDER BY similarity DESC, id)::int AS rank FROM p WHERE similarity >= 0.5
    QUALIFY rank <= CASE kind WHEN 'module' THEN 5 WHEN 'file' THEN 10 WHEN 'symbol' THEN 20 WHEN 'relation' THEN 15 ELSE 0 END""",
)
def knn_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Of every hundredth object embedding its nearest objects per type, as many as the type's bucket holds."""
    e = table(spark, d, "object_embeddings")
    rows = e.select("id", F.lower(F.trim("object_type")).alias("kind"), F.col("embedding").alias("vector")).dropDuplicates(["id"])
    return E.nearest(rows, rows.filter("id % 100 = 0"), "cosine", dict(C.BUCKETS))


@query(
    "vector_normalize",
    "SELECT vec_id, list_transform(embedding::double[], lambda x: round(CASE WHEN n > 0 THEN x / n ELSE x END, 6)) AS unit FROM (SELECT *, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS n FROM embeddings)",
)
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform(VF.normalised(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query(
    "hit_max_merge",
    "WITH e AS (SELECT repo_id, object_id, id % 1000 / 1000.0 AS similarity FROM object_embeddings) SELECT repo_id, object_id, max(similarity)::double AS similarity FROM e GROUP BY ALL",
)
def hit_max_merge(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "object_embeddings").select("repo_id", "object_id", (F.col("id") % 1000 / 1000.0).alias("similarity"))
    return E.merged_hits(hits, ["repo_id", "object_id"])


@query(
    "embedding_upsert",
    "SELECT repo_id, object_id, id FROM object_embeddings QUALIFY row_number() OVER (PARTITION BY repo_id, object_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1",
)
def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the year's embeddings with the later ones upserted."""
    e = table(spark, d, "object_embeddings").select("repo_id", "object_id", "id", "created_at")
    split = F.lit("2025-12-01").cast("timestamp")
    old, new = e.filter(F.col("created_at").isNull() | (F.col("created_at") < split)), e.filter(F.col("created_at") >= split)
    return E.upserted(old, new).drop("created_at")


@query(
    "embedding_delete_stale",
    f"""WITH {V.CODE}, k AS (SELECT repo_id, id FROM m UNION SELECT repo_id, id FROM f UNION SELECT repo_id, id FROM s)
    SELECT e.id FROM object_embeddings e WHERE EXISTS (SELECT 1 FROM k WHERE k.repo_id = e.repo_id AND k.id = e.object_id)""",
)
def embedding_delete_stale(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings without those of objects that are no longer there."""
    e = table(spark, d, "object_embeddings").select("repo_id", "object_id", "id")
    known = L.objects(V.modules(spark, d), V.files(spark, d), V.symbols(spark, d)).select("repo_id", F.col("id").alias("object_id"))
    gone = e.select("repo_id", "object_id").distinct().join(known, ["repo_id", "object_id"], "left_anti")
    return E.deleted(e, gone).select("id")


# -- resolution --------------------------------------------------------------------------------------------------------


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    s = V.symbols(spark, d).select(F.col("repo_id").alias("scope"), "id", "name", "qualified_name", "file_id")
    f = V.files(spark, d).select(F.col("repo_id").alias("scope"), "id", "path")
    return R.unique_keys(R.symbol_keys(s, f))


_KEYS = f"""WITH {V.CODE}, j AS (SELECT s.*, regexp_replace(f.path, '\\.[^./]*$', '') AS sp FROM s LEFT JOIN f ON s.repo_id = f.repo_id AND s.file_id = f.id),
j2 AS (SELECT *, list_filter(str_split(qualified_name, '.'), lambda p: p <> '') AS d1, list_filter(str_split(qualified_name, '::'), lambda p: p <> '') AS d2, str_split(sp, '/') AS pt FROM j),
j3 AS (SELECT *, CASE WHEN pt[-1] = 'mod' AND len(pt) > 1 THEN pt[1:-2] ELSE pt END AS np FROM j2),
j4 AS (SELECT *, array_to_string(np, '.') AS dots, array_to_string(CASE WHEN np[1] = 'src' AND len(np) > 1 THEN np[2:] ELSE np END, '::') AS cols FROM j3),
k AS (SELECT DISTINCT repo_id AS scope, id, unnest([id, qualified_name, name, CASE WHEN len(d1) > 1 THEN d1[-1] END, CASE WHEN len(d1) > 1 THEN array_to_string(d1[-2:], '.') END,
  CASE WHEN len(d2) > 1 THEN d2[-1] END, CASE WHEN len(d2) > 1 THEN array_to_string(d2[-2:], '::') END, concat_ws('.', pt[-1], name), concat_ws('.', pt[-1], qualified_name),
  concat_ws('.', dots, name), concat_ws('.', dots, qualified_name), concat_ws('::', cols, name), concat_ws('::', cols, qualified_name),
  concat_ws('::', cols, replace(qualified_name, '.', '::'))]) AS key FROM j4),
u AS (SELECT scope, key, min(id) AS id FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT id) = 1)
"""


@query("lookup_unique_keys", _KEYS + "SELECT scope, key, id FROM u")
def lookup_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    return _lookup(spark, d)


_CALLEES = r"""regexp_extract(summary, '"callees": \[([^\]]*)\]', 1)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Raw call relations of the symbols, from the callee names in their summaries."""
    names = F.regexp_extract_all(F.regexp_extract("summary", r'"callees": \[([^\]]*)\]', 1), F.lit(r'"([^"]+)"'), F.lit(1))
    return V.symbols(spark, d).select(F.col("repo_id").alias("scope"), F.col("id").alias("source_id"), F.explode(names).alias("raw_id"))


@query(
    "endpoint_resolution",
    _KEYS
    + f""", c AS (SELECT repo_id AS scope, id AS source_id, unnest(regexp_extract_all({_CALLEES}, '"([^"]+)"', 1)) AS raw_id FROM s)
    SELECT c.scope, source_id, raw_id, coalesce(u.id, trim(raw_id)) AS object_id FROM c LEFT JOIN u ON c.scope = u.scope AND trim(raw_id) = u.key""",
)
def endpoint_resolution(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(_calls(spark, d), _lookup(spark, d))


_EXPORTS = (
    _KEYS
    + f""", lk AS (SELECT repo_id AS scope, file_id, key, max(id) AS id FROM (SELECT repo_id, file_id, id, unnest([name, qualified_name]) AS key FROM s) WHERE key <> '' AND file_id IS NOT NULL GROUP BY ALL),
    xr AS (SELECT s.repo_id AS scope, s.file_id, s.name AS export, s.name AS raw_id, regexp_replace(regexp_extract(f.path, '[^/]*$'), '\\.[^.]*$', '') || '.' || s.name AS key FROM s JOIN f ON s.repo_id = f.repo_id AND s.file_id = f.id WHERE s.visibility = 'public'),
    xo AS (SELECT xr.scope, xr.key, coalesce(lk.id, u.id) AS id FROM xr LEFT JOIN lk ON xr.scope = lk.scope AND xr.file_id = lk.file_id AND trim(xr.raw_id) = lk.key LEFT JOIN u ON xr.scope = u.scope AND trim(xr.raw_id) = u.key),
    xk AS (SELECT scope, key, min(id) AS id FROM xo WHERE id IN (SELECT id FROM s WHERE s.repo_id = xo.scope) AND key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) = 1),
    u2 AS (SELECT * FROM u WHERE (scope, key) NOT IN (SELECT (scope, key) FROM xk) UNION ALL SELECT * FROM xk),
    c AS (SELECT repo_id AS scope, id AS source_id, file_id, module_id, unnest(regexp_extract_all({_CALLEES}, '"([^"]+)"', 1)) AS raw_id FROM s),
    e AS (SELECT c.*, coalesce(lk.id, u2.id, trim(raw_id)) AS object_id FROM c LEFT JOIN lk ON c.scope = lk.scope AND c.file_id = lk.file_id AND trim(raw_id) = lk.key LEFT JOIN u2 ON c.scope = u2.scope AND trim(raw_id) = u2.key)
"""
)


def _scoped(df: DataFrame) -> DataFrame:
    return df.withColumn("scope", F.col("repo_id"))


def _exported(spark: SparkSession, d: str) -> DataFrame:
    """The lookup with the public symbols of every file as its exports."""
    s, f = _scoped(V.symbols(spark, d)), _scoped(V.files(spark, d))
    paths = f.select("scope", F.col("id").alias("file_id"), "path")
    exports = s.filter("visibility = 'public'").join(paths, ["scope", "file_id"]).select("scope", "file_id", "path", F.concat(F.lit("export:"), "name").alias("export"), F.col("name").alias("raw_id"))
    return R.export_keys(exports, _lookup(spark, d), R.local_keys(s), s)


@query("export_lookup", _EXPORTS + "SELECT scope, key, id FROM xk")
def export_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _exported(spark, d)


@query(
    "endpoint_modules",
    _EXPORTS
    + """SELECT e.scope, source_id, raw_id, object_id, coalesce(es.module_id, ef.module_id, em.id, e.module_id) AS object_module FROM e LEFT JOIN s es ON e.scope = es.repo_id AND object_id = es.id
    LEFT JOIN f ef ON e.scope = ef.repo_id AND object_id = ef.id LEFT JOIN m em ON e.scope = em.repo_id AND object_id = em.id""",
)
def endpoint_modules(spark: SparkSession, d: str) -> DataFrame:
    """Raw calls resolved within their file, then among exports and all symbols, with the module that each end belongs to."""
    s, f, m = _scoped(V.symbols(spark, d)), _scoped(V.files(spark, d)), _scoped(V.modules(spark, d))
    at = s.select("scope", F.col("id").alias("source_id"), "file_id", "module_id")
    raw = _calls(spark, d).join(at, ["scope", "source_id"])
    ends = R.resolve(raw, R.with_exports(_lookup(spark, d), _exported(spark, d)), R.local_keys(s))
    return R.end_modules(ends, m, f, s).select("scope", "source_id", "raw_id", "object_id", "object_module")


@query(
    "relations_valid_filter",
    f"""WITH {V.GRAPH}, r AS (SELECT 'S_' || l_orderkey AS source_id, 'symbol' AS source_type, CASE WHEN l_linenumber = 7 THEN 'S_' || l_partkey || 'x' ELSE 'S_' || l_partkey END AS target_id,
      CASE WHEN l_returnflag = 'N' THEN 'external' ELSE 'symbol' END AS target_type FROM lineitem)
    SELECT r.* FROM r SEMI JOIN gs ON r.source_id = gs.id WHERE target_type = 'external' OR target_id IN (SELECT id FROM gs)""",
)
def relations_valid_filter(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    target = F.concat(F.lit("S_"), "l_partkey", F.when(F.col("l_linenumber") == 7, "x").otherwise(""))
    r = li.select(F.concat(F.lit("S_"), "l_orderkey").alias("source_id"), F.lit("symbol").alias("source_type"), target.alias("target_id"), F.when(F.col("l_returnflag") == "N", "external").otherwise("symbol").alias("target_type"))
    return R.valid_relations(r, V.g_symbols(spark, d).select("id", F.lit("symbol").alias("kind"))).select("source_id", "source_type", "target_id", "target_type")


@query("relation_resequence", f"WITH {V.GRAPH} SELECT source_id, target_id, relation_type, 'R_' || row_number() OVER (ORDER BY source_id, target_id, relation_type) AS id FROM gr")
def relation_resequence(spark: SparkSession, d: str) -> DataFrame:
    return R.renumbered(V.g_relations(spark, d), ["source_id", "target_id", "relation_type"])
