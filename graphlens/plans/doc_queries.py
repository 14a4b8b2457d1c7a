"""Queries on texts, anchors, document plans, reviews and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import text as X
from graphlens.operators import anchors as A
from graphlens.operators import diagrams as G
from graphlens.operators import docs as D
from graphlens.operators import lookup as L
from graphlens.operators import review as R
from graphlens.operators import traverse as T
from graphlens.plans import graph_queries as GQ
from graphlens.plans import views as V
from graphlens.plans.graph_queries import _BFS, _N, _RANK
from graphlens.plans.lookup_queries import _ENDS
from graphlens.operators.positions import carried, positioned
from graphlens.plans.registry import oracle, query
from graphlens.tables import cut, table

# -- texts --------------------------------------------------------------------------------------------------------------

_TERMS = r"list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][\p{L}\p{N}_./:-]*'), lambda t: lower(regexp_replace(t, '^[.,:;()\[\]{}<>]+|[.,:;()\[\]{}<>]+$', '', 'g')))), lambda t: length(t) > 1)"


@query("identifier_tokens", f"SELECT doc_id, list_sort({_TERMS}) AS terms FROM documents WHERE text IS NOT NULL")
def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.array_sort(X.identifiers(F.col("text"))).alias("terms"))


@query("text_normalize", r"SELECT doc_id, lower(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS plain FROM documents WHERE text IS NOT NULL")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", X.normalised(F.col("text")).alias("plain"))


@query(
    "call_targets",
    r"""WITH r AS (SELECT DISTINCT repo_id, file_id, content FROM raw_sources WHERE content IS NOT NULL),
    t AS (SELECT repo_id, file_id, unnest(list_distinct(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_.]*)\s*\(', 1))) AS target FROM r)
    SELECT repo_id, file_id, target FROM t WHERE target NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'func', 'fn', 'new', 'sizeof', 'super', 'def', 'class', 'match', 'elif', 'except', 'with')""",
)
def call_targets(spark: SparkSession, d: str) -> DataFrame:
    from graphlens.sources.extract import call_targets as targets

    r = table(spark, d, "raw_sources").filter("content is not null").select("repo_id", "file_id", "content").distinct()
    return targets(r, ["repo_id", "file_id"], "content")


@query("token_estimates", "SELECT doc_id, length(text) // 2 AS tokens, length(text) // 2 <= 2000 AS fits FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), (X.token_estimate(F.col("text")) <= 2000).alias("fits"))


@query(
    "summary_texts",
    f"""WITH {V.CODE}, x AS (SELECT repo_id, id, summary FROM m), k AS (SELECT repo_id, id, trim(summary) AS s, CASE WHEN json_valid(trim(summary)) THEN trim(summary) ELSE '{{}}' END AS js FROM x)
    SELECT repo_id, id, CASE WHEN starts_with(s, '{{') THEN (SELECT v FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS o, unnest([nullif(json_extract_string(js, '$.summary'), ''), nullif(json_extract_string(js, '$.description'), ''),
      nullif(json_extract_string(js, '$.responsibility'), ''), nullif(json_extract_string(js, '$.responsibility_label'), ''), nullif(json_extract_string(js, '$.name'), ''), nullif(json_extract_string(js, '$.module_path'), '')]) AS v)
      WHERE v IS NOT NULL ORDER BY o LIMIT 1) ELSE nullif(s, '') END AS told FROM k""",
)
def summary_texts(spark: SparkSession, d: str) -> DataFrame:
    return V.modules(spark, d).select("repo_id", "id", D.json_text(F.col("summary")).alias("told"))


# -- anchors: each file's first symbol name, asked for as a question in its repo ------------------------------------------


def _asked(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d)
    return f.select(F.concat_ws("/", "repo_id", "id").alias("question_id"), "repo_id", "id", F.concat(F.lit("explain `"), F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("`")).alias("question"))


@query(
    "name_candidates",
    r"""WITH c0 AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[`''"“”‘’]([A-Za-z_][\p{L}\p{N}_./:-]*)[`''"“”‘’]', 1), lambda t: lower(regexp_replace(t, '^[.,:;()\[\]{}<>]+|[.,:;()\[\]{}<>]+$', '', 'g'))), lambda t: length(t) > 1) AS quoted,
      list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][\p{L}\p{N}_./:-]*'), lambda t: lower(regexp_replace(t, '^[.,:;()\[\]{}<>]+|[.,:;()\[\]{}<>]+$', '', 'g'))), lambda t: length(t) > 1) AS terms FROM eval_items),
    c1 AS (SELECT item_id, list_concat(quoted, terms) AS l FROM c0)
    SELECT item_id, list_filter(l, lambda t, i: list_position(l, t) = i AND t NOT IN ('what', 'why', 'how', 'when', 'where', 'which', 'who', 'does', 'show', 'explain', 'tell', 'about', '实现', '作用', '为什么', '怎么', '如何', '哪个', '哪些')) AS candidates FROM c1""",
)
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", A.name_candidates(F.col("text")).alias("candidates"))


_NAMED = f"""WITH {V.CODE}, o AS (SELECT repo_id, id, 'module' AS kind, lower(name) AS n, lower(path) AS p FROM m UNION ALL SELECT repo_id, id, 'file', lower(name), lower(path) FROM f
      UNION ALL SELECT repo_id, id, 'symbol', lower(name), lower(qualified_name) FROM s),
    q AS (SELECT concat_ws('/', repo_id, id) AS question_id, repo_id, 'explain `' || regexp_replace(name, '\\.[^.]*$', '') || '`' AS text FROM f),
    c0 AS (SELECT question_id, repo_id, list_filter([lower(regexp_extract(text, '`([A-Za-z_][\\p{{L}}\\p{{N}}_./:-]*)`', 1))], lambda t: length(t) > 1) AS quoted,
      list_transform(regexp_extract_all(text, '[A-Za-z_][\\p{{L}}\\p{{N}}_./:-]*'), lambda t: lower(regexp_replace(t, '^[.,:;()\\[\\]{{}}<>]+|[.,:;()\\[\\]{{}}<>]+$', '', 'g'))) AS terms FROM q),
    c1 AS (SELECT question_id, repo_id, list_concat(quoted, list_filter(terms, lambda t: length(t) > 1)) AS l FROM c0),
    c AS (SELECT question_id, repo_id, list_filter(l, lambda t, i: list_position(l, t) = i AND t NOT IN ('what', 'why', 'how', 'when', 'where', 'which', 'who', 'does', 'show', 'explain', 'tell', 'about', '实现', '作用', '为什么', '怎么', '如何', '哪个', '哪些')) AS cand FROM c1),
    a AS (SELECT question_id, repo_id, unnest(cand) AS term, generate_subscripts(cand, 1) - 1 AS i FROM c),
    w AS (SELECT DISTINCT repo_id, term FROM a),
    h AS (SELECT o.repo_id, term, id, kind, n, p, CASE WHEN (CASE kind WHEN 'symbol' THEN p ELSE n END) = term THEN 0 WHEN (CASE kind WHEN 'symbol' THEN n ELSE p END) = term THEN 1 ELSE 2 END AS tier,
      CASE kind WHEN 'symbol' THEN 0 WHEN 'file' THEN 1 ELSE 2 END AS kk FROM o JOIN w ON o.repo_id = w.repo_id AND (contains(n, term) OR contains(p, term))),
    h4 AS (SELECT *, row_number() OVER (PARTITION BY repo_id, term, kind ORDER BY tier, length(p), id) AS rk FROM h QUALIFY rk <= 4),
    j AS (SELECT question_id, id, kind, kk, rk, i, greatest(0, 10 - i) + CASE WHEN term IN (n, p) THEN 10 WHEN ends_with(n, term) OR ends_with(p, term) THEN 7 ELSE 4 END AS w FROM a JOIN h4 USING (repo_id, term)
      QUALIFY row_number() OVER (PARTITION BY question_id, id ORDER BY i, kk, rk) = 1),
    n AS (SELECT question_id, count(*) AS n FROM j GROUP BY ALL),
    an AS (SELECT question_id, id, kind, CASE WHEN n = 1 THEN 0.85 ELSE 0.65 END::double AS confidence FROM j JOIN n USING (question_id) WHERE n <= 3
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY w DESC, i, kk, rk) = 1)
"""


@query("anchor_from_name", _NAMED + "SELECT question_id, id, kind, confidence FROM an")
def anchor_from_name(spark: SparkSession, d: str) -> DataFrame:
    o = L.objects(V.modules(spark, d), V.files(spark, d), V.symbols(spark, d))
    return A.by_name(_asked(spark, d), o)


@query(
    "follow_up_detect",
    r"""WITH t AS (SELECT item_id, text, lower(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS p FROM eval_items WHERE text IS NOT NULL)
    SELECT item_id, p <> '' AND ((len(str_split(p, ' ')) <= 12 AND len(list_filter(['它', '这个', '该', '这里', '上面', '上述', 'that', 'this', 'it', 'they', 'them', 'method', 'class', 'file'], lambda h: contains(p, h))) > 0)
      OR len(list_filter(['该方法', '这个类', '这个文件', '这个模块', 'that method', 'this class'], lambda h: contains(lower(text), h))) > 0) AS follows FROM t""",
)
def follow_up_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").filter("text is not null").select("item_id", A.is_follow_up(F.col("text")).alias("follows"))


@query(
    "anchor_resolution",
    _NAMED
    + """, sel AS (SELECT repo_id, id, file_id, start_line, end_line FROM s WHERE start_line % 3 = 0),
    sp AS (SELECT repo_id, file_id, id AS span_id, type, start_line AS a, end_line AS b FROM s UNION ALL SELECT repo_id, id, id, 'file', start_line, end_line FROM f),
    hit AS (SELECT sel.repo_id, sel.file_id, sel.id AS sel_id, span_id FROM sel JOIN sp USING (repo_id, file_id) WHERE a <= sel.start_line AND b >= sel.end_line
      QUALIFY row_number() OVER (PARTITION BY sel.repo_id, sel.id ORDER BY CASE WHEN type IN ('method', 'function') THEN 0 WHEN type IN ('class', 'interface') THEN 1 WHEN type = 'file' THEN 2 ELSE 3 END, b - a, span_id) = 1),
    fs AS (SELECT concat_ws('/', repo_id, file_id) AS question_id, min(span_id) AS id FROM hit GROUP BY ALL),
    ask AS (SELECT concat_ws('/', repo_id, id) AS question_id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY id) AS turn FROM f),
    real AS (SELECT ask.question_id, repo_id, turn, coalesce(fs.id, an.id) AS id, CASE WHEN fs.id IS NOT NULL THEN 0.95 ELSE an.confidence END AS confidence FROM ask LEFT JOIN fs USING (question_id) LEFT JOIN an USING (question_id)),
    bef AS (SELECT question_id, last_value(CASE WHEN id IS NOT NULL THEN {'id': id, 'c': confidence} END IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM real)
    SELECT ask.question_id, CASE WHEN fs.id IS NOT NULL THEN 'selection' WHEN an.id IS NOT NULL THEN 'name_match' WHEN k IS NOT NULL AND turn % 2 = 0 THEN 'memory_inherit' ELSE 'none' END AS source,
      CASE WHEN fs.id IS NOT NULL THEN fs.id WHEN an.id IS NOT NULL THEN an.id WHEN turn % 2 = 0 THEN k.id END AS id,
      CASE WHEN fs.id IS NOT NULL THEN 0.95 WHEN an.id IS NOT NULL THEN an.confidence WHEN k IS NOT NULL AND turn % 2 = 0 THEN round(k.c::decimal(10,6) * 0.9::decimal(10,6), 4)::double ELSE 0 END::double AS confidence
    FROM ask LEFT JOIN fs USING (question_id) LEFT JOIN an USING (question_id) LEFT JOIN bef USING (question_id)""",
)
def anchor_resolution(spark: SparkSession, d: str) -> DataFrame:
    """One question about every file: selections (every third symbol's lines) by their best span, names by search, and what the
    repo's earlier questions were about, which every second question takes over."""
    s, f = V.symbols(spark, d), V.files(spark, d)
    spans = s.select("repo_id", "file_id", F.col("id").alias("span_id"), "type", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    spans = spans.unionByName(f.select("repo_id", F.col("id").alias("file_id"), F.col("id").alias("span_id"), F.lit("file").alias("type"), F.col("start_line").alias("a"), F.col("end_line").alias("b")))
    selections = s.filter("start_line % 3 = 0").select("repo_id", F.col("id").alias("sel_id"), "file_id", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"))
    hit = L.best_span(L.containing_spans(selections, spans)).groupBy(F.concat_ws("/", "repo_id", "file_id").alias("question_id")).agg(F.min("span_id").alias("id")).withColumn("confidence", F.lit(0.95))
    asked = _asked(spark, d)
    named = cut(A.by_name(asked, L.objects(V.modules(spark, d), f, s)), "named")
    turns = positioned(asked.select("question_id", "repo_id", F.col("id").alias("file_id")), ["repo_id"], ["file_id"], "turn")
    real = turns.join(hit.select("question_id", F.struct("id", "confidence").alias("_s")), "question_id", "left").join(named.select("question_id", F.struct("id", "confidence").alias("_n")), "question_id", "left")
    kept = carried(real.withColumn("_a", F.coalesce("_s", "_n")), ["repo_id"], ["turn"], "_a", "before")
    memory = kept.filter("before is not null").select("question_id", "before.*", (F.col("turn") % 2 == 0).alias("takes"))
    return A.resolved(asked, hit, named, memory)


# -- plans and sections --------------------------------------------------------------------------------------------------

_API = "(type IN ('route', 'controller', 'endpoint', 'api') OR regexp_matches(lower(qualified_name), 'route|controller|endpoint|api'))"


def _cross(spark: SparkSession, d: str) -> DataFrame:
    """Repos with a resolved call from one module into another."""
    from graphlens.operators.resolve import resolve
    from graphlens.plans.summary_queries import _calls, _lookup

    module = V.symbols(spark, d).select(F.col("repo_id").alias("scope"), "id", "module_id")
    r = resolve(_calls(spark, d), _lookup(spark, d))
    r = r.join(module.withColumnsRenamed({"id": "source_id", "module_id": "a"}), ["scope", "source_id"]).join(module.withColumnsRenamed({"id": "object_id", "module_id": "b"}), ["scope", "object_id"])
    return r.filter("a <> b").select(F.col("scope").alias("repo_id")).distinct()


def _skeleton_sql() -> str:
    from graphlens.plans.summary_queries import _CALLEES, _KEYS

    return (
        _KEYS
        + f""", cl AS (SELECT repo_id AS scope, id AS source_id, unnest(regexp_extract_all({_CALLEES}, '"([^"]+)"', 1)) AS raw_id FROM s),
    en AS (SELECT cl.scope, source_id, coalesce(u.id, trim(raw_id)) AS object_id FROM cl LEFT JOIN u ON cl.scope = u.scope AND trim(raw_id) = u.key),
    cr AS (SELECT DISTINCT en.scope AS repo_id FROM en JOIN s a ON en.scope = a.repo_id AND source_id = a.id JOIN s b ON en.scope = b.repo_id AND object_id = b.id WHERE a.module_id <> b.module_id),
    rp AS (SELECT DISTINCT repo_id FROM m), nn AS (SELECT repo_id, file_id AS id, count(*) AS c FROM s GROUP BY ALL),
    bf AS (SELECT f.repo_id, f.module_id, f.id, f.name, row_number() OVER (PARTITION BY f.repo_id, f.module_id ORDER BY coalesce(c, 0) + (length(coalesce(f.summary, '')) > 0)::int DESC, f.path NULLS FIRST, f.id) AS k
      FROM f LEFT JOIN nn ON f.repo_id = nn.repo_id AND f.id = nn.id QUALIFY k <= 3),
    al AS (SELECT repo_id, 0 AS a, '' AS b, 0 AS c, 'overview' AS section_id, 'overview' AS title, 1 AS level, 'overview' AS section_type FROM rp UNION ALL SELECT repo_id, 1, '', 0, 'architecture', 'architecture', 1, 'architecture' FROM rp
      UNION ALL SELECT repo_id, 2, id, 0, 'module-' || id, name, 2, 'module' FROM m UNION ALL SELECT bf.repo_id, 2, bf.module_id, k, 'file-' || bf.id, bf.name, 3, 'module' FROM bf SEMI JOIN m ON bf.repo_id = m.repo_id AND bf.module_id = m.id
      UNION ALL SELECT repo_id, 3, '', 0, 'dependency-analysis', 'dependency-analysis', 1, 'dependency' FROM cr WHERE repo_id IN (SELECT repo_id FROM rp)
      UNION ALL SELECT DISTINCT repo_id, 4, '', 0, 'api', 'api', 1, 'api' FROM s WHERE {_API} AND repo_id IN (SELECT repo_id FROM rp) UNION ALL SELECT repo_id, 5, '', 0, 'summary', 'summary', 1, 'summary' FROM rp)
    SELECT repo_id, section_id, title, level, section_type, row_number() OVER (PARTITION BY repo_id ORDER BY a, b, c, section_id)::int AS position FROM al"""
    )


@query("plan_skeleton", _skeleton_sql())
def plan_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return D.skeleton(V.modules(spark, d), V.files(spark, d).select("repo_id", "module_id", "id", "name", "path", "summary"), V.symbols(spark, d), _cross(spark, d))


@query(
    "plan_section_counts",
    f"""WITH {V.CODE}, k AS (SELECT repo_id, count(*) AS n_modules FROM m GROUP BY ALL), fl AS (SELECT repo_id, sum(least(c, 3)) AS n_files FROM (SELECT f.repo_id, f.module_id, count(*) AS c FROM f JOIN m ON f.repo_id = m.repo_id AND f.module_id = m.id GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT DISTINCT repo_id FROM s WHERE {_API})
    SELECT k.repo_id, n_modules, coalesce(n_files, 0)::bigint AS n_files, (a.repo_id IS NOT NULL) AS has_api FROM k LEFT JOIN fl USING (repo_id) LEFT JOIN a ON k.repo_id = a.repo_id""",
)
def plan_section_counts(spark: SparkSession, d: str) -> DataFrame:
    s = D.skeleton(V.modules(spark, d), V.files(spark, d).select("repo_id", "module_id", "id", "name", "path", "summary"), V.symbols(spark, d), V.modules(spark, d).limit(0))
    return s.groupBy("repo_id").agg(F.count_if(F.col("level") == 2).alias("n_modules"), F.count_if(F.col("level") == 3).alias("n_files"), F.max(F.col("section_id") == "api").alias("has_api"))


@query("section_recall_overview", f"WITH {V.CODE} SELECT repo_id, id, 0 AS distance FROM m")
def section_recall_overview(spark: SparkSession, d: str) -> DataFrame:
    return V.modules(spark, d).select("repo_id", "id", F.lit(0).alias("distance"))


@query("section_recall_architecture", _ENDS + "SELECT gm.repo_id, count(DISTINCT source_id || '>' || target_id || relation_type) AS relations FROM x JOIN gm ON source_module = gm.id WHERE source_module <> target_module GROUP BY ALL")
def section_recall_architecture(spark: SparkSession, d: str) -> DataFrame:
    cross = L.with_modules(V.g_relations(spark, d), V.g_symbols(spark, d)).filter("source_module <> target_module")
    return cross.join(V.g_modules(spark, d).select(F.col("id").alias("source_module"), "repo_id"), "source_module").groupBy("repo_id").agg(F.count("*").alias("relations"))


@query(
    "section_recall_module",
    f"""WITH {V.GRAPH}, y AS (SELECT module_id, id FROM gs QUALIFY row_number() OVER (PARTITION BY module_id ORDER BY qualified_name, id) <= 8)
    SELECT id AS module_id, id, 'module' AS kind, 0 AS distance FROM gm UNION ALL SELECT module_id, id, 'file', 1 FROM gf UNION ALL SELECT module_id, id, 'symbol', 2 FROM y""",
)
def section_recall_module(spark: SparkSession, d: str) -> DataFrame:
    return D.module_recall(V.g_modules(spark, d), V.g_files(spark, d), V.g_symbols(spark, d))


@query(
    "section_recall_file",
    f"""WITH {V.GRAPH}, y AS (SELECT file_id, id FROM gs QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY start_line, qualified_name, id) <= 8)
    SELECT id AS file_id, id, 'file' AS kind, 0 AS distance FROM gf UNION ALL SELECT id, module_id, 'module', 1 FROM gf UNION ALL SELECT file_id, id, 'symbol', 1 FROM y""",
)
def section_recall_file(spark: SparkSession, d: str) -> DataFrame:
    return D.file_recall(V.g_files(spark, d), V.g_symbols(spark, d))


@query(
    "section_recall_api",
    f"""WITH {V.GRAPH}, gs2 AS (SELECT id, CASE WHEN name LIKE 'get%' THEN 'api' ELSE type END AS type, qualified_name FROM gs), a AS (SELECT id FROM gs2 WHERE {_API}),
    e AS (SELECT source_id AS id, target_id AS other FROM gr WHERE relation_type IN ('calls', 'depends_on') UNION SELECT target_id, source_id FROM gr WHERE relation_type IN ('calls', 'depends_on'))
    SELECT id, min(dd) AS distance FROM (SELECT id, 0 AS dd FROM a UNION ALL SELECT other, 1 FROM e SEMI JOIN a ON e.id = a.id WHERE other IN (SELECT id FROM gs)) GROUP BY id""",
)
def section_recall_api(spark: SparkSession, d: str) -> DataFrame:
    s = V.g_symbols(spark, d).withColumn("type", F.when(F.col("name").startswith("get"), "api").otherwise(F.col("type")))
    return D.api_recall(s, V.g_relations(spark, d))


@query(
    "section_recall_dependency",
    _ENDS + "SELECT DISTINCT gm.repo_id, x.relation_type, unnest([source_module, target_module]) AS id FROM x JOIN gm ON source_module = gm.id WHERE source_module <> target_module",
)
def section_recall_dependency(spark: SparkSession, d: str) -> DataFrame:
    cross = L.with_modules(V.g_relations(spark, d), V.g_symbols(spark, d)).filter("source_module <> target_module")
    cross = cross.join(V.g_modules(spark, d).select(F.col("id").alias("source_module"), "repo_id"), "source_module")
    return cross.select("repo_id", "relation_type", F.explode(F.array("source_module", "target_module")).alias("id")).distinct()


@query(
    "section_recall_data_flow",
    _BFS.replace("relation_type IN ('calls', 'depends_on', 'references')", "relation_type IN ('calls', 'depends_on')")
    + "SELECT seed, id, distance FROM b",
)
def section_recall_data_flow(spark: SparkSession, d: str) -> DataFrame:
    seeds = GQ._seeds(spark, d).withColumn("modes", F.array(*[F.lit(m) for m in ("callers", "callees", "depends_on", "reverse_depends_on")]))
    return T.expand(seeds, V.g_relations(spark, d), 2, V.g_symbols(spark, d).select("id"))


@query("section_confidence", _RANK + "SELECT seed, round(avg(score::decimal(12, 4)), 4)::double AS confidence FROM r WHERE rank <= 3 GROUP BY ALL")
def section_confidence(spark: SparkSession, d: str) -> DataFrame:
    return D.section_confidence(GQ.scored(spark, d))


@query(
    "low_confidence_label",
    """WITH t AS (SELECT doc_id, text, doc_id % 100 / 100.0 AS c FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN c < 0.3 THEN '> Low confidence: little evidence was found for this section.' || chr(10) || chr(10) || text ELSE text END AS text FROM t""",
)
def low_confidence_label(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", D.with_banner(F.col("text"), F.col("doc_id") % 100 / 100).alias("text"))


@query(
    "budget_trim",
    _RANK
    + """, l AS (SELECT seed, rank, '- symbol ' || id || ' [' || type || '] ' || score AS line FROM (SELECT seed, id, type, (round(score * 10000))::bigint AS score, rank FROM r)),
    u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY seed ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM l)
    SELECT seed, rank, used::bigint AS used FROM u WHERE used <= 241""",
)
def budget_trim(spark: SparkSession, d: str) -> DataFrame:
    r = GQ.top_ranked(spark, d)
    line = F.concat(F.lit("- symbol "), "id", F.lit(" ["), "type", F.lit("] "), F.round(F.col("score") * 10000).cast("long").cast("string"))
    return D.budget_prefix(r.select("seed", F.lit(0).alias("part"), "rank", line.alias("line")), 120).select("seed", "rank", "used")


@query(
    "section_text",
    _RANK
    + """, t AS (SELECT r.seed, count(*) AS n, array_to_string(list('`' || r.id || '`' ORDER BY rank) FILTER (WHERE rank <= 5), ', ') AS names FROM r GROUP BY ALL),
    rl AS (SELECT source_id AS seed, count(*) AS m, array_to_string(list_sort(list(DISTINCT relation_type)), ', ') AS kinds FROM gr GROUP BY ALL)
    SELECT t.seed, 'Objects: ' || n || ', among them ' || names || '.' || CASE WHEN m > 0 THEN ' Relations: ' || m || ' (' || kinds || ').' ELSE '' END AS content FROM t LEFT JOIN rl USING (seed)""",
)
def section_text(spark: SparkSession, d: str) -> DataFrame:
    r = GQ.top_ranked(spark, d).select("seed", "rank", F.col("id").alias("name"))
    return D.section_text(r, V.g_relations(spark, d).select(F.col("source_id").alias("seed"), "relation_type"))


@query("latest_document", "SELECT source, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY generated_at DESC NULLS LAST, doc_id DESC) = 1")
def latest_document(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source is not null").select("source", "doc_id", "generated_at")
    return D.latest_document(docs, "source", "generated_at", "doc_id").select("source", "doc_id")


# -- reviews -------------------------------------------------------------------------------------------------------------

_TYPES = "overview architecture module api dependency data_flow summary".split()


@query(
    "review_missing_sections",
    f"""WITH p AS (SELECT DISTINCT source, unnest({_TYPES}) AS section_type FROM documents WHERE source IS NOT NULL), g AS (SELECT DISTINCT source, section_type FROM documents WHERE source IS NOT NULL AND section_type IS NOT NULL)
    SELECT *, 'error' AS severity FROM (SELECT * FROM p EXCEPT SELECT * FROM g) UNION ALL SELECT *, 'warning' FROM (SELECT * FROM g EXCEPT SELECT * FROM p)""",
)
def review_missing_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source is not null").select("source", "section_type")
    planned = docs.select("source").distinct().select("source", F.explode(F.array(*[F.lit(t) for t in _TYPES])).alias("section_type"))
    return R.missing_sections(planned, docs.filter("section_type is not null"), ["source", "section_type"])


_HEAD = r"""WITH t AS (SELECT doc_id, str_split(regexp_replace(text, '(?s)```.*?(```|$)', '', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS line FROM t),
h AS (SELECT doc_id, line, length(regexp_extract(x, '^(#{1,6})[ \t]+\S', 1)) AS level FROM u WHERE regexp_matches(x, '^(#{1,6})[ \t]+\S'))
"""


@query("review_headings", _HEAD + "SELECT doc_id, line::int AS line, level::int AS level FROM h")
def review_headings(spark: SparkSession, d: str) -> DataFrame:
    return R.headings(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")


@query(
    "review_level_jump",
    _HEAD.replace("WITH t", "WITH o AS (SELECT source, doc_id, generated_at FROM documents WHERE source IS NOT NULL), t")
    + """, j AS (SELECT h.*, lag(level) OVER (PARTITION BY doc_id ORDER BY line) AS previous FROM h JOIN o USING (doc_id))
    SELECT doc_id, line::int AS line, previous::int AS previous, level::int AS level FROM j WHERE level > previous + 1""",
)
def review_level_jump(spark: SparkSession, d: str) -> DataFrame:
    """Headings of a document that go down more than one level at once."""
    docs = table(spark, d, "documents").filter("text is not null and source is not null")
    return R.level_jumps(R.headings(docs, "doc_id", "text"), "doc_id", "line")


@query("review_missing_types", "WITH g AS (SELECT source, max((section_type IN ('overview', 'architecture'))::int) AS o, max((section_type = 'summary')::int) AS s FROM documents WHERE source IS NOT NULL GROUP BY ALL) SELECT source, 'overview' AS missing FROM g WHERE coalesce(o, 0) = 0 UNION ALL SELECT source, 'summary' FROM g WHERE coalesce(s, 0) = 0")
def review_missing_types(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_types(table(spark, d, "documents").filter("source is not null"), "source")


@query(
    "review_links",
    r"""WITH t AS (SELECT doc_id, section_type, coalesce(text, '') || ' see [there](#' || coalesce(section_type, 'none') || CASE WHEN doc_id % 3 = 0 THEN '-old' ELSE '' END || ')' AS text FROM documents),
    l AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\(#([a-zA-Z0-9_-]+)\)', 1))) AS target FROM t) SELECT doc_id, target FROM l WHERE target NOT IN (SELECT section_type FROM documents WHERE section_type IS NOT NULL)""",
)
def review_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of all documents, each given one to its own section type, of every third to an older name."""
    docs = table(spark, d, "documents")
    link = F.concat(F.lit(" see [there](#"), F.coalesce("section_type", F.lit("none")), F.when(F.col("doc_id") % 3 == 0, "-old").otherwise(""), F.lit(")"))
    known = docs.filter("section_type is not null").select(F.col("section_type").alias("target"))
    return R.bad_links(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), link)), "doc_id", "text", known)


@query(
    "review_terms",
    rf"""WITH {V.CODE}, n AS (SELECT DISTINCT lower(name) AS l FROM s UNION SELECT lower(qualified_name) FROM s UNION SELECT lower(path) FROM f UNION SELECT lower(name) FROM m),
    t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '(?s)```.*?(```|$)', '', 'g'), '`([^`\n]+)`', 1))) AS term FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, term FROM t WHERE lower(trim(term)) <> '' AND NOT starts_with(lower(trim(term)), 'section ') AND lower(trim(term)) NOT IN (SELECT l FROM n WHERE l IS NOT NULL)""",
)
def review_terms(spark: SparkSession, d: str) -> DataFrame:
    s, f, m = V.symbols(spark, d), V.files(spark, d), V.modules(spark, d)
    names = s.select("name").unionByName(s.select(F.col("qualified_name").alias("name"))).unionByName(f.select(F.col("path").alias("name"))).unionByName(m.select("name"))
    return R.unknown_terms(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", names.filter("name is not null"))


@query(
    "review_unknown_objects",
    f"WITH {V.CODE}, k AS (SELECT repo_id, id FROM f UNION SELECT repo_id, id FROM s) SELECT DISTINCT repo_id, object_id AS id FROM object_embeddings WHERE (repo_id, object_id) NOT IN (SELECT (repo_id, id) FROM k)",
)
def review_unknown_objects(spark: SparkSession, d: str) -> DataFrame:
    """Embedded ids that are neither file nor symbol."""
    known = V.files(spark, d).select("repo_id", "id").unionByName(V.symbols(spark, d).select("repo_id", "id"))
    return R.unknown_objects(table(spark, d, "object_embeddings").select("repo_id", F.col("object_id").alias("id")), known, ["repo_id", "id"])


@query(
    "review_diagram_terms",
    rf"""WITH {V.CODE}, n AS (SELECT DISTINCT lower(name) AS l FROM s UNION SELECT lower(qualified_name) FROM s UNION SELECT lower(path) FROM f UNION SELECT lower(name) FROM m),
    t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(coalesce(text, ''), '(?s)@startuml.*?@enduml'), chr(10)), '[A-Za-z_][A-Za-z0-9_.]*'))) AS term FROM documents)
    SELECT doc_id, term FROM t WHERE lower(term) NOT IN ({", ".join(repr(w) for w in R.DIAGRAM_WORDS)}) AND NOT regexp_full_match(term, '[A-Z0-9_]+') AND NOT starts_with(lower(term), 'node_')
    AND lower(term) NOT IN (SELECT l FROM n WHERE l IS NOT NULL)""",
)
def review_diagram_terms(spark: SparkSession, d: str) -> DataFrame:
    s, f, m = V.symbols(spark, d), V.files(spark, d), V.modules(spark, d)
    known = s.select(F.explode(F.array("name", "qualified_name")).alias("t")).unionByName(f.select(F.col("path").alias("t"))).unionByName(m.select(F.col("name").alias("t")))
    return R.diagram_terms(table(spark, d, "documents"), "doc_id", "text", known.select(F.lower("t").alias("term")).filter("term is not null"))


@query(
    "review_passed",
    f"""WITH p AS (SELECT DISTINCT source, unnest({_TYPES}) AS section_type FROM documents WHERE source IS NOT NULL), g AS (SELECT DISTINCT source, section_type FROM documents WHERE source IS NOT NULL AND section_type IS NOT NULL),
    i AS (SELECT source, 1 AS e FROM (SELECT * FROM p EXCEPT SELECT * FROM g) UNION ALL SELECT source, 0 FROM (SELECT * FROM g EXCEPT SELECT * FROM p))
    SELECT source, sum(e) = 0 AS passed FROM i GROUP BY ALL""",
)
def review_passed(spark: SparkSession, d: str) -> DataFrame:
    return R.passed(review_missing_sections(spark, d), "source")


# -- diagrams ------------------------------------------------------------------------------------------------------------


@query(
    "diagram_component",
    _ENDS
    + """, l AS (SELECT repo_id, 0 AS part, name AS x, id AS y, '' AS z, 'component "' || name || '" as node_' || id AS line FROM gm UNION ALL
      SELECT DISTINCT gm.repo_id, 1, source_module, target_module, relation_type, 'node_' || source_module || ' --> node_' || target_module || ' : ' || relation_type FROM x JOIN gm ON source_module = gm.id WHERE source_module <> target_module)
    SELECT repo_id, '@startuml' || chr(10) || 'skinparam componentStyle rectangle' || chr(10) || array_to_string(list(line ORDER BY part, x, y, z), chr(10)) || chr(10) || '@enduml' AS diagram FROM l GROUP BY ALL""",
)
def diagram_component(spark: SparkSession, d: str) -> DataFrame:
    m = V.g_modules(spark, d)
    e = L.with_modules(V.g_relations(spark, d), V.g_symbols(spark, d)).join(m.select(F.col("id").alias("source_module"), "repo_id"), "source_module")
    return G.component(m, e, "repo_id")


@query(
    "diagram_class",
    f"""WITH {V.GRAPH}, o AS (SELECT file_id, id, qualified_name FROM gs WHERE type = 'class'),
    l AS (SELECT file_id, 0 AS part, qualified_name AS x, id AS y, '' AS z, 'class "' || qualified_name || '" as node_' || id AS line FROM o UNION ALL
      SELECT a.file_id, 1, source_id, target_id, relation_type, 'node_' || target_id || ' ' || CASE relation_type WHEN 'inherits' THEN '<|--' WHEN 'implements' THEN '<|..' WHEN 'depends_on' THEN '..>' ELSE '-->' END || ' node_' || source_id || ' : ' || relation_type
      FROM gr JOIN o a ON source_id = a.id JOIN o b ON target_id = b.id AND a.file_id = b.file_id)
    SELECT file_id, '@startuml' || chr(10) || 'hide empty members' || chr(10) || array_to_string(list(line ORDER BY part, x, y, z), chr(10)) || chr(10) || '@enduml' AS diagram FROM l GROUP BY ALL""",
)
def diagram_class(spark: SparkSession, d: str) -> DataFrame:
    return G.classes(V.g_symbols(spark, d), V.g_relations(spark, d), "file_id")


_NODE = "'node_' || regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '_', 'g')"


@query(
    "diagram_sequence",
    f"""WITH ch AS ({oracle("call_chain_edges")}), who AS (SELECT seed, id, min(depth) AS depth FROM (SELECT seed, source_id AS id, depth FROM ch UNION ALL SELECT seed, target_id, depth FROM ch) GROUP BY ALL),
    l AS (SELECT seed, 0 AS part, depth, id AS y, '' AS z, 'participant "' || id || '" as ' || {_NODE.format("id")} AS line FROM who UNION ALL SELECT seed, 1, depth, source_id, target_id, {_NODE.format("source_id")} || ' -> ' || {_NODE.format("target_id")} || ' : calls' FROM ch)
    SELECT seed, '@startuml' || chr(10) || 'autonumber' || chr(10) || string_agg(line, chr(10) ORDER BY part, depth, y, z) || chr(10) || '@enduml' AS diagram FROM l GROUP BY seed""",
)
def diagram_sequence(spark: SparkSession, d: str) -> DataFrame:
    return G.sequence(T.call_chain(GQ._seeds(spark, d), V.g_relations(spark, d)))


@query(
    "entry_symbols",
    _RANK + ", cs AS (SELECT DISTINCT source_id AS id FROM gr WHERE relation_type = 'calls') SELECT seed, r.id FROM r LEFT JOIN cs ON r.id = cs.id QUALIFY row_number() OVER (PARTITION BY seed ORDER BY cs.id IS NULL, rank, r.id) = 1",
)
def entry_symbols(spark: SparkSession, d: str) -> DataFrame:
    return G.entry_symbols(GQ.top_ranked(spark, d), V.g_relations(spark, d))


# -- extraction ----------------------------------------------------------------------------------------------------------


@query("extract_symbols")
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of every source file, by its language."""
    from graphlens.sources.extract import extract

    return extract(table(spark, d, "raw_sources").select("repo_id", "file_id", "path", "content").distinct()).filter("part = 'symbol'").drop("part", "target")


@query("extract_relations")
def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    """Calls, imports, inheritance and exports of every source file."""
    from graphlens.sources.extract import extract

    rows = extract(table(spark, d, "raw_sources").select("repo_id", "file_id", "path", "content").distinct())
    return rows.filter("part <> 'symbol'").select("repo_id", "file_id", "part", F.col("qualified_name").alias("source"), "type", "target", "start_line")
