"""Queries on scans, lookups, joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.operators import lookup as L
from graphlens.plans import views as V
from graphlens.plans.registry import query
from graphlens.tables import table


@query("latest_repo_by_path", "SELECT repo_path, max(struct_pack(t := scan_time, r := repo_id)).r AS repo_id FROM repos GROUP BY repo_path")
def latest_repo_by_path(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_repo_by_path(table(spark, d, "repos"))


@query(
    "list_symbols_by_file",
    f"""WITH {V.CODE} SELECT repo_id, file_id, id, qualified_name,
    row_number() OVER (PARTITION BY repo_id, file_id ORDER BY start_line NULLS FIRST, qualified_name NULLS FIRST, id) AS place FROM s""",
)
def list_symbols_by_file(spark: SparkSession, d: str) -> DataFrame:
    rows = V.symbols(spark, d).select("repo_id", "file_id", "id", "qualified_name", "start_line")
    return L.first_of(rows, ["repo_id", "file_id"], ["start_line", "qualified_name", "id"], 1 << 30, "place").drop("start_line")


@query(
    "embedded_objects",
    f"""WITH {V.CODE}, o AS (SELECT repo_id, id, 'module' AS kind, name FROM m UNION ALL SELECT repo_id, id, 'file', name FROM f UNION ALL SELECT repo_id, id, 'symbol', name FROM s),
    e AS (SELECT DISTINCT repo_id, object_id AS id, lower(trim(object_type)) AS kind FROM object_embeddings)
    SELECT repo_id, id, kind, name FROM e JOIN o USING (repo_id, id, kind)""",
)
def embedded_objects(spark: SparkSession, d: str) -> DataFrame:
    """Search hits joined with their objects by id and type; misses drop out."""
    o = L.objects(V.modules(spark, d), V.files(spark, d), V.symbols(spark, d)).select("repo_id", "id", "kind", "name")
    e = table(spark, d, "object_embeddings").select("repo_id", F.col("object_id").alias("id"), F.lower(F.trim("object_type")).alias("kind")).distinct()
    return e.join(o, ["repo_id", "id", "kind"])


@query(
    "name_search_files",
    f"""WITH {V.CODE}, t AS (SELECT DISTINCT lower(trim(name)) AS term FROM m WHERE trim(name) <> ''),
    h AS (SELECT term, repo_id, id, lower(path) AS o, CASE WHEN lower(name) = term THEN 0 WHEN lower(path) = term THEN 1 ELSE 2 END AS tier
          FROM f JOIN t ON contains(lower(name), term) OR contains(lower(path), term))
    SELECT term, repo_id, id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tier, length(o), repo_id, id) AS rank FROM h) WHERE rank <= 10""",
)
def name_search_files(spark: SparkSession, d: str) -> DataFrame:
    return L.name_search(V.files(spark, d).select("repo_id", "id", "name", F.col("path").alias("other")), V.modules(spark, d).select("name")).drop("n", "o")


_SPANS = f"""WITH {V.CODE}, sp AS (
  SELECT repo_id, file_id, id AS span_id, type, start_line AS a, end_line AS b FROM s
  UNION ALL SELECT repo_id, id, id, 'file', start_line, end_line FROM f),
q AS (SELECT repo_id, id AS sel_id, file_id, start_line AS line_start, end_line AS line_end FROM s),
c AS (SELECT q.*, span_id, type, a, b FROM q JOIN sp USING (repo_id, file_id) WHERE a <= line_start AND b >= line_end)
"""


def _contained(spark: SparkSession, d: str) -> DataFrame:
    s, f = V.symbols(spark, d), V.files(spark, d)
    spans = s.select("repo_id", "file_id", F.col("id").alias("span_id"), "type", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    spans = spans.unionByName(f.select("repo_id", F.col("id").alias("file_id"), F.col("id").alias("span_id"), F.lit("file").alias("type"), F.col("start_line").alias("a"), F.col("end_line").alias("b")))
    asked = s.select("repo_id", F.col("id").alias("sel_id"), "file_id", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"))
    return L.containing_spans(asked, spans)


@query("span_containment", _SPANS + "SELECT repo_id, sel_id, count(*) AS spans, min(b - a) AS narrowest FROM c GROUP BY repo_id, sel_id")
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    return _contained(spark, d).groupBy("repo_id", "sel_id").agg(F.count("*").alias("spans"), F.min(F.col("b") - F.col("a")).alias("narrowest"))


@query(
    "span_best_match",
    _SPANS
    + """SELECT repo_id, sel_id, span_id FROM c QUALIFY row_number() OVER (PARTITION BY repo_id, sel_id ORDER BY
    CASE WHEN type IN ('method', 'function') THEN 0 WHEN type IN ('class', 'interface') THEN 1 WHEN type = 'file' THEN 2 ELSE 3 END, b - a, span_id) = 1""",
)
def span_best_match(spark: SparkSession, d: str) -> DataFrame:
    return L.best_span(_contained(spark, d)).select("repo_id", "sel_id", "span_id")


@query(
    "symbol_containers",
    f"WITH {V.CODE} SELECT s.repo_id, s.id, f.path AS file_path, m.name AS module_name FROM s LEFT JOIN f ON s.repo_id = f.repo_id AND s.file_id = f.id LEFT JOIN m ON s.repo_id = m.repo_id AND s.module_id = m.id",
)
def symbol_containers(spark: SparkSession, d: str) -> DataFrame:
    return L.with_containers(V.symbols(spark, d), V.files(spark, d), V.modules(spark, d)).select("repo_id", "id", "file_path", "module_name")


@query(
    "neighbors",
    f"""WITH {V.GRAPH}, e AS (SELECT source_id AS id, target_id AS other, 1 AS o, 0 AS i FROM gr UNION ALL SELECT target_id, source_id, 0, 1 FROM gr)
    SELECT e.id, sum(o)::bigint AS n_out, sum(i)::bigint AS n_in, count(DISTINCT other) AS n_neighbors
    FROM e JOIN gs a ON e.id = a.id JOIN gs b ON e.other = b.id GROUP BY e.id""",
)
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    known = V.g_symbols(spark, d).select("id")
    ends = L.directed(V.g_relations(spark, d))
    ends = ends.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "other"), "other", "left_semi")
    return ends.groupBy("id").agg(
        F.count_if(F.col("direction") == "out").alias("n_out"), F.count_if(F.col("direction") == "in").alias("n_in"), F.countDistinct("other").alias("n_neighbors")
    )


_ENDS = f"WITH {V.GRAPH}, x AS (SELECT gr.*, a.module_id AS source_module, b.module_id AS target_module FROM gr JOIN gs a ON source_id = a.id JOIN gs b ON target_id = b.id)\n"


@query(
    "module_dependency_matrix",
    _ENDS + "SELECT source_module, target_module, count(*) AS edges, array_to_string(list_sort(list(DISTINCT relation_type)), ', ') AS kinds FROM x WHERE source_module <> target_module GROUP BY ALL",
)
def module_dependency_matrix(spark: SparkSession, d: str) -> DataFrame:
    cross = L.with_modules(V.g_relations(spark, d), V.g_symbols(spark, d)).filter("source_module <> target_module")
    kinds = F.array_join(F.array_sort(F.collect_set("relation_type")), ", ").alias("kinds")
    return cross.groupBy("source_module", "target_module").agg(F.count("*").alias("edges"), kinds)


@query(
    "edges_touching_modules",
    _ENDS + "SELECT module_id, count(*) AS edges FROM (SELECT source_id, target_id, relation_type, unnest(list_distinct([source_module, target_module])) AS module_id FROM x) GROUP BY module_id",
)
def edges_touching_modules(spark: SparkSession, d: str) -> DataFrame:
    """Edges with either end in a module: one row per end instead of a join on either of two columns."""
    ends = L.with_modules(V.g_relations(spark, d), V.g_symbols(spark, d))
    return ends.select(F.explode(F.array_distinct(F.array("source_module", "target_module"))).alias("module_id")).groupBy("module_id").agg(F.count("*").alias("edges"))


@query(
    "edge_endpoints_module_set",
    _ENDS + "SELECT DISTINCT unnest([source_module, target_module]) AS module_id FROM x WHERE source_module <> target_module",
)
def edge_endpoints_module_set(spark: SparkSession, d: str) -> DataFrame:
    cross = L.with_modules(V.g_relations(spark, d), V.g_symbols(spark, d)).filter("source_module <> target_module")
    return cross.select(F.explode(F.array("source_module", "target_module")).alias("module_id")).distinct()


@query(
    "api_symbols",
    f"""WITH {V.CODE} SELECT repo_id, id FROM s WHERE type IN ('route', 'controller', 'endpoint', 'api') OR regexp_matches(lower(qualified_name), 'route|controller|endpoint|api')""",
)
def api_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = V.symbols(spark, d)
    return s.filter(F.col("type").isin(*C.API_TYPES) | F.lower("qualified_name").rlike("|".join(C.API_TYPES))).select("repo_id", "id")


@query("public_symbols", f"WITH {V.CODE} SELECT repo_id, id, type FROM s WHERE visibility = 'public' AND type IN ('class', 'function', 'method')")
def public_symbols(spark: SparkSession, d: str) -> DataFrame:
    return V.symbols(spark, d).filter((F.col("visibility") == "public") & F.col("type").isin("class", "function", "method")).select("repo_id", "id", "type")


@query(
    "embedding_candidates",
    f"""WITH {V.CODE} SELECT repo_id, id, 'module' AS kind FROM m WHERE trim(summary) <> '' UNION ALL SELECT repo_id, id, 'file' FROM f WHERE trim(summary) <> ''
    UNION ALL SELECT repo_id, id, 'symbol' FROM s WHERE trim(summary) <> ''""",
)
def embedding_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Objects whose summary is not blank."""
    parts = [("module", V.modules(spark, d)), ("file", V.files(spark, d)), ("symbol", V.symbols(spark, d))]
    rows = [df.filter(F.trim("summary") != "").select("repo_id", "id", F.lit(kind).alias("kind")) for kind, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "scan_filter",
    r"""WITH p AS (SELECT DISTINCT repo_id, trim(regexp_replace(regexp_replace(trim(path), '[\\/]+', '/', 'g'), '^(\.?/)+', '')) AS path, n_bytes FROM raw_sources)
    SELECT repo_id, path FROM p WHERE path <> '' AND n_bytes <= 1000000 AND NOT regexp_matches(lower(path), '\.(min|bundle)\.js$')
      AND regexp_matches(lower(path), '\.(py|java|js|jsx|ts|tsx|go|rs|c|h|cc|cpp|hpp)$')
      AND NOT regexp_matches('/' || path, '/(\.git|node_modules|dist|build|target|__pycache__|\.pytest_cache|venv|\.venv)/')""",
)
def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    from graphlens.operators.snapshots import plain_path
    from graphlens.sources.scan import supported

    rows = table(spark, d, "raw_sources").select("repo_id", plain_path(F.col("path")).alias("path"), F.col("n_bytes").alias("length")).distinct()
    return supported(rows.filter("path is not null")).select("repo_id", "path")


@query(
    "path_parts",
    r"""WITH p AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)
    SELECT path, split_part(path, '/', 1) AS first_part, regexp_extract(path, '([^/]*)$', 1) AS name,
      'F_' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') || '_' || substr(sha1(path), 1, 8) AS file_id,
      CASE regexp_extract(lower(path), '\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript'
        WHEN 'ts' THEN 'javascript' WHEN 'tsx' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cc' THEN 'cpp'
        WHEN 'cpp' THEN 'cpp' WHEN 'hpp' THEN 'cpp' END AS language FROM p""",
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "files").filter("path is not null").select("path").distinct()
    return p.select(
        "path",
        F.element_at(F.split("path", "/"), 1).alias("first_part"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        X.file_id(F.col("path")).alias("file_id"),
        X.language_of_path(F.col("path")).alias("language"),
    )


@query(
    "content_hash_and_lines",
    r"""WITH r AS (SELECT DISTINCT repo_id, file_id, content FROM raw_sources WHERE content IS NOT NULL)
    SELECT repo_id, file_id, sha1(content) AS content_hash, greatest(1, length(content) - length(replace(content, chr(10), '')) +
      CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END)::int AS n_lines FROM r""",
)
def content_hash_and_lines(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_sources").filter("content is not null").select("repo_id", "file_id", "content").distinct()
    return r.select("repo_id", "file_id", F.sha1("content").alias("content_hash"), X.line_count(F.col("content")).alias("n_lines"))


@query(
    "snippet_range",
    f"""WITH {V.CODE}, r AS (SELECT repo_id, file_id, max(struct_pack(n := length(content), c := content)).c AS content FROM raw_sources GROUP BY ALL),
    l AS (SELECT repo_id, file_id, str_split(content, chr(10)) AS lines FROM r)
    SELECT s.repo_id, s.id, array_to_string(lines[start_line:end_line], chr(10)) AS snippet FROM s JOIN l USING (repo_id, file_id) WHERE start_line >= 1 AND end_line >= start_line AND start_line <= len(lines)""",
)
def snippet_range(spark: SparkSession, d: str) -> DataFrame:
    """The source lines of each symbol, as far as the file's text is at hand."""
    from graphlens.sources.scan import snippets

    asked = V.symbols(spark, d).select("repo_id", "file_id", "id", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"))
    return snippets(asked, table(spark, d, "raw_sources")).select("repo_id", "id", "snippet")
