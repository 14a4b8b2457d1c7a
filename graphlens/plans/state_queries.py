"""Queries on incremental builds, sessions, limits, tasks and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import cdc as D
from graphlens.operators import state as S
from graphlens.operators.lookup import first_of
from graphlens.operators.positions import nearest_rank
from graphlens.operators.snapshots import plain_hash, plain_path
from graphlens.plans.registry import query
from graphlens.tables import table

# -- incremental builds: what was known by the end of March 2025 against everything -------------------------------------

_P = r"nullif(trim(regexp_replace(regexp_replace(trim(path), '[\\/]+', '/', 'g'), '^(\.?/)+', '')), '')"
_CDC = rf"""WITH x AS (SELECT repo_id, {_P} AS path, nullif(trim(regexp_replace(lower(trim(content_hash)), '^sha1:', '')), '') AS content_hash, loaded_at, id FROM files),
p AS (SELECT * FROM x WHERE path IS NOT NULL AND loaded_at < timestamp '2025-04-01' QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY loaded_at DESC, content_hash DESC NULLS LAST) = 1),
c AS (SELECT * FROM x WHERE path IS NOT NULL AND loaded_at >= timestamp '2025-04-01' QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY loaded_at DESC, content_hash DESC NULLS LAST) = 1),
st AS (SELECT coalesce(p.repo_id, c.repo_id) AS repo_id, coalesce(p.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN p.content_hash = c.content_hash THEN 'reused' ELSE 'parsed' END AS status
  FROM p FULL JOIN c ON p.repo_id = c.repo_id AND p.path = c.path)
"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "files").select("repo_id", plain_path(F.col("path")).alias("path"), plain_hash(F.col("content_hash")).alias("content_hash"), "loaded_at").filter("path is not null")
    split = F.lit("2025-04-01").cast("timestamp")
    order = [F.col("loaded_at").desc(), F.col("content_hash").desc_nulls_last()]
    return tuple(first_of(x.filter(c), ["repo_id", "path"], order) for c in (F.col("loaded_at") < split, F.col("loaded_at") >= split))


@query("cdc_file_status", _CDC + "SELECT repo_id, path, status FROM st")
def cdc_file_status(spark: SparkSession, d: str) -> DataFrame:
    return D.file_status(*_halves(spark, d), ["repo_id", "path"])


@query(
    "cdc_build_stats",
    _CDC
    + """SELECT repo_id, count(*) FILTER (WHERE status = 'parsed') AS parsed, count(*) FILTER (WHERE status = 'reused') AS reused, count(*) FILTER (WHERE status = 'deleted') AS deleted,
    count(*) FILTER (WHERE status <> 'deleted') AS scanned FROM st GROUP BY ALL""",
)
def cdc_build_stats(spark: SparkSession, d: str) -> DataFrame:
    return D.build_stats(D.file_status(*_halves(spark, d), ["repo_id", "path"]), ["repo_id"])


@query("stale_ids", _CDC + "SELECT repo_id, path FROM p EXCEPT SELECT repo_id, path FROM c")
def stale_ids(spark: SparkSession, d: str) -> DataFrame:
    return D.stale_ids(*_halves(spark, d), ["repo_id", "path"])


# -- sessions and limits ------------------------------------------------------------------------------------------------


@query(
    "session_ttl",
    """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE ts IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT user_id, session::bigint AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL""",
)
def session_ttl(spark: SparkSession, d: str) -> DataFrame:
    return S.session_spans(table(spark, d, "events"), ttl_s=43_200)


_LIMITED = """WITH RECURSIVE w AS (SELECT user_id, min(ts) AS s FROM events GROUP BY user_id
      UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 6 HOUR GROUP BY w.user_id, w.s),
    a AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS z FROM w),
    c AS (SELECT a.user_id, a.s, count(*) AS n FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.s AND (a.z IS NULL OR e.ts < a.z) GROUP BY ALL)
    SELECT user_id, count(*) AS windows, sum(least(n, 2))::bigint AS accepted, sum(greatest(n - 2, 0))::bigint AS rejected FROM c GROUP BY user_id"""


@query("rate_limit_fixed_window", _LIMITED)
def rate_limit_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return S.rate_limited(table(spark, d, "events"), limit=2, window_s=21_600)


_TURNS = """WITH t AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('view', 'signup') THEN 'none' ELSE 'symbol' END AS level, CASE event_type WHEN 'click' THEN 0.9 WHEN 'purchase' THEN 0.85 WHEN 'error' THEN 0.5 ELSE 0 END AS confidence,
CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'S_' || (event_id % 7) END AS target FROM events),
k AS (SELECT *, last_value(CASE WHEN level <> 'none' THEN struct_pack(t := target, c := confidence) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS l FROM t),
r AS (SELECT *, CASE WHEN level <> 'none' THEN target WHEN l.c >= 0.8 THEN l.t END AS kept FROM k), q AS (SELECT *, lag(kept) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM r)
"""


@query("anchor_memory_fold", _TURNS + "SELECT user_id, event_id, kept AS kept_target, b IS NOT NULL AND kept IS NOT NULL AND b <> kept AS cleared FROM q")
def anchor_memory_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    real = ~F.col("event_type").isin("view", "signup")
    turns = e.select(
        "user_id", "event_id", "ts",
        F.when(real, "symbol").otherwise("none").alias("level"),
        F.when(F.col("event_type") == "click", 0.9).when(F.col("event_type") == "purchase", 0.85).when(F.col("event_type") == "error", 0.5).otherwise(0.0).alias("confidence"),
        F.when(real, F.concat(F.lit("S_"), (F.col("event_id") % 7).cast("string"))).alias("target"),
    )
    return S.anchors_kept(turns, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "kept_target", "cleared")


@query("focus_memory_fold")
def focus_memory_fold(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each document as a question in the session of its source, in order of writing."""
    docs = table(spark, d, "documents").select("source", "doc_id", "generated_at", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("q"))
    return S.focus_memory(docs, "source", ["generated_at", "doc_id"], "q", "doc_id")


# -- tasks: a user's events as a task's log -----------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END"
_LOG = f"""WITH log AS (SELECT 'task_' || user_id || '_' || (event_id % 5) AS task_id, {_STATUS} AS status, ts AS tm, event_id AS seq FROM events),
t AS (SELECT task_id, max(struct_pack(a := tm, b := seq, c := status)) AS m, min(tm) AS created_at FROM log GROUP BY ALL), k AS (SELECT task_id, m.c AS status, created_at, m.a AS updated_at FROM t)
"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    e, t = table(spark, d, "events"), F.col("event_type")
    status = F.when(t == "signup", "queued").when(t == "purchase", "success").when(t == "error", "failed").otherwise("running")
    return e.select(F.concat(F.lit("task_"), "user_id", F.lit("_"), (F.col("event_id") % 5).cast("string")).alias("task_id"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query("task_latest_status", _LOG + "SELECT * FROM k")
def task_latest_status(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_tasks(_log(spark, d))


@query(
    "task_retention",
    _LOG
    + """, r AS (SELECT * FROM k WHERE NOT (status IN ('success', 'failed') AND updated_at < timestamp '2024-01-30' - INTERVAL 2 DAY)), n AS (SELECT greatest(count(*) - 200, 0) AS o FROM r),
    x AS (SELECT *, row_number() OVER (ORDER BY updated_at, task_id) AS rn FROM r WHERE status IN ('success', 'failed'))
    SELECT task_id, status, updated_at FROM r WHERE status NOT IN ('success', 'failed') UNION ALL SELECT task_id, status, updated_at FROM x, n WHERE rn > o""",
)
def task_retention(spark: SparkSession, d: str) -> DataFrame:
    tasks = S.latest_tasks(_log(spark, d)).drop("created_at")
    return S.retained(tasks, F.lit("2024-01-30").cast("timestamp_ntz"), 172_800, 200)


_SECTIONS = """WITH log AS (SELECT 'task_' || user_id AS task_id, 's' || (event_id % 4) AS section, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'done' END AS status, ts AS tm, event_id AS seq FROM events)
"""


def _section_log(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, d, "events").select(
        F.concat(F.lit("task_"), "user_id").alias("task_id"),
        F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("section"),
        F.when(t == "error", "failed").when(t == "view", "pending").otherwise("done").alias("status"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


@query(
    "task_progress_state",
    _SECTIONS
    + """, l AS (SELECT task_id, section, max(struct_pack(a := tm, b := seq, c := status)).c AS status FROM log GROUP BY ALL)
    SELECT task_id, count(*) AS sections, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed,
    CASE WHEN count(*) FILTER (WHERE status = 'done') = count(*) THEN 'completed' WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' ELSE 'in_progress' END AS status FROM l GROUP BY task_id""",
)
def task_progress_state(spark: SparkSession, d: str) -> DataFrame:
    return S.task_progress(_section_log(spark, d))


@query("retries_exhausted", _SECTIONS + "SELECT task_id, section, seq FROM log WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY task_id, section ORDER BY tm, seq) = 4")
def retries_exhausted(spark: SparkSession, d: str) -> DataFrame:
    return S.retries_exhausted(_section_log(spark, d).filter("status = 'failed'"))


@query(
    "sections_to_resume",
    _SECTIONS
    + """, l AS (SELECT task_id, section, max(struct_pack(a := tm, b := seq, c := status)).c AS status FROM log GROUP BY ALL), ck AS (SELECT DISTINCT task_id, section FROM log WHERE seq % 2 = 0 AND status = 'done')
    SELECT DISTINCT task_id, section FROM log EXCEPT (SELECT task_id, section FROM l WHERE status = 'done' INTERSECT SELECT * FROM ck)""",
)
def sections_to_resume(spark: SparkSession, d: str) -> DataFrame:
    log = _section_log(spark, d)
    last = log.groupBy("task_id", "section").agg(F.max(F.struct("at", "seq", "status")).alias("m")).select("task_id", "section", "m.status")
    saved = log.filter("seq % 2 = 0 and status = 'done'").select("task_id", "section").distinct()
    return S.to_resume(log.select("task_id", "section").distinct(), last, saved)


# -- metrics ------------------------------------------------------------------------------------------------------------


@query("metric_counters", "SELECT event_type AS name, count(*) AS value FROM events GROUP BY event_type")
def metric_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))


_PCT = """WITH v AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT name, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, count(*) AS count, sum(value::decimal(12, 2)) AS sum, max(value) FILTER (WHERE rn = round_even((n - 1) * 0.5::double, 0) + 1) AS p50,
  max(value) FILTER (WHERE rn = round_even((n - 1) * 0.99::double, 0) + 1) AS p99 FROM v GROUP BY name)
"""


@query("histogram_stats", _PCT + "SELECT name, min, max, avg, count, p50, p99 FROM p")
def histogram_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram_stats(table(spark, d, "events").withColumnRenamed("event_type", "name"), "name", "value").withColumn("avg", F.round("avg", 6))


@query("percentile_nearest_rank", _PCT + "SELECT name, p50, p99 FROM p")
def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return nearest_rank(table(spark, d, "events").withColumnRenamed("event_type", "name"), "name", "value", {"p50": 0.5, "p99": 0.99})


@query(
    "prometheus_text",
    _PCT
    + """SELECT 'events_' || name AS metric, '# TYPE events_' || name || ' counter' || chr(10) || 'events_' || name || ' ' || count AS text FROM p UNION ALL
    SELECT 'value_' || name, '# TYPE value_' || name || ' summary' || chr(10) || 'value_' || name || '_count ' || count || chr(10) || 'value_' || name || '_sum ' || sum::decimal(22, 2) || chr(10) ||
    'value_' || name || '{quantile="0.5"} ' || p50::decimal(12, 2) || chr(10) || 'value_' || name || '{quantile="0.99"} ' || p99::decimal(12, 2) FROM p""",
)
def prometheus_text(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    counters = e.groupBy(F.concat(F.lit("events."), "event_type").alias("name")).agg(F.count("*").alias("value"))
    named = e.withColumn("name", F.concat(F.lit("value."), "event_type"))
    stats = S.histogram_stats(named, "name", "value").join(named.groupBy("name").agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("sum")), "name")
    for c in ("p50", "p99"):
        stats = stats.withColumn(c, F.col(c).cast("decimal(12,2)"))
    return S.exposition(counters, stats)


# -- streams ------------------------------------------------------------------------------------------------------------


@query("stream_counters", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    from graphlens.streaming.events import daily_counters

    return daily_counters(spark, f"{d}/events.parquet")


@query("stream_rate_limit", _LIMITED)
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    from graphlens.streaming.events import limited

    return limited(spark, f"{d}/events.parquet", limit=2, window_s=21_600)
