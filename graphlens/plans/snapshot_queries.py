"""Queries on what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlens.operators.snapshots import snapshot_changes
from graphlens.plans.registry import query
from graphlens.tables import table


@query(
    "p2_found",
    r"""
WITH f0 AS (
  SELECT repo_id, lower(trim(commit_hash)) AS name, loaded_at,
         trim(regexp_replace(regexp_replace(trim(path), '[\\/]+', '/', 'g'), '^(\.?/)+', '')) AS path,
         nullif(trim(regexp_replace(lower(trim(content_hash)), '^sha1:', '')), '') AS hash
  FROM files),
k AS (SELECT DISTINCT repo_id, commit_hash FROM repos),
m AS (
  SELECT n.repo_id, n.name, max(k.commit_hash) AS commit_hash, count(*) AS c
  FROM (SELECT DISTINCT repo_id, name FROM f0) n
  JOIN k ON n.repo_id = k.repo_id AND starts_with(lower(trim(k.commit_hash)), n.name) AND length(n.name) >= 4
  GROUP BY ALL HAVING c = 1),
f AS (
  SELECT repo_id, commit_hash, path, max(struct_pack(a := loaded_at, b := hash)).b AS hash
  FROM f0 JOIN m USING (repo_id, name) WHERE path <> '' GROUP BY ALL),
s AS (
  SELECT repo_id, commit_hash, min(scan_time) AS t, min_by(regexp_replace(trim(branch), '^refs/heads/', ''), scan_time) AS b
  FROM repos WHERE (repo_id, commit_hash) IN (SELECT (repo_id, commit_hash) FROM f) GROUP BY ALL),
p AS (SELECT repo_id, commit_hash AS new, lag(commit_hash) OVER (PARTITION BY repo_id, b ORDER BY t, commit_hash) AS old FROM s),
n AS (SELECT p.repo_id, p.new, f.path, f.hash FROM p JOIN f ON p.repo_id = f.repo_id AND p.new = f.commit_hash WHERE old IS NOT NULL),
o AS (SELECT p.repo_id, p.new, f.path, f.hash FROM p JOIN f ON p.repo_id = f.repo_id AND p.old = f.commit_hash)
SELECT coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.new, o.new) AS commit_hash, coalesce(n.path, o.path) AS path,
       CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.repo_id = o.repo_id AND n.new = o.new AND n.path = o.path
WHERE o.path IS NULL OR n.path IS NULL OR n.hash <> o.hash
""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "repos"), table(spark, sf_dir, "files"))
