"""Source trees, bundles and snippets as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.tables import FILES, MODULES, RELATIONS, REPOS, SPANS, SYMBOLS

#: Folders and endings that a scan leaves out.
IGNORED_DIRS = (".git", "node_modules", "dist", "build", "target", "__pycache__", ".pytest_cache", "venv", ".venv")
IGNORED_ENDINGS = (".min.js", ".bundle.js")


def supported(rows: DataFrame, max_bytes: int = C.MAX_FILE_BYTES) -> DataFrame:
    """Rows (path, length, optionally content) that a scan takes: a known extension, no ignored folder or ending, not too
    large and, where the content is there, no zero byte in its first 1024 bytes."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ignored = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in IGNORED_DIRS]))
    for ending in IGNORED_ENDINGS:
        ignored = ignored | F.lower("path").endswith(ending)
    keep = rows.filter(~ignored & X.language_of_path(F.col("path")).isNotNull() & (F.col("length") <= max_bytes))
    if "content" in rows.columns:
        keep = keep.filter(~F.hex(F.substring("content", 1, 1024)).rlike("^(..)*00"))
    return keep


def scan_tree(spark: SparkSession, root: str, max_files: int = 5_000) -> DataFrame:
    """path (below root), language, content, content_hash, n_lines of the source files of a folder.

    Raises where there are more than `max_files`. Files that are not UTF-8 keep replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/") + r"\E/", "")
    taken = supported(raw.select(rel.alias("path"), "length", "content"))
    n = taken.limit(max_files + 1).count()
    if n > max_files:
        raise ValueError(f"{root} holds more than {max_files} source files")
    text = F.decode("content", "UTF-8")
    return taken.select("path", X.language_of_path(F.col("path")).alias("language"), text.alias("content"), F.sha1("content").alias("content_hash"), X.line_count(text).alias("n_lines"))


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a JSON bundle {repo_meta, modules, files, symbols, relations, spans}; missing fields are null."""

    def struct(ddl: str) -> str:
        return "struct<" + ",".join(f"{c.split()[0]}:{' '.join(c.split()[1:])}" for c in ddl.replace("map<string,string>", "map<string;string>").split(", ")).replace(";", ",") + ">"

    parts = {"modules": MODULES, "files": FILES, "symbols": SYMBOLS, "relations": RELATIONS, "spans": SPANS}
    schema = f"repo_meta {struct(REPOS)}, " + ", ".join(f"{k} array<{struct(v)}>" for k, v in parts.items())
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    out = {"repos": whole.select("repo_meta.*")}
    for k in parts:
        out[k] = whole.select(F.col("repo_meta.repo_id").alias("repo"), F.explode(k).alias("x")).select("repo", "x.*").withColumn("repo_id", F.coalesce("repo_id", "repo")).drop("repo")
    return out


def snippets(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """`asked` (repo_id, file_id, line_start, line_end, ...) with `snippet`, the lines from 1-based start to end, both
    included; rows outside the text drop out. Of several texts of a file the longest counts."""
    text = sources.groupBy("repo_id", "file_id").agg(F.max(F.struct(F.length("content").alias("n"), "content")).alias("t"))
    both = asked.join(text.select("repo_id", "file_id", F.split("t.content", "\n").alias("lines")), ["repo_id", "file_id"])
    both = both.filter("line_start >= 1 and line_end >= line_start and line_start <= size(lines)")
    return both.withColumn("snippet", F.array_join(F.expr("slice(lines, line_start, line_end - line_start + 1)"), "\n")).drop("lines")


def changed_paths(status: DataFrame) -> DataFrame:
    """path, change from lines of a version control's name-status listing (code, path, new_path): deleted where the code
    is D, or for the old name of a rename; else changed. A path that is both counts as changed."""
    code = F.upper(F.substring("code", 1, 1))
    rows = status.select(F.when(code == "D", "deleted").otherwise("changed").alias("change"), F.coalesce("new_path", "path").alias("path"))
    renamed = status.filter(code == "R").select(F.lit("deleted").alias("change"), "path")
    return rows.unionByName(renamed).filter("path is not null").groupBy("path").agg(F.min("change").alias("change"))
