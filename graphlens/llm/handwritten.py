"""Files that nobody wrote by hand: generated, minified, vendored, or data kept as code.

Layout statistics of each whole text are taken in Python, once per row and without moving texts; limits of each language are
then applied to those numbers by Spark. What comments and paths say stands beside that in columns of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.natural import prose_of
from graphlens.llm.prose import language_of
from graphlens.operators.snapshots import plain_path
from graphlens.tables import table

#: Layout limits by language. Minified: the longest line and the mean line at least, white space and alphanumeric share at
#: most. Data: share of lines that hold nothing but literals, and of characters in numeric literals or encoded runs, at
#: least. Machine-made: the longest and the mean line at most (tools write many short lines of one make; people's
#: comments make lines long). Set from the corpus' distributions of each language: minified and data far between the two
#: groups, machine-made well above what tools' output shows, as short files scatter.
LIMITS = {
    "python": {"dense": (900, 300, 0.08, 0.80), "data": (0.6, 0.5), "machine": (130, 54)},
    "javascript": {"dense": (400, 200, 0.11, 0.85), "data": (0.6, 0.5), "machine": (130, 50)},
    "java": {"dense": (900, 350, 0.09, 0.80), "data": (0.6, 0.5), "machine": (130, 48)},
    "go": {"dense": (900, 300, 0.08, 0.80), "data": (0.6, 0.5), "machine": (130, 48)},
    "rust": {"dense": (900, 300, 0.08, 0.80), "data": (0.6, 0.5), "machine": (130, 48)},
    "cpp": {"dense": (900, 300, 0.08, 0.80), "data": (0.6, 0.5), "machine": (130, 46)},
    "c": {"dense": (900, 300, 0.08, 0.80), "data": (0.55, 0.45), "machine": (120, 44)},
    "": {"dense": (900, 300, 0.08, 0.80), "data": (0.6, 0.5), "machine": (130, 48)},
}
#: Lines of a data file at least.
DATA_LINES = 8

#: A line of a comment says that a tool wrote the file.
TOOL = re.compile(
    r"@generated\b|<auto-?generated>|\b(?:auto(?:matically)?|machine)[- ]?(?:generated|created|produced|written|made)\b(?! method| stub)"
    r"|\b(?:code|file|source|parser|stubs?|bindings?)\b.{0,40}\b(?:generated|produced automatically|created automatically)\b|\bgenerated (?:by|from|with|using|on|file|code)\b|\bdo not (?:edit|modify|change|touch)\b|\bregenerate with\b"
    r"|\bmaschinell (?:erzeugt|erstellt|generiert)|\bautomatisch (?:erzeugt|erstellt|generiert)|\bnicht (?:von hand |manuell )?(?:ändern|bearbeiten)|\bgénérée?\b(?! d)|\bne pas (?:modifier|éditer)|\bgenerad[oa]\b|\bno (?:editar|modificar)|\bgerad[oa]\b|\bnão (?:edit|modif)|\bgenerat[oa]\b|\bnon modificare|\bgegenereerd\b|\bniet (?:wijzigen|bewerken)"
    r"|сгенерирован|создан автоматически|не (?:редактировать|изменять|править)|自动生成|请勿|勿手工修改|自動生成|編集しない|変更しない",
    re.I,
)
#: A line of a comment names a release of another project.
RELEASE = re.compile(
    r"\b(?:part of|taken from|copied from|imported from|vendored from|based on|distribution|upstream|release|licen[cs]e)\b.*\bv?\d+\.\d+(?:\.\d+)?\b|\bv?\d+\.\d+(?:\.\d+)?\b.*\b(?:upstream|release|distribution|licen[cs]ed?|repository|copyright)\b|^\W*[\w.@/-]+ v?\d+\.\d+\.\d+\b",
    re.I,
)
VERSION = re.compile(r"\d\.\d")
NOT_RELEASE = re.compile(r"\b(?:python|java|go|node|c\+\+|requires|since|version of this)\b", re.I)
COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|pragma|\[)|/\*|\*|\"\"\"|<!--|--)")
NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])")
ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{32,}|(?:\\x[0-9a-fA-F]{2}){8,}")
LITERAL_LINE = re.compile(r"^[\s,;+()\[\]{}]*(?:(?:[-+]?(?:0[xX][0-9a-fA-F]+|[\d.]+(?:[eE][-+]?\d+)?)[uUlLfF]*|[bB]?[\"'][A-Za-z0-9+/=_\\-]{16,}[\"'])[\s,;+()\[\]{}]*)+$")
LICENCE = re.compile(r"licen[cs]e|copyright|warrant|redistribut|copying", re.I)

#: Path patterns (lower case): folders and names that tools and package managers use. A tool's counts only where the
#: layout is machine-made.
VENDOR_DIR = r"(^|/)(node_modules|bower_components|third_?party|3rd_?party|site-packages|dist-packages|_vendor|godeps/_workspace|jspm_packages|(vendor|external|deps)/[a-z][\w.-]*-\d+\.\d+[\w.-]*)/"
TOOL_DIR = r"(^|/)(__generated__|generated|generated-sources|autogen|_gen|gen)/"
TOOL_NAME = r"(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h)|_grpc\.py|outerclass\.java|(^|/)zz_generated\.[^/]*|(^|/)moc_[^/]*|_stub\.java|\.gen\.[a-z]+|\.graphql\.tsx?|\.(yy|tab)\.[ch]|\.g\.[a-z]+|\.designer\.cs|_generated\.[a-z]+)$"
MIN_NAME = r"[.-](min|bundle|chunk)\.(js|mjs|cjs|css)$"

STATS = "chars int, lines int, longest int, mean_line double, blank double, alnum double, numeric double, encoded double, literal double, tool boolean, release boolean, sentences int"
_BLANKS, _ALNUM = b" \t\r\n\f\v", bytes(c for c in range(128) if chr(c).isalnum()) + bytes(range(128, 256))


def comment_lines(full: list[str]) -> list[str]:
    """Lines of comments, out of a text's lines that are not blank, wherever they stand. Of a docstring only the first line
    is given; the lines after it are passed over."""
    out, ends = [], ""
    for x in full:
        if ends:
            if ends != '"""':
                out.append(x.split(ends)[0])
            if ends in x:
                ends = ""
            continue
        if COMMENT.match(x):
            out.append(x)
            mark = x.strip()
            ends = next((e for m, e in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""')) if mark.startswith(m)), "")
            if ends and ends in mark[3 if ends == '"""' else 2 :]:
                ends = ""
    return out


def statistics(text: str | None) -> tuple:
    """Layout of one text, and what its comments say; see STATS. Null is as empty."""
    t = (text or "").lstrip("\ufeff")
    data = t.encode("utf-8", "replace")
    n = max(len(data), 1)
    lines = t.splitlines() or [""]
    sizes = [len(x) for x in lines]
    full = [x for x in lines if x.strip()]
    said = comment_lines(full)
    release = any(RELEASE.search(x) and not NOT_RELEASE.search(x) for x in said if VERSION.search(x))
    tool = bool(TOOL.search("\n".join(said)))
    numeric = sum(m.end() - m.start() for m in NUMBER.finditer(t)) / max(1, n - sum(data.count(bytes([b])) for b in _BLANKS))
    encoded = sum(m.end() - m.start() for m in ENCODED.finditer(t)) / n
    literal = sum(bool(LITERAL_LINE.match(x)) for x in full) / max(1, len(full)) if numeric > 0.2 or encoded > 0.2 else 0.0
    blank = (n - len(data.translate(None, _BLANKS))) / n
    alnum = (n - len(data.translate(None, _ALNUM))) / n
    return len(t), len(lines), max(sizes), len(t) / max(1, len(full)), blank, alnum, numeric, encoded, literal, tool, release


def text_statistics(sources: DataFrame) -> DataFrame:
    """repo_id, path (plain), and STATS of each row of the raw sources. sentences (of prose, licences left out) decide only
    where nothing but the path names a tool, and are counted there only."""
    named = re.compile(f"{TOOL_DIR}|{TOOL_NAME}")

    def taken(batches):
        for b in batches:
            told = pd.DataFrame([statistics(t) for t in b["content"]], columns=[c.split()[0] for c in STATS.split(", ")][:-1])
            at = [i for i, p in enumerate(b["path"]) if p and named.search(p.lower())]
            which, words, _ = prose_of([(b["content"].iloc[i] or "") for i in at])
            told["sentences"] = np.bincount([at[k] for k, w in zip(which, words) if not LICENCE.search(w) and not TOOL.search(w)], minlength=len(b)) if which else 0
            yield pd.concat([b[["repo_id", "path"]].reset_index(drop=True), told], axis=1)

    return sources.select("repo_id", plain_path(F.col("path")).alias("path"), "content").mapInPandas(taken, f"repo_id string, path string, {STATS}")


def _limit(language: Column, kind: str, k: int) -> Column:
    pairs = [x for name, limits in LIMITS.items() for x in (F.lit(name), F.lit(float(limits[kind][k])))]
    return F.create_map(*pairs)[language]


def layout_of(language: Column, length: Column, low: Column) -> Column:
    """What the layout statistics say by the limits of the language: `data`, `minified`, `machine` or `written`; null where
    there is no text. A name that minifiers give halves their limits of length."""
    limit = lambda kind, k: _limit(language, kind, k)
    dense = (F.col("longest") >= limit("dense", 0)) & (F.col("mean_line") >= limit("dense", 1)) & (F.col("blank") <= limit("dense", 2)) & (F.col("alnum") <= limit("dense", 3))
    named = low.rlike(MIN_NAME) & (F.col("longest") >= limit("dense", 0) / 2) & (F.col("blank") <= limit("dense", 2) + 0.04)
    return (
        F.when(F.col("chars").isNull(), None)
        .when((length >= DATA_LINES) & (F.col("literal") >= limit("data", 0)) & (F.greatest("numeric", "encoded") >= limit("data", 1)), "data")
        .when(dense | named, "minified")
        .when((F.col("chars") > 0) & (F.col("longest") <= limit("machine", 0)) & (F.col("mean_line") <= limit("machine", 1)), "machine")
        .otherwise("written")
    )


def file_origins(files: DataFrame, sources: DataFrame) -> DataFrame:
    """repo_id, path, language, layout, marker, place, kind of every file.

    layout: what the statistics of its text say (`data`, `minified`, `machine`, `written`; null: no text at hand). marker: what
    its comments say (`tool`, `release`, else empty). place: what its path says (`vendor`, `tool`, else empty). kind: `data` and
    `minified` by layout alone; `generated` where the layout is machine-made and the marker, or else the place of a text without a sentence, names a tool (a short hand-written
    file has the same layout, so that it alone cannot tell); `vendored` where marker or place names another project's
    release (a copy of hand-written code has the layout of hand-written code); else `written`.

    Paths are in plain form; rows with a null path are left out. Of several texts of a path (repeated rows) the largest
    counts; a file without text is judged by its place. Null, empty and cut-off texts have the statistics of what is there; an
    empty text is `written` unless its folder is a vendor's. end_line (the largest delivered) stands for the length of a text
    that was cut off. Texts are read whole. Other columns are ignored; empty tables give an empty result.
    """
    path = plain_path(F.col("path")).alias("path")
    told = files.select("repo_id", path, "language", "end_line").groupBy("repo_id", "path").agg(F.max("end_line").alias("end_line"), F.max("language").alias("named"))
    numbers = [c.split()[0] for c in STATS.split(", ")]
    stats = text_statistics(sources).groupBy("repo_id", "path").agg(F.max(F.struct(*numbers)).alias("s")).select("repo_id", "path", "s.*")
    both = told.join(stats, ["repo_id", "path"], "full_outer").filter("path is not null")
    both = both.withColumn("language", language_of(F.col("named"), F.col("path"))).withColumn("low", F.lower("path"))
    both = both.withColumn("layout", layout_of(F.col("language"), F.greatest("lines", F.coalesce("end_line", F.lit(0))), F.col("low")))
    both = both.withColumn("marker", F.when(F.col("tool"), "tool").when(F.col("release"), "release").otherwise(""))
    both = both.withColumn("place", F.when(F.col("low").rlike(VENDOR_DIR), "vendor").when(F.col("low").rlike(f"{TOOL_DIR}|{TOOL_NAME}"), "tool").otherwise(""))
    machine = F.coalesce(F.col("layout") == "machine", F.lit(True))
    silent = F.coalesce("sentences", F.lit(0)) == 0
    kind = (
        F.when(F.col("layout").isin("data", "minified"), F.col("layout"))
        .when(machine & ((F.col("marker") == "tool") | (F.col("place") == "tool") & silent), "generated")
        .when((F.col("marker") == "release") | (F.col("place") == "vendor"), "vendored")
        .otherwise("written")
    )
    return both.select("repo_id", "path", "language", "layout", "marker", "place", kind.alias("kind"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_origins(table(spark, sf_dir, "files"), table(spark, sf_dir, "raw_sources")).filter("kind <> 'written'").select("repo_id", "path")
