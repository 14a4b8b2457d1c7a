"""Scans, point lookups, name search, containment of spans, containers and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the pieces by which names and terms meet.
GRAM = 3


def first_of(df: DataFrame, keys: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first `n` rows of each key in the given order; `rank` names the column that numbers them."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_repo_by_path(repos: DataFrame) -> DataFrame:
    """repo_path, repo_id: the repo that was scanned last at each path (ties: greater id). Null paths are one path."""
    return repos.groupBy("repo_path").agg(F.max(F.struct("scan_time", "repo_id")).alias("m")).select("repo_path", "m.repo_id")


def objects(modules: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Modules, files and symbols as one wide table: repo_id, id, kind, name, other, type, file_id, module_id.

    `other` is the qualified name of a symbol, the path of a file or module."""
    none = F.lit(None).cast("string")
    return (
        modules.select("repo_id", "id", F.lit("module").alias("kind"), "name", F.col("path").alias("other"), F.lit("module").alias("type"), none.alias("file_id"), F.col("id").alias("module_id"))
        .unionByName(files.select("repo_id", "id", F.lit("file").alias("kind"), "name", F.col("path").alias("other"), F.lit("file").alias("type"), F.col("id").alias("file_id"), "module_id"))
        .unionByName(symbols.select("repo_id", "id", F.lit("symbol").alias("kind"), "name", F.col("qualified_name").alias("other"), "type", "file_id", "module_id"))
    )


def _pieces(text, n: int):
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def parts_of(strings: DataFrame, terms: DataFrame) -> DataFrame:
    """term, string: which of the distinct `strings` contain which of the distinct `terms` (columns string, term; no blanks).

    A string that contains a term contains the term's rarest piece of GRAM characters (all of a shorter term): an equi-join on
    that piece gives the candidates. Only pieces that some term has go further than the scan of the strings."""
    own = F.when(F.length("term") < GRAM, F.array("term")).otherwise(_pieces("term", GRAM))
    asked = terms.select("term", F.explode(F.array_distinct(own)).alias("gram"))
    every = F.array_distinct(F.flatten(F.array(*[_pieces("string", n) for n in range(1, GRAM + 1)])))
    held = strings.select("string", F.explode(every).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    rare = asked.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return held.join(rare, "gram").filter(F.contains("string", F.col("term"))).select("term", "string")


def name_search(found_in: DataFrame, terms: DataFrame, limit: int = 10, within: tuple[str, ...] = (), other_first: Column | None = None) -> DataFrame:
    """term, repo_id, id, tier, rank, n, o and the columns of `within`: objects whose name or other name equals or contains a
    term, case apart.

    found_in: repo_id, id, name, other. Tier 0: equal name, 1: equal other name (the other way round where `other_first`), 2: part
    of one. Of each term the first `limit` by tier, length of the other name, repo_id, id. Terms are trimmed, in lower case
    and distinct; null and blank ones are dropped. terms: the term in its last column, before it columns that `found_in` has
    as well (`within`): then a term is looked for among the objects with these values only. Terms meet distinct names only,
    and of each name no more than `limit` objects go further.
    """
    asked = terms.select(*within, F.lower(F.trim(terms.columns[-1])).alias("term")).filter("term <> ''").distinct()
    more = [c for c in within if c != "repo_id"]
    rows = found_in.select("repo_id", "id", *more, F.lower("name").alias("n"), F.lower("other").alias("o"), F.coalesce(other_first if other_first is not None else F.lit(False), F.lit(False)).alias("_first"))
    order = [F.length("o"), "repo_id", "id"]
    of = lambda c, turned: rows.filter(F.col(c).isNotNull()).select(F.col(c).alias("string"), "n", "o", "repo_id", "id", *more, (F.col("_first") if turned else ~F.col("_first")).alias("_top"))
    bears = [first_of(of(c, turned), [*within, "string"], order, limit) for c, turned in (("n", False), ("o", True))]
    bears = bears[0].unionByName(bears[1])
    met = parts_of(rows.select(F.explode(F.array("n", "o")).alias("string")).filter("string is not null").distinct(), asked.select("term").distinct())
    out = met.join(bears, "string")
    if within:
        out = out.join(asked, [*within, "term"], "left_semi")
    out = out.withColumn("tier", F.when(F.col("string") != F.col("term"), 2).when(F.col("_top"), 0).otherwise(1))
    out = out.groupBy("term", "repo_id", "id", *more, "n", "o").agg(F.min("tier").alias("tier"))
    return first_of(out, [*within, "term"], ["tier", *order], limit, "rank").select("term", "repo_id", "id", *more, "tier", "rank", "n", "o")


def containing_spans(selections: DataFrame, spans: DataFrame) -> DataFrame:
    """Selections (sel_id, repo_id, file_id, line_start, line_end) with every span (repo_id, file_id, span_id, type, a, b)
    that contains them, both ends included. Null lines contain nothing."""
    inside = (F.col("a") <= F.col("line_start")) & (F.col("b") >= F.col("line_end"))
    return selections.join(spans, ["repo_id", "file_id"]).filter(inside)


def best_span(contained: DataFrame) -> DataFrame:
    """Of each selection the span by priority of its type (function and method, class and interface, file, others), then
    the narrowest, then by id."""
    priority = F.when(F.col("type").isin("method", "function"), 0).when(F.col("type").isin("class", "interface"), 1).when(F.col("type") == "file", 2).otherwise(3)
    return first_of(contained.withColumn("priority", priority).withColumn("width", F.col("b") - F.col("a")), ["repo_id", "sel_id"], ["priority", "width", "span_id"])


def with_containers(symbols: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """Symbols with path of their file and name of their module (null where it is not at hand)."""
    f = files.select("repo_id", F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    m = modules.select("repo_id", F.col("id").alias("module_id"), F.col("name").alias("module_name"))
    return symbols.join(f, ["repo_id", "file_id"], "left").join(m, ["repo_id", "module_id"], "left")


def directed(relations: DataFrame) -> DataFrame:
    """id, other, direction: each relation from both ends (an edge to itself from each end, too)."""
    out = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation_type", F.lit("out").alias("direction"))
    back = relations.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "relation_type", F.lit("in").alias("direction"))
    return out.unionByName(back)


def with_modules(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Relations between known symbols with the module of each end."""
    of = symbols.select("id", "module_id")
    src = of.withColumnsRenamed({"id": "source_id", "module_id": "source_module"})
    tgt = of.withColumnsRenamed({"id": "target_id", "module_id": "target_module"})
    return relations.join(src, "source_id").join(tgt, "target_id")
