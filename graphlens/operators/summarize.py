"""Rule-based summaries of modules, files, symbols and relations, as grouped joins over all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.operators.lookup import directed, first_of, with_modules
from graphlens.operators.positions import positioned

CORE_FILES, CORE_SYMBOLS = 5, 10


def core_files(files: DataFrame, symbols: DataFrame, keys: list[str], top: int = CORE_FILES) -> DataFrame:
    """Of each module (keys) its files with most symbols (ties: by path, id), with `n_symbols` and `rank`.

    files: keys, id, path; symbols: file_id and, where files have it, repo_id. Files without symbols count 0."""
    scope = [k for k in keys if k in symbols.columns and k != "module_id"]
    n = symbols.groupBy(*scope, F.col("file_id").alias("id")).agg(F.count("*").alias("n_symbols"))
    both = files.join(n, [*scope, "id"], "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))
    return first_of(both, keys, [F.col("n_symbols").desc(), "path", "id"], top, "rank")


def core_symbols(symbols: DataFrame, keys: list[str], top: int = CORE_SYMBOLS) -> DataFrame:
    """Of each module (keys) its first public classes, functions and methods by qualified name, with `rank`."""
    public = symbols.filter((F.col("visibility") == "public") & F.col("type").isin("class", "function", "method"))
    return first_of(public, keys, ["qualified_name", "id"], top, "rank")


def adjacent_modules(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """module_id, other: modules that some relation joins to another one, from both sides."""
    pairs = with_modules(relations, symbols).select("source_module", "target_module").distinct().filter("source_module <> target_module")
    back = pairs.select(F.col("target_module").alias("module_id"), F.col("source_module").alias("other"))
    return pairs.select(F.col("source_module").alias("module_id"), F.col("target_module").alias("other")).unionByName(back).distinct()


def file_dependencies(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, dependency: names of symbols in other files that a file's symbols are related to, either way."""
    ends = directed(relations).select("id", "other").distinct()
    own = symbols.select("id", "file_id")
    other = symbols.select(F.col("id").alias("other"), F.col("file_id").alias("other_file"), F.col("qualified_name").alias("dependency"))
    return ends.join(own, "id").join(other, "other").filter("file_id <> other_file").select("file_id", "dependency").distinct()


def related_names(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, role, name: of each symbol its callers, callees and the names of relations into other modules (external).

    Names of unknown symbols are their ids. Long form, so that a symbol with very many callers is no single row."""
    name = symbols.select(F.col("id").alias("other"), F.col("qualified_name").alias("n"), F.col("module_id").alias("other_module"))
    ends = directed(relations).join(symbols.select("id", "module_id"), "id").join(name, "other", "left")
    ends = ends.withColumn("name", F.coalesce("n", "other"))
    roles = F.array(
        F.when(F.col("direction") == "in", F.lit("caller")).otherwise(F.lit("callee")),
        F.when(~F.col("module_id").eqNullSafe(F.col("other_module")), F.lit("external")),
    )
    return ends.select("id", F.explode(roles).alias("role"), "name").filter("role is not null").distinct()


def module_label(name: str = "name", path: str = "path"):
    return X.first_match(F.concat_ws("/", name, path), C.MODULE_RULES, F.lit("Module"))


def symbol_label(name: str = "name", kind: str = "type"):
    return X.first_match(F.col(name), C.SYMBOL_RULES, F.initcap(F.col(kind)))


def module_summaries(modules: DataFrame, files: DataFrame, symbols: DataFrame, adjacent: DataFrame) -> DataFrame:
    """id, summary: a JSON text with the keys in order, of every module. Lists hold at most what the limits allow; the
    adjacent modules are at most as many as there are modules."""
    listed = lambda df, key, value, order, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("l")).select(F.col(key).alias("id"), F.transform("l", lambda x: x[value]).alias(name))
    f = listed(core_files(files, symbols, ["module_id"]), "module_id", "path", "rank", "core_files")
    s = listed(core_symbols(symbols, ["module_id"]), "module_id", "qualified_name", "rank", "core_symbols")
    a = adjacent.groupBy(F.col("module_id").alias("id")).agg(F.array_sort(F.collect_set("other")).alias("adjacent_modules"))
    out = modules.join(f, "id", "left").join(s, "id", "left").join(a, "id", "left")
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(c, empty).alias(c) for c in ("adjacent_modules", "core_files", "core_symbols")]
    return out.select("id", F.to_json(F.struct(*parts, F.col("path").alias("module_path"), module_label().alias("responsibility_label"))).alias("summary"))


#: Names of a list in one row of a summary; a longer list goes on in rows of its own.
LIST_PART = 1_000


def _lists(names: DataFrame, key: str, roles: tuple[str, ...]) -> DataFrame:
    """key, part, and an array of each role's names in order, LIST_PART at most; names: key, role, name, distinct."""
    placed = positioned(names.select(key, "role", "name"), [key, "role"], ["name"]).withColumn("part", F.floor((F.col("position") - 1) / LIST_PART).cast("int"))
    # the names of a role in their order; a role without names in this part has an empty list
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("position", "name")))), lambda x: x["name"]).alias(role)
    return placed.groupBy(key, "part").agg(*[of(r) for r in roles])


def file_summaries(modules: DataFrame, files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """id, part, summary: a JSON text of every file: dependencies, file_path, main_symbols (public ones), module, responsibility_label.

    Dependencies are names of what the file's symbols are related to outside of it, either way (an id where there is no such
    symbol). Files need language; lists of more than LIST_PART names go on in the next part."""
    ends = directed(relations).select("id", "other").distinct().join(symbols.select("id", "file_id"), "id")
    other = symbols.select(F.col("id").alias("other"), F.col("file_id").alias("other_file"), "qualified_name")
    out = ends.join(other, "other", "left").filter("other_file is null or file_id <> other_file").select(F.col("file_id").alias("id"), F.lit("dependencies").alias("role"), F.coalesce("qualified_name", "other").alias("name"))
    main = symbols.filter("visibility = 'public'").select(F.col("file_id").alias("id"), F.lit("main_symbols").alias("role"), F.col("qualified_name").alias("name"))
    lists = _lists(out.unionByName(main).distinct(), "id", ("dependencies", "main_symbols"))
    rows = files.join(modules.select(F.col("id").alias("module_id"), F.col("path").alias("module")), "module_id", "left").join(lists, "id", "left")
    empty = F.array().cast("array<string>")
    fields = [F.coalesce("dependencies", empty).alias("dependencies"), F.col("path").alias("file_path"), F.coalesce("main_symbols", empty).alias("main_symbols"), F.coalesce("module", "module_id").alias("module"), X.file_label(F.col("name"), F.col("language")).alias("responsibility_label")]
    return rows.select("id", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(F.struct(*fields)).alias("summary"))


def symbol_summaries(modules: DataFrame, files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """id, part, summary: a JSON text of every symbol: callees, callers, external_dependencies, file, module, name,
    responsibility_label, and where symbols have it signature, with parameters and return_value. Lists of more than LIST_PART names go on in the next part."""
    names = related_names(relations, symbols)
    role = F.when(F.col("role") == "caller", "callers").when(F.col("role") == "callee", "callees").otherwise("external_dependencies")
    lists = _lists(names.select("id", role.alias("role"), "name"), "id", ("callees", "callers", "external_dependencies"))
    rows = symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id", "left").join(modules.select(F.col("id").alias("module_id"), F.col("path").alias("module")), "module_id", "left").join(lists, "id", "left")
    empty = F.array().cast("array<string>")
    listed = [F.coalesce(c, empty).alias(c) for c in ("callees", "callers", "external_dependencies")]
    fields = [*listed, F.coalesce("file", "file_id").alias("file"), F.coalesce("module", "module_id").alias("module"), "name", symbol_label().alias("responsibility_label")]
    if "signature" in symbols.columns:
        s = F.coalesce("signature", F.lit(""))
        fields += [s.alias("signature"), X.parameters(s).alias("parameters"), X.return_type(s).alias("return_value")]
    return rows.select("id", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(F.struct(*fields)).alias("summary"))


def relation_summaries(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """source_id, target_id, relation_type, summary: a JSON text of every relation between symbols: its label, modules, names, types."""
    side = lambda s: symbols.select(F.col("id").alias(f"{s}_id"), F.col("qualified_name").alias(f"{s}_name"), F.col("type").alias(f"{s}_type"), F.col("module_id").alias(f"{s}_module"))
    rows = relations.join(side("source"), "source_id").join(side("target"), "target_id")
    label = X.relation_text(F.col("source_name"), F.col("relation_type"), F.col("target_name")).alias("relationship_label")
    fields = ["relation_type", label, "source_module", "source_name", "source_type", "target_module", "target_name", "target_type"]
    return rows.select("source_id", "target_id", "relation_type", F.to_json(F.struct(*fields)).alias("summary"))
