"""Raw names of relation ends resolved to object ids, with everything that name lookup offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.operators.lookup import first_of
from graphlens.operators.positions import positioned


def _last_parts(name: Column, sep: str) -> list[Column]:
    parts = F.filter(F.split(name, "\\Q" + sep + "\\E"), lambda p: p != "")
    many = F.size(parts) > 1
    return [F.when(many, F.element_at(parts, -1)), F.when(many, F.array_join(F.slice(parts, -2, 2), sep))]


def symbol_keys(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """scope, key, id: every key that stands for a symbol: id, qualified name, name, last and last two parts (`.`, `::`), names
    below the file's stem and path (dots or `::`; `mod` and a leading `src` dropped). symbols need scope, id, name,
    qualified_name, file_id; files scope, id, path."""
    path = files.select("scope", F.col("id").alias("file_id"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem_path"))
    q, n = F.col("qualified_name"), F.col("name")
    parts = F.split("stem_path", "/")
    parts = F.when((F.element_at(parts, -1) == "mod") & (F.size(parts) > 1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    dots = F.array_join(parts, ".")
    colons = F.array_join(F.when((F.element_at(parts, 1) == "src") & (F.size(parts) > 1), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts), "::")
    stem = F.element_at(F.split("stem_path", "/"), -1)
    keys = F.array(
        F.col("id"), q, n, *_last_parts(q, "."), *_last_parts(q, "::"),
        F.concat_ws(".", stem, n), F.concat_ws(".", stem, q), F.concat_ws(".", dots, n), F.concat_ws(".", dots, q),
        F.concat_ws("::", colons, n), F.concat_ws("::", colons, q), F.concat_ws("::", colons, F.replace(q, F.lit("."), F.lit("::"))),
    )
    rows = symbols.join(path, ["scope", "file_id"], "left")
    return rows.select("scope", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))).alias("key"), "id")


def unique_keys(keys: DataFrame) -> DataFrame:
    """scope, key, id of the keys that stand for one id only; ambiguous ones are dropped."""
    one = keys.groupBy("scope", "key").agg(F.min("id").alias("id"), F.max("id").alias("_last"))
    return one.filter("id = _last").drop("_last")


def forms(name: Column, imported: Column | None = None) -> Column:
    """Ways to write a raw name, in the order in which they are tried: as it is, with the other separators, as imported (and its
    default export), by its last part."""
    def others(x: Column) -> list[Column]:
        return [x, F.replace(x, F.lit("::"), F.lit(".")), F.replace(x, F.lit("."), F.lit("::")), F.replace(x, F.lit("->"), F.lit("::")), F.replace(x, F.lit("->"), F.lit("."))]

    def last(x: Column) -> list[Column]:
        return [F.when(F.contains(x, F.lit(sep)), F.element_at(F.split(x, "\\Q" + sep + "\\E"), -1)) for sep in (".", "::", "->")]

    all_forms = others(name)
    if imported is not None:
        all_forms += [imported, F.concat(imported, F.lit(".default"))]
        for o in others(imported):
            all_forms += [o, F.concat(o, F.lit(".default"))]
    all_forms += last(name) + (last(imported) if imported is not None else [])
    return F.array_distinct(F.filter(F.array(*all_forms), lambda f: f.isNotNull() & (f != "")))


def imported_name(raw: Column, aliases: Column) -> Column:
    """A raw name with its first part (or all of it) replaced by what it was imported as; null where it was not."""
    out = aliases[raw]
    for sep, joint in ((".", "."), ("::", "::"), ("->", "::")):
        head = F.substring_index(raw, sep, 1)
        tail = F.substring(raw, F.length(head) + len(sep) + 1, F.length(raw))
        mapped = aliases[head]
        out = F.coalesce(out, F.when(F.contains(raw, F.lit(sep)) & mapped.isNotNull(), F.concat(mapped, F.lit(joint), F.replace(tail, F.lit("->"), F.lit("::")) if joint == "::" else tail)))
    return out


def resolve(raw: DataFrame, lookup: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """`raw` (scope, raw_id, optionally imported and file_id) with `object_id`: of the name's forms the first that is known, else
    the trimmed name itself (dangling ends are legal). lookup: scope, key, id. local: scope, file_id, key, id: what a key
    stands for within a file, before what it stands for elsewhere. Distinct names are resolved once and joined back."""
    name = F.trim("raw_id")
    imported = F.col("imported") if "imported" in raw.columns else None
    keys = ["scope", "raw_id"] + (["imported"] if imported is not None else []) + (["file_id"] if local is not None else [])
    tried = raw.select(*keys).distinct().select(*keys, F.posexplode(forms(name, imported)).alias("priority", "key"))
    met = tried.join(lookup, ["scope", "key"]).withColumn("far", F.lit(1))
    if local is not None:
        met = met.select(*keys, "priority", "id", "far").unionByName(tried.join(local, ["scope", "file_id", "key"]).select(*keys, "priority", "id", F.lit(0).alias("far")))
    hit = first_of(met, keys, ["priority", "far", "id"]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("object_id"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return raw.join(hit, same, "left").withColumn("object_id", F.coalesce("object_id", name)).drop(*[f"_{k}" for k in keys])


def local_keys(symbols: DataFrame) -> DataFrame:
    """scope, file_id, key, id: names and qualified names within a file (of several symbols with one, the greatest id)."""
    keys = symbols.select("scope", "file_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), "id")
    return keys.filter("key <> ''").groupBy("scope", "file_id", "key").agg(F.max("id").alias("id"))


def export_keys(exports: DataFrame, lookup: DataFrame, local: DataFrame, symbols: DataFrame) -> DataFrame:
    """scope, key, id: `stem.name` for what a file exports under a name: exports: scope, file_id, path, export, raw_id (what is
    exported, as written). Names that lead to several symbols, or to none, have no key."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = exports.withColumn("key", F.concat(stem, F.lit("."), F.regexp_replace("export", "^export:", "")))
    met = resolve(named, lookup, local).select("scope", "key", F.col("object_id").alias("id"))
    return unique_keys(met.join(symbols.select("scope", "id"), ["scope", "id"], "left_semi"))


def with_exports(lookup: DataFrame, exported: DataFrame) -> DataFrame:
    """The lookup, in which exported names stand before others of the same key."""
    return lookup.join(exported.select("scope", "key"), ["scope", "key"], "left_anti").unionByName(exported)


def end_modules(ends: DataFrame, modules: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """`ends` (scope, object_id, module_id of where the name stands) with `object_module`: the module of the symbol or file that
    the end is, the end itself where it is a module, else module_id."""
    of = symbols.select("scope", F.col("id").alias("object_id"), F.lit(0).alias("_p"), F.col("module_id").alias("_m"))
    of = of.unionByName(files.select("scope", F.col("id").alias("object_id"), F.lit(1).alias("_p"), F.col("module_id").alias("_m"))).unionByName(modules.select("scope", F.col("id").alias("object_id"), F.lit(2).alias("_p"), F.col("id").alias("_m")))
    one = of.groupBy("scope", "object_id").agg(F.min_by("_m", F.struct("_p", "_m")).alias("_m"))
    return ends.join(one, ["scope", "object_id"], "left").withColumn("object_module", F.coalesce("_m", "module_id")).drop("_m")


def valid_relations(relations: DataFrame, objects: DataFrame) -> DataFrame:
    """Relations both of whose ends exist among `objects` (id, kind); ends of type `external` need not."""
    known = objects.select("id", F.col("kind")).distinct()

    def end(df: DataFrame, side: str) -> DataFrame:
        k = known.withColumnsRenamed({"id": f"{side}_id", "kind": f"{side}_type"}).withColumn(f"_{side}", F.lit(True))
        return df.join(k, [f"{side}_id", f"{side}_type"], "left").filter((F.col(f"{side}_type") == "external") | F.col(f"_{side}")).drop(f"_{side}")

    return end(end(relations, "source"), "target")


def renumbered(rows: DataFrame, order: list[str], prefix: str = "R_") -> DataFrame:
    """`rows` with a dense `id` prefix1..prefixN in the given order."""
    return positioned(rows, [], order, "_n").withColumn("id", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")
