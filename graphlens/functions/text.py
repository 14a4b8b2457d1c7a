"""Column functions on names, paths, texts and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlens import config as C

#: Word characters are letters, numbers of any kind, and the underscore; combining marks are none.
IDENTIFIER = r"[A-Za-z_][\p{L}\p{N}_./:-]*"


def first_match(name: Column, rules: tuple[tuple[str, str], ...], default: Column | str) -> Column:
    """The label of the first rule whose key is part of `name` (in lower case); else `default`."""
    low, out = F.lower(name), None
    for key, label in rules:
        out = F.when(low.contains(key), label) if out is None else out.when(low.contains(key), label)
    return out.otherwise(default)


def file_label(name: Column, language: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in C.LANGUAGE_LABELS.items() for x in pair])
    return first_match(name, C.FILE_RULES, F.coalesce(labels[F.lower(language)], F.lit("Source File")))


def language_of_path(path: Column) -> Column:
    """Language by extension (case apart), null where none is known."""
    known = F.create_map(*[F.lit(x) for pair in C.EXTENSIONS.items() for x in pair])
    return known[F.regexp_extract(F.lower(path), r"\.([a-z]+)$", 1)]


def identifiers(text: Column) -> Column:
    """Distinct identifiers of more than one character, in order of first appearance, in lower case, outer marks cut."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    terms = F.transform(raw, lambda t: F.lower(F.regexp_replace(t, r"^[.,:;()\[\]{}<>]+|[.,:;()\[\]{}<>]+$", "")))
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) > 1))


def normalised(text: Column) -> Column:
    """Everything but word characters becomes one blank; trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")))


def line_count(text: Column) -> Column:
    """Lines of a text, at least 1; a newline at the very end adds none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.greatest(F.lit(1), newlines + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("int")


def name_match(name: Column, other: Column, term: Column) -> Column:
    """1.0 for an equal name, .7 for a suffix, .4 for a part, else 0; of two names the better."""
    def one(v: Column) -> Column:
        return F.when(v == term, 1.0).when(v.endswith(term), 0.7).when(v.contains(term), 0.4).otherwise(0.0)

    return F.greatest(one(F.lower(name)), one(F.lower(other)))


def sha8(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 8)


def file_id(path: Column) -> Column:
    """F_<stem>_<hash of the path>."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.lit("F_"), stem, F.lit("_"), sha8(path))


#: name(parameters) and, after an arrow, a return type; nothing may follow.
SIGNATURE = r"^[^(]+\(([^)]*)\)\s*(?:->\s*(.+))?$"


def parameters(signature: Column) -> Column:
    """Parameters of a signature of the form name(a, b) -> type, each trimmed; empty for any other form."""
    parts = F.transform(F.split(F.regexp_extract(F.trim(signature), SIGNATURE, 1), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def return_type(signature: Column) -> Column:
    """What follows the arrow of such a signature; null where there is none."""
    r = F.trim(F.regexp_extract(F.trim(signature), SIGNATURE, 2))
    return F.when(r != "", r)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 2)


def relation_text(source: Column, kind: Column, target: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in C.RELATION_WORDS.items() for x in pair])
    return F.concat(source, F.lit(" "), F.coalesce(words[kind], F.lit("relates to")), F.lit(" "), target)


def alias(name: Column) -> Column:
    """A name as a diagram takes it."""
    return F.regexp_replace(name, r"[^A-Za-z0-9]", "_")


def metric_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_:]", "_")


def state_key(*parts: Column) -> Column:
    """Parts of a key, trimmed, without blank ones, joined by colons."""
    trimmed = F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(trimmed, ":")


def backoff_seconds(attempt: Column) -> Column:
    """How long to wait before the next attempt: 2^attempt, at most 5."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(5.0))


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies below one; without roots every path is allowed."""
    if not roots:
        return path.isNotNull()
    return F.exists(F.array(*[F.lit(r.rstrip("/")) for r in roots]), lambda r: (path == r) | path.startswith(F.concat(r, F.lit("/"))))
