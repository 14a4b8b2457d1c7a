"""Symbols and relations of source files, one scanner per language, on executors.

Rows: part (symbol, relation, alias), name, qualified_name, type, signature, visibility, doc, start_line, end_line, target.
Python goes through the standard library's parser; the other languages through declarations and matching braces in a
text whose strings and comments were blanked, with all offsets kept.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens import config as C

OUT = "repo_id string, file_id string, part string, name string, qualified_name string, type string, signature string, visibility string, doc string, start_line int, end_line int, target string"
FIELDS = [c.split()[0] for c in OUT.split(", ")][2:]
#: Words before a bracket that are no calls.
NO_CALLS = "if for while switch catch return function func fn new sizeof super def class match elif except with".split()


def call_targets(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, target: distinct names that stand before an opening bracket, without the language's own words."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\s*\("), F.lit(1))
    return rows.select(*keys, F.explode(F.array_distinct(found)).alias("target")).filter(~F.col("target").isin(*NO_CALLS))


def _row(part: str, **values: Any) -> dict[str, Any]:
    return dict.fromkeys(FIELDS) | {"part": part} | values


# -- Python --------------------------------------------------------------------------------------------------------------


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def python_rows(text: str, path: str) -> Iterator[dict[str, Any]]:
    """Classes (public), functions and methods (private with a leading underscore), calls in bodies, import aliases."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield from brace_free_python(text)
        return
    todo: list[tuple[ast.AST, str, bool]] = [(n, "", False) for n in reversed(tree.body)]
    package = path.rsplit("/", 1)[0].replace("/", ".") if "/" in path else ""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield _row("alias", name=a.asname or a.name.split(".")[0], target=a.name if a.asname else a.name.split(".")[0], type="import", start_line=node.lineno)
        elif isinstance(node, ast.ImportFrom):
            base = package.split(".") if package else []
            head = ".".join([*base[: len(base) - node.level + 1], *([node.module] if node.module else [])]) if node.level else (node.module or "")
            for a in node.names:
                yield _row("alias", name=a.asname or a.name, target=f"{head}.{a.name}" if head else a.name, type="import", start_line=node.lineno)
    while todo:
        node, scope, inside = todo.pop()
        if isinstance(node, ast.ClassDef):
            q = f"{scope}.{node.name}" if scope else node.name
            yield _row("symbol", name=node.name, qualified_name=q, type="class", signature=node.name, visibility="public", doc=ast.get_docstring(node), start_line=node.lineno, end_line=node.end_lineno)
            for b in node.bases:
                if t := _dotted(b):
                    yield _row("relation", qualified_name=q, type="inherits", target=t, start_line=node.lineno)
            todo += [(n, q, True) for n in reversed(node.body)]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            q = f"{scope}.{node.name}" if scope else node.name
            args = ", ".join(a.arg for a in [*node.args.posonlyargs, *node.args.args, *([node.args.vararg] if node.args.vararg else []), *node.args.kwonlyargs, *([node.args.kwarg] if node.args.kwarg else [])])
            yield _row("symbol", name=node.name, qualified_name=q, type="method" if inside else "function", signature=f"{node.name}({args})", visibility="private" if node.name.startswith("_") else "public", doc=ast.get_docstring(node), start_line=node.lineno, end_line=node.end_lineno)
            for n in ast.walk(node):
                if isinstance(n, ast.Call) and (t := _dotted(n.func)):
                    yield _row("relation", qualified_name=q, type="calls", target=t, start_line=n.lineno)
            todo += [(n, q, True) for n in reversed(node.body)]
        else:
            todo += [(n, scope, inside) for n in reversed(list(ast.iter_child_nodes(node))) if isinstance(n, ast.stmt)]


def brace_free_python(text: str) -> Iterator[dict[str, Any]]:
    """Declarations of a Python text that does not parse, by indentation."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        m = re.match(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)[ \t]*(\([^)\n]*\))?", line)
        if m:
            depth = len(m.group(1).expandtabs(4))
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and len(lines[j].expandtabs(4)) - len(lines[j].expandtabs(4).lstrip()) <= depth), len(lines))
            kind = "class" if m.group(2) == "class" else "method" if depth else "function"
            private = kind != "class" and m.group(3).startswith("_")
            yield _row("symbol", name=m.group(3), qualified_name=m.group(3), type=kind, signature=m.group(3) + (m.group(4) or "") * (kind != "class"), visibility="private" if private else "public", start_line=i + 1, end_line=end)


# -- languages with braces -----------------------------------------------------------------------------------------------

_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)+'|`(?:[^`\\]|\\.)*`?", re.S)
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*\(")
_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|async|export|inline|virtual|explicit|constexpr|extern|friend)\s+)*"

#: Declarations by language: (pattern with groups name and, optionally, owner; type inside a class; type outside).
DECLARATIONS: dict[str, list[tuple[str, str, str]]] = {
    "javascript": [
        (r"(?:export\s+)?(?:default\s+)?class\s+(?P<name>[\w$]+)(?:\s+extends\s+(?P<base>[\w$.]+))?\s*(?=\{)", "class", "class"),
        (r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*\([^)]*\)\s*(?=\{)", "function", "function"),
        (r"(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>\s*(?=\{)", "function", "function"),
        (r"(?m:^)[ \t]+(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?P<name>[\w$]+)\s*\([^)]*\)\s*(?=\{)", "method", "method"),
    ],
    "go": [
        (r"type\s+(?P<name>\w+)\s+struct\s*(?=\{)", "struct", "struct"),
        (r"type\s+(?P<name>\w+)\s+interface\s*(?=\{)", "interface", "interface"),
        (r"func\s+\(\s*\w*\s*\*?(?P<owner>\w+)\s*\)\s*(?P<name>\w+)\s*\([^)]*\)[^{;\n]*(?=\{)", "method", "method"),
        (r"func\s+(?P<name>\w+)\s*\([^)]*\)[^{;\n]*(?=\{)", "function", "function"),
    ],
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)[^;{]*(?=[{;])", "struct", "struct"),
        (r"impl(?:<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)[^{;]*(?=\{)", "impl", "impl"),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^)]*\)[^{;]*(?=\{)", "method", "function"),
    ],
    "java": [
        (_MODIFIERS + r"class\s+(?P<name>\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w.]+))?(?:\s+implements\s+(?P<more>[\w., ]+))?\s*(?=\{)", "class", "class"),
        (_MODIFIERS + r"interface\s+(?P<name>\w+)[^{;]*(?=\{)", "interface", "interface"),
        (r"(?<![\w.])" + _MODIFIERS + r"(?:[\w<>\[\],.?]+\s+)+(?P<name>\w+)\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?(?=\{)", "method", "method"),
        (r"(?m:^)[ \t]+(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?=[=;])", "field", "field"),
    ],
    "cpp": [
        (r"(?:class|struct)\s+(?P<name>\w+)(?:\s*:\s*(?:public|private|protected)?\s*(?P<base>[\w:]+))?[^;{()]*(?=\{)", "class", "class"),
        (r"namespace\s+(?P<name>\w+)\s*(?=\{)", "namespace", "namespace"),
        (r"(?<![\w.>])(?:[\w:<>*&\[\]]+\s+)+[*&]?(?:(?P<owner>\w+)::)?(?P<name>~?\w+)\s*\([^;{}()]*\)\s*(?:const|noexcept|override|\s)*(?=\{)", "method", "function"),
    ],
}
DECLARATIONS["c"] = DECLARATIONS["cpp"]
_PATTERNS = {language: [(re.compile(p), inside, outside) for p, inside, outside in rules] for language, rules in DECLARATIONS.items()}
IMPORTS = {
    "javascript": r"import\s+(?:(?P<name>[\w$]+)|\{\s*(?P<names>[^}]*)\}|\*\s+as\s+(?P<star>[\w$]+))\s+from\s+['\"](?P<from>[^'\"]+)|(?:const|let|var)\s+(?P<req>[\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"](?P<reqfrom>[^'\"]+)",
    "go": r"(?m)^\s*(?:import\s+)?(?P<name>\w+)?\s*\"(?P<from>[\w./-]+)\"\s*$",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+(?P<from>[\w:]+)(?:\s+as\s+(?P<name>\w+))?\s*;",
    "java": r"(?m)^\s*import\s+(?:static\s+)?(?P<from>[\w.]+(?:\.\*)?)\s*;",
    "cpp": r"(?m)^\s*#include\s+[<\"](?P<from>[^>\"]+)",
}
IMPORTS["c"] = IMPORTS["cpp"]
_EXPORTS = re.compile(r"export\s*\{(?P<names>[^}]*)\}|module\.exports\s*=\s*(?P<one>[\w$]+)|(?:module\.)?exports\.(?P<prop>[\w$]+)\s*=|export\s+default\s+(?P<default>[\w$]+)\s*;")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "new", "match", "loop", "function"}


def blanked(text: str) -> str:
    """The text with strings and comments as blanks; every offset and line end stays where it is."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def closing(text: str, at: int) -> int:
    """The place after the brace that closes the one at `at`; the end of the text where none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _visibility(language: str, name: str, head: str, kind: str) -> str:
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if head.lstrip().startswith("pub") else "private"
    if language == "java":
        return next((v for v in ("public", "private", "protected") if re.search(rf"\b{v}\b", head)), "package")
    if language in ("c", "cpp") and kind in ("class",):
        return "public" if head.lstrip().startswith("struct") else "private"
    return "private" if name.startswith(("_", "#")) else "public"


def brace_rows(text: str, language: str) -> Iterator[dict[str, Any]]:
    quiet = blanked(text)
    line = [0]
    for m in re.finditer("\n", text):
        line.append(m.end())

    def number(at: int) -> int:
        return bisect.bisect_right(line, at)

    found: dict[int, tuple[int, int, str, str, str | None, re.Match]] = {}
    for pattern, inside, outside in _PATTERNS[language]:
        for m in pattern.finditer(quiet):
            name = m.group("name")
            if name in _NOT_NAMES or m.start("name") in found:
                continue
            body = m.end() if m.end() < len(quiet) and quiet[m.end()] == "{" else None
            end = closing(quiet, body) if body is not None else m.end()
            found[m.start("name")] = (m.start("name"), end, inside, outside, m.groupdict().get("owner"), m)
    scopes = sorted(found.values(), key=lambda x: x[0])
    joint = "::" if language in ("cpp", "c", "rust") else "."
    open_: list[tuple[int, str, str]] = []
    for start, end, inside, outside, owner, m in scopes:
        while open_ and open_[-1][0] <= start:
            open_.pop()
        holder = [x for x in open_ if x[2] in ("class", "struct", "interface", "impl", "namespace")]
        kind = inside if owner or any(x[2] != "namespace" for x in holder) else outside
        name = m.group("name")
        q = joint.join([*(x[1] for x in holder[-1:]), *([owner] if owner else []), name])
        head = quiet[m.start() : m.end()]
        if kind not in ("impl", "namespace"):
            signature = " ".join(text[m.start() : m.end() + 1].split("\n")[0].split()) if language != "python" else name
            yield _row("symbol", name=name, qualified_name=q, type=kind, signature=signature, visibility=_visibility(language, name, head, kind), start_line=number(start), end_line=number(max(start, end - 1)))
            groups = m.groupdict()
            for t in [groups.get("base"), *(groups.get("more") or "").split(",")]:
                if t and t.strip():
                    yield _row("relation", qualified_name=q, type="inherits" if t == groups.get("base") else "implements", target=t.strip(), start_line=number(start))
        if kind in ("function", "method"):
            seen = set()
            for c in _CALL.finditer(quiet, m.end(), end):
                t = c.group(1)
                if t in _NOT_NAMES or t == name or (language in ("java", "c", "cpp") and t in seen):
                    continue
                seen.add(t)
                yield _row("relation", qualified_name=q, type="calls", target=t, start_line=number(c.start()))
        open_.append((end, q if kind not in ("namespace",) else name, kind))
    for m in re.finditer(IMPORTS[language], text):
        g = m.groupdict()
        origin = g.get("from") or g.get("reqfrom")
        if language in ("c", "cpp"):
            yield _row("relation", type="depends_on", target=origin, start_line=number(m.start()))
            continue
        names = g.get("name") or g.get("star") or g.get("names") or g.get("req") or re.split(r"::|[./]", origin)[-1]
        for n in names.strip("{} ").split(","):
            a, _, b = (x.strip() for x in n.replace(" as ", ":").partition(":"))
            if a:
                yield _row("alias", name=b or a, target=f"{origin}.{a}" if g.get("names") or (g.get("req") or "").startswith("{") else origin, type="import", start_line=number(m.start()))
    if language == "javascript":
        for m in _EXPORTS.finditer(quiet):
            g = m.groupdict()
            for n in (g.get("names") or g.get("one") or g.get("prop") or g.get("default") or "").split(","):
                a, _, b = (x.strip() for x in n.replace(" as ", ":").partition(":"))
                if a:
                    yield _row("relation", type="exports", qualified_name=a, target=f"export:{'default' if g.get('default') or g.get('one') else b or a}", start_line=number(m.start()))


def rows_of(text: str | None, path: str | None) -> list[dict[str, Any]]:
    """All rows of one file; none where the language is unknown or there is no text."""
    language = C.EXTENSIONS.get((path or "").lower().rsplit(".", 1)[-1])
    if not text or language is None:
        return []
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    return list(python_rows(text, path) if language == "python" else brace_rows(text, language))


def extract(sources: DataFrame) -> DataFrame:
    """Rows (OUT) of many files (repo_id, file_id, path, content), each file on its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for repo, file, path, text in b[["repo_id", "file_id", "path", "content"]].itertuples(index=False, name=None):
                out += [{"repo_id": repo, "file_id": file} | r for r in rows_of(text, path)]
            frame = pd.DataFrame(out, columns=["repo_id", "file_id", *FIELDS])
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    return sources.mapInPandas(run, OUT)
