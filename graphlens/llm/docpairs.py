"""Functions paired with their documentation: packrat grammars for signatures and documentation comments.

The documentation grammar tells text from rulers, tags, examples and code, per comment style; the signature grammar of the
file's language gives name, parameters and return type. Both keep offsets. A pair is kept where some sentence of the text
is neither a placeholder, a pointer elsewhere, a licence notice, the name over again, nor code.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.natural import latest_symbols
from graphlens.llm.peg import Expr, absent, choice, emit, many, maybe, parse, rule, seq, token
from graphlens.llm.prose import CJK, CODE_MARK, WORD, file_languages, sentences, without_code
from graphlens.tables import table

# -- documentation comments ------------------------------------------------------------------------------------------

#: Marks that open a line, by style.
STYLES = {
    "block": r"[ \t]*(?:/\*+!?|\*+(?!/)|(?=\*/))?[ \t]?",
    "slash": r"[ \t]*(?://+[!/]?)?[ \t]?",
    "hash": r"[ \t]*(?:#+!?)?[ \t]?",
    "quote": r"[ \t]*(?:[rRuUbB]?(?:\"\"\"|'''))?",
    "bare": r"",
}


def documentation(lead_pattern: str):
    """Grammar of a documentation text whose lines open with `lead_pattern`. Values: ("text", begin, end, line)."""
    lead = rule("lead", token(lead_pattern))
    close = r"[ \t]*(?:\*+/|\"\"\"|\'\'\')?[ \t]*\r?(?:\n|\Z)"
    rest = r"[^\n]*(?:\n|\Z)"
    titles = r"(?:[Ee]xamples?|[Uu]sage|Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Attributes)[ \t]*:{0,2}[ \t]*\r?(?:\n|\Z)"
    blank = rule("blank", seq(lead, token(close)))
    deep = seq(lead, token(r"(?:[ ]{2,}|\t)\S" + rest))
    fence_mark = token(r"[ \t]*(?:```|~~~)" + rest)
    fence_line = rule("fence_line", seq(lead, fence_mark))
    plain = emit("text", rf"(?!{titles}|```)([\w`(][^\n]*?){close}")
    listed = seq(token(titles), many(choice(blank, deep)))
    fence = seq(fence_mark, many(seq(absent(fence_line), lead, token(rest))), maybe(fence_line))
    doctest = token(r"[ \t]*(?:>>>|\.\.\.[ \t])" + rest)
    about = emit("text", rf"[ \t]*(?:[@\\](?:brief|short|summary|desc(?:ription)?|details|returns?|result|note|remarks?|warning|attention)\b|:(?:returns?|note|summary):)(?:[ \t]+\{{[^}}\n]*\}})?[ \t]*(?:-[ \t]+)?([^\n]*?){close}")
    tag = token(r"[ \t]*(?::\w+[^:\n]*:|[@\\]\w+|\{@\w+[^}\n]*\}[ \t]*(?=\r?\n|\Z))" + rest)
    named = token(r"(?:[ ]{2,}|\t)[\w*]+[ \t]*:" + rest)
    ruler = token(r"[ \t]*[^\w\s]{3,}[ \t]*\r?(?:\n|\Z)")
    prose = emit("text", rf"([^\n]*?){close}")
    return many(seq(lead, choice(plain, token(close), fence, doctest, listed, about, tag, named, ruler, prose)))


DOCUMENTATION = {name: documentation(lead) for name, lead in STYLES.items()}


def style_of(doc: str) -> str:
    d = doc.lstrip()
    for name, marks in (("block", ("/*",)), ("slash", ("//",)), ("quote", ('"""', "'''", 'r"""')), ("hash", ("#",))):
        if d.startswith(marks):
            return name
    return "bare"


# -- signatures ------------------------------------------------------------------------------------------------------


def signatures() -> dict[str, Expr]:
    """One grammar per language. Values: ("name" | "parameters" | "returns" | "receiver", begin, end, text)."""
    blank = rule("blank", token(r"\s*"))
    # parameters: anything with round brackets in pairs, three deep, quoted text aside
    flat = r"[^()\"']|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|'"
    inner = flat
    for _ in range(3):
        inner = rf"{flat}|\((?:{inner})*\)"
    arguments = rule("arguments", seq(token(r"\s*\("), emit("parameters", rf"((?:{inner})*)"), token(r"\)")))
    generic = token(r"\s*(?:<(?:[^<>()]|<(?:[^<>()]|<[^<>()]*>)*>)*>)?")
    name = emit("name", r"[\w$]+")
    rest = token(r"\s*(?:\{|=>|;|:|=)?.*\Z", re.S)
    end = token(r"\s*(?:\{.*|;.*|)\Z", re.S)
    words = lambda kinds: many(rule(kinds, token(rf"(?:{kinds})\b\s*")))
    typed = r"[\w.:$]+(?:\s*<(?:[^<>()]|<(?:[^<>()]|<[^<>()]*>)*>)*>)?(?:\s*\[\s*\])*"
    marks = many(token(r"@\w+(?:\.\w+)*(?:\([^()]*\))?\s*"))
    java_type = emit("returns", rf"{typed}(?:\.\.\.)?(?=\s+[\w$]+\s*\()")
    js_returns = maybe(emit("returns", r"\s*:\s*([^={]+?)\s*(?==>|\{|;|\Z)"))
    c_words = "static|inline|extern|virtual|explicit|constexpr|friend|register|_Noreturn|__inline|typedef"
    c_type = r"(?:(?:const|volatile|unsigned|signed|long|short|struct|enum|union|class|typename)\s+)*" + typed + r"(?:\s+(?:const|long|int|short|char|double))*(?:\s*(?:[*&]+|\bconst\b))*"
    after_cpp = token(r"\s*(?:(?:const|noexcept(?:\([^()]*\))?|override|final|volatile|&{1,2}|=\s*(?:0|default|delete))\s*)*")
    cpp_name = emit("name", r"(?:[\w$]+(?:<[^<>()]*>)?::)*(?:operator\s*(?:\(\)|\[\]|[^\s\w(]+|[\w:*& ]+)|~?[\w$]+)")
    return {
        "go": seq(token(r"\s*func\s+"), maybe(seq(token(r"\("), emit("receiver", r"[^()]*"), token(r"\)\s*"))), name, token(r"\s*(?:\[[^\]()]*\])?"), arguments, maybe(emit("returns", r"\s*([^{\s](?:[^{]|\{\})*?)\s*(?=\{\s*\Z|\{[^}]|\Z)")), end),
        "rust": seq(blank, many(token(r"#\[[^\]]*\]\s*")), token(r"(?:pub(?:\s*\([^)]*\))?\s+)?"), words(r"async|const|unsafe|extern(?:\s+\"[^\"]*\")?"), token(r"fn\s+"), name, generic, arguments, maybe(emit("returns", r"\s*->\s*([^{;]+?)\s*(?=\bwhere\b|\{|;|\Z)")), token(r"(?:\s*where\b[^{;]*)?"), end),
        "javascript": choice(
            seq(blank, words("export|default|declare|async"), token(r"function\b\s*\*?\s*"), maybe(name), generic, arguments, js_returns, rest),
            seq(blank, words("export|default|declare"), token(r"(?:const|let|var)\s+"), name, token(r"\s*(?::[^=]+)?=\s*"), choice(seq(token(r"(?:async\s*)?"), generic, arguments, js_returns, token(r"\s*=>")), seq(token(r"(?:async\s+)?"), emit("parameters", r"[\w$]+"), token(r"\s*=>")), seq(token(r"(?:async\s+)?function\b\s*\*?\s*[\w$]*"), arguments)), rest),
            seq(blank, marks, words(r"(?:public|private|protected|static|async|get|set|override|abstract|readonly)(?=\s+[\w$#*\[])"), token(r"\*?\s*#?"), choice(name, emit("name", r"\[[^\]]+\]")), token(r"\??"), generic, arguments, js_returns, end),
        ),
        "python": seq(blank, marks, token(r"(?:(?:async\s+)?def\s+)?"), name, token(r"\s*(?:\[[^\]()]*\])?"), arguments, maybe(emit("returns", r"\s*->\s*([^:]*(?::(?!\s*\Z)[^:]*)*?)\s*(?=:?\s*\Z|:\s)")), token(r"\s*(?::.*|)\Z", re.S)),
        "java": seq(blank, marks, words("public|protected|private|static|final|abstract|synchronized|native|default|strictfp"), marks, token(r"(?:<(?:[^<>()]|<(?:[^<>()]|<[^<>()]*>)*>)*>\s*)?"), maybe(java_type), blank, name, arguments, token(r"(?:\s*\[\s*\])*\s*(?:throws\s+[\w.]+(?:\s*,\s*[\w.]+)*)?"), end),
        "cpp": choice(
            seq(blank, token(r"(?:template\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>\s*)?"), many(token(r"\[\[[^\]]*\]\]\s*")), words(c_words), emit("returns", rf"({c_type})(?=[\s*&]+(?:[\w$]+(?:<[^<>()]*>)?::)*(?:operator\b[^(]*|~?[\w$]+)\s*\()"), token(r"[\s*&]*"), cpp_name, arguments, after_cpp, maybe(emit("returns", r"\s*->\s*([^{;]+?)\s*(?=\{|;|\Z)")), end),
            seq(blank, token(r"(?:template\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>\s*)?"), words(c_words), cpp_name, arguments, after_cpp, token(r"\s*(?::(?!:)[^{;]*)?"), end),
        ),
        "c": seq(blank, words(c_words), many(token(r"__attribute__\s*\(\([^()]*(?:\([^()]*\))?[^()]*\)\)\s*")), emit("returns", rf"({c_type})(?=[\s*]+[\w$]+\s*\()"), token(r"[\s*]*"), name, arguments, end),
    }


SIGNATURES = signatures()
PART_COLUMNS = ("parsed", "name", "parameters", "returns", "name_begin", "name_end")


def signature_parts(signature: str, language: str) -> tuple | None:
    """PART_COLUMNS of a signature by the grammar of its language; None where there is none or it does not take all of it.
    Offsets count characters of the signature. A name is given without the type or namespace before it."""
    grammar = SIGNATURES.get(language)
    values = parse(grammar, signature) if grammar else None
    if values is None:
        return None
    found = {kind: (begin, end, text) for kind, begin, end, text in values}
    begin, end, name = found.get("name", (0, 0, ""))
    short = re.split(r"::(?!.*::)", name)[-1]
    text = lambda kind: found.get(kind, (0, 0, ""))[2].strip()
    return True, short, text("parameters"), text("returns"), end - len(short), end


# -- what says something ---------------------------------------------------------------------------------------------

#: Words that name a kind of symbol and say nothing beside its name.
KINDS = frozenset("function method class struct constructor procedure helper routine the a an this is of for funktion methode fonction méthode función método função metodo funzione functie метод функция".split())
NOTICE = re.compile(
    r"copyright|licen[cs]e|warrant|redistribut|all rights reserved|spdx|\bcopying\b|©|\(c\) \d{4}|lizenz|urheber|licencia|licença|licenza|licentie|лиценз|авторск|许可|版权|著作権|ライセンス",
    re.I,
)
STUB = re.compile(
    r"^\W*(?:to-?do|fixme|xxx|tbd|tba|wip|n/?a|hack|auto-?\s?generated|stub|placeholder|(?:documentation|description|docs?)\s+(?:pending|missing|follows|to)|(?:no|missing|add|write)\s+(?:\w+\s+)?(?:description|documentation|docs?|comment)|non-javadoc|inherit)",
    re.I,
)
POINTER = re.compile(r"^\W*(?:see(?: also)?|cf\.?|same as|like|siehe(?: auch)?|vgl\.?|voir|véase|ver|vedi|zie|см\.?|参见|参照|同上|見よ)\s*:?\s*(?:(?:the|oben|unten|above|below|interface|parent|super\w*|base|class|documentation|docs?|readme|wiki|\w+ class)\W*)*(?:[`#{@]?[\w./:#()]+[`}]?\W*)?$", re.I)
#: Words, or characters of Chinese and Japanese, that a sentence has at least if it says something.
SAYS_WORDS, SAYS_CJK = 4, 8
CODE = re.compile(r"(?:^|\s)(?:[=!]=|:=|->|=>|\|\||&&|\+=)(?:\s|$)|[;{]\s*$|^(?:return|if|for|while|elif|def|func|fn)\b[^.]*[:({]")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")


def says_something(sentence: str, name: str) -> bool:
    if STUB.match(sentence) or POINTER.match(sentence) or NOTICE.search(sentence):
        return False
    plain = without_code(sentence, " x ")
    words = WORD.findall(sentence)
    cjk = len(CJK.findall(plain))
    if cjk >= 3:
        return cjk >= SAYS_CJK and len(CODE_MARK.findall(plain)) <= cjk / 4
    if len(words) < SAYS_WORDS or len(CODE_MARK.findall(plain)) > max(1, 0.2 * len(words)) or CODE.search(sentence):
        return False
    own = {p.lower() for p in PARTS.findall(name)} | KINDS
    return len({p.lower() for w in words for p in PARTS.findall(w)} - own) >= 3


def described(doc: str, name: str) -> tuple[str, int, int] | None:
    """The sentences of a documentation text that say something about `name`, and the characters of the text from the
    first to the last of them; None where none does."""
    kept = []
    for _, begin, _, text in parse(DOCUMENTATION[style_of(doc)], doc) or ():
        if NOTICE.search(text):
            continue
        at = 0
        for s in sentences(text):
            s = s.strip()
            at = text.index(s, at)
            if s and says_something(s, name):
                kept.append((s, begin + at, begin + at + len(s)))
            at += len(s)
    return (" ".join(s for s, _, _ in kept), kept[0][1], kept[-1][2]) if kept else None


def description(doc: str, name: str) -> str | None:
    found = described(doc, name)
    return found[0] if found else None


def function_pairs(symbols: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """repo_id, symbol_id, file_id, language, parsed, name, parameters, returns, name_begin, name_end, signature, start_line,
    end_line, description, doc_begin, doc_end.

    Of each symbol only the row with the latest indexed_at counts (ties: greatest doc). Rows that are no function or method
    (case and outer blanks apart), have a null or blank signature, a null or blank doc, or a doc that says nothing give
    nothing. `sources` (repo_id, file_id, path) tells a file's language, whose grammar reads the signature; a signature of an
    unknown language, or one that the grammar does not take, stays with parsed false, its symbol's name, and null parts. A
    null name counts as empty. doc_begin and doc_end are characters of doc from the first to the last sentence that is kept,
    name_begin and name_end those of the name in signature. Docs of any length are read whole. Other columns are ignored; an
    empty table gives an empty result.
    """
    columns = ("type", "signature", "doc", "name", "file_id", "start_line", "end_line")
    ends_blank = F.lower(F.trim(F.regexp_replace("type", r"\s+", " ")))
    rows = latest_symbols(symbols, "doc", *[c for c in columns if c != "doc"]).filter(ends_blank.isin("function", "method"))
    rows = rows.filter(F.col("signature").rlike(r"\S") & F.col("doc").rlike(r"[\p{L}\p{N}]")).select("repo_id", F.col("id").alias("symbol_id"), *columns[1:])
    ints = {c: "Int32" for c in ("start_line", "end_line", "name_begin", "name_end")}

    def told(batches):
        for b in batches:
            found = [described(d, n or "") for d, n in zip(b["doc"], b["name"])]
            kept = np.array([f is not None for f in found], bool)
            b = b[kept].drop(columns="doc")
            yield b.assign(**dict(zip(("description", "doc_begin", "doc_end"), zip(*[f for f in found if f])) if kept.any() else {c: pd.Series(dtype=object) for c in ("description", "doc_begin", "doc_end")})).astype({c: "Int32" for c in ("start_line", "end_line")})

    def parts(batches):
        for b in batches:
            read = [signature_parts(s, x or "") or (False, n or "", None, None, None, None) for s, n, x in zip(b["signature"], b["name"], b["language"])]
            own = pd.DataFrame(read, columns=list(PART_COLUMNS), index=b.index)
            yield pd.concat([b.drop(columns="name"), own], axis=1).astype(ints)

    kept = "repo_id string, symbol_id string, file_id string, signature string, start_line int, end_line int, description string, doc_begin int, doc_end int"
    pairs = rows.mapInPandas(told, f"{kept}, name string")
    pairs = pairs.join(file_languages(sources), ["repo_id", "file_id"], "left") if sources is not None else pairs.withColumn("language", F.lit(None).cast("string"))
    pairs = pairs.withColumn("language", F.coalesce("language", F.lit("")))
    out = pairs.mapInPandas(parts, f"{kept}, language string, parsed boolean, name string, parameters string, returns string, name_begin int, name_end int")
    return out.select("repo_id", "symbol_id", "file_id", "language", *PART_COLUMNS, "signature", "start_line", "end_line", "description", "doc_begin", "doc_end")


#: Pairs of one file that are cut out of its text in one row.
TOGETHER = 1_000


def with_source(pairs: DataFrame, sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """The pairs with `source`, the lines start_line to end_line of the file's text (null where it is not at hand or cut
    off before them). Of several texts of a file the longest counts. A file's pairs come to its text as ranges, so that the
    text moves once; a file with more than TOGETHER symbols gets its text once per that many.
    """
    text = sources.groupBy("repo_id", "file_id").agg(F.max_by("content", F.struct(F.length("content"), "content")).alias("content"))
    lines = F.split(F.regexp_replace(F.regexp_replace("content", "^\ufeff", ""), r"\r\n?", "\n"), "\n")
    crowded = symbols.groupBy("repo_id", "file_id").count().filter(F.col("count") > TOGETHER).select("repo_id", "file_id", F.ceil(F.col("count") / TOGETHER).alias("lots"))
    own = [c for c in pairs.columns if c not in ("repo_id", "file_id")]
    salted = pairs.join(crowded, ["repo_id", "file_id"], "left").withColumn("lot", F.coalesce(F.pmod(F.xxhash64("symbol_id"), "lots"), F.lit(0)))
    files = salted.groupBy("repo_id", "file_id", "lot").agg(F.collect_list(F.struct(*own)).alias("pairs"))
    both = files.join(text.withColumn("lines", lines).drop("content"), ["repo_id", "file_id"], "left")
    has = lambda p: (p["start_line"] >= 1) & (p["end_line"] >= p["start_line"]) & (F.size("lines") >= p["end_line"])
    cut = lambda p: F.when(has(p), F.array_join(F.slice("lines", p["start_line"], p["end_line"] - p["start_line"] + 1), "\n"))
    return both.select("repo_id", "file_id", F.inline(F.transform("pairs", lambda p: F.struct(*[p[c].alias(c) for c in own], cut(p).alias("source"))))).select(*pairs.columns, "source")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_pairs(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "raw_sources")).select("repo_id", "symbol_id")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, sources = table(spark, sf_dir, "symbols"), table(spark, sf_dir, "raw_sources")
    return with_source(function_pairs(symbols, sources), sources, symbols)
