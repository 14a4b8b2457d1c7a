"""Sentences of natural language in documents, comments and strings; names of languages."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ISO 639-1 code, then other codes and names of the language.
LANGUAGES = {
    "de": "deu ger german deutsch",
    "en": "eng english",
    "es": "spa spanish español espanol castellano castilian",
    "fr": "fra fre french français francais",
    "it": "ita italian italiano",
    "ja": "jpn japanese 日本語",
    "nl": "nld dut dutch nederlands flemish",
    "pt": "por portuguese português portugues",
    "ru": "rus russian русский",
    "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語",
}
NAMED = {name: code for code, names in LANGUAGES.items() for name in [code, *names.split()]}

#: Labelled documents of each language that a model is fitted on.
DOCS_PER_LANGUAGE = 120

FENCE = re.compile(r"^[ \t>|*-]*(```|~~~).*?(?:^[ \t>|*-]*\1[^\n]*$|\Z)|^@start\w+.*?(?:^@end\w+[^\n]*$|\Z)", re.S | re.M)
LEADER = re.compile(r"^[ \t]*(?:(?:[>|*\-+•#/]+|\d{1,3}[.)])[ \t]+)+", re.M)
HEADING = re.compile(r"^[ \t]*#{1,6}[ \t].*$", re.M)
CUT = regex.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|(?<=[。！？][」』”»]?)(?![」』”»])\s*")
CUT_LATIN = re.compile(r"([.!?…])[\"'»”)\]]*\s+")
#: Code inside a sentence; each alternative reads a run of word characters once.
SPAN = re.compile(
    r"`[^`\n]*`|(?<![\w])'[\w./:]+'|(?<![\w-])(?:[\w-]*+[./:]\w|(?:[^\W_]|-)*+_\w)[\w./:-]*|(?<![\w-])[./:]\w[\w./:-]*"
    r"|\b[^\Wa-z]*+[a-z][^\WA-Z]*+[A-Z]\w*|\b[^\W\d]*+\d\w*|<[^<>\n]{1,40}>|&\w+;"
)
#: What no sentence lacks that SPAN finds something in.
MAYBE_SPAN = re.compile(r"[`<&\d_]|'[\w./:]|[./:]\w|\w[A-Z]")
WORD = re.compile(r"[^\W\d_]+")
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾝ]")
CODE_MARK = re.compile(r"[;=(){}\[\]<>]")
END = re.compile(r"[.!?…。！？][\"'»”)\]」』*_]*$")
#: Words, or characters of Chinese and Japanese, from which on a sentence counts.
LEAST_WORDS, LEAST_CJK = 5, 10


#: Names of programming languages in the deliveries and endings of paths, by language.
LANGUAGE_OF = {
    "python": "python py python3 pyi pyw",
    "javascript": "javascript js jsx mjs cjs typescript ts tsx ecmascript node",
    "java": "java",
    "go": "go golang",
    "rust": "rust rs",
    "cpp": "cpp c++ cc cxx hpp hh hxx",
    "c": "c h",
}
ALIAS = {alias: language for language, aliases in LANGUAGE_OF.items() for alias in aliases.split()}


def language_of(name: Column, path: Column) -> Column:
    """A programming language by the name that deliveries give, else by the path's ending; empty where neither tells."""
    known = F.create_map(*[F.lit(x) for pair in ALIAS.items() for x in pair])
    return F.coalesce(known[F.lower(F.trim(name))], known[F.regexp_extract(F.lower(path), r"\.([a-z0-9+]+)$", 1)], F.lit(""))


def file_languages(sources: DataFrame) -> DataFrame:
    """repo_id, file_id, language of each file by the ending of its path (ties: the greatest)."""
    return sources.groupBy("repo_id", "file_id").agg(F.max(language_of(F.lit(None).cast("string"), F.trim("path"))).alias("language"))


def lang_codes(label: str | None) -> set[str]:
    """Codes of the languages that a label names in any notation; placeholders and blanks name none."""
    parts = re.split(r"[,;/+&|]| and ", (label or "").strip().lower())
    return {NAMED[m] for p in parts if (m := re.split(r"[-_. ]", p.strip())[0]) in NAMED}


def sentences(text: str) -> list[str]:
    """A text cut after each sentence; text without the enders of Chinese and Japanese takes a shorter way to the same."""
    if "\0" in text or "。" in text or "！" in text or "？" in text:
        return CUT.split(text)
    return CUT_LATIN.sub("\\1\0", text).split("\0")


def without_code(sentence: str, instead: str = " ") -> str:
    return SPAN.sub(instead, sentence) if MAYBE_SPAN.search(sentence) else sentence


def _is_prose(sentence: str) -> str | None:
    words = without_code(sentence)
    found = WORD.findall(words)
    cjk = 0 if words.isascii() else len(CJK.findall(words))
    n = len(found if words is sentence else WORD.findall(sentence)) if cjk < 3 else 0
    if (cjk < LEAST_CJK) if n == 0 else (n < LEAST_WORDS):
        return None
    if len(CODE_MARK.findall(words)) > max(1, 0.2 * max(n, cjk / 2)):
        return None
    words = " ".join(found).lower()
    return words if len(words) >= 4 else None


class Memory(dict):
    """What was found out before; it travels to workers empty."""

    def __reduce__(self):
        return Memory, ()


_known = Memory()


def is_prose(sentence: str) -> str | None:
    """The words of a sentence without code, in lower case; None where it is code or shorter than a sentence. Sentences of
    usual length are remembered, as texts repeat them."""
    if len(sentence) > 400:
        return _is_prose(sentence)
    if sentence not in _known:
        if len(_known) >= 1 << 16:
            _known.clear()
        _known[sentence] = _is_prose(sentence)
    return _known[sentence]


def document_sentences(text: str | None) -> list[tuple[str, str, bool]]:
    """(sentence, its words, whether it ends like one) of a document, in order, code blocks, headings, list and
    quote leaders left out. Sentences too short to count are left out, too."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text.replace("&nbsp;", " ").replace("­", "").replace("\r\n", "\n").replace("\r", "\n"))
    text = re.sub(r"[​⁠‪-‮﻿]", "", text)
    text = HEADING.sub("\n\n", FENCE.sub("\n\n", text))
    out = []
    for block in re.split(r"\n\s*\n", text):
        block = re.sub(r"-\n(?=[^\W\d_])", "", LEADER.sub("", block))
        for s in sentences(" ".join(re.sub(r"</?[a-z][^<>]{0,40}>", " ", block).split())):
            s = s.strip()
            if s and (w := is_prose(s)):
                out.append((s, w, bool(END.search(s))))
    return out


def _units(words: str) -> list[str]:
    return [u for w in words.split() for u in ([w[i : i + 2] for i in range(len(w) - 1)] if CJK.search(w) else [w])]


def agreeing(texts: list[str], labels: np.ndarray, languages: int, rounds: int = 3) -> np.ndarray:
    """Which sentences get their own label from word frequencies (pairs of characters in Chinese and Japanese).

    A minority of foreign sentences under a label leaves each of their words rarer there than under its own language,
    so that plain frequencies find them where a model of contexts would learn them.
    """
    number: dict[str, int] = {}
    words = np.array([number.setdefault(u, len(number)) for t in texts for u in _units(t)] or [0], np.int64)
    of = np.repeat(np.arange(len(texts)), [len(_units(t)) for t in texts])
    keep = np.ones(len(texts), bool)
    for _ in range(rounds if len(of) else 0):
        used = keep[of]
        counts = np.bincount(words[used] * languages + labels[of[used]], minlength=len(number) * languages).reshape(-1, languages) + 0.02
        logp = np.log(counts / counts.sum(0))
        total = np.zeros((len(texts), languages))
        np.add.at(total, of, logp[words])
        keep = total.argmax(1) == labels
    return keep


def labelled_sentences(documents: DataFrame) -> tuple[list[str], np.ndarray, list[str]]:
    """Words of sentences, their language's number, and the languages: of at most DOCS_PER_LANGUAGE documents of each
    label that names one language. Labels may be wrong and texts mixed; sentences whose words belong to another
    language are left out."""
    names = F.array(*[F.lit(x) for x in sorted(NAMED)])
    first = F.split(F.lower(F.trim("lang")), "[-_. ]")[0]
    rows = documents.filter(F.array_contains(names, first) & F.col("text").isNotNull()).select(first.alias("name"), "text", F.xxhash64("text").alias("h"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("h", "text"))).filter(F.col("n") <= DOCS_PER_LANGUAGE)
    texts, found = [], []
    for name, text in sorted((r["name"], r["text"]) for r in rows.select("name", "text").toLocalIterator()):
        for _, w, _ in document_sentences(text):
            texts.append(w)
            found.append(NAMED[name])
    langs = sorted(set(found))
    labels = np.array([langs.index(x) for x in found], np.int64)
    keep = agreeing(texts, labels, len(langs))
    return [t for t, ok in zip(texts, keep) if ok], labels[keep], langs
