"""Natural language hidden inside code: comments, strings, JSON values and doc texts of a file's symbols.

Table-driven automata, one per family of languages, run over the UTF-8 bytes of Arrow buffers: a class per byte by one
lookup, a state per row by one more, many rows at once. They mark what is plain, comment or string; the mask decides which
runs are read: comments, strings, and plain lines only where they are prose themselves. Interpolated Kneser-Ney character
models tell the language of each sentence of those runs.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.kneser_ney import fit_clean
from graphlens.llm.prose import file_languages, is_prose, labelled_sentences, sentences
from graphlens.tables import shipped, table

# -- automata --------------------------------------------------------------------------------------------------------

OTHER, WORD, QUOTE, TICK, BACKTICK, BACK, SLASH, STAR, HASH, LINE, BLANK, COLON = range(12)
CLASS = np.zeros(256, np.uint8)
CLASS[[c for c in range(128) if chr(c).isalnum() or chr(c) == "_"] + list(range(128, 256))] = WORD
for _text, _kind in (('"', QUOTE), ("'", TICK), ("`", BACKTICK), ("\\", BACK), ("/", SLASH), ("*", STAR), ("#", HASH), ("\n", LINE), (" \t\r", BLANK), (":", COLON)):
    CLASS[[ord(c) for c in _text]] = _kind
CODE_BYTES = np.zeros(256, bool)
CODE_BYTES[[ord(c) for c in ";=(){}[]<>"]] = True

#: States by what their bytes belong to: plain text (1), comment (2), string (3).
STATES = {
    "gap": 1, "word": 1, "colon": 1, "slash": 1, "line": 2, "block": 2, "block*": 2,
    "quote": 3, "quote+": 3, "tick": 3, "tick+": 3, "raw": 3, "raw+": 3,
    "quote1": 3, "quote2": 3, "quotes": 3, "quotes+": 3, "quotes1": 3, "quotes2": 3,
    "tick1": 3, "tick2": 3, "ticks": 3, "ticks+": 3, "ticks1": 3, "ticks2": 3,
}
NUMBER_OF = {name: i for i, name in enumerate(STATES)}
PART = np.array(list(STATES.values()), np.uint8)
GAP = NUMBER_OF["gap"]


def automaton(slashes: bool, hashes: bool, ticks: bool, raw: bool, triple: bool) -> np.ndarray:
    """STEP[state, class] of a family of languages: which comments and quotes it has. `#` opens a comment only after a blank,
    `'` a string only where no word goes before; strings end with their line but for raw and triple-quoted ones."""
    step = np.zeros((len(STATES), COLON + 1), np.uint8)

    def go(state: str, rest: str, **to: str) -> None:
        step[NUMBER_OF[state]] = NUMBER_OF[rest]
        for kind, target in to.items():
            step[NUMBER_OF[state], globals()[kind]] = NUMBER_OF[target]

    opening = {"QUOTE": "quote1" if triple else "quote", "LINE": "gap", "BLANK": "gap", "WORD": "word", "COLON": "colon"}
    opening |= {"SLASH": "slash"} if slashes else {}
    opening |= {"BACKTICK": "raw"} if raw else {}
    tick = {"TICK": "tick1" if triple else "tick"} if ticks else {}
    hash_ = {"HASH": "line"} if hashes else {}
    go("gap", "gap", **opening, **tick, **hash_)
    go("word", "gap", **opening)
    go("colon", "gap", **(opening | tick | hash_ | {"SLASH": "gap"}))  # an address, no comment
    go("slash", "gap", **(opening | tick | ({"SLASH": "line", "STAR": "block"} if slashes else {})))
    go("line", "line", LINE="gap")
    go("block", "block", STAR="block*")
    go("block*", "block", STAR="block*", SLASH="gap")
    for name, mark in (("quote", "QUOTE"), ("tick", "TICK")):
        go(name, name, **{mark: "gap", "BACK": f"{name}+", "LINE": "gap"})
        go(f"{name}+", name, LINE="gap")
        go(f"{name}1", name, **{mark: f"{name}2", "BACK": f"{name}+", "LINE": "gap"})
        step[NUMBER_OF[f"{name}2"]] = step[GAP]  # two quotes are an empty string unless a third follows
        step[NUMBER_OF[f"{name}2"], globals()[mark]] = NUMBER_OF[f"{name}s"]
        go(f"{name}s", f"{name}s", **{mark: f"{name}s1", "BACK": f"{name}s+"})
        go(f"{name}s+", f"{name}s")
        go(f"{name}s1", f"{name}s", **{mark: f"{name}s2", "BACK": f"{name}s+"})
        go(f"{name}s2", f"{name}s", **{mark: "gap", "BACK": f"{name}s+"})
    go("raw", "raw", BACKTICK="gap", BACK="raw+")
    go("raw+", "raw")
    return step


#: One table per language; texts of an unknown language get the last, which takes every mark.
TABLES = {
    "python": automaton(False, True, True, False, True),
    "javascript": automaton(True, False, True, True, False),
    "java": automaton(True, False, True, False, True),
    "go": automaton(True, False, True, True, False),
    "rust": automaton(True, False, False, False, False),
    "cpp": automaton(True, False, True, False, False),
    "c": automaton(True, False, True, False, False),
    "": automaton(True, True, True, False, True),
}
FAMILY = {name: i for i, name in enumerate(TABLES)}
STEP = np.stack(list(TABLES.values()))
#: Bytes of a row of the automata (longer texts are several rows), and of the rows that run together at most.
CHUNK, TOGETHER = 1024, 1 << 22


def _blocks(lengths: np.ndarray, times: int = 1):
    """Rows in the order of their lengths, as many at once as TOGETHER allows when padded to the longest."""
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        hi = len(order)
        while hi > lo + 1 and int(lengths[order[hi - 1]]) * (hi - lo) * times > TOGETHER:
            hi = lo + max(1, (hi - lo) // 2)
        yield order[lo:hi]
        lo = hi


def part_mask(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, family: np.ndarray) -> np.ndarray:
    """What each byte belongs to (see STATES; 0 line end). A text longer than CHUNK is cut in rows: the automaton runs over
    each from every state, the rows' maps are composed to give the state at each row's begin, and all rows run together."""
    rows = -(-lengths // CHUNK)
    text = np.repeat(np.arange(len(lengths)), rows)
    within = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = starts[text] + within * CHUNK
    size = np.minimum(CHUNK, lengths[text] - within * CHUNK)
    states, classes = STEP.shape[1:]
    table, base = STEP.astype(np.int32).ravel(), family[text].astype(np.int32) * states * classes
    kinds = CLASS[data]
    first = np.full(len(text), GAP, np.int32)
    # maps of the rows that others follow
    inner = np.flatnonzero(within < rows[text] - 1)
    if len(inner):
        maps = np.empty((len(text), states), np.int32)
        for part in np.array_split(inner, -(-len(inner) * states * CHUNK // (TOGETHER * 8))):
            state = np.broadcast_to(np.arange(states, dtype=np.int32), (len(part), states)).copy()
            for j in range(CHUNK):
                state = table[base[part, None] + state * classes + kinds[begin[part] + j][:, None]]
            maps[part] = state
        for r in inner:  # one step per row of CHUNK bytes
            first[r + 1] = maps[r, first[r]]
    out = np.zeros(len(data), np.uint8)
    for own in _blocks(size):
        lengths_, width = size[own], int(size[own[-1]])
        state, at, b = first[own], begin[own], base[own]
        marks = np.zeros((width, len(own)), np.uint8)
        for j in range(width):
            lo = int(np.searchsorted(lengths_, j, side="right"))
            state[lo:] = table[b[lo:] + state[lo:] * classes + kinds[at[lo:] + j]]
            marks[j, lo:] = PART[state[lo:]]
        inside = np.arange(width)[:, None] < lengths_
        out[(at + np.arange(width)[:, None])[inside]] = marks[inside]
    out[kinds == LINE] = 0
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The data, and where each text begins and how long it is, out of the buffers of an Arrow array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def marked_runs(texts: pa.Array | list[str], family: np.ndarray | None = None, again: bool = True) -> list[tuple[int, str]]:
    """(number of the text, run) for every run that may hold prose, in order; none crosses a line end.

    Comments are runs, and so is a line's plain text. A line with strings in its plain text gives the strings, unless the
    rest of it is prose, too (few marks of code): then all of it is one run. Comments and strings that show a mark of code are
    read once `again` in the same way, as they may hold code with comments and strings of its own (examples)."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_string())
    if not len(texts):
        return []
    data, starts, lengths = _bytes(texts)
    if not len(data):
        return []
    mask = part_mask(data, starts, lengths, np.full(len(texts), FAMILY[""]) if family is None else family)
    zone = np.array([0, 1, 2, 1], np.uint8)[mask]
    string = mask == 3
    code = np.r_[0, np.cumsum(CODE_BYTES[data], dtype=np.int64)]
    stringy = np.r_[0, np.cumsum(string, dtype=np.int64)]
    plain_code = np.r_[0, np.cumsum(CODE_BYTES[data] & ~string, dtype=np.int64)]
    edge = np.r_[True, zone[1:] != zone[:-1]]
    edge[starts[lengths > 0]] = True
    b = np.flatnonzero(edge)
    e = np.r_[b[1:], len(data)]
    full = (zone[b] > 0) & (e - b >= 10)
    strings = stringy[e] - stringy[b]
    base = e - b - strings
    whole = full & ((strings == 0) | (base >= 10) & (plain_code[e] - plain_code[b] <= 0.02 * base))
    apart = np.zeros(len(data) + 1, np.int32)
    apart[b[full & ~whole]] += 1
    apart[e[full & ~whole]] -= 1
    held = string & (np.cumsum(apart[:-1]) > 0)
    s_b = np.flatnonzero(held & (np.r_[True, ~held[:-1]] | edge))
    s_e = np.flatnonzero(held & np.r_[~held[1:] | edge[1:], True]) + 1
    b, e = np.r_[b[whole], s_b], np.r_[e[whole], s_e]
    order = np.argsort(b, kind="stable")
    b, e = b[order], e[order]
    long = e - b >= 10
    b, e = b[long], e[long]
    of = np.searchsorted(starts, b, side="right") - 1
    raw = data.tobytes()
    runs = [raw[x:y].decode("utf-8", "ignore") for x, y in zip(b.tolist(), e.tolist())]
    nested = np.flatnonzero((mask[b] > 1) & (code[e] > code[b])) if again else []
    if not len(nested):
        return list(zip(of.tolist(), runs))
    found: dict[int, list[str]] = {int(k): [] for k in nested}
    for k, run in marked_runs([runs[k].lstrip(LEFT) for k in nested], again=False):
        found[int(nested[k])].append(run)
    return [(i, x) for k, (i, run) in enumerate(zip(of.tolist(), runs)) for x in found.get(k, [run])]


# -- texts -------------------------------------------------------------------------------------------------------------

LEFT, RIGHT = " \t\r\n\f\v*/#!>|~\"'-", " \t\r\n\f\v*/#>|~\""
TAG = re.compile(r"^(?:[:@\\]\w+(?:[ \t]+[\w.]+)?(?::|(?=[ \t]|$))|[A-Za-z_]\w*:)[ \t]*")
JSON_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("?)(\s*:)?', re.S)


def json_values(text: str) -> list[str]:
    """String values (not keys) of a JSON text, also of one that breaks off; other texts as they are."""
    if not text.lstrip().startswith(("{", "[")):
        return [text]
    try:
        todo, out = [json.loads(text)], []
        while todo:
            x = todo.pop()
            todo += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
            out += [x] if isinstance(x, str) else []
        return out
    except ValueError:
        pass
    out = []
    for body, _, key in JSON_STRING.findall(text):
        if not key:
            try:
                out.append(json.loads(f'"{body}"', strict=False))
            except ValueError:
                out.append(re.sub(r"\\[^n]?$", "", body).replace("\\n", "\n").replace('\\"', '"'))
    return out


def prose_of(texts: pa.Array | list[str], family: np.ndarray | None = None) -> tuple[list[int], list[str], list[int]]:
    """Of many texts: each sentence's text number, its words, and its number of characters."""
    which, words, sizes = [], [], []
    for i, run in marked_runs(texts, family):
        for s in sentences(run):
            s = TAG.sub("", s.lstrip(LEFT).rstrip(RIGHT))
            if len(s) >= 10 and (w := is_prose(s)):
                which.append(i)
                words.append(w)
                sizes.append(len(s))
    return which, words, sizes


def latest_symbols(symbols: DataFrame, *columns: str) -> DataFrame:
    """Of each (repo_id, id) the row with the latest indexed_at; ties by the greatest of the chosen columns."""
    last = Window.partitionBy("repo_id", "id").orderBy(F.col("indexed_at").desc_nulls_last(), *[F.col(c).desc() for c in columns])
    return symbols.select("repo_id", "id", "indexed_at", *columns).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "indexed_at")


def language_shares(symbols: DataFrame, documents: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """repo_id, file_id, lang, chars, share: characters of prose in each language, and their share of the file's prose.

    Texts are doc and summary of the file's latest symbols. `sources` (repo_id, file_id, path) tells the programming language
    that the texts are read by; without it, or for a file it does not hold, all marks of comments and strings count. Null,
    empty and prose-free texts add nothing, and a file without prose has no row. Symbols with a null file_id count as one
    file per repo. Without labelled documents there is no model, and the result is empty. Texts are read whole. Other columns
    are ignored.
    """
    out = "repo_id string, file_id string, lang string, chars long"
    texts, labels, langs = labelled_sentences(documents)
    if not texts:
        return symbols.sparkSession.createDataFrame([], out + ", share double")
    model = shipped(symbols.sparkSession, fit_clean(texts, labels, len(langs)))

    def counted(batches):
        models = model()
        for batch in batches:
            family = np.array([FAMILY.get(x, FAMILY[""]) for x in batch.column("language").fill_null("").to_pylist()])
            row, parts = [], []
            for name in ("doc", "summary"):
                column = batch.column(name)
                at = np.flatnonzero(np.asarray(column.is_valid()))
                values = column.take(pa.array(at))
                if name == "summary":  # JSON gives its values, one text each
                    told = [json_values(t) if t.lstrip().startswith(("{", "[")) else [t] for t in values.to_pylist()]
                    at = np.repeat(at, [len(x) for x in told])
                    values = pa.array([v for x in told for v in x], pa.large_string())
                row.append(at)
                parts.append(values.cast(pa.large_string()))
            row = np.concatenate(row)
            which, words, sizes = prose_of(pa.concat_arrays(parts), family[row])
            if words:
                best = models.scores(words).argmax(1)
                at = row[which]
                found = pd.DataFrame({"repo_id": np.array(batch.column("repo_id").to_pylist(), object)[at], "file_id": np.array(batch.column("file_id").to_pylist(), object)[at], "lang": np.array(langs, object)[best], "chars": sizes})
                yield pa.RecordBatch.from_pandas(found.groupby(["repo_id", "file_id", "lang"], dropna=False, as_index=False)["chars"].sum(), schema, preserve_index=False)

    schema = pa.schema([("repo_id", pa.string()), ("file_id", pa.string()), ("lang", pa.string()), ("chars", pa.int64())])
    rows = latest_symbols(symbols, "file_id", "doc", "summary").select("repo_id", "file_id", "doc", "summary")
    rows = rows.join(file_languages(sources), ["repo_id", "file_id"], "left") if sources is not None else rows.withColumn("language", F.lit(""))
    by_lang = rows.mapInArrow(counted, out).groupBy("repo_id", "file_id", "lang").agg(F.sum("chars").alias("chars"))
    whole = F.sum("chars").over(Window.partitionBy("repo_id", "file_id"))
    return by_lang.withColumn("share", F.col("chars") / whole)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = language_shares(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "raw_sources"))
    return shares.filter("share >= 0.2").select("repo_id", "file_id", "lang")
