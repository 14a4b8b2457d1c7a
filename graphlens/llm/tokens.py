"""Encoding of the whole corpus with a public byte-level BPE tokenizer by tree concatenation.

Every text is cut into leaves of at most LEAF characters, leaves are encoded on their own, and neighbours are joined in
pairs up to the root. A cut falls where the tokenizer's own pattern ends a piece; only inside a piece longer than what is
left of a leaf (one endless word, ruler or blank) it falls anywhere. There a window around the join is encoded anew and
grown until its outermost tokens agree with both sides: as every pair of neighbouring tokens inside and at the edges of
the window is then one that the encoding itself produces, so is the whole. Leaves of a segment (SEGMENT characters) are
joined where they were encoded; a text of several segments is joined further across tasks, FAN neighbours at a time.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.tables import shipped, table

#: Where the vocabulary (ranks of byte sequences) lies; read once on the driver and sent along.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer cuts a text into pieces before it merges bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf, and of a segment whose leaves one task encodes.
LEAF, SEGMENT = 512, 1 << 17
#: How far back from a full leaf an end of a piece is looked for first.
LOOK = 64
#: Parts that one step across tasks joins, and such steps: FAN ** STEPS segments are more than a string can hold.
FAN, STEPS = 16, 4


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def narrowed(kind: str) -> str:
    """`kind` (\\p{L} or \\p{N}) as a class that holds only the characters that the tokenizer's own engine counts there, too:
    the two engines know different versions of Unicode."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    own = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    more = np.array(sorted(set(map(ord, regex.findall(kind, every))) - set(map(ord, own.decode(own.encode_ordinary(every))))), np.int64)
    if not len(more):
        return rf"[{kind}]"
    runs = np.split(more, np.flatnonzero(np.diff(more) > 1) + 1)
    return rf"[{kind}--[{''.join(rf'\U{r[0]:08x}-\U{r[-1]:08x}' for r in runs)}]]"


class Cutter:
    """Leaves of a text. Where a piece must end whatever stands before it is looked for near the end of a full leaf; only
    where no such place is near are the pieces themselves matched, from the last place that is sure."""

    def __init__(self, letters: str, digits: str):
        self.patterns = letters, digits
        none = f"[^\\s{letters}{digits}]"
        self.piece = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?{letters}+| ?{digits}+| ?{none}+|\s+(?!\S)|\s+", regex.V1)
        self.sure = regex.compile(rf"(?<={letters})(?!{letters})|(?<={digits})(?!{digits})|(?<=\S)(?=\s)", regex.V1)
        self.after_blank = regex.compile(r"(?<=\s)(?=\S)")

    def __reduce__(self):
        return Cutter, self.patterns

    def _last_sure(self, text: str, low: int, stop: int) -> int:
        # the search ends one character later than a cut may fall, so that what follows the place is seen
        return max((m.start() for m in self.sure.finditer(text, low, min(len(text), stop + 1)) if low < m.start() <= stop), default=-1)

    def leaves(self, text: str, size: int) -> list[tuple[int, int, int, bool]]:
        """(begin, end, head, glued) in order: the first `head` characters belong to a piece that began before the leaf; all
        of a `glued` leaf lies in a piece that goes on after it."""
        out, start, over = [], 0, 0
        begin = end = 0  # the piece that was looked at last; at its end a piece ends for sure
        while len(text) - start > size:
            stop = start + size
            if stop >= end:
                before = max(start, end)
                at = near = self._last_sure(text, max(before, stop - LOOK), stop)
                if near < 0:
                    at = self._last_sure(text, before, stop)
                if at >= 0:
                    begin = end = at
                if near < 0:
                    for m in self.piece.finditer(text, end):
                        begin, end = m.span()
                        if end >= stop:
                            break
            cut = end if end <= stop else begin if begin > start else stop
            if cut - 1 > start and not begin < cut < end and self.after_blank.match(text, cut):
                cut -= 1  # the last blank before a word is a piece only because of that word
            glued = begin < cut < end
            out.append((start, cut, max(0, min(over, cut) - start), glued))
            start, over = cut, end if glued else cut
        out.append((start, len(text), max(0, over - start), False))
        return out


class Encoder:
    """ids() of a whole text; leaf() and join() of its parts: (ids, tokens of the head, tokens of the tail)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}

    def ids(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def one(self, text: str) -> list[int]:
        return self.bpe._encode_single_piece(text.encode("utf-8", "replace"))

    def leaf(self, text: str, head: int, glued: bool) -> tuple[list[int], int, int]:
        if not head and not glued:
            return self.ids(text), 0, 0
        if glued or head == len(text):
            whole = self.one(text)
            return whole, len(whole) * (head > 0), len(whole) * glued
        a = self.one(text[:head])
        return a + self.ids(text[head:]), len(a), 0

    def join_piece(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of one piece from those of its two halves."""
        k = 4
        while True:
            left, right = a[max(0, len(a) - k) :], b[:k]
            new = list(self.bpe._encode_single_piece(b"".join(self.bytes_of[t] for t in left + right)))
            if (k >= len(a) or new[0] == left[0]) and (k >= len(b) or new[-1] == right[-1]):
                return a[: len(a) - len(left)] + new + b[len(right) :]
            k *= 2

    def join(self, a: tuple, b: tuple) -> tuple[list[int], int, int]:
        """Two neighbouring parts as one."""
        (x, x_head, x_tail), (y, y_head, y_tail) = a, b
        if not x_tail:
            return x + y, x_head, y_tail
        middle = self.join_piece(x[len(x) - x_tail :], y[:y_head])
        # where all of a side is inside the piece, so is what was the piece's part on that side
        head = len(middle) if x_head == len(x) else x_head
        tail = len(middle) if y_tail == len(y) == y_head else y_tail
        return x[: len(x) - x_tail] + middle + y[y_head:], head, tail

    def tree(self, parts: list[tuple]) -> tuple[list[int], int, int]:
        while len(parts) > 1:
            odd = [parts[-1]] if len(parts) % 2 else []
            parts = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)] + odd
        return parts[0]

    def encode(self, text: str, leaves: list[tuple[int, int, int, bool]]) -> tuple[list[int], int, int]:
        return self.tree([self.leaf(text[b:e], head, glued) for b, e, head, glued in leaves])


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF, segment: int = SEGMENT) -> DataFrame:
    """doc_id and ids, one row per row of `documents` (a doc_id on several rows gives several rows).

    Null and empty texts both give an empty list; strings that look like special tokens are ordinary text. Texts of any
    length are encoded whole. Other columns are ignored; an empty table gives an empty result. A text of more than one
    segment moves once per step of the tree above segments; one that fits a segment is never moved.
    """
    sent = shipped(documents.sparkSession, (read_vocabulary(vocabulary), Cutter(narrowed(r"\p{L}"), narrowed(r"\p{N}"))))
    rows = documents.select("doc_id", "text")
    per = max(1, segment // leaf)

    def whole(batches):
        ranks, cutter = sent()
        own = Encoder(ranks)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [np.array(own.encode(t, cutter.leaves(t, leaf))[0] if t else [], np.int32) for t in b["text"]]})

    def cut(batches):
        _, cutter = sent()
        for b in batches:
            for r in b.itertuples(index=False):
                leaves = cutter.leaves(r.text, leaf)
                for n in range(0, len(leaves), per):
                    own = np.array(leaves[n : n + per])
                    text = r.text[own[0, 0] : own[-1, 1]]
                    own[:, :2] -= own[0, 0]
                    yield pd.DataFrame({"doc_id": [r.doc_id], "h1": r.h1, "h2": r.h2, "copies": r.copies, "n": n // per, "leaves": [own.ravel()], "text": text})

    def encoded(batches):
        own = Encoder(sent()[0])
        for b in batches:
            done = [own.encode(t, [tuple(x) for x in at.reshape(-1, 4).tolist()]) for t, at in zip(b["text"], b["leaves"])]
            yield b[["doc_id", "h1", "h2", "copies", "n"]].assign(ids=[np.array(x[0], np.int32) for x in done], head=[x[1] for x in done], tail=[x[2] for x in done])

    def joined(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("n")
        ids, head, tail = Encoder(sent()[0]).tree([(x.tolist(), h, t) for x, h, t in zip(b["ids"], b["head"], b["tail"])]) if len(b) > 1 else (b["ids"].iloc[0], b["head"].iloc[0], b["tail"].iloc[0])
        return b[["doc_id", "h1", "h2", "copies"]].head(1).assign(n=b["n"].iloc[0] // FAN, ids=[np.array(ids, np.int32)], head=head, tail=tail)

    size = F.coalesce(F.length("text"), F.lit(0))
    short = rows.filter(size <= segment).mapInPandas(whole, "doc_id long, ids array<int>")
    # a long text's row is known by its hashes, so that a task that runs again gives the same keys; equal rows are encoded once
    same = ["doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    lengthy = rows.filter(size > segment).groupBy(*same).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    keyed, part = "doc_id long, h1 long, h2 long, copies long, n int", "ids array<int>, head int, tail int"
    parts = lengthy.mapInPandas(cut, f"{keyed}, leaves array<int>, text string").repartition("doc_id", "h1", "h2", "n").mapInPandas(encoded, f"{keyed}, {part}")
    for _ in range(STEPS):
        parts = parts.groupBy("doc_id", "h1", "h2", F.floor(F.col("n") / FAN).alias("up")).applyInPandas(joined, f"{keyed}, {part}")
    long = parts.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
    return short.unionByName(long)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
