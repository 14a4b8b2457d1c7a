"""Evaluation texts leaking into training text: latent semantic retrieval, then exact and subsequence checks.

Texts become words, words passages (windows of PASSAGE words, one every STRIDE). Passages are TF-IDF vectors over the
words and word pairs that evaluation items hold; frequencies count all passages of the corpus. A randomised SVD of the
corpus' passages (sketched by partition, summed by Spark) gives a latent space in which every passage looks for items'
passages by cosine. A passage's cosine cannot exceed the share of its length that the space keeps, so most are done
with after one product. Candidates are then checked word by word; runs of words are looked for in every document.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.tables import cut, shipped, table

PASSAGE, STRIDE = 24, 12
#: Dimensions of the latent space, and how many more the sketch has.
RANK, EXTRA = 128, 16
#: Cosine of two passages from which on a document and an item are compared word by word.
LEAST_COSINE = 0.2
#: Words in a row that make a leak (Chinese items, where each character is a word: LEAK_ZH), and for a paraphrase the share
#: of an item's passage that is a common subsequence.
LEAK, LEAK_ZH, PARAPHRASE = 12, 24, 0.75
#: Words and word pairs of one block of evaluation items, counted with repetition: what is broadcast and what comes back to
#: the driver (a row of RANK + EXTRA floats for each that differs) is bounded by a block, not by the evaluation set.
BLOCK_TERMS = 100_000
#: Documents whose passages the latent space is fitted on, about; frequencies and the search cover all.
FIT_DOCS = 5_000

TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
LEADER = re.compile(r"(?m)^[ \t]*(?:(?:[>|*+•#/%;:=~\-]+|\d{1,3}[.)])(?:[ \t]+|$))+")
LINE_END_HYPHEN = regex.compile(r"(?<=\p{L})-[ \t]*\n[ \t]*(?=\p{L})")
INVISIBLE = regex.compile(r"\p{Cf}+")
_EACH = r"\p{Han}\p{Hiragana}\p{Katakana}"
#: Words of any text; of a text without such characters and without marks; of ASCII in lower case.
WORD = regex.compile(rf"[{_EACH}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{_EACH}]]+", regex.V1)
PLAIN, ASCII = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")
SPECIAL = regex.compile(rf"[{_EACH}\p{{M}}]")


def words(text: str | None) -> list[str]:
    """Words as TESTDATA.md counts them: runs of letters and digits, Chinese and Japanese characters one by one; letter
    case, marks, line leaders, tags, entities, invisible characters and line-end hyphens left out."""
    if not text:
        return []
    t = html.unescape(TAG.sub(" ", text)) if "<" in text or "&" in text else text
    ascii_ = t.isascii()
    if not ascii_:
        t = INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = LEADER.sub("", t)
    if "-" in t and "\n" in t:
        t = LINE_END_HYPHEN.sub("", t)
    if ascii_:
        return ASCII.findall(t.lower())
    t = unicodedata.normalize("NFKC", t.casefold())
    return WORD.findall(t) if SPECIAL.search(t) else PLAIN.findall(t)


class Items:
    """Words and word pairs of a block of evaluation items, as numbers; words that no item holds are 0."""

    def __init__(self, ids: list[int], langs: list[str | None], texts: list[str | None]):
        told = [words(t) for t in texts]
        self.ids = np.array(ids, np.int64)
        self.need = np.array([LEAK_ZH if (x or "").strip().lower()[:2] == "zh" else LEAK for x in langs])
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in told for w in t}))}
        self.words = [np.array([self.number[w] for w in t], np.int64) for t in told]
        pairs = [a[:-1] * len(self) + a[1:] for a in self.words if len(a) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.terms = len(self) + len(self.pairs)
        self.weight = np.ones(self.terms, np.float32)
        self.grams = {n: self._grams(n) for n in {LEAK, LEAK_ZH}}

    def __len__(self) -> int:
        return len(self.number) + 1

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def passages(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all passages of many documents: document, term entries (passage, term), unknown words, words (-1: none)."""
        doc, start = [], []
        for i, a in enumerate(docs):
            s = np.arange(0, max(1, len(a) - (PASSAGE - STRIDE)), STRIDE) if len(a) else np.zeros(0, int)
            doc.append(np.full(len(s), i))
            start.append(s)
        doc, start = np.concatenate(doc or [np.zeros(0, int)]), np.concatenate(start or [np.zeros(0, int)])
        flat = np.concatenate([*docs, np.zeros(PASSAGE, np.int64)])
        begin = np.cumsum([0] + [len(a) for a in docs])
        size = np.minimum(PASSAGE, (begin[1:] - begin[:-1])[doc] - start) if len(doc) else np.zeros(0, int)
        at = begin[doc][:, None] + start[:, None] + np.arange(PASSAGE)
        inside = np.arange(PASSAGE) < size[:, None]
        w = np.where(inside, flat[np.minimum(at, len(flat) - 1)], -1)
        unknown = (w == 0).sum(1)
        p1, c1 = np.nonzero(w > 0)
        two = (w[:, :-1] > 0) & (w[:, 1:] > 0)
        p2, c2 = np.nonzero(two)
        key = w[p2, c2] * len(self) + w[p2, c2 + 1]
        pos = np.searchsorted(self.pairs, key)
        known = (pos < len(self.pairs)) & (self.pairs[np.minimum(pos, max(len(self.pairs) - 1, 0))] == key) if len(self.pairs) else np.zeros(len(key), bool)
        passage = np.r_[p1, p2[known]]
        term = np.r_[w[p1, c1], len(self) + pos[known]]
        order = np.argsort(passage, kind="stable")
        return doc, passage[order], term[order], unknown, w

    def latent(self, docs: list[np.ndarray], basis: np.ndarray):
        """Document, words, latent vector and full length of every passage."""
        return self.projected(self.passages(docs), basis)

    def projected(self, told: tuple, basis: np.ndarray):
        doc, passage, term, unknown, w = told
        z = np.zeros((len(doc), basis.shape[1]), np.float32)
        scaled = basis * self.weight[:, None]
        # an unknown word weighs what the passage's known words weigh in the mean: else how common a leak is would decide
        heavy = self.weight[term].astype(float) ** 2
        single = term < len(self)
        known = np.bincount(passage[single], minlength=len(doc))
        mean = np.bincount(passage[single], heavy[single], len(doc)) / np.maximum(known, 1)
        square = unknown * np.where(known > 0, mean, float(self.weight.max(initial=1)) ** 2)
        square += np.bincount(passage, heavy, len(doc))
        for lo in range(0, len(doc), 2048):
            a, b = np.searchsorted(passage, [lo, lo + 2048])
            if b > a:
                own = scaled[term[a:b]]
                first = np.flatnonzero(np.r_[True, passage[a + 1 : b] != passage[a : b - 1]])
                z[passage[a:b][first]] = np.add.reduceat(own, first, axis=0)
        return doc, w, z, np.sqrt(np.maximum(square, 1e-12)).astype(np.float32)

    def hashes(self, a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every n words in a row; runs with an unknown word are left out."""
        gaps = np.cumsum(np.r_[0, a == 0])
        start = np.flatnonzero(gaps[n:] == gaps[:-n]) if len(a) >= n else np.zeros(0, np.int64)
        h = np.zeros(len(start), np.uint64)
        for i in range(n):
            h = (h ^ a[start + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return start, h

    def _grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the leaks of items that need n words, in order, and the item of each."""
        own = [(np.unique(self.hashes(a, n)[1]), i) for i, a in enumerate(self.words) if self.need[i] == n]
        h = np.concatenate([x for x, _ in own] or [np.zeros(0, np.uint64)])
        item = np.concatenate([np.full(len(x), i) for x, i in own] or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        return h[order], item[order]

    def verbatim(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and items of which they hold a leak word by word."""
        flat = np.concatenate([np.append(a, 0) for a in docs] or [np.zeros(0, np.int64)])
        of = np.repeat(np.arange(len(docs)), [len(a) + 1 for a in docs])
        found = [np.zeros(0, np.int64)]
        for n, (h, item) in self.grams.items():
            start, own = self.hashes(flat, n)
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            found += [of[start[k]] * len(self.ids) + item[lo[k] : hi[k]] for k in np.flatnonzero(hi > lo)]
        pair = np.unique(np.concatenate(found))
        return pair // len(self.ids), pair % len(self.ids)


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Words in a row that both hold (0: no word), from where equal words stand on one diagonal without a gap."""
    at = np.flatnonzero(np.isin(a, b[b > 0]))
    i, j = np.nonzero(a[at, None] == b[None, :])
    i = at[i]
    order = np.lexsort((i, i - j))
    i, diagonal = i[order], (i - j)[order]
    new = np.flatnonzero(np.r_[True, (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1)][: len(i)])
    return int(np.diff(np.r_[new, len(i)]).max(initial=0))


def subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows (0: no word)."""
    table = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for i in range(a.shape[1]):
        before, new = table, np.zeros_like(table)
        for j in range(b.shape[1]):
            same = (a[:, i] == b[:, j]) & (a[:, i] > 0)
            new[:, j + 1] = np.where(same, before[:, j] + 1, np.maximum(before[:, j + 1], new[:, j]))
        table = new
    return table[:, -1]


def signatures(w: np.ndarray) -> np.ndarray:
    """128 bits for the words (above 0) of each row, as two numbers."""
    x = np.maximum(w, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.uint64(1) << (x >> np.uint64(58))
    half = (x >> np.uint64(57) & np.uint64(1)).astype(bool)
    zero = np.uint64(0)
    return np.stack([np.bitwise_or.reduce(np.where((w > 0) & (half == k), bits, zero), axis=1) for k in (False, True)], 1)


def possible(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether rows with the signatures a may cover PARAPHRASE of rows with the signatures b and so many words: each bit that
    only b has is a word of b that a has not."""
    missing = np.bitwise_count(b[:, 0] & ~a[:, 0]) + np.bitwise_count(b[:, 1] & ~a[:, 1])
    return (size >= LEAK) & (size - missing >= PARAPHRASE * size)


def paraphrased(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of b (items' passages; -1 after the end) are covered to PARAPHRASE by a common subsequence with a, and the share.
    A subsequence cannot be longer than the words of either row that both hold; only what that leaves is compared in order."""
    at, share = [np.zeros(0, np.int64)], [np.zeros(0)]
    size = (b >= 0).sum(1)
    open_ = np.flatnonzero((size >= LEAK) & ((a > 0).sum(1) >= PARAPHRASE * size))
    for lo in range(0, len(open_), 8192):
        own = open_[lo : lo + 8192]
        same = (a[own][:, :, None] == b[own][:, None, :]) & (a[own] > 0)[:, :, None]
        own = own[np.minimum(same.any(1).sum(1), same.any(2).sum(1)) >= PARAPHRASE * size[own]]
        part = subsequence(np.maximum(a[own], 0), np.maximum(b[own], 0)) / size[own]
        at.append(own[part >= PARAPHRASE])
        share.append(part[part >= PARAPHRASE])
    return np.concatenate(at), np.concatenate(share)


def _summed(parts: DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by term of the partitions' rows; what reaches the driver is bounded by the terms of a block of items."""

    def added(p: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(p["row"]), np.float32).reshape(len(p), columns)
        order = np.argsort(p["term"].to_numpy(), kind="stable")
        term = p["term"].to_numpy()[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        return pd.DataFrame({"term": term[first], "row": [x.tobytes() for x in np.add.reduceat(rows[order].astype(np.float64), first, axis=0).astype(np.float32)]})

    got = parts.groupBy((F.col("term") % 64).alias("part")).applyInPandas(added, "term long, row binary").toPandas()
    return got["term"].to_numpy(np.int64), np.frombuffer(b"".join(got["row"]), np.float32).reshape(len(got), columns)


def _docs(batch: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32).astype(np.int64) for x in batch["words"]]


def latent_basis(docs: DataFrame, items: Items, share: float) -> np.ndarray:
    """Sets the items' term weights from all passages, and gives the leading right singular vectors (terms x RANK) of the
    TF-IDF matrix of the passages of items and of a share of the documents, by a randomised range finder with one power
    step. The documents are chosen by a hash of their words."""
    spark = docs.sparkSession
    sent = shipped(spark, items)
    width = min(RANK + EXTRA, max(items.terms, 1))

    def frequencies(batches):
        own, total, n = sent(), None, 0
        for b in batches:
            doc, passage, term, _, _ = own.passages(_docs(b))
            key = np.sort(passage * own.terms + term)
            add = np.bincount(key[np.r_[True, key[1:] != key[:-1]][: len(key)]] % own.terms, minlength=own.terms)
            total, n = add if total is None else total + add, n + len(doc)
        if total is not None:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"term": np.r_[-1, at], "df": np.r_[n, total[at]]})

    df = docs.mapInPandas(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    count = np.zeros(items.terms)
    at = df["term"].to_numpy()
    count[at[at >= 0]] = df["df"].to_numpy()[at >= 0]
    n = float(df["df"].to_numpy()[at == -1].sum())
    items.weight = np.log((n + 2) / (count + 1)).astype(np.float32)
    sent = shipped(spark, items)
    some = docs.filter(F.pmod(F.xxhash64("words"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else docs
    some = some.coalesce(max(1, spark.sparkContext.defaultParallelism))

    def products(own: Items, told: list[np.ndarray], m: np.ndarray):
        """Rows of A'A m that a batch adds to."""
        p = own.passages(told)
        _, passage, term, _, _ = p
        _, _, z, _ = own.projected(p, m)
        w = own.weight[term]
        order = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.r_[True, term[order][1:] != term[order][:-1]]) if len(term) else np.zeros(0, int)
        out = [np.zeros((0, m.shape[1]), np.float32)]
        ends = np.r_[first[1:], len(term)]
        lo = 0
        while lo < len(first):  # some thousand entries at a time
            hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + 65536, side="right")))
            take = order[first[lo] : ends[hi - 1]]
            out.append(np.add.reduceat(z[passage[take]] * w[take, None], first[lo:hi] - first[lo], axis=0))
            lo = hi
        return term[order][first], np.concatenate(out)

    def sketch(m: np.ndarray) -> np.ndarray:
        matrix = shipped(spark, m)

        def partial(batches):
            own, mine, total, seen = sent(), matrix(), None, None
            for b in batches:
                term, rows = products(own, _docs(b), mine)
                if total is None:
                    total, seen = np.zeros((own.terms, mine.shape[1]), np.float32), np.zeros(own.terms, bool)
                total[term] += rows
                seen[term] = True
            if total is not None:
                for lo in range(0, own.terms, 4096):
                    at = lo + np.flatnonzero(seen[lo : lo + 4096])
                    yield pd.DataFrame({"term": at, "row": [x.tobytes() for x in total[at]]})

        out = np.zeros((items.terms, m.shape[1]), np.float32)
        term, rows = products(items, items.words, m)
        out[term] += rows
        term, rows = _summed(some.mapInPandas(partial, "term long, row binary"), m.shape[1])
        out[term] += rows
        return out

    omega = np.random.default_rng(13).standard_normal((items.terms, width)).astype(np.float32)
    q = np.linalg.qr(sketch(np.linalg.qr(sketch(omega))[0].astype(np.float32)))[0].astype(np.float32)
    small = q.T @ sketch(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-values)[:RANK]
    return (q @ vectors[:, keep]).astype(np.float32)


def leaked_block(docs: DataFrame, items: Items, share: float) -> DataFrame:
    basis = latent_basis(docs, items, share)
    doc, w, z, _ = items.latent(items.words, basis)
    length = np.linalg.norm(z, axis=1)
    unit = np.where(length[:, None] > 1e-6, z / np.maximum(length, 1e-6)[:, None], 0).astype(np.float32)
    sent = shipped(docs.sparkSession, (items, basis, doc, w, unit, signatures(w), (w >= 0).sum(1)))

    def search(batches):
        own, v, of, item_words, unit, item_bits, item_size = sent()
        count = len(own.ids)
        for b in batches:
            told = _docs(b)
            doc, w, z, full = own.latent(told, v)
            alive = np.flatnonzero(np.linalg.norm(z, axis=1) >= LEAST_COSINE * full)
            bits = signatures(w)
            parts = []
            for lo in range(0, len(alive), 512):
                own_p = alive[lo : lo + 512]
                dot = z[own_p] @ unit.T
                r, c = np.divmod(np.flatnonzero(dot >= LEAST_COSINE * full[own_p, None]), len(unit))
                near = possible(bits[own_p[r]], item_bits[c], item_size[c])
                r, c = r[near], c[near]
                k, share = paraphrased(w[own_p[r]], item_words[c])
                r, c = r[k], c[k]
                parts.append((doc[own_p[r]] * count + of[c], dot[r, c] / full[own_p[r]], share))
            held = own.verbatim(told)
            exact = held[0] * count + held[1]
            best = []
            for d, i in zip(*held):  # leaks count at any cosine
                mine, its = np.arange(*np.searchsorted(doc, [d, d + 1])), np.arange(*np.searchsorted(of, [i, i + 1]))
                cos = z[mine] @ unit[its].T / full[mine, None]
                r, c = np.unravel_index(cos.argmax(), cos.shape)
                best.append((mine[r], its[c], cos[r, c]))
            if best:
                r, c, cos = (np.array(x) for x in zip(*best))
                x = item_words[c]
                parts.append((exact, cos, subsequence(np.maximum(w[r], 0), np.maximum(x, 0)) / (x >= 0).sum(1)))
            if not parts:
                continue
            pair, cosine, share = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((-cosine, -share, pair))
            order = order[np.r_[True, pair[order][1:] != pair[order][:-1]][: len(order)]]
            pair, cosine, share = pair[order], cosine[order], share[order]
            verbatim = np.isin(pair, exact)
            run = [longest_run(told[d], own.words[i]) if exactly else 0 for d, i, exactly in zip(pair // count, pair % count, verbatim)]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].to_numpy()[pair // count],
                    "item_id": own.ids[pair % count],
                    "cosine": cosine.astype(float),
                    "run": np.array(run, np.int32),
                    "common": share,
                    "kind": np.where(verbatim, "verbatim", "paraphrase").astype(object),
                }
            )

    return docs.mapInPandas(search, "doc_id long, item_id long, cosine double, run int, common double, kind string")


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, run, common, kind: documents that carry passages of evaluation items.

    kind `verbatim`: `run` (words in a row that both hold) is LEAK or more, LEAK_ZH where the item's lang is zh.
    `paraphrase`: less, but some passages of both have cosine LEAST_COSINE or more and a common subsequence that covers
    PARAPHRASE of the item's; `common` is the largest share of such. Null and empty texts, and items shorter than a leak, have no verbatim row; repeated items are reported one by one; rows with one
    doc_id count as one. An empty table gives an empty result. Texts are read whole. Other columns are ignored.
    """

    def counted(batches):
        for b in batches:
            yield pd.DataFrame({"n": [2 * len(words(t)) for t in b["text"]]})  # words, and pairs of them

    size = eval_items.select("text").mapInPandas(counted, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_TERMS))
    share = min(1.0, FIT_DOCS / max(1, documents.count()))
    numbered = eval_items.select("item_id", "lang", "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        own = numbered.filter(F.col("block") == k).orderBy("item_id", "text").toPandas()
        items = Items(list(own["item_id"]), list(own["lang"]), list(own["text"]))
        if not items.terms > 1:
            continue
        sent = shipped(documents.sparkSession, items)

        def numbers(batches, sent=sent):
            mine = sent()
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "words": [mine.numbers(t).astype(np.int32).tobytes() for t in b["text"]]})

        docs = cut(documents.select("doc_id", "text").filter("text is not null").mapInPandas(numbers, "doc_id long, words binary"), "leak-words")
        block = leaked_block(docs, items, share)
        found = block if found is None else found.unionByName(block)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, run int, common double, kind string")
    best = F.max(F.struct("run", "common", "cosine", "kind")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.run", "best.common", "best.kind")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.filter("kind = 'verbatim'").select("doc_id", "item_id")


def p7_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry an item's passage in other words (no run of words long enough for p7_found)."""
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.filter("kind = 'paraphrase'").select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("common", 4).alias("common"))
