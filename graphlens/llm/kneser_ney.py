"""Interpolated Kneser-Ney character models of several languages, scored together over arrays."""

from __future__ import annotations

import numpy as np

ORDER, DISCOUNT = 4, 0.75
#: How far below the best language a single character can put another one: no rare cluster decides alone.
FLOOR = 2.0


class Lookup:
    """Positions of 64-bit keys in a fixed set, by direct addressing; -1 where a key is not in it."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys))
        bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        while len(left):
            mult = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * len(self.tables) & 0xFFFFFFFFFFFFFFFF | 1)
            slot = self._slot(keys[left], mult, bits)
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = left
            self.tables.append((mult, bits, table))
            left = left[table[slot] != left]

    @staticmethod
    def _slot(keys: np.ndarray, mult: np.uint64, bits: int) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * mult >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, q: np.ndarray) -> np.ndarray:
        out = np.full(len(q), -1, np.int32)
        open_ = np.arange(len(q))
        for mult, bits, table in self.tables:
            at = table[self._slot(q[open_], mult, bits)]
            hit = (at >= 0) & (self.keys[np.maximum(at, 0)] == q[open_])
            out[open_[hit]] = at[hit]
            open_ = open_[(at >= 0) & ~hit]
            if not len(open_):
                break
        return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts as 16-bit codes, each text with ORDER - 1 blanks before it; where each text begins."""
    pad = " " * (ORDER - 1)
    joined = "".join(pad + t for t in texts)
    x = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
    lengths = np.array([len(t) + len(pad) for t in texts])
    return x, np.cumsum(lengths) - lengths


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """For every place from ORDER - 1 on, the n-gram that ends there, the newest character in the lowest bits."""
    out = np.zeros(len(x) - ORDER + 1, np.uint64)
    for i in range(n):
        out |= x[ORDER - 1 - i : len(x) - i] << np.uint64(16 * i)
    return out


class CharModels:
    """fit() on (text, language) pairs; scores() gives the log probability of each text under every language."""

    def __init__(self, texts: list[str], labels: np.ndarray, languages: int):
        self.languages = languages
        self.keys: list[Lookup] = []
        self.logp: list[np.ndarray] = []
        self.ctx: list[Lookup] = []
        self.fall: list[np.ndarray] = []
        counts = [[None] * (ORDER + 1) for _ in range(languages)]
        for lang in range(languages):
            x, starts = codes([t for t, y in zip(texts, labels) if y == lang] or [" "])
            real = np.ones(len(x), bool)
            for i in range(ORDER - 1):
                real[starts + i] = False
            k, c = np.unique(grams(x, ORDER)[real[ORDER - 1 :]], return_counts=True)
            counts[lang][ORDER] = k, c.astype(float)
            for n in range(ORDER - 1, 0, -1):
                mask = np.uint64((1 << 16 * n) - 1)
                k, c = np.unique(counts[lang][n + 1][0] & mask, return_counts=True)
                counts[lang][n] = k, c.astype(float)
        below: np.ndarray | None = None
        for n in range(1, ORDER + 1):
            union = np.unique(np.concatenate([counts[lang][n][0] for lang in range(languages)]))
            contexts = np.unique(union >> np.uint64(16)) if n > 1 else np.zeros(1, np.uint64)
            p = np.zeros((len(union), languages))
            fall = np.zeros((len(contexts), languages))
            of = np.searchsorted(contexts, union >> np.uint64(16)) if n > 1 else np.zeros(len(union), int)
            base = below[self.keys[-1](union & np.uint64((1 << 16 * (n - 1)) - 1))] if n > 1 else np.full((len(union), languages), 1 / 8192)
            for lang in range(languages):
                k, c = counts[lang][n]
                at = np.searchsorted(union, k)
                own = np.zeros(len(union))
                own[at] = c
                total = np.bincount(of[at], c, len(contexts))
                kinds = np.bincount(of[at], minlength=len(contexts))
                weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                p[:, lang] = np.maximum(own - DISCOUNT, 0) / np.maximum(total, 1)[of] + weight[of] * base[:, lang]
                fall[:, lang] = np.log(weight)
            self.keys.append(Lookup(union))
            self.logp.append(np.log(p).astype(np.float32))
            self.ctx.append(Lookup(contexts))
            self.fall.append(fall.astype(np.float32))
            below = p

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.languages), np.float32)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (size < 200_000 or hi == lo):
                size += len(texts[hi]) + ORDER - 1
                hi += 1
            x, starts = codes(texts[lo:hi])
            out[lo:hi] = np.add.reduceat(self._places(x, starts), starts, axis=0)
            lo = hi
        return out

    def _places(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        per = np.zeros((len(x), self.languages), np.float32)
        real = np.ones(len(x), bool)
        for i in range(ORDER - 1):
            real[starts + i] = False
        places = np.flatnonzero(real)
        key = grams(x, ORDER)[places - ORDER + 1]
        for n in range(ORDER, 0, -1):
            at = self.keys[n - 1](key)
            hit = at >= 0
            per[places[hit]] += self.logp[n - 1][at[hit]]
            places, key = places[~hit], key[~hit]
            if not len(places):
                break
            if n == 1:
                per[places] += np.float32(np.log(1 / 8192))
                break
            c = self.ctx[n - 1](key >> np.uint64(16))
            known = c >= 0
            per[places[known]] += self.fall[n - 1][c[known]]
            key = key & np.uint64((1 << 16 * (n - 1)) - 1)
        return np.maximum(per, per.max(axis=1, keepdims=True) - np.float32(FLOOR))


def fit_clean(texts: list[str], labels: np.ndarray, languages: int, rounds: int = 3) -> CharModels:
    """A model fitted several times, each time without the sentences that the one before gave another language."""
    keep = np.ones(len(texts), bool)
    for _ in range(rounds):
        model = CharModels([t for t, ok in zip(texts, keep) if ok], labels[keep], languages)
        keep = model.scores(texts).argmax(1) == labels
    return model
