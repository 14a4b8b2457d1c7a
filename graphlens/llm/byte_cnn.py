"""A small byte convolutional network in numpy: filters of several widths, max pooling, softmax."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Bytes of a window, and how far the next one of the same text begins after it.
WINDOW, STRIDE = 64, 48
WIDTHS, FILTERS, DIM = (2, 3, 4, 6), 32, 12
#: Windows that a network is fitted on, at most, and how often it sees them.
TRAIN_WINDOWS, EPOCHS, BATCH = 8_000, 6, 128


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts (bytes, blank-padded), and the text each belongs to; every byte is in one."""
    raw = [b" " + t.encode("utf-8", "ignore") + b" " for t in texts]
    counts = np.array([max(1, -(-(len(r) - WINDOW) // STRIDE) + 1) for r in raw])
    of = np.repeat(np.arange(len(raw)), counts)
    out = np.full((len(of), WINDOW), 32, np.uint8)
    n = 0
    for r, c in zip(raw, counts):
        for i in range(c):
            part = r[i * STRIDE : i * STRIDE + WINDOW]
            out[n, : len(part)] = np.frombuffer(part, np.uint8)
            n += 1
    return out, of


class ByteNet:
    """Bytes get fixed random vectors; filters, and a linear layer over their maxima, are learnt with Adam."""

    def __init__(self, classes: int, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.vectors = rng.standard_normal((256, DIM)).astype(np.float32) / np.sqrt(DIM)
        self.p = {}
        for w in WIDTHS:
            self.p[f"w{w}"] = (rng.standard_normal((w * DIM, FILTERS)) / np.sqrt(w)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = (rng.standard_normal((len(WIDTHS) * FILTERS, classes)) * 0.05).astype(np.float32)
        self.p["bias"] = np.zeros(classes, np.float32)

    def _patches(self, x: np.ndarray, w: int) -> np.ndarray:
        e = self.vectors[x].reshape(len(x), -1)
        places = WINDOW - w + 1
        shape, step = (len(x), places, w * DIM), e.strides
        return np.lib.stride_tricks.as_strided(e, shape, (step[0], DIM * step[1], step[1]))

    def _pooled(self, x: np.ndarray, keep: bool = False):
        maxima, kept = [], []
        for w in WIDTHS:
            patch = np.ascontiguousarray(self._patches(x, w)).reshape(-1, w * DIM)
            z = (patch @ self.p[f"w{w}"]).reshape(len(x), WINDOW - w + 1, FILTERS)
            if keep:
                at = z.argmax(1)
                kept.append((patch.reshape(len(x), -1, w * DIM), at))
                top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            else:
                top = z.max(1)
            maxima.append(np.maximum(top + self.p[f"b{w}"], 0))
        return np.concatenate(maxima, 1), kept

    def _tables(self) -> dict[int, list[np.ndarray]]:
        """What each byte adds to the filters of a width, at each of its offsets (small enough for a core's own cache)."""
        return {w: [self.vectors @ self.p[f"w{w}"][k * DIM : (k + 1) * DIM] for k in range(w)] for w in WIDTHS}

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Applying the filters needs no products: sums over the tables of bytes are the same numbers."""
        tables = self.__dict__.setdefault("_kept", None) or self._tables()
        self._kept = tables
        out = np.zeros((len(x), len(self.p["bias"])), np.float32)
        for i in range(0, len(x), 128):
            part = x[i : i + 128].astype(np.intp)
            maxima = []
            for w, own in tables.items():
                places = WINDOW - w + 1
                z = own[0].take(part[:, :places], axis=0)
                for k, t in enumerate(own[1:], 1):
                    z += t.take(part[:, k : k + places], axis=0)
                maxima.append(np.maximum(z.max(1) + self.p[f"b{w}"], 0))
            z = np.concatenate(maxima, 1) @ self.p["out"] + self.p["bias"]
            z -= z.max(1, keepdims=True)
            out[i : i + 128] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 3e-3, seed: int = 4) -> ByteNet:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                own = order[i : i + BATCH]
                h, kept = self._pooled(x[own], keep=True)
                z = h @ self.p["out"] + self.p["bias"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(own)), y[own]] -= 1
                z /= len(own)
                g = {"out": h.T @ z, "bias": z.sum(0)}
                dh = (z @ self.p["out"].T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    patch, at = kept[k]
                    best = patch[np.arange(len(own))[:, None], at]
                    g[f"w{w}"] = np.einsum("bfk,bf->kf", best, d, optimize=True)
                    g[f"b{w}"] = d.sum(0)
                t += 1
                for name, v in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * v
                    s[name] = 0.99 * s[name] + 0.01 * v * v
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def fit_texts(texts: list[str], labels: np.ndarray, classes: int, seed: int = 9) -> ByteNet:
    """A network fitted on windows of labelled texts, about as many of each class, at most TRAIN_WINDOWS; every fourth
    text is shown without its accents, too."""
    bare = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts[::4]]
    also = [i for i, t in enumerate(bare) if len(t) > 0.9 * len(texts[4 * i])]
    x, of = windows(texts + [bare[i] for i in also])
    y = np.r_[labels, labels[::4][also]][of]
    rng = np.random.default_rng(seed)
    own = []
    for c in range(classes):
        at = np.flatnonzero(y == c)
        own.append(rng.choice(at, min(len(at), max(1, TRAIN_WINDOWS // classes)), replace=False) if len(at) else at)
    own = np.concatenate(own)
    return ByteNet(classes).fit(x[own], y[own])
