"""Attention-based multiple-instance quality classifier.

A text is a bag of passages of PASSAGE words.  Every passage is encoded from its words and runs of three
characters (shares of both in BUCKETS hashed buckets) and from what it looks like (letters, symbols, lines,
word lengths, repeated words and word runs), all of it figures of the passage alone.  Gated attention
weights, learnt from document labels alone, weigh the encoded passages, and the weighted sum is scored.
Training (numpy, Adam, on the driver) takes at most max_docs labelled documents, the least by a hash, with
all their passages; scoring takes all passages of all texts.

Edge cases: null texts count as empty; a text without words is one passage without words; labels
that are null are left out, and of several for one doc_id the least counts, as does the text that is least
by a hash; without labels of both kinds every score is 0.5; repeated rows give repeated results; very long
texts are taken whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod
from .repetition import _mix, again, batches, code_points, prefix_hashes, word_spans

PASSAGE = 64
_CLASSES: np.ndarray | None = None
N_CLASSES = 9
FIGURES = N_CLASSES + 10
BUCKETS = 512  # of words, and as many of character runs
FEATURES = FIGURES + 2 * BUCKETS
DAMPED = 10  # by how much a bucket's share, in standard deviations, counts for less than a figure


def _classes() -> np.ndarray:
    """A bit for each class that a code point is in."""
    global _CLASSES
    if _CLASSES is None:
        out = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            s = chr(c)
            out[c] = s.isalpha() | s.isdigit() << 1 | s.isupper() << 2
        for bit, chars in enumerate((" \t\r\v\f", "\n", ".,;:!?'\"-()", "#*$%&<>", "|", "@/\\_=+{}[]~^`")):
            out[[ord(c) for c in chars]] |= 1 << (3 + bit)
        _CLASSES = out
    return _CLASSES


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, FEATURES) of all texts one after another, and each text's passages."""
    cp, starts = code_points(texts)
    n_docs = len(texts)
    counts = np.ones(n_docs, np.int64)
    if not len(cp):
        out = np.zeros((n_docs, FEATURES), np.float32)
        out[:, FIGURES - 1] = 1  # no words
        return out, counts
    begin, end, doc = word_spans(cp, starts)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n_words = np.diff(first)
    counts = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate(([0], np.cumsum(counts)))
    passage = base[doc] + (np.arange(len(doc)) - first[doc]) // PASSAGE
    n = int(base[-1])
    out = np.zeros((n, FEATURES), np.float32)
    words = np.bincount(passage, minlength=n)
    # A passage runs from its first word (a text's first one from the text's start) to the next one's.
    low = np.full(n, -1, np.int64)
    low[passage[::-1]] = begin[::-1]
    low[base[:-1]] = starts[:-1]
    high = np.concatenate((low[1:], [len(cp)]))
    chars = np.maximum(high - low, 1)
    bits = _classes()[cp]
    for k in range(N_CLASSES):
        run = np.concatenate(([0], np.cumsum((bits >> k) & 1)))
        out[:, k] = (run[high] - run[low]) / chars
    some = np.maximum(words, 1)
    length = (end - begin).astype(np.float64)
    sums, inverse = prefix_hashes(cp)
    h = _mix((sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64))
    mean = lambda x: np.bincount(passage, weights=x, minlength=n) / some
    k = N_CLASSES
    out[:, k] = mean(length) / 10
    out[:, k + 1] = np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10
    out[:, k + 2] = mean(length <= 3)
    out[:, k + 3] = mean(length >= 14)
    key = h + _mix(passage)
    seen = np.zeros(len(h))
    seen[again(key)] = 1
    out[:, k + 4] = mean(seen)
    kinds = np.unique(np.stack([passage.astype(np.uint64), h], 1), axis=0)[:, 0].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    out[:, k + 5] = np.bincount(kinds, minlength=n) / some
    run_hit = np.zeros(len(h) + 1)
    if len(h) >= 5:
        five = _mix(passage[: len(h) - 4])
        for j in range(5):
            five = five * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - 4 + j]
        ok = np.flatnonzero(passage[: len(h) - 4] == passage[4:])
        at = ok[again(five[ok])]
        np.add.at(run_hit, at, 1)
        np.add.at(run_hit, at + 5, -1)
    out[:, k + 6] = mean(np.cumsum(run_hit[:-1]) > 0)
    out[:, k + 7] = words / PASSAGE
    tail = bits[np.maximum(end - 1, 0)] if len(end) else bits[:0]
    out[:, k + 8] = mean((tail & 1) == 0)
    out[:, k + 9] = words == 0
    bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    out[:, FIGURES : FIGURES + BUCKETS] = np.bincount(passage * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / some[:, None]
    if len(cp) >= 3:
        three = (cp[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cp[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + cp[2:]
        bucket = (_mix(three) >> np.uint64(40)).astype(np.int64) % BUCKETS
        here = np.repeat(np.arange(n), high - low)[: len(bucket)]
        inside = np.arange(len(bucket)) + 3 <= high[here]  # the run ends in its passage
        out[:, FIGURES + BUCKETS :] = np.bincount((here * BUCKETS + bucket)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS) / chars[:, None]
    return out, counts


class Network:
    """Encoder, gated attention and scorer; bags are runs of passages."""

    SHAPES = {"w1": (FEATURES, 24), "b1": (24,), "v": (24, 12), "u": (24, 12), "a": (12,), "c": (24,), "d": ()}

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, 0.3 if len(s) < 2 or s[0] < FEATURES else 0.05, s).astype(np.float32) if len(s) else np.zeros(s, np.float32) for k, s in self.SHAPES.items()}
        self.p["b1"] = np.zeros(24, np.float32)
        self.mean, self.std, self.trained = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), False

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, at = self.p, np.concatenate(([0], np.cumsum(counts)))[:-1]
        bag = np.repeat(np.arange(len(counts)), counts)
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        alpha = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(alpha[:, None] * h, at)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"at": at, "bag": bag, "x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "s": s}

    def gradient(self, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the bags' weighted cross entropy, by parameter; f is what forward gave."""
        p = self.p
        ds = (f["s"] - y) * weight
        dz = ds[:, None] * p["c"]
        dz_p = dz[f["bag"]]
        da = (dz_p * f["h"]).sum(1)
        de = f["alpha"] * (da - np.add.reduceat(f["alpha"] * da, f["at"])[f["bag"]])
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["alpha"][:, None] * dz_p + dt @ p["v"].T + dg @ p["u"].T
        dw = dh * (1 - f["h"] ** 2)
        return {"w1": f["x"].T @ dw, "b1": dw.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum()}

    def train(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = 60, bags: int = 512, rate: float = 0.01, decay: float = 1e-3) -> None:
        """rounds passes over the bags in batches; the kinds of label weigh the same."""
        if not 0 < y.sum() < len(y):
            return
        self.trained = True
        damped = np.where(np.arange(FEATURES) < FIGURES, 1, DAMPED).astype(np.float32)
        self.mean, self.std = x.mean(0), (x.std(0) + 1e-3) * damped
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        first = np.concatenate(([0], np.cumsum(counts)))
        order, rng, i = np.arange(len(y)), np.random.default_rng(1), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for a in [a for _ in range(rounds) for a in range(0, len(y), bags)]:
            order = rng.permutation(len(y)) if a == 0 else order
            own, i = np.sort(order[a : a + bags]), i + 1
            rows = np.concatenate([np.arange(first[j], first[j + 1]) for j in own.tolist()])
            grad, p = self.gradient(self.forward(x[rows], counts[own]), y[own], weight[own] / len(own)), self.p
            for k in p:
                g = grad[k] + decay * p[k] * (k not in ("b1", "d"))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trained or not texts:
            return np.full(len(texts), 0.5)
        return self.forward(*passages(texts))["s"]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000) -> Network:
    """A network from docs(doc_id, text) and labels(doc_id, quality); at most max_docs texts reach the driver."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    own = own.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(max_docs)  # so it can be broadcast
    text = F.coalesce("text", F.lit(""))
    first = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id", "y").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    got = sorted(first.select("doc_id", "y", "text").collect())
    net = Network()
    if got:
        parts = [passages([r["text"] for r in got[a:b]]) for a, b in batches([r["text"] for r in got], 300_000)]
        net.train(np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]), np.array([r["y"] for r in got], np.float32))
    return net


def quality_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text)."""

    def make():
        def run(ids, texts):
            texts = [t or "" for t in texts]
            return [ids, [s for a, b in batches(texts, 300_000) for s in net.scores(texts[a:b]).tolist()]]

        return run

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = lambda: crc_mod(F.col("doc_id"), 5) == 0
    net = train(docs.filter(~held_out()), labels.filter(~held_out()))
    return quality_scores(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
