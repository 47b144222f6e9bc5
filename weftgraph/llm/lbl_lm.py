"""Log-bilinear language model trained by noise-contrastive estimation, beside a unigram base.

Words (bytes with A-Z lowered; 64-bit hashes beyond a task) are counted over all training documents.
The model predicts a word in two steps, both normalised by matrix products.  First its unit: the TOP most
frequent tokens are a unit each, all other words fall into TAIL units by their last letters.  The two units
before give a predicted vector, A1[u1] + A2[u2]; its products with the units' vectors, plus biases, are
normalised over all units, once for each context that occurs.  Then, inside a unit of many words, the
word: the WORDS next most frequent words have vectors of their own, the others share one of their unit;
products with a vector of the unit before are normalised over the unit's words, and the others have their
smoothed share of the counts.  Training is by noise-contrastive estimation with unigram distributions as
noise.  Documents fall into ROUNDS classes by a hash; in each round every task trains on all tokens of its
documents of one class from the parameters of the round before, and the tasks' parameters are averaged by
their tokens.  (So the parameters depend on how the input is split into tasks, the results' form does not.)

Texts are read twice, to count and to code; training and scoring read the codes.  Words with at least
N / HEAD tokens (at most HEAD of them) are broadcast; the rest of a document's words are joined to their
counts by a shuffle.

Edge cases: null texts count as empty and have one token, the end; without training documents all
counts are 0, base_score divides by 0.1 and the model is uniform over units; rows with equal doc_id are
kept apart by their own row number; very long texts are taken whole; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, partitions, resident, saved
from .repetition import _mix

TOP, TAIL, WORDS = 384, 128, 16_384
UNITS, ENTRIES = TOP + TAIL, WORDS + TAIL
DIM, DIM2, NOISE, BATCH, RATE, ROUNDS = 24, 16, 32, 1024, 0.3, 2
HEAD = 2_000_000
END_HASH = 0  # the end token's hash
CHUNK = 16_384  # parameters in a row


PIECE = 1 << 20  # bytes hashed at a time
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIXED = _mix(np.arange(256))
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)))) for f in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _hashed_piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some bytes begin, their hashes and tail units; the last byte is a blank."""
    low, n = _LOWER[buf], len(buf)
    inside = ~_BLANK[buf]
    before = np.concatenate(([False], inside[:-1]))
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_MIXED[low] * power[:n], out=sums[1:])
    h = _mix((sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64)).view(np.int64)
    h[h == END_HASH] = 1
    at = lambda back: np.where(end - back >= begin, low[np.maximum(end - back, 0)], 0).astype(np.uint64)
    unit = TOP + (_mix(at(1) | at(2) << np.uint64(8) | at(3) << np.uint64(16)) % np.uint64(TAIL)).astype(np.int64)
    return begin, h, unit


def hashed(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail units of all texts' words, and where the texts begin among them (with the end).

    Words are the parts of a text at space, \\t, \\n, \\v, \\f and \\r, in bytes with A-Z lowered.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raw], dtype=np.int64)
    hs, units, counts, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(raw), np.int64), 0
    while a < len(buf):
        size = PIECE
        while True:  # a piece ends behind a blank
            blanks = np.flatnonzero(_BLANK[buf[a : a + size]])
            if len(blanks):
                break
            size *= 2
        b = a + int(blanks[-1]) + 1
        begin, h, unit = _hashed_piece(buf[a:b])
        hs.append(h)
        units.append(unit)
        counts += np.bincount(np.searchsorted(ends, begin + a, "right"), minlength=len(raw))
        a = b
    return np.concatenate(hs), np.concatenate(units), np.concatenate(([0], np.cumsum(counts)))


def words(text: str | None) -> list[bytes]:
    """A text's words one by one."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(w: bytes) -> int:
    return int(hashed([w.decode("utf-8", "surrogatepass")])[0][0])


def tail_unit(w: bytes) -> int:
    """A word's unit among the TAIL ones: by its last three bytes."""
    return int(hashed([w.decode("utf-8", "surrogatepass")])[1][0])


def counted(h: np.ndarray, unit: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, their units and sums of counts."""
    if not len(h):
        return h, unit, c
    order = np.argsort(h)
    own = h[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[first], unit[order[first]], np.add.reduceat(c[order], first)


class Counting:
    """Counts of the words of each batch, TEXTS texts at a time."""

    TEXTS = 2000

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        parts = []
        for a in range(0, len(texts), self.TEXTS):
            h, unit, _ = hashed(texts[a : a + self.TEXTS].to_pylist())
            parts.append(counted(h, unit, np.ones(len(h), np.int64)))
        return list(counted(*(np.concatenate(x) for x in zip(*parts))))


class Vocabulary:
    """The head's words by hash (h), their counts (c), units (unit) and entries; and N and V.

    A code is a word's place in the head, len(h) + unit for any other word, and len(h) + UNITS for the end.
    By code: units, entries (-1 for what is a unit by itself; WORDS + i for the others of tail unit i), log_c
    (log10 of the smoothed count; 0 beyond the head) and share (log10 of what log_c must be divided by).
    """

    def __init__(self, h: np.ndarray, c: np.ndarray, unit: np.ndarray, n: int, v: int, sums: dict[int, tuple[int, int]], n_end: int) -> None:
        by_hash = np.argsort(h)
        h, c, unit = h[by_hash], c[by_hash], unit[by_hash].copy()
        order = np.lexsort((h, -c))
        top, mid = order[: TOP - 1], order[TOP - 1 : TOP - 1 + WORDS]
        # Counts and kinds of the units; unit 0 is the end, 1 .. TOP - 1 the top words.
        mass = np.zeros((UNITS, 2))
        for u, (count, kinds) in sums.items():
            mass[u] = count, kinds
        np.add.at(mass, unit[top], np.stack([-c[top], np.full(len(top), -1)], 1))
        unit[top] = np.arange(1, len(top) + 1)
        mass[0] = n_end, 1
        mass[unit[top]] = np.stack([c[top], np.ones(len(top))], 1)
        # Of each entry its unit and mass: words of their own, then the others of each tail unit.
        entry = WORDS + unit - TOP
        entry[top], entry[mid] = -1, np.arange(len(mid))
        self.unit_of = np.concatenate((np.full(WORDS, TOP), np.arange(TOP, UNITS)))
        self.unit_of[: len(mid)] = unit[mid]
        rest = mass[TOP:].copy()
        np.add.at(rest, unit[mid] - TOP, np.stack([-c[mid], np.full(len(mid), -1)], 1))
        share = np.log10(rest[:, 0] + 0.1 * (rest[:, 1] + 1))
        own = np.zeros(ENTRIES)
        own[: len(mid)] = c[mid]
        own[WORDS:] = rest[:, 0]
        self.n_entries = len(mid)
        self.n, self.v, self.n_end, self.h = n, v, n_end, h
        self.log_total = math.log10(n + 0.1 * (v + 1))
        self.units = np.concatenate((unit, np.arange(UNITS), [0])).astype(np.int16)
        self.entries = np.concatenate((entry, np.full(TOP, -1), np.arange(WORDS, ENTRIES), [-1])).astype(np.int16)
        self.log_c = np.concatenate((np.log10(c + 0.1), np.zeros(UNITS), [math.log10(n_end + 0.1)]))
        self.share = np.concatenate((np.where(entry >= WORDS, np.log10(c + 0.1) - share[np.maximum(entry - WORDS, 0)], 0.0), np.zeros(TOP), -share, [0.0]))
        p = mass[:, 0] + 0.1
        self.noise = p / p.sum()
        p = np.where((np.arange(ENTRIES) < len(mid)) | (np.arange(ENTRIES) >= WORDS), own + 0.1, 0.0)
        self.noise2 = p / p.sum()
        self.id = hashlib.blake2b(h.tobytes() + c.tobytes() + self.noise.tobytes() + self.noise2.tobytes(), digest_size=8).hexdigest()


class Coder:
    """Hashes to codes, by a table of the head's hashes with a place for each of their first bits."""

    def __init__(self, voc: Vocabulary) -> None:
        self.voc, self.n_head = voc, len(voc.h)
        self.bits = max(4, int(4 * self.n_head).bit_length())
        self.table = np.full((1 << self.bits) + 64, -1, np.int32)
        slot, left = self._slot(voc.h), np.arange(self.n_head)
        self.far = 0  # how far a hash may stand behind its place
        while len(left):
            if self.far == 64:  # a run that long means equal first bits by the dozen: keep these apart
                break
            at = slot[left] + self.far
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left = left[self.table[at] != left]
            self.far += 1
        self.apart = left

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def place(self, h: np.ndarray) -> np.ndarray:
        """The head's places of hashes, or -1."""
        out, slot, left = np.full(len(h), -1, np.int64), self._slot(h), np.arange(len(h))
        for k in range(self.far):
            at = self.table[slot[left] + k]
            hit = (at >= 0) & (self.voc.h[at] == h[left]) if self.n_head else np.zeros(len(left), bool)
            out[left[hit]] = at[hit]
            left = left[~hit & (at >= 0)]  # behind a free place nothing stands
        for i in self.apart.tolist():
            out[h == self.voc.h[i]] = i
        return out

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts' words with the end's behind each text, where the texts begin (with the end), and
        the hashes of the words beyond the head (0 for the others)."""
        h, unit, first = hashed(texts)
        n = len(texts)
        starts = first + np.arange(n + 1)
        codes, hashes = np.full(int(starts[-1]), self.n_head + UNITS, np.int64), np.zeros(int(starts[-1]), np.int64)
        at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))
        place = self.place(h)
        codes[at] = np.where(place >= 0, place, self.n_head + unit)
        hashes[at] = np.where(place >= 0, 0, h)
        return codes, starts, hashes


def contexts(units: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that; ends stand before a text."""
    one = np.concatenate((np.zeros(1, units.dtype), units[:-1]))
    two = np.concatenate((np.zeros(2, units.dtype), units[:-2]))[: len(units)]
    one[starts] = 0
    two[starts] = 0
    two[starts[starts + 1 < len(units)] + 1] = 0
    return one, two


def _summed(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, and the sums of their values."""
    order = np.argsort(at, kind="stable")  # a radix sort, for 16-bit numbers
    own = at[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[first], np.add.reduceat(value[order], first, axis=0)


class Layer:
    """Vectors and biases of what is predicted (qb), and of contexts; Adagrad on the rows that a batch touches."""

    def __init__(self, noise: np.ndarray, kinds: int, dim: int, rng: np.random.Generator) -> None:
        self.noise, self.log_noise, self.cum = noise, np.log(np.maximum(noise, 1e-30)).astype(np.float32), np.cumsum(noise)
        self.context = [rng.normal(0, 0.1, (UNITS, dim)).astype(np.float32) for _ in range(kinds)]
        self.qb = np.concatenate((rng.normal(0, 0.1, (len(noise), dim)), self.log_noise[:, None]), 1).astype(np.float32)
        self.sums = [np.full_like(x, 1e-3) for x in (*self.context, self.qb)]

    def arrays(self) -> list[np.ndarray]:
        return [*self.context, self.qb]

    def vector(self, places: tuple) -> np.ndarray:
        """The predicted vectors, with a 1 for the biases."""
        out = np.empty((len(places[0]), self.qb.shape[1]), np.float32)
        out[:, :-1] = self.context[0][places[0]]
        for x, at in zip(self.context[1:], places[1:]):
            out[:, :-1] += x[at]
        out[:, -1] = 1
        return out

    def step(self, places: tuple, to: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One step of noise-contrastive estimation; the batch shares NOISE draws."""
        n, base = len(to), math.log(NOISE)
        drawn = np.minimum(np.searchsorted(self.cum, rng.random(NOISE) * self.cum[-1]), len(self.noise) - 1).astype(to.dtype)
        r = self.vector(places)
        q_to, q_drawn = self.qb[to], self.qb[drawn]
        own = np.einsum("ij,ij->i", r, q_to) - self.log_noise[to] - base
        other = r @ q_drawn.T - (self.log_noise[drawn] + base)
        g_own = 1 / (1 + np.exp(own))  # ascent: 1 - sigmoid
        g_other = np.exp(np.negative(other, out=other), out=other)
        g_other += 1
        np.divide(-1, g_other, out=g_other)
        g_r = g_own[:, None] * q_to[:, :-1] + g_other @ q_drawn[:, :-1]
        pulls = np.concatenate((g_own[:, None] * r, g_other.T @ r))
        changes = [(x, s, at, g_r) for x, s, at in zip(self.context, self.sums, places)]
        for x, s, at, g in [*changes, (self.qb, self.sums[-1], np.concatenate((to, drawn)), pulls)]:
            rows, g = _summed(at, g)
            g /= n
            s[rows] += g * g
            x[rows] += rate * g / np.sqrt(s[rows])


class LogBilinear:
    """The units' layer (contexts: the two units before) and the entries' (context: the unit before)."""

    def __init__(self, noise: np.ndarray, noise2: np.ndarray | None = None, seed: int = 5) -> None:
        self.rng = np.random.default_rng(seed)
        self.units = Layer(noise, 2, DIM, self.rng)
        self.entries = Layer(np.full(ENTRIES, 1 / ENTRIES) if noise2 is None else noise2, 1, DIM2, self.rng)

    a1 = property(lambda self: self.units.context[0])
    a2 = property(lambda self: self.units.context[1])
    q = property(lambda self: self.units.qb[:, :-1])
    b = property(lambda self: self.units.qb[:, -1])

    def params(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.units.arrays(), *self.entries.arrays())])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.units.arrays(), *self.entries.arrays()):
            x[:] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def step(self, one: np.ndarray, two: np.ndarray, to: np.ndarray, entry: np.ndarray, rate: float = RATE) -> None:
        """A batch's step: units of the tokens and of the two before, and entries (-1: none)."""
        self.units.step((one, two), to, self.rng, rate)
        own = np.flatnonzero(entry >= 0)
        if len(own):
            self.entries.step((one[own],), entry[own], self.rng, rate)

    def log_z(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Logarithms of the units' normalisers, by matrix products over all units."""
        out = np.empty(len(one), np.float32)
        for a in range(0, len(one), 4096):
            s = self.units.vector((one[a : a + 4096], two[a : a + 4096])) @ self.units.qb.T
            most = s.max(1)
            out[a : a + 4096] = most + np.log(np.exp(s - most[:, None]).sum(1))
        return out

    def log_z2(self, unit_of: np.ndarray, real: np.ndarray) -> np.ndarray:
        """(UNITS, TAIL): of each unit before and tail unit, the normaliser over the tail unit's entries."""
        own = real[np.argsort(unit_of[real], kind="stable")]
        first = np.searchsorted(unit_of[own], np.arange(TOP, UNITS))
        s = self.entries.vector((np.arange(UNITS),)) @ self.entries.qb[own].T
        most = s.max(1, keepdims=True)
        # Every tail unit has the entry of its other words, so no stretch is empty.
        return most + np.log(np.add.reduceat(np.exp(s - most), first, axis=1))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values one after another, and where each list begins (with the end)."""
    starts = column.offsets.to_numpy()
    return column.flatten().to_numpy(), starts - starts[0]


class Coding:
    """doc_id, learn, part and texts to the columns of `coded`, TEXTS texts at a time."""

    SCHEMA = "doc_id long, learn boolean, part int, n_tokens long, codes array<int>, tail array<struct<h:long,tf:long>>"
    TEXTS = 2000

    def __init__(self, voc: Vocabulary) -> None:
        self.coder = resident(voc.id, lambda: Coder(voc))

    def __call__(self, ids: pa.Array, learn: pa.Array, part: pa.Array, texts: pa.Array) -> list:
        parts = [self._some(texts[a : a + self.TEXTS].to_pylist()) for a in range(0, len(texts), self.TEXTS)]
        return [ids, learn, part, np.concatenate([x[0] for x in parts]), *(pa.concat_arrays([x[k] for x in parts]) for k in (1, 2))]

    def _some(self, texts: list) -> tuple[np.ndarray, pa.Array, pa.Array]:
        codes, starts, h = self.coder(texts)
        n = len(starts) - 1
        at = np.flatnonzero(h)
        doc = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((h[at], doc))
        doc, h = doc[order], h[at][order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(doc) else np.zeros(0, np.int64)
        tf = np.diff(np.concatenate((new, [len(doc)])))
        struct = pa.StructArray.from_arrays([pa.array(h[new], pa.int64()), pa.array(tf, pa.int64())], names=["h", "tf"])
        return np.diff(starts), _list(starts, pa.array(codes, pa.int32())), _list(np.searchsorted(doc[new], np.arange(n + 1)), struct)


def _list(starts: np.ndarray, values: pa.Array) -> pa.Array:
    field = pa.field("element", values.type)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values, type=pa.list_(field))


class Training:
    """Trains on a task's codes; flush gives its parameters and tokens, CHUNK parameters a row."""

    def __init__(self, voc: Vocabulary, flat: np.ndarray | None) -> None:
        self.voc, self.model, self.seen = voc, LogBilinear(voc.noise, voc.noise2), 0
        if flat is not None:
            self.model.load(flat)

    def __call__(self, codes: pa.Array) -> list[list]:
        codes, starts = _flat(codes)
        units, entries = self.voc.units[codes], self.voc.entries[codes]
        one, two = contexts(units, starts[:-1])
        order = self.model.rng.permutation(len(units))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            self.model.step(one[at], two[at], units[at], entries[at])
        self.seen += len(units)
        return [[], [], []]

    def flush(self) -> list[list]:
        if not self.seen:
            return [[], [], []]
        x = self.model.params()
        parts = [x[a : a + CHUNK].astype(np.float32).tobytes() for a in range(0, len(x), CHUNK)]
        return [list(range(len(parts))), [self.seen] * len(parts), parts]


class Averaging:
    """The weighted mean of each chunk's rows; all rows of a chunk are in one task, one at a time."""

    def __init__(self) -> None:
        self.sums: dict[int, list] = {}

    def __call__(self, chunks: list, seen: list, parts: list) -> list[list]:
        for k, n, x in zip(chunks, seen, parts):
            got = self.sums.setdefault(k, [0, 0.0])
            got[0] += n
            got[1] = got[1] + n * np.frombuffer(x, np.float32).astype(np.float64)
        return [[], []]

    def flush(self) -> list[list]:
        return [list(self.sums), [(x / n).astype(np.float32).tobytes() for n, x in self.sums.values()]]


class Scoring:
    def __init__(self, voc: Vocabulary, flat: np.ndarray | None) -> None:
        self.voc, self.model = voc, LogBilinear(voc.noise, voc.noise2)
        if flat is not None:
            self.model.load(flat)
        self.z = np.full(UNITS * UNITS, np.nan, np.float32)
        real = np.concatenate((np.arange(voc.n_entries), np.arange(WORDS, ENTRIES)))
        self.z2 = self.model.log_z2(voc.unit_of, real)

    def __call__(self, codes: pa.Array) -> list[np.ndarray]:
        """Known tokens, base score and score of each list of codes."""
        voc, m, n_head = self.voc, self.model, len(self.voc.h)
        codes, starts = _flat(codes)
        units, entries = voc.units[codes], voc.entries[codes]
        one, two = contexts(units, starts[:-1])
        pair = one.astype(np.int32) * UNITS + two
        new = np.unique(pair[np.isnan(self.z[pair])])
        self.z[new] = m.log_z(new // UNITS, new % UNITS)
        out = np.empty(len(codes), np.float64)
        for a in range(0, len(codes), 65_536):
            s = slice(a, a + 65_536)
            out[s] = np.einsum("ij,ij->i", m.units.vector((one[s], two[s])), m.units.qb[units[s]]) - self.z[pair[s]]
            at = a + np.flatnonzero(entries[s] >= 0)
            out[at] += np.einsum("ij,ij->i", m.entries.vector((one[at],)), m.entries.qb[entries[at]]) - self.z2[one[at], units[at] - TOP]
        model = out / math.log(10) + voc.share[codes]
        base = voc.log_c[codes] - voc.log_total
        known = (codes < n_head) | ((codes == n_head + UNITS) & (voc.n_end > 0))
        return [np.add.reduceat(x, starts[:-1]) if len(codes) else x for x in (known.astype(np.int64), base, model)]


def count(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Vocabulary, and the table of all counts (h, c), from docs(text)."""
    partial = arrow_map(docs.select("text"), Counting, "h long, unit int, c long", raw=True)
    counts = saved(partial.groupBy("h").agg(F.min("unit").alias("unit"), F.sum("c").alias("c")))
    n_docs = docs.count()
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    n, v = n + n_docs, v + (n_docs > 0)
    sums = {r[0]: (int(r[1]), int(r[2])) for r in counts.groupBy("unit").agg(F.sum("c"), F.count(F.lit(1))).collect()}
    head = counts.filter(F.col("c") >= math.ceil(max(n, 1) / HEAD)).toArrow()  # at most HEAD rows
    col = lambda k: head.column(k).to_numpy().astype(np.int64)
    return Vocabulary(col("h"), col("c"), col("unit"), n, v, sums, n_docs), counts


def coded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """docs(doc_id, text, learn) in codes, written to the shared folder, with a row number."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    rows = docs.select("doc_id", "learn", F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(ROUNDS)).cast("int").alias("part"), "text")
    return saved(arrow_map(rows, lambda: Coding(shared.value), Coding.SCHEMA, voc.id, raw=True).withColumn("rid", F.monotonically_increasing_id()))


def train(codes: DataFrame, voc: Vocabulary) -> np.ndarray | None:
    """The parameters after ROUNDS rounds over the coded documents that may be learnt from."""
    spark, flat = codes.sparkSession, None
    for i in range(ROUNDS):
        shared = spark.sparkContext.broadcast((voc, flat))
        own = codes.filter(F.col("learn") & (F.col("part") == i)).select("codes")
        trained = arrow_map(own, lambda: Training(*shared.value), "chunk int, seen long, params binary", raw=True)  # noqa: B023
        mean = arrow_map(trained.repartition(partitions(spark), "chunk"), Averaging, "chunk int, params binary").toArrow()
        got = sorted(zip(mean.column("chunk").to_pylist(), mean.column("params").to_pylist()))
        flat = np.frombuffer(b"".join(x for _, x in got), np.float32) if got else flat
    return flat


def score(codes: DataFrame, voc: Vocabulary, flat: np.ndarray | None, counts: DataFrame) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, base_score and score (log10) of every coded document."""
    shared = codes.sparkSession.sparkContext.broadcast((voc, flat))

    def make():
        s = Scoring(*shared.value)
        return lambda ids, learn, n, rid, own: [ids, learn, n, rid, *s(own)]

    part = arrow_map(codes.select("doc_id", "learn", "n_tokens", "rid", "codes"), make, "doc_id long, learn boolean, n_tokens long, rid long, known long, base double, model double", raw=True)
    log_c = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    tail = (
        codes.select("rid", F.explode("tail").alias("t")).select("rid", "t.*").join(counts.select("h", "c"), "h", "left")
        .groupBy("rid").agg(F.sum(log_c).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("also"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return part.join(tail, "rid", "left").select(
        "doc_id", "learn", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")
    )


def lm_digest(docs: DataFrame) -> DataFrame:
    told = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) != 0).alias("learn"))
    voc, counts = count(told.filter("learn"))
    codes = coded(told, voc)
    got = score(codes, voc, train(codes, voc), counts)
    return got.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(voc.n).cast("long").alias("train_tokens"), "base_score", "score")
