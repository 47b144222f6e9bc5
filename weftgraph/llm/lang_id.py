"""Language identification by cross-parsing entropy.

Of every language a suffix automaton is built over a bounded sample of its labelled documents, taken
whole.  A text is parsed greedily into the longest phrases that the sample holds (Ziv-Merhav
cross-parsing).  Phrases are normalised by what a pointer into the sample costs, the logarithm of its
letters (a letter that the sample lacks costs the logarithm of all samples' letters); so they estimate the
text's cross entropy, and the language that needs the fewest wins, ties going to the first by code points.
Every letter of the samples has a code.  Automata are laid out as one transition table (where letters
times states pass DENSE entries, as sorted arcs instead) and walked by numpy, many stretches of text at
once.  Stretches are only a way to walk: each is parsed from the start at first; then, where the stretch
before it ends inside a phrase, again from that state until both walks stand in the same state at
the same letter, from where on they are one.  So the phrases are those of the whole text.

Bounds: n_docs documents a language are learnt from; the model is as large as these texts, at most
4 * DENSE bytes as a table or some 60 bytes a letter as arcs.

Edge cases: texts that are null or have no letter give `und` with score 0, as do all texts if nothing
is labelled; texts are taken whole; repeated rows give repeated results; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod

STRETCH, TOGETHER = 256, 2048  # letters of a stretch, stretches walked at once
DENSE = 1 << 25  # entries of a full transition table, four bytes each
SCHEMA = "doc_id long, lang_pred string, score double"


def sample(docs: DataFrame, n_docs: int) -> dict[str, list[str]]:
    """Texts to learn from: of every lang at most n_docs documents, the least by hash in as many
    classes of another hash."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(3), "doc_id", "text").alias("h"))
    own = own.withColumn("b", F.pmod(F.xxhash64(F.lit(5), "h"), F.lit(n_docs)))
    # n_docs numbers a language reach the join, and as many texts the driver.
    least = own.groupBy("lang", "b").agg(F.min("h").alias("h")).select("lang", "h")
    rows = own.join(F.broadcast(least), ["lang", "h"], "left_semi").select("lang", "h", "text").distinct().collect()
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        out.setdefault(lang, []).append(text)
    return out


class Letters:
    """Codes of letters: 0 any letter that no sample has, 1 all that is no letter, then the samples' letters."""

    def __init__(self, texts: list[str]) -> None:
        self.alphabet = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {"alphabet": self.alphabet, "_table": None}

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            # The least type that also holds the code of padding, which follows the letters'.
            self._table = np.array([0 if chr(c).isalpha() else 1 for c in range(0x110000)], np.min_scalar_type(len(self.alphabet) + 2))
            for i, c in enumerate(self.alphabet):
                self._table[ord(c)] = i + 2
        return self._table

    def codes(self, text: str) -> np.ndarray:
        """A text's letters, with one break where others stood between them."""
        x = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        is_break = x == 1
        keep = ~is_break
        keep[1:] |= is_break[1:] & ~is_break[:-1]
        x = x[keep]
        return x[(x[:1] == 1).sum() : len(x) - (x[-1:] == 1).sum()] if len(x) > 1 else x[x != 1]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    follow, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        if c == 0:  # no phrase runs on over a letter without a code
            last = 0
            continue
        p = last
        if c in follow[p]:  # after a break between texts the substring may be there already
            q = follow[p][c]
            if length[q] == length[p] + 1:
                last = q
                continue
            last = _clone(follow, link, length, p, c, q)
            continue
        last = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and c not in follow[p]:
            follow[p][c] = last
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            link[last] = q if length[q] == length[p] + 1 else _clone(follow, link, length, p, c, q)
    return follow


def _clone(follow: list, link: list, length: list, p: int, c: int, q: int) -> int:
    new = len(follow)
    follow.append(dict(follow[q]))
    link.append(link[q])
    length.append(length[p] + 1)
    link[q] = new
    while p >= 0 and follow[p].get(c) == q:
        follow[p][c] = new
        p = link[p]
    return new


class Model:
    """All languages' automata in one table, or as sorted arcs if the table would pass `dense` entries.

    An entry of the table holds the next state's row (times the row's width), shifted by two, and in its
    last bits how many phrases ended.  The last column stands for padding and leads nowhere.  An arc's
    key is state times width plus letter; what no arc holds begins anew from the language's start.
    """

    def __init__(self, texts: dict[str, list[str]], dense: int = DENSE) -> None:
        self.langs = sorted(texts)
        self.letters = Letters([t for lang in self.langs for t in texts[lang]])
        width = self.width = len(self.letters.alphabet) + 3
        codes = [[self.letters.codes(t).tolist() for t in texts[lang]] for lang in self.langs]
        size = np.array([sum(map(len, own)) for own in codes])
        #: What a phrase costs: the logarithm of the places in the sample that it may point at; `strange` for
        #: a letter that the sample lacks (`lacks`: which ones).
        self.price, self.strange = np.log2(2 + size), float(np.log2(2 + size.sum()))
        self.lacks = np.ones((len(codes), width), bool)
        self.lacks[:, -1] = False
        for i, own in enumerate(codes):
            self.lacks[i, list({c for t in own for c in t} - {0})] = False
        automata = [suffix_automaton([c for t in own for c in (*t, 0)]) for own in codes]
        first = np.cumsum([0, *map(len, automata)])
        self.full = int(first[-1]) * width <= min(dense, 1 << 29)  # entries are shifted by two bits in 32
        self.kind = np.int32 if self.full or first[-1] < 1 << 31 else np.int64
        self.roots = (first[:-1] * (width if self.full else 1)).tolist()
        if self.full:
            self.table = np.concatenate([self._rows(f, o) for f, o in zip(automata, first.tolist())]).ravel() if automata else np.zeros(0, np.int32)
            return
        self.keys = np.array([(s + o) * width + c for f, o in zip(automata, first.tolist()) for s, arcs in enumerate(f) for c in sorted(arcs)], np.int64)
        self.ends = np.array([arcs[c] + o for f, o in zip(automata, first.tolist()) for arcs in f for c in sorted(arcs)], self.kind)
        self.anew = np.repeat(np.array(self.roots, self.kind)[:, None], width, axis=1)  # where a phrase that begins with the letter stands
        self.alone = np.ones((len(self.langs), width), np.int8)
        for i, f in enumerate(automata):
            self.anew[i, list(f[0])] = first[i] + np.array(list(f[0].values()))
            self.alone[i, list(f[0])] = 0

    def _rows(self, follow: list[dict[int, int]], offset: int) -> np.ndarray:
        """One automaton's rows of the table."""
        width = self.width
        to = np.full((len(follow), width), -1, np.int64)
        for s, arcs in enumerate(follow):
            to[s, list(arcs)] = list(arcs.values())
        # A phrase that ends before a letter begins anew with it; a letter that no sample has is
        # a phrase of its own, after which the walk stands at the start.
        alone = to[0] < 0
        ended = np.where(to < 0, 1 + alone, 0)
        ended[0] = alone
        to = np.where(to < 0, np.maximum(to[0], 0)[None, :], to)
        to[:, -1], ended[:, -1] = np.arange(len(follow)), 0
        return ((to + offset) * width * 4 + ended).astype(np.int32)

    def _step(self, state: np.ndarray, c: np.ndarray, lang: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and ended phrases, for walks' next letters, languages and starts."""
        if self.full:
            got = self.table[state + c]
            return got >> 2, got & 3
        key = state * np.int64(self.width) + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        miss = self.keys[at] != key
        pad = c == self.width - 1
        to = np.where(pad, state, np.where(miss, self.anew[lang, c], self.ends[at]))
        return to, np.where(miss & ~pad, (state != roots) + self.alone[lang, c], 0)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) phrases, and each text's letters."""
        codes = [self.letters.codes(t) for t in texts]
        letters = np.array([len(c) for c in codes], np.int64)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not self.langs or not letters.any():
            return out, letters
        pieces = -(-letters // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        opens = np.concatenate(([True], owner[1:] != owner[:-1]))  # the stretches that begin a text
        cells = np.full(len(owner) * STRETCH, self.width - 1, self.letters.table.dtype)
        begin = np.concatenate(([0], np.cumsum(pieces)))[:-1] * STRETCH
        for a, c in zip(begin.tolist(), codes):
            cells[a : a + len(c)] = c
        cells = cells.reshape(-1, STRETCH)
        roots = np.array(self.roots, self.kind)
        carry = roots.copy()  # where each language's walk stands before the next stretch
        for a in range(0, len(cells), TOGETHER):
            b = min(a + TOGETHER, len(cells))
            count, end = self._walk(np.ascontiguousarray(cells[a:b].T), opens[a:b], carry)
            closes = np.concatenate((opens[a + 1 : b], opens[b : b + 1] if b < len(opens) else [True]))
            count += closes & (end != roots[:, None])  # the phrase that a text ends in
            for i in range(len(self.langs)):
                out[:, i] += np.bincount(owner[a:b], weights=count[i], minlength=len(texts)).astype(np.int64)
            carry = end[:, -1]
        return out, letters

    def _walk(self, cells: np.ndarray, opens: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages, stretches) phrases ended in, and states after, consecutive stretches (cells: a column each)."""
        n, m = len(self.langs), cells.shape[1]
        lang = np.repeat(np.arange(n), m)
        roots = np.array(self.roots, self.kind)[lang]
        state = roots.copy()
        if not opens[0]:
            state[::m] = carry
        told = state.copy()  # the state that each stretch was walked from
        count = np.zeros(n * m, np.int16)
        states, counts = np.empty((STRETCH, n * m), self.kind), np.empty((STRETCH, n * m), np.int16)
        for t in range(STRETCH):
            state, ended = self._step(state, np.tile(cells[t].astype(self.kind), n), lang, roots)
            count = count + ended.astype(np.int16)
            states[t], counts[t] = state, count
        total, end = count.astype(np.int64), state.copy()
        follows = np.flatnonzero(~np.tile(opens, n) & (np.arange(n * m) % m > 0))
        while True:
            own = follows[told[follows] != end[follows - 1]]
            if not len(own):
                return total.reshape(n, m), end.reshape(n, m)
            state = told[own] = end[own - 1]
            count = np.zeros(len(own), np.int64)
            for t in range(STRETCH):
                state, ended = self._step(state, cells[t][own % m].astype(self.kind), lang[own], roots[own])
                count += ended
                met = state == states[t, own]  # from here on the first walk's phrases are this one's
                if met.any():
                    done = own[met]
                    total[done] = count[met] + counts[-1, done] - counts[t, done]
                    end[done] = states[-1, done]
                    own, state, count = own[~met], state[~met], count[~met]
                    if not len(own):
                        break
            total[own], end[own] = count, state

    def _normalised(self, texts: list[str], counts: np.ndarray) -> np.ndarray:
        alone = np.array([[int(lacks[c].sum()) for lacks in self.lacks] for c in map(self.letters.codes, texts)]).reshape(counts.shape)
        return (counts - alone) * self.price + alone * self.strange

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        texts = [t or "" for t in texts]
        counts, letters = self.phrases(texts)
        langs, scores = [], []
        for row, n in zip(self._normalised(texts, counts), letters.tolist()):
            if not n or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            rest = np.delete(row, best)
            langs.append(self.langs[best])
            scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
        return langs, scores


def train(docs: DataFrame, n_docs: int = 8) -> Model:
    """A model of docs(doc_id, text, lang), which should be the rows that may be learnt from."""
    return Model(sample(docs, n_docs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text).

    score: the share of normalised phrases that the best language saves against the second.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # see Bounds above

    def make():
        m = shared.value
        return lambda ids, texts: [ids, *m.predict(texts)]

    return arrow_map(docs.select("doc_id", "text"), make, SCHEMA)


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; all its columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def make():
        m, at = shared.value, names.index("text")
        return lambda *cols: [*cols, *m.predict(cols[at])]

    return arrow_map(docs, make, f"{kinds}, lang_pred string, score double")


def lang_digest(docs: DataFrame) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    got = identify(docs, train(docs.filter(~held_out)))
    return got.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
