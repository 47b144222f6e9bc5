"""BPE by an automaton over tokens.

compile starts from one state in which every base symbol may follow, and applies the merges in order.  The
gadget for a merge u, v -> w: the state p that u leads to is copied without its arc on v, u leads to the
copy from now on, and w leads where v led; a state has the arc w if it has the arc u.  Every gadget's state
is kept with the one arc that its row lacks; a row's other entries are those of the state copied, so the
49,000 rows by as many tokens take a few numbers each instead of 2.4 thousand million entries, and are
entered into the transition table when a walk first asks for them.  A token sequence is accepted exactly if
byte-pair encoding yields it, and each word has one accepted spelling, so a word is encoded by a walk
through the table.  Decoding emits the labels of the arcs.

Edge cases: null texts count as empty and have no tokens (their decoded text is empty); texts are
taken whole, and a dead-end table keeps the walk linear on very long words; repeated rows give
repeated results; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, env_path, give_back, resident

END = ""  # stands for the end-of-word suffix, as one character
SUFFIX = "</w>"
# The vocabulary's white space.
SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE = 100_000  # words a worker remembers, twice
PART = 1 << 20  # bytes of texts that are encoded at once
AHEAD = 6  # letters by which it remembers the tokens that match


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Automaton:
    """The automaton's states, and its arcs as rows that share what they have in common.

    lead: of each token the state that it leads to.  A state other than the first is a copy that has not the
    arc of one token; owner is the token that it was made for (which led to the state copied until then), made
    the merge's number.  Of each token, born is the merge that made it (-1: a base symbol), like its first
    part, whose arcs the token's own are added to, and tail its second part, whose state it leads to at first.
    cut: by owner and token the merge whose copy lost the arc, which all later copies lack too.
    table: the rows' entries that a walk has asked for, by (state, token): -1 for no arc, else the next state.
    """

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        n = max(vocab.values()) + 1
        self.lead, self.born, self.like, self.tail = (array("i", [x] * n) for x in (0, -1, -1, -1))
        self.owner, self.made = array("i", [-1]), array("i", [-1])
        self.cut: dict[int, int] = {}
        self.table: dict[int, int] = {}
        pairs = [pair if isinstance(pair, (list, tuple)) else pair.split(" ") for pair in merges]
        made = {vocab[a + b] for a, b in pairs}
        there = lambda t: self.born[t] >= 0 or t not in made  # noqa: E731  (a base symbol, or merged already)
        for number, (a, b) in enumerate(pairs):
            if there(vocab[a]) and there(vocab[b]):
                self._merge(number, vocab[a], vocab[b], vocab[a + b])
        self.ids = {self._spelled(t): i for t, i in vocab.items() if there(i)}
        self.labels = [""] * n
        for t, i in vocab.items():
            self.labels[i] = t
        self.trie: dict | None = None

    def _merge(self, number: int, u: int, v: int, w: int) -> None:
        """The gadget of the merge u v -> w; none if w is there already, or if v never follows u."""
        if self.born[w] >= 0 or not self.arc(self.lead[u], v):
            return
        self.born[w], self.like[w], self.tail[w] = number, u, v
        self.lead[w] = self.lead[v]
        self.lead[u] = len(self.owner)  # the copy without the arc on v
        self.owner.append(u)
        self.made.append(number)
        self.cut[u << 20 | v] = number

    @staticmethod
    def _spelled(token: str) -> str:
        return token[: -len(SUFFIX)] + END if token.endswith(SUFFIX) else token

    def arc(self, state: int, token: int) -> bool:
        """Whether a state's row has an arc on a token.

        The row is copied from the owner's earlier states, and before the owner was born from its second
        part's; an arc that was lost on this way is missing.  A token's arc goes where its first part's is when
        the token is born, so it is missing too where that one was lost until then.
        """
        cut, born, like, tail = self.cut, self.born, self.like, self.tail
        x, until = self.owner[state], self.made[state]
        while x >= 0:
            y, before = token, 1 << 30
            while y >= 0:
                lost = cut.get(x << 20 | y)
                if lost is not None and lost <= until and lost <= before:
                    return False
                y, before = like[y], born[y]
            x, until = tail[x], born[x] - 1
        return True

    def enter(self, state: int, token: int) -> int:
        """The table's entry for a state and a token."""
        if len(self.table) > 400_000:
            self.table.clear()
        got = self.table[state << 20 | token] = self.lead[token] if self.arc(state, token) else -1
        return got

    def _matches(self, word: str, at: int) -> tuple:
        """(length, token) of the tokens that spell what stands at a place, longest first.

        What the next AHEAD letters decide is remembered; only where a longer token may follow is the
        trie walked on.
        """
        key = word[at : at + AHEAD]
        got = self.near.get(key)
        if got is None:
            if len(self.near) > 60_000:
                self.near.clear()
            got = self.near[key] = self._walk(key, 0)
        if got[1] and len(key) == AHEAD:
            return self._walk(word, at)[0]
        return got[0]

    def _walk(self, word: str, at: int) -> tuple[tuple, bool]:
        node, out = self.trie, []
        for end in range(at, len(word)):
            node = node.get(word[end])
            if node is None:
                break
            t = node.get("")
            if t is not None:
                out.append((end + 1 - at, t))
        return tuple(reversed(out)), node is not None and len(node) > ("" in node)

    def _grow(self) -> None:
        self.trie, self.near = {}, {}
        for token, i in self.ids.items():
            node = self.trie
            for c in token:
                node = node.setdefault(c, {})
            node[""] = i

    def encode(self, word: str) -> list[int]:
        """Ids of a word spelled in byte letters, with END as its last character.

        Depth first, longest arcs first; (place, state) pairs from which no walk ends are remembered.
        """
        if self.trie is None:
            self._grow()
        entry, enter, n = self.table.get, self.enter, len(word)
        path: list[int] = []
        at, state, options = 0, 0, iter(self._matches(word, 0))
        stack: list[tuple] = []
        dead: set[tuple[int, int]] = set()
        while at < n:
            for size, t in options:
                to = entry(state << 20 | t)
                if to is None:
                    to = enter(state, t)
                if to >= 0 and not (dead and (at + size, to) in dead):
                    stack.append((at, state, options))
                    path.append(t)
                    at, state = at + size, to
                    options = iter(self._matches(word, at))
                    break
            else:
                if not stack:
                    raise ValueError("no accepted spelling")
                dead.add((at, state))
                at, state, options = stack.pop()
                path.pop()
        return path


def ranges(codes: list[int]) -> str:
    """A regular expression's class, without brackets, of sorted code points."""
    out, begin = [], None
    for i, c in enumerate(codes):
        begin = c if begin is None else begin
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{begin:08x}-\\U{c:08x}")
            begin = None
    return "".join(out)


def word_patterns() -> tuple[str, str]:
    """The vocabulary's pattern of words with its classes written out: for texts of the basic plane
    alone, whose classes are looked up in one step, and for all texts.

    Letters and numbers are those of the tokenizers library's own Unicode tables, which are the vocabulary's.
    """
    from tokenizers import Regex, pre_tokenizers

    span = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, kinds = "".join(map(chr, span)), {}
    for k in "LN":
        is_k = pre_tokenizers.Split(Regex(rf"\p{{{k}}}+"), behavior="removed")
        rest = {i for _, (a, b) in is_k.pre_tokenize_str(text) for i in range(a, b)}
        kinds[k] = [c for i, c in enumerate(span) if i not in rest]
    out = []
    for most in (0xFFFF, 0x10FFFF):
        letters, numbers = (ranges([c for c in kinds[k] if c <= most]) for k in "LN")
        out.append(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{ranges(SPACE)}{letters}{numbers}]+")
    return out[0], out[1]


def unlike(normalize) -> str:
    """The code points that Python's composition and lower case treat otherwise than a vocabulary's normalizer, whose
    Unicode tables are of another version.

    Those of the first three planes are tried (the others hold neither marks nor letters with case), each behind a letter
    and around a mark.  Marks are tried before and behind one of every combining class, since an order that differs shows
    in one of them; what Python does not know is tried with the first class and the last.
    """
    every = [chr(c) for c in range(2, 0x30000) if not 0xD800 <= c < 0xE000 and c not in SPACE]  # white space ends words either way
    first: dict[int, str] = {}
    for c in every:
        first.setdefault(unicodedata.combining(c), c)
    del first[0]
    least, most = first[min(first)], first[max(first)]
    marks = [c for c in every if unicodedata.category(c).startswith("M")]
    new = [c for c in every if unicodedata.category(c) == "Cn"]
    shapes = [(every, lambda c: f"a{c}\u0301B\u0301{c}"), (new, lambda c: f"a{most}{c} a{c}{least}")]
    shapes += [(marks, lambda c, m=m: f"a{c}{m} a{m}{c}") for m in first.values()]
    out: set[str] = set()
    for span, shape in shapes:
        for at in range(0, len(span), 20_000):
            own = list(map(shape, span[at : at + 20_000]))
            text = "\1".join(own)
            if _normal(text) != (told := normalize(text)):
                out |= {c for c, mine, theirs in zip(span[at : at + 20_000], own, told.split("\1")) if _normal(mine) != theirs}
    return "".join(sorted(out))


def _normal(text: str) -> str:
    """Composed and in lower case; a capital sigma has no final form."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


_MADE: dict[str, tuple] = {}


def load(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton and the special tokens of a vocabulary file (on the driver, once a context; kept only until they are broadcast)."""
    if path not in _MADE:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        automaton = Automaton(spec["model"]["vocab"], spec["model"]["merges"])
        for token, i in special.items():
            automaton.labels += [""] * (i + 1 - len(automaton.labels))
            automaton.labels[i] = token
        from tokenizers import Tokenizer

        normalizer = Tokenizer.from_file(path).normalizer
        _MADE[path] = automaton, special, word_patterns(), normalizer, unlike(normalizer.normalize_str)
    return _MADE[path]


LONGEST = 64  # letters of a word that is remembered


class Known(dict):
    """Ids of words; what is missing is worked out, and remembered unless it is long."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: str) -> bytes:
        got = self.make(word)
        if len(word) <= LONGEST:
            self[word] = got
        return got


class Encoder:
    """Texts to ids and back, with the ids of words that came before."""

    def __init__(self, automaton: Automaton, special: dict[str, int], patterns: tuple[str, str], normalizer, unlike: str) -> None:
        self.automaton, self.special = automaton, special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split
        self.basic, self.all = (re.compile(p).findall for p in patterns)
        self.beyond = re.compile('[\U00010000-\U0010ffff]').search
        self.letters = str.maketrans({i: c for i, c in enumerate(byte_letters())})
        self.known, self.before = Known(self.word), {}
        self.lead = os.path.commonprefix(list(special))
        self.normalize = normalizer.normalize_str
        self.seek = re.compile(f"[{ranges(sorted(map(ord, unlike)))}]").search if unlike else lambda part: None
        self.plain = min(unlike, default="\u0100") > "\xff"  # no letter of Latin-1 is odd

    def odd(self, part: str) -> bool:
        """Whether a text holds a code point that Python's tables have otherwise."""
        if self.plain:
            try:
                part.encode("latin-1")
                return False  # much faster than the search
            except UnicodeEncodeError:
                pass
        return self.seek(part) is not None

    def word(self, word: str) -> bytes:
        """The ids of a word that is not remembered, or was in the time before."""
        if (got := self.before.get(word)) is not None:
            return got
        spelled = word if word.isascii() and word.isalpha() else word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        ids = self.automaton.encode(spelled + END)
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs; this vocabulary's library joins them by spaces."""
        return " ".join(map(self.automaton.labels.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if len(self.known) >= CACHE:  # words that are not asked for in the next such time go
            self.known, self.before = Known(self.word), self.known
        out: list[bytes] = []
        ids_of = self.known.__getitem__
        for part in self.split(text) if self.special and self.lead in text else (text,):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
                continue
            part = self.normalize(part) if self.odd(part) else _normal(part)
            out += map(ids_of, (self.all if self.beyond(part) else self.basic)(part))
        return b"".join(out)


def _mapped(docs: DataFrame, cols: list[str], path: str | None, each, schema: str) -> DataFrame:
    path = path or env_path("word_bpe_49k.json")
    sc = docs.sparkSession.sparkContext
    if getattr(sc, "_weftgraph_bpe", (None,))[0] != path:  # about 6 MB, fixed by the vocabulary file
        sc._weftgraph_bpe = (path, sc.broadcast(load(path)))
        _MADE.pop(path, None)  # some 100 MB, which the driver does not need again
        give_back(None)
    shared = sc._weftgraph_bpe[1]

    def make():
        encoder = resident(path, lambda: Encoder(*shared.value))
        return lambda *lists: each(encoder, *lists)

    return arrow_map(docs.select(*cols), make, schema, path, most_bytes=PART)


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of every row of docs(doc_id, text)."""

    def each(encoder, ids, texts):
        got = [encoder(t or "") for t in texts]
        return [ids, [np.frombuffer(b, "<i4") for b in got], [encoder.decode(b) for b in got]]

    return _mapped(docs, ["doc_id", "text"], path, each, "doc_id long, ids array<int>, decoded string")


def bpe_append(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source and ids of every row of docs(doc_id, source, text)."""

    def each(encoder, ids, sources, texts):
        return [ids, sources, [np.frombuffer(encoder(t or ""), "<i4") for t in texts]]

    return _mapped(docs, ["doc_id", "source", "text"], path, each, "doc_id long, source string, ids array<int>")


def bpe_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: bpe_encode's output without moving the ids."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def each(encoder, ids, texts):
        got = [encoder(t or "") for t in texts]
        return [ids, [len(b) // 4 for b in got], [sha(b) for b in got], [sha(encoder.decode(b).encode("utf-8")) for b in got]]

    return _mapped(docs, ["doc_id", "text"], path, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
