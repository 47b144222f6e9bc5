"""Secret scan: fixed patterns, and guess costs of values in credential contexts.

The base patterns (assign, access, hex) are matched on whole texts.  The method looks at values that
stand in a wider credential context (`client_secret = v`, `Authorization: Bearer v`, `pwd: v`, `//user:v@` ...): in quotes
all of them, blanks included, else up to white space, letters of all scripts included.  It
finds the cheapest way for an attacker to guess them: a dynamic programme over all segmentations into
dictionary words, dates, repeats, keyboard walks or sequences, and brute-force spans.  Values that
cost at least 10**min_log10 guesses and lie in no base span give spans of kind `guess`; a value that a base
span covers only in part is costed whole, and its span overlaps the base span.

The dictionary holds frequent password parts and then the whole words of a public vocabulary (a file, see
common.env_path), commonest first: a word's place is what it costs to guess.  A stretch of one character, a
walk, or a repetition of the two to four characters before it counts from where it begins.

Edge cases: null texts count as empty and have no spans; very long texts and values are taken whole,
the programme being linear in the value's length; repeated rows give repeated results; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, env_path, ship

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT = re.compile(
    r"""(?ai:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(bearer)|(?:api|access|private|secret|client|encryption|signing)[_-]?(?:key|secret|token)))["'`]?(?:[\x20\t]*(?::=|=>|[:=])[\x20\t]*|(?(1)[\x20\t]+|(?!)))(?ai:(?:bearer|basic)[\x20\t]+)?"""
)
URL = re.compile(r"//[^\s/:@]*:([^\s/@]+)@")
PLAIN = re.compile(r"\S*")
QUOTES, LONGEST_QUOTED = "\"'`", 256
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "guess")

# Frequent password parts, commonest first.
WORDS = (
    "password 123456 qwerty letmein welcome admin login user root guest test demo changeme secret default master "
    "monkey dragon football baseball iloveyou sunshine princess shadow superman batman trustno1 hello freedom whatever "
    "server database backup oracle mysql postgres apache tomcat system manager public private service account access "
    "summer winter spring autumn monday friday january february march april june july august september october november "
    "december love money happy lucky summer star blue red green black white gold silver tiger lion eagle computer internet "
    "company office home family mother father john michael david robert daniel thomas james maria anna the and for you pass "
    "word token example sample placeholder your none null true false string value insert here todo"
).split()
# Rows of a keyboard and other sequences that walks follow.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
LONGEST_WORD = 32
VOCABULARY = "word_bpe_49k.json"


def _neighbours() -> set[str]:
    pairs = {x[i : i + 2] for x in WALKS for i in range(len(x) - 1)}
    return pairs | {p[::-1] for p in pairs}


NEXT = _neighbours()


@cache
def dictionary(path: str | None = None) -> dict[str, int]:
    """Words in lower case with their places: frequent password parts, then a vocabulary's whole words in the order of its ids."""
    with open(path or env_path(VOCABULARY), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = (t[:-4] for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    ranked = dict.fromkeys([*WORDS, *(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())])
    return {w: i for i, w in enumerate(ranked, 1)}


def guess_cost(value: str, words: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs.

    Each segment costs the logarithm of its own guesses, plus log10(2) for the choice of its kind.
    """
    words = dictionary() if words is None else words
    low = value.lower()
    plain = low.translate(LEET)
    n, best = len(value), [0.0] + [math.inf] * len(value)
    switch = math.log10(2)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    run = walk = 0  # where the run of one character, and the walk, that hold character j - 1 begin
    period = {p: 0 for p in (2, 3, 4)}  # length of the stretch that repeats with period p
    force = [(0.0, "")] * (n + 1)  # brute force: cost of the cheapest span that ends here
    for j in range(1, n + 1):
        c = value[j - 1]
        size = 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33
        grown = force[j - 1][0] if j > 1 else math.inf
        force[j] = (min(best[j - 1] + switch, grown) + math.log10(size), "")
        cost = force[j][0]
        if j > 1:
            run = run if value[j - 2] == c else j - 1
            walk = walk if low[j - 2 : j] in NEXT else j - 1
        if j - run >= 3:
            cost = min(cost, best[run] + switch + math.log10(size * (j - run)))
        if j - walk >= 3:
            cost = min(cost, best[walk] + switch + math.log10(2 * sum(map(len, WALKS)) * (j - walk)))
        for p in period:
            period[p] = period[p] + 1 if j > p and value[j - 1 - p] == c else 0
            if period[p] >= p:
                k = j - period[p] - p
                cost = min(cost, best[k + p] + switch + math.log10(2 + period[p] // p))
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + switch + (4.6 if j - i > 4 else 2.1))
        for i in range(max(0, j - LONGEST_WORD), j - 2):
            r = words.get(low[i:j]) or words.get(plain[i:j])
            if r:
                upper = value[i:j] != low[i:j]
                leet = low[i:j] not in words
                cost = min(cost, best[i] + switch + math.log10(r * (1 + upper) * (1 + leet)))
        best[j] = cost
    return best[n]


def value_at(text: str, at: int) -> tuple[int, int]:
    """Where the value that begins at a place begins and ends: in quotes all up to the same quote on that line, unless it is
    behind a backslash; else, or if the quote is never closed, all up to white space, without punctuation at its end."""
    quote = text[at : at + 1]
    if quote and quote in QUOTES:
        at += 1
        for end in range(at, min(len(text), at + LONGEST_QUOTED)):
            if text[end] == "\n":
                break
            if text[end] == quote and (len(text[at:end]) - len(text[at:end].rstrip("\\"))) % 2 == 0:
                return at, end
    value = PLAIN.match(text, at)[0]
    return at, at + len(value.rstrip(".,;:)]}\"'`"))


def _values(text: str, low: str):
    """(start, end) of the values in credential contexts and of passwords in addresses; a value may be the next one's context."""
    if "//" in text:
        yield from (m.span(1) for m in URL.finditer(text))
    begin = 0
    if any(h in low for h in CONTEXT_HINTS):
        while m := CONTEXT.search(text, begin):
            a, b = value_at(text, m.end())
            begin = m.end() if b - a < LEAST_VALUE or CONTEXT.match(text, a) else max(b, m.end())
            yield a, b


def spans_of(text: str, min_log10: float, words: dict[str, int]) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, sorted."""
    out, low = [], text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, at, reach = sorted((a, b) for a, _, b in out), 0, -1
    for a, b in sorted(set(_values(text, low))):
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][1])
            at += 1
        if reach < b and b - a >= LEAST_VALUE and guess_cost(text[a:b], words) >= min_log10:
            out.append((a, 3, b))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _shared(docs: DataFrame, path: str | None, extra_words: tuple[str, ...] = ()):
    """The dictionary as a broadcast: its size is the vocabulary file's."""
    words = dict(dictionary(path))
    for w in extra_words:
        words.setdefault(w.lower(), len(words) + 1)
    return docs.sparkSession.sparkContext.broadcast(words)


def secret_spans(docs: DataFrame, min_log10: float = 8.0, extra_words: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Every row of docs(doc_id, text) with its spans: arrays of kind, start and end (code points)."""
    shared = _shared(docs, path, extra_words)

    def make():
        words = shared.value

        def run(ids, texts):
            found = [spans_of(t or "", min_log10, words) for t in texts]
            return [ids, [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in found]]

        return run

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from secret_spans by DataFrame functions."""
    text = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(docs).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(lambda s: s["kind"] != "guess"), 256).alias("base_sha256"),
        text(lambda s: F.lit(True)).alias("spans"), count("guess").alias("n_guess"),
    )


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with every span of its text replaced by `[secret]`; all other columns stay."""
    shared = _shared(docs, path)

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, shared.value) for t in texts], dtype=object)

    ship(docs.sparkSession)
    return docs.withColumn("text", hide("text"))


def redacted(text: str | None, words: dict[str, int] | None = None, min_log10: float = 8.0) -> str | None:
    """A text with `[secret]` in the place of each run of overlapping spans."""
    if text is None:
        return None
    out, done = [], 0
    for a, _, b in spans_of(text, min_log10, dictionary() if words is None else words):
        if b > done:
            out += [text[done:a], "[secret]"] if a >= done else []
            done = b
    return "".join([*out, text[done:]]) if out else text
