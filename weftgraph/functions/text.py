"""Scalar text functions as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing about a prompt.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "can", "shall", "to", "of", "for",
    "in", "on", "at", "by", "with", "from", "and", "or", "but", "not",
    "no", "this", "that", "these", "those", "i", "you", "he", "she", "it",
    "we", "they", "my", "your", "his", "her", "its", "our", "their", "me",
    "him", "us", "them", "as", "if", "when", "where", "why", "how",
    "what", "which", "who", "whom", "so", "than", "then", "just",
)


def make_id(*parts: Column, most: int = 120) -> Column:
    """Parts joined by `_`, all but ASCII letters and digits as `_`, one trimmed at each end."""
    x = F.regexp_replace(F.concat_ws("_", *parts), "[^a-zA-Z0-9]+", "_")
    return F.substring(F.lower(F.regexp_replace(x, "^_|_$", "")), 1, most)


def bare_name(c: Column) -> Column:
    return F.trim(F.split(c, "[(<]")[0])


def dirname(c: Column) -> Column:
    return F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of the code points, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct runs of n words; fewer words are one run."""
    w = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[\s]+", " ")), " "), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def keywords(c: Column) -> Column:
    """Distinct words of three letters and more that are no stop words, in order."""
    w = F.split(F.lower(c), "[^a-z0-9_]+")
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS)))


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over UTF-16 code units (two for a letter beyond the basic plane)."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(....)"))
    step = lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(units, F.lit(2166136261).cast("long"), step)


#: A word boundary of ASCII letters, digits and underscore (Java's own also knows other letters).
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: Categories of personal data, in the order in which they are taken out.
PII = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("bearer", r"\b(?:Bearer|Token)\s+[A-Za-z0-9._\-+/=]{16,}\b"),
    ("eth-address", r"\b0x[a-fA-F0-9]{40}\b"),
    ("btc-address", r"\b(?:bc1[ac-hj-np-z02-9]{11,71}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"),
    ("ssn-like", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", r"\+?\b(?:\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("phone", r"\+\d{1,3}[-.\s]?\d{1,4}(?:[-.\s]?\d{1,4}){2,5}\b"),
    ("ipv4", r"\b(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)){3}(?:\/\d{1,2})?\b"),
    ("fs-path", r"(?:\/Users\/|\/home\/|[A-Z]:\\Users\\)[^\s\"'<>]+"),
    ("hostname", r"\b[a-zA-Z0-9-]{1,63}(?:\.[a-zA-Z0-9-]{1,63})*\.[a-zA-Z]{2,24}\b"),
)
#: What a text must hold for each of them to match: a plain search that spares most texts the pattern.
NEEDS = (
    "@[A-Za-z0-9.-]+[.][A-Za-z]{2}", "A[KS]IA[0-9A-Z]{16}", "eyJ[A-Za-z0-9_-]+[.]", r"(?:Bearer|Token)\s", "0x[a-fA-F0-9]{40}", "bc1[ac-hj-np-z02-9]{11}|[13][a-km-zA-HJ-NP-Z1-9]{25}", r"\d{3}-\d{2}-\d{4}",
    r"\d{3}[-.\s]?\d{4}", r"\+\d", r"\d[.]\d", r"/Users/|/home/|:\\Users", "[a-zA-Z0-9-][.][a-zA-Z]{2}",
)
TOKEN = r"[A-Za-z0-9_+/=-]{24,}"
CARD = r"\b(?:\d[ -]?){13,19}\b"
REDACTED = "[REDACTED]"


#: What `\s` means where the patterns come from; Java's own knows ASCII alone.
BLANK = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def java(pattern: str) -> str:
    """A pattern with ASCII word boundaries, and white space of all scripts, for Java's engine."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", BLANK), pattern.replace(r"\b", EDGE))
    return inside.replace(r"\s", f"[{BLANK}]")


def random_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: entropy(t) >= 4.0)


def cards(c: Column) -> Column:
    """Runs of digits, spaced or not, with a valid check digit."""
    return F.filter(F.regexp_extract_all(c, F.lit(java(CARD)), F.lit(0)), lambda t: F.call_function("luhn_check", F.regexp_replace(t, r"[^0-9]", "")))


def _passes() -> list[tuple[str, Callable[[Column], Column], Callable[[Column], Column]]]:
    """(category, whether it fires on a text, the text without it), in order."""
    out = []
    for (name, p), need in zip(PII, NEEDS):
        own, first = java(p), java(need)
        out.append((name, lambda c, own=own, first=first: c.rlike(first) & c.rlike(own), lambda c, own=own: F.regexp_replace(c, own, REDACTED)))
    for name, found, need in (("high-entropy-token", random_tokens, TOKEN), ("credit-card", cards, r"(?:\d[ -]?){13}")):
        fires = lambda c, found=found, need=need: c.rlike(need) & (F.size(found(c)) > 0)
        out.append((name, fires, lambda c, found=found: F.aggregate(found(c), c, lambda left, hit: F.replace(left, hit, F.lit(REDACTED)))))
    return out


CATEGORIES = [*dict.fromkeys(name for name, _ in PII), "high-entropy-token", "credit-card"]


def _in_order(fired: str) -> Column:
    return F.array_intersect(F.array(*map(F.lit, CATEGORIES)), fired)


def pii_strip(text: DataFrame, column: str = "text") -> DataFrame:
    """text with `redacted` and `categories` (those that fired, in order).  Each pass is a projection of its own, so
    no expression holds the others' twice over."""
    out = text.withColumns({"redacted": F.col(column), "_fired": F.array().cast("array<string>")})
    c = F.col("redacted")
    for name, fires, left in _passes():
        fired = F.when(fires(c), F.array_union("_fired", F.array(F.lit(name)))).otherwise(F.col("_fired"))
        out = out.withColumns({"_fired": fired, "redacted": F.when(fires(c), left(c)).otherwise(c)})
    return out.withColumn("categories", _in_order("_fired")).drop("_fired")


def pii_contains(c: Column) -> Column:
    """Whether a text holds personal data of any category (null: no)."""
    return F.coalesce(reduce(Column.__or__, (fires(c) for _, fires, _ in _passes())), F.lit(False))


def _strings(c: Column, kind: T.DataType) -> Column:
    """All strings of a nested value, but for map keys, in one array; nulls are left out."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), F.array(c)).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = [_strings(c[f.name], f.dataType) for f in kind.fields if _has_strings(f.dataType)]
    elif isinstance(kind, T.ArrayType):
        parts = [F.flatten(F.transform(c, lambda x: _strings(x, kind.elementType)))]
    else:
        parts = [F.flatten(F.transform(F.map_values(c), lambda x: _strings(x, kind.valueType)))]
    return F.coalesce(F.concat(*parts), none)


def _has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else kind
    return isinstance(inner, T.StringType) if inner is kind else _has_strings(inner)


def _replaced(c: Column, kind: T.DataType, by: Column) -> Column:
    """The nested value with other strings (a map) in place of its own, in the same shape."""
    if not _has_strings(kind):
        return c
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), by[c])
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_replaced(c[f.name], f.dataType, by).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _replaced(x, kind.elementType, by))
    return F.transform_values(c, lambda _, v: _replaced(v, kind.valueType, by))


def pii_strip_deep(df: DataFrame, *columns: str) -> DataFrame:
    """df with personal data taken out of every string in the columns, however deep in structs, arrays and maps (their keys
    stay), and `categories`, those that fired in any of them.

    Each row's distinct strings go through the passes together; the values are rebuilt from their schema.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    typed, none = [c for c, k in kinds.items() if _has_strings(k)], F.array().cast("array<string>")
    every = [_strings(F.col(c), kinds[c]) for c in typed]
    out = df.withColumns({"_before": F.array_distinct(F.concat(*every)) if every else none, "_fired": none}).withColumn("_after", F.col("_before"))
    for name, fires, left in _passes():
        # Functions of one parameter: a default would be taken for a second one of the array functions.
        fired = F.when(F.exists("_after", lambda x: fires(x)), F.array_union("_fired", F.array(F.lit(name)))).otherwise(F.col("_fired"))  # noqa: B023
        out = out.withColumns({"_fired": fired, "_after": F.transform("_after", lambda x: F.when(fires(x), left(x)).otherwise(x))})  # noqa: B023
    out = out.withColumn("_by", F.map_from_arrays("_before", "_after")).withColumns({c: _replaced(F.col(c), kinds[c], F.col("_by")) for c in typed})
    return out.withColumn("categories", _in_order("_fired")).drop("_fired", "_before", "_after", "_by")


def entropy(c: Column) -> Column:
    """Shannon entropy in bits for each character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    part = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda x: x == d)) / n)
    return F.aggregate(part, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def is_fix(subject: Column, body: Column) -> Column:
    """Commits that fix a bug: a fix prefix, or an issue-closing word in subject or body; no reverts, fixups, squashes."""
    s = F.trim(subject)
    closes = F.concat_ws("\n", s, F.coalesce(body, F.lit(""))).rlike(r"(?i)\b(fix(es|ed)?|close[sd]?|resolve[sd]?)\s+#[0-9]+")
    return (s.rlike(r"(?i)^(fix|bugfix|hotfix)(\([^)]+\))?!?:\s") | closes) & ~s.rlike(r"(?i)^(revert\b|(fixup|squash)!)")


def reverted_sha(body: Column) -> Column:
    """The commit that a body says it reverts, or an empty string."""
    return F.regexp_extract(body, r"(?i)This reverts commit\s+([0-9a-f]{7,40})", 1)


def is_revert(subject: Column, body: Column) -> Column:
    """A revert's subject or body; only those whose body names a commit can be paired."""
    return (F.trim(subject).rlike(r"(?i)^revert\b") | (reverted_sha(body) != "")) & (reverted_sha(body) != "")


def normalised(text: str) -> str:
    """For comparison alone: compatibility forms folded, lower case, no headers, no [labels], single spaces."""
    x = unicodedata.normalize("NFKC", text).lower()
    x = re.sub(r"(?m)^#+\s*", "", x)
    return re.sub(r"\s+", " ", re.sub(r"\[[^\]\n]*\]", " ", x)).strip()


def word_runs(text: str, n: int = 5) -> frozenset[str]:
    """Runs of n words of a normalised text; fewer words are one run."""
    w = text.split()
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def likeness(a: frozenset, b: frozenset) -> float:
    """Jaccard similarity: 1 if both are empty, 0 if one is."""
    return len(a & b) / len(a | b) if a or b else 1.0


def alike(a: frozenset, b: frozenset, least: float) -> bool:
    """likeness(a, b) >= least; sets of too different sizes are not compared."""
    return min(len(a), len(b)) / max(len(a), len(b), 1) >= least and likeness(a, b) >= least if a or b else least <= 1.0


class Runs:
    """Sets of runs, found again by the runs that they share."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.having: dict[str, list[int]] = {}

    def add(self, runs: frozenset) -> None:
        for x in runs:
            self.having.setdefault(x, []).append(len(self.sizes))
        self.sizes.append(len(runs))

    def holds(self, runs: frozenset, least: float) -> bool:
        """Whether one of the sets has a likeness of `least` (more than 0) or more with runs, which are not empty."""
        shared: dict[int, int] = {}
        for x in runs:
            for i in self.having.get(x, ()):
                shared[i] = shared.get(i, 0) + 1
        return any(n / (len(runs) + self.sizes[i] - n) >= least for i, n in shared.items())


def cut_units(text: str, most: int) -> str:
    """At most `most` UTF-16 units of a text, never half a letter."""
    if most <= 0:
        return ""
    return text.encode("utf-16-le", "surrogatepass")[: 2 * most].decode("utf-16-le", "ignore")


def shortened(text: str, most: int) -> str:
    """The text in at most `most` UTF-16 units, with an ellipsis where it was cut."""
    if len(text.encode("utf-16-le", "surrogatepass")) // 2 <= most:
        return text if most > 0 else ""
    return cut_units(text, most - 1) + "…" if most > 1 else ""
