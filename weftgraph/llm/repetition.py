"""Suffix-array repetition rule.

For each text a suffix array is built by prefix doubling (numpy, many texts at once) over the places
that a substring of min_len found twice covers, which is where all longer repeats lie; the longest
common prefixes of neighbouring suffixes are read off the doubling's ranks, and the intervals of
common prefixes of at least min_len code points give the maximal repeated substrings.  The union of
their occurrences is the covered part of the text: the deepest interval that holds a suffix is as long as the
longer of its common prefixes with its neighbours, and a repeat that is not maximal lies in a maximal one.  A text is kept if the covered fraction and the
longest repeat stay within the limits, and the base rule holds.

Edge cases: null and empty texts have no words, so the base rule fails them; texts of any length are
taken whole (memory grows in proportion to the longest text, and beyond that with its repeated part times the
logarithm of its longest repeat); repeated rows give repeated results;
other columns of the input are not read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_chars long, longest_repeat long, n_repeats long"
_WS = np.zeros(0x110000, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_SYM = np.zeros(0x110000, bool)
_SYM[[ord(c) for c in "#*$%&|<>"]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text begins (with the end as last)."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), starts


_BASE = 0x5851F42D4C957F2D


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def prefix_hashes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of mixed code points times powers, modulo 2**64, and the powers' inverses: the span a:b
    hashes to (sums[b] - sums[a]) * inverse[a], wherever it lies."""
    n = len(cp)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(np.arange(int(cp.max(initial=0)) + 1))[cp] * _powers(_BASE, n + 1)[:n], out=sums[1:])
    return sums, _powers(pow(_BASE, -1, 1 << 64), n + 1)


def word_spans(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and their texts."""
    n = len(cp)
    inside = ~_WS[cp]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    begin = np.flatnonzero(inside & (first[:n] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def word_figures(cp: np.ndarray, starts: np.ndarray, hashes: tuple | None = None) -> dict[str, np.ndarray]:
    """Words, their code points, symbols, and words in windows of five found again in the text."""
    n_docs, n = len(starts) - 1, len(cp)
    zero = np.zeros(n_docs, np.int64)
    if not n:
        return {"n_words": zero, "word_chars": zero, "n_symbols": zero, "n_repeat_words": zero}
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[starts])
    begin, end, doc = word_spans(cp, starts)
    out = {"n_words": np.bincount(doc, minlength=n_docs), "word_chars": total(~_WS[cp]), "n_symbols": total(_SYM[cp])}
    sums, inverse = hashes or prefix_hashes(cp)
    word = _mix((sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64))
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= 5:
        key = _mix(doc[: len(word) - 4])
        for j in range(5):
            key = key * np.uint64(0x9E3779B97F4A7C15) + word[j : len(word) - 4 + j]
        ok = np.flatnonzero(doc[: len(word) - 4] == doc[4:])
        ok, key = ok[again(key[ok])], key[ok]
        np.add.at(covered, ok, 1)
        np.add.at(covered, ok + 5, -1)
    hit = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc, weights=hit, minlength=n_docs).astype(np.int64)
    return out


def again(key: np.ndarray) -> np.ndarray:
    """Places of the keys that occur twice or more: two tables of counts rule out most, sorting decides."""
    at = np.arange(len(key))
    for shift in (44, 24):
        slot = (key[at] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(shift)).astype(np.int64) & 0xFFFFF
        at = at[np.bincount(slot)[slot] > 1]
        if not len(at):
            return at
    own = key[at]
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return at[twice]


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_part(cp: np.ndarray, starts: np.ndarray, hashes: tuple, min_len: int) -> np.ndarray:
    """Places of all code points inside a substring of min_len that its text holds twice."""
    n = len(cp)
    if n < min_len:
        return np.zeros(0, np.int64)
    sums, inverse = hashes
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: n - min_len + 1]
    at = np.flatnonzero(starts[1:][doc] - np.arange(n - min_len + 1) >= min_len)
    key = (sums[min_len:] - sums[: n - min_len + 1]) * inverse[: n - min_len + 1] + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    at = at[again(key[at])]
    step = np.zeros(n + 1, np.int64)
    step[at] += 1
    step[at + min_len] -= 1
    return np.flatnonzero(np.cumsum(step[:-1]))


def suffix_array(cp: np.ndarray, starts: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes at pos sorted by (text, suffix), the ranks of pos by prefixes of doubling lengths, of each
    place where it is in pos (len(pos): nowhere), codes, text ends.

    Only suffixes that still share their rank are sorted again.  Where a common prefix leaves pos, it
    has ended (see repeated_part): such a suffix counts as different from all others from there on.
    """
    n, m = len(cp), len(pos)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = starts[1:][doc]
    seen = np.flatnonzero(np.bincount(cp, minlength=1))
    code_of = np.zeros(int(seen[-1]) + 1, np.int64)
    code_of[seen] = np.arange(1, len(seen) + 1)
    codes = code_of[cp]
    bits = int(len(seen)).bit_length()
    room = 62 - max(1, int(len(starts)).bit_length())
    h = max(1, room // bits)
    left = end - np.arange(n)
    key = doc[pos].astype(np.int64)
    for j in range(h):
        key = (key << bits) + codes[np.minimum(pos + j, n - 1)] * (left[pos] > j)
    order = np.argsort(key)
    sa = pos[order]
    ks = key[order]
    new = np.concatenate(([True], ks[1:] != ks[:-1]))
    rank = np.arange(m, m + n)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    place = np.full(n, m, np.int32)
    place[pos] = np.arange(m)
    levels = [(h, rank[pos])]
    slots = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    while len(slots):
        i = sa[slots]
        nxt = np.where(left[i] > h, rank[np.minimum(i + h, n - 1)] + 1, 0)
        key = rank[i] * (m + n + 1) + nxt
        order = np.argsort(key)
        sa[slots] = i = i[order]
        ks = key[order]
        new = np.concatenate(([True], ks[1:] != ks[:-1]))
        rank[i] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2
        levels.append((h, rank[pos]))
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
    return sa, levels, place, codes, end


def common_prefixes(sa: np.ndarray, levels: list, place: np.ndarray, codes: np.ndarray, end: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots r whose suffix shares at least min_len code points with the one at r - 1, and how many."""
    low = [x for h, x in levels if h <= min_len]
    if not low:  # the first packed prefix is longer than min_len: compare neighbours in one text
        r = np.flatnonzero(end[sa[1:]] == end[sa[:-1]]) + 1
    else:
        at = low[-1][place[sa]]
        r = np.flatnonzero(at[1:] == at[:-1]) + 1
    a, b = sa[r - 1], sa[r]
    n, lcp = len(codes), np.zeros(len(r), np.int64)
    inside = lambda: (a + lcp < end[a]) & (b + lcp < end[b])
    for h, rank in reversed(levels):
        at, bt = place[np.minimum(a + lcp, n - 1)], place[np.minimum(b + lcp, n - 1)]
        known = inside() & (at < len(rank)) & (bt < len(rank))  # elsewhere all suffixes differ
        known[known] = rank[at[known]] == rank[bt[known]]
        lcp += h * known
    for _ in range(levels[0][0] - 1):
        lcp += inside() & (codes[np.minimum(a + lcp, n - 1)] == codes[np.minimum(b + lcp, n - 1)]) & True
    ok = lcp >= min_len
    return r[ok], lcp[ok]


def maximal_repeats(sa: np.ndarray, r: np.ndarray, lcp: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(first slot, last slot, length) of the intervals whose occurrences differ in the code point before."""
    first = np.zeros(len(codes) + 1, bool)
    first[starts] = True  # a text's first suffix has nothing before it: unlike any other
    before = np.where(first[sa], -sa - 1, codes[np.maximum(sa, 1) - 1])
    differ = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    out, stack, last = [], [], -2

    def close(down_to: int, slot: int) -> int:
        begin = slot
        while stack and stack[-1][1] > down_to:
            begin, length = stack.pop()
            if differ[slot] > differ[begin]:
                out.append((begin, slot, length))
        return begin

    for slot, length in zip(r.tolist(), lcp.tolist()):
        if slot != last + 1:
            close(0, last)
            begin = slot - 1
        else:
            begin = slot - 1
            if stack and stack[-1][1] > length:
                begin = close(length, slot - 1)
        if not stack or stack[-1][1] < length:
            stack.append((begin, length))
        last = slot
    close(0, last)
    return out


def repeat_figures(cp: np.ndarray, starts: np.ndarray, hashes: tuple, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered code points, longest repeat and number of maximal repeats of each text."""
    covered, longest, count = (np.zeros(len(starts) - 1, np.int64) for _ in range(3))
    pos = repeated_part(cp, starts, hashes, min_len)
    if not len(pos):
        return covered, longest, count
    sa, levels, place, codes, end = suffix_array(cp, starts, pos)
    r, lcp = common_prefixes(sa, levels, place, codes, end, min_len)
    if len(r):
        reach = np.zeros(len(cp) + 1, np.int64)
        np.maximum.at(reach, sa[r], lcp)
        np.maximum.at(reach, sa[r - 1], lcp)
        at = np.flatnonzero(reach)
        step = np.zeros(len(cp) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + reach[at], -1)
        hit = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
        covered = np.diff(hit[starts])
        found = np.array(maximal_repeats(sa, r, lcp, codes, starts), np.int64).reshape(-1, 3)
        doc = np.searchsorted(starts, sa[found[:, 0]], "right") - 1
        np.add.at(count, doc, 1)
        np.maximum.at(longest, doc, found[:, 2])
    return covered, longest, count


def batches(texts: list[str], most: int) -> list[tuple[int, int]]:
    """Ranges of texts with at most `most` code points together; a longer text is a range by itself."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((begin, i))
            begin, size = i, 0
        size += len(t)
    return [*out, (begin, len(texts))] if texts else []


def repetition_rule(docs: DataFrame, min_len: int = 50, max_covered: float = 0.3, max_longest: int = 1000) -> DataFrame:
    """doc_id and the figures and verdicts of SCHEMA for every row of docs(doc_id, text)."""

    def make():
        def run(ids, texts):
            texts = [t or "" for t in texts]
            cols = {k: [] for k in SCHEMA_NAMES}
            cols["doc_id"] = ids
            for a, b in batches(texts, 300_000):
                part = texts[a:b]
                cp, starts = code_points(part)
                hashes = prefix_hashes(cp)
                figures = word_figures(cp, starts, hashes)
                covered, longest, count = repeat_figures(cp, starts, hashes, min_len)
                n, again = figures["n_words"], figures["n_repeat_words"]
                failed = (n < 10) | (100 * again > 20 * n)
                chars = np.array([len(t) for t in part])
                kept = ~failed & (covered <= max_covered * chars) & (longest <= max_longest)
                figures |= {"n_dup_lines": [dup_lines(t) for t in part], "base_failed": failed, "kept": kept, "covered_chars": covered, "longest_repeat": longest, "n_repeats": count}
                for k, v in figures.items():
                    cols[k].extend(v.tolist() if hasattr(v, "tolist") else v)
            return [cols[k] for k in SCHEMA_NAMES]

        return run

    return arrow_map(docs.select("doc_id", "text"), make, SCHEMA)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
