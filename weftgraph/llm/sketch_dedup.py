"""Near-duplicate removal: fast similarity sketches, banding, exact verification.

1. Words (A-Z in lower case) are hashed to 64 bits; a document's set are its distinct two-word shingles (one word: that
   word).  Documents with the same set are one text with copies from here on.
2. A sketch has COORDINATES bins.  In round i every element is hashed to a bin and a value, and a bin keeps the least
   (round, value); rounds go on while a bin is empty, and from round COORDINATES on round i fills bin i - COORDINATES, so
   all are filled after twice as many.  A set of s elements needs about COORDINATES * ln(COORDINATES) / s rounds, in place of one pass
   for each coordinate; two sketches agree in a coordinate with the probability of their Jaccard similarity.
3. BANDS bands of ROWS coordinates are buckets; a pair at the threshold is missed with a probability of
   (1 - 0.8**6)**40 = 5e-6.  A bucket's least text is its lead, so buckets of one group mostly share few leads.
4. Every member is verified exactly against its leads: units of a lead's members hold about SALT texts or MASS shingles each.
   Verified links give components.  Where a member stays apart from its lead's component, it visits all units of
   that lead and is verified against every resident; overlaps follow from both texts' differences to the lead.
   So a group of near copies is not expanded into pairs: only texts that no lead has linked meet whole groups.
5. Components of all verified links (Spark rounds of large and small stars) and their least doc_ids.

Shingles and sets are identified by 64-bit hashes.

Edge cases: null texts and texts without words have an empty set and are linked with nothing; repeated rows are
copies of each other; rows without a doc_id take part like the others, and a component of them alone has a null
component_id (all its rows are kept); a doc_id may stand for several texts; very long texts are taken whole; texts of one
word are equal or not; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, freed, met, partitions, saved
from .jaccard_join import BANDS, ROWS, band_keys, components, spanning
from .repetition import _mix, batches, code_points, prefix_hashes, word_spans

PERCENT = 80
COORDINATES = ROWS * BANDS
SALT, MASS = 256, 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct two-word shingles, hashed and sorted."""
    cp, starts = code_points(texts)
    if not len(cp):
        return [np.zeros(0, np.uint64)] * len(texts)
    cp = np.where((cp >= ord("A")) & (cp <= ord("Z")), cp + 32, cp)
    sums, inverse = prefix_hashes(cp)
    begin, end, doc = word_spans(cp, starts)
    word = _mix((sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64))
    first = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    pair = _mix(word[:-1] * _ODD + word[1:]) if len(word) else word
    return [np.unique(pair[a : b - 1]) if b - a > 1 else _mix(word[a:b] ^ _ODD) for a, b in zip(first, first[1:])]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES): round and value of the element that fills each bin; sets must not be empty."""
    t = COORDINATES
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max)
    left, at = np.arange(len(sets)), 0
    x, own = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(left, [len(s) for s in sets])
    while len(left) and at < 2 * t:
        many = min(max(1, 20_000 // len(x)), 2 * t - at)
        rounds = np.arange(at, at + many, dtype=np.uint64)
        h = _mix(x[None, :] ^ _mix(rounds + np.uint64(0xF57))[:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        late = np.arange(at, at + many) - t
        bins[late >= 0] = late[late >= 0, None]
        np.minimum.at(out, (own * t + bins).ravel(), ((rounds << np.uint64(32))[:, None] | (h & np.uint64(0xFFFFFFFF))).ravel())
        at += many
        open_ = (out.reshape(-1, t)[left] == np.iinfo(np.uint64).max).any(1)
        left = left[open_]
        wanted = np.zeros(len(sets), bool)
        wanted[left] = True
        x, own = x[wanted[own]], own[wanted[own]]
    return out.reshape(-1, t)


def alike(both: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of a and b elements with `both` in common are similar."""
    return 100 * both >= PERCENT * (a + b - both)


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), k (hash of the set; null if empty), n_sh and the bands' keys."""

    def make():
        def run(ids, hashes, texts):
            texts = [t or "" for t in texts.to_pylist()]
            ks, sizes, bands = [], [], []
            for a, b in batches(texts, 300_000):
                sets = shingle_sets(texts[a:b])
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                keys = np.zeros((b - a, BANDS), np.int64)
                if full:
                    keys[n > 0] = band_keys(sketches(full))
                    own = _mix(np.add.reduceat(_mix(np.concatenate(full)), np.cumsum(n[n > 0]) - n[n > 0]) + n[n > 0].astype(np.uint64))
                k = np.zeros(b - a, np.int64)
                if full:
                    k[n > 0] = own.view(np.int64)
                ks.append(pa.array(k, mask=n == 0))
                sizes.append(pa.array(n.astype(np.int64)))
                bands.append(pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())))
            return [ids, hashes, *map(pa.concat_arrays, (ks, sizes, bands))]

        return run

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    return arrow_map(rows, make, "doc_id long, t long, k long, n_sh long, bands array<long>", raw=True)


def _led(texts: DataFrame) -> DataFrame:
    """k, l: each text and every lead of its buckets; n, the greatest of these buckets; unit (parts, part)."""
    rows = texts.select("k", "n_sh", F.explode("bands").alias("bk"))
    leads = saved(rows.groupBy("bk").agg(F.min("k").alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("weight", F.col("n")))
    pairs = met(rows, leads, ["bk"], "weight", "inner").filter("k <> l").groupBy("k", "l").agg(F.max("n").alias("n"), F.max("n_sh").alias("n_sh"))
    share = F.greatest(F.lit(1.0), F.col("n") / SALT, F.col("n") * F.col("n_sh") / MASS)
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(share))).cast("long")  # powers of two, so that members of one size share units
    out = saved(pairs.select("k", "l", "n", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts"))))
    freed(leads)
    return out


def _sets(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """k, set of every text in pairs, read from a row with its least doc_id."""
    wanted = pairs.select("k").union(pairs.select("l")).distinct()
    key = lambda df, i: df.withColumns({"none": F.col(i).isNull(), "id": F.coalesce(i, F.lit(0))}).drop(i)
    facts = saved(key(texts.select("k", "t", "rep", "copies").join(wanted.hint("merge"), "k", "left_semi"), "rep"))
    rows = key(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text"), "doc_id").filter("text IS NOT NULL")
    found = met(rows, facts, ["t", "none", "id"], "copies", "inner").select("k", "text")

    def make():
        def run(ks, bodies):
            seen, out = set(), []
            for k, s in ((k, s) for a, b in batches(bodies, 300_000) for k, s in zip(ks[a:b], shingle_sets(bodies[a:b]))):
                own = int(_mix(_mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])
                if own == k and k not in seen:  # else another text with the same hash, or a copy
                    seen.add(k)
                    out.append((k, s.tobytes()))
            return list(map(list, zip(*out))) or [[], []]

        return run

    return saved(arrow_map(found, make, "k long, set binary").dropDuplicates(["k"]))


def _by_unit(members: DataFrame, leads: DataFrame, sets: DataFrame, make, schema: str) -> DataFrame:
    """Rows (l, parts, part, role, k, set) of units, each unit's lead first, through make."""
    unit = ["l", "parts", "part"]
    first = leads.select(*unit, F.lit(0).alias("role"), F.col("l").alias("k"))
    rows = first.union(members.select(*unit, "role", "k")).join(sets.hint("merge"), "k").select(*unit, "role", "k", "set")
    dealt = rows.repartition(partitions(rows.sparkSession), *unit).sortWithinPartitions(*unit, "role")
    return arrow_map(dealt, make, schema)


class Star:
    """Members against their unit's lead."""

    def __init__(self):
        self.lead = None

    def __call__(self, ls, parts, part, roles, ks, sets):
        ok = []
        for role, s in zip(roles, sets):
            s = np.frombuffer(s, np.uint64)
            if role == 0:
                self.lead = s
            ok.append(bool(role) and bool(alike(common(self.lead, s), len(self.lead), len(s))))
        rows = [r for r in zip(ks, ls, parts, part, ok, roles) if r[-1]]
        return [list(c) for c in zip(*rows)][:5] or [[]] * 5


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in both of two sorted sets."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


class Visits:
    """Visitors against all residents of a unit; edges of a forest that spans the links come out.

    With D what the lead has and a text lacks, and X the symmetric difference of both, two texts share
    |lead| - |D1| - |D2| + |X1 and X2| shingles: only differences are kept of the residents, and compared.
    """

    def __init__(self):
        self.unit, self.links = None, []

    def __call__(self, ls, parts, part, roles, ks, sets):
        out = []
        for unit, role, k, s in zip(zip(ls, parts, part), roles, ks, sets):
            if unit != self.unit:
                out += self.done()
                self.unit, self.residents, self.places, self.index = unit, [], {}, None
            s = np.frombuffer(s, np.uint64)
            if role == 0:
                self.lead = s
                continue
            x = np.setxor1d(self.lead, s, assume_unique=True)
            both = (len(self.lead) + len(s) - len(x)) // 2
            if role == 1:
                self.places[k] = len(self.residents)
                self.residents.append((k, len(s), len(self.lead) - both, x))
            else:
                self.visit(k, len(s), len(self.lead) - both, x)
        return list(map(list, zip(*out))) or [[], []]

    def visit(self, k, size, lacks, x):
        if self.index is None and self.residents:
            values = np.concatenate([r[3] for r in self.residents])
            owner = np.repeat(np.arange(len(self.residents)), [len(r[3]) for r in self.residents])
            order = np.argsort(values, kind="stable")
            self.index = values[order], owner[order], np.array([r[1] for r in self.residents]), np.array([r[2] for r in self.residents])
        if not self.residents:
            return
        values, owner, sizes, lack = self.index
        lo, hi = np.searchsorted(values, x), np.searchsorted(values, x, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = len(self.lead) - lacks - lack + np.bincount(owner[at], minlength=len(sizes))
        self.links += [(k, self.residents[j][0]) for j in np.flatnonzero(alike(both, sizes, size)).tolist() if self.residents[j][0] != k]
        if len(self.links) > 100_000:
            self.links = self.forest()

    def forest(self):
        names = sorted({k for e in self.links for k in e})
        place = {k: i for i, k in enumerate(names)}
        pairs = np.array([(place[a], place[b]) for a, b in self.links], np.int64).reshape(-1, 2)
        return [(names[a], names[b]) for a, b in spanning(len(names), pairs)]

    def done(self):
        out, self.links = self.forest(), []
        return out

    def flush(self):
        return list(map(list, zip(*self.done()))) or [[], []]


def _linked(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, c: the component of every text that has a link."""
    unit = ["l", "parts", "part"]
    pairs = _led(texts)
    sets = _sets(docs, texts, pairs)
    judged = saved(_by_unit(pairs.withColumn("role", F.lit(1)), pairs.select(*unit).distinct(), sets, Star, "k long, l long, parts long, part long, ok boolean"))
    groups = components(judged.filter("ok").select(F.col("k").alias("u"), F.col("l").alias("v")))
    # Texts that share a bucket of three or more with a lead in another component may be linked with other members.
    own, led = groups.select(F.col("u").alias("k"), F.col("c").alias("ck")), groups.select(F.col("u").alias("l"), F.col("c").alias("cl"))
    failed = judged.filter("NOT ok").select("k", "l").join(pairs.filter("n > 2").select("k", "l"), ["k", "l"])
    odd = saved(failed.join(own, "k", "left").join(led, "l", "left").filter(F.coalesce("ck", "k") != F.coalesce("cl", "l")).select("k", "l"))
    units = saved(judged.select(*unit).distinct().join(odd.select("l").distinct(), "l"))
    visitors = odd.join(units, "l").withColumn("role", F.lit(2))
    residents = judged.join(units, unit, "left_semi").withColumn("role", F.lit(1))
    cols = [*unit, "role", "k"]
    more = saved(_by_unit(residents.select(*cols).union(visitors.select(*cols)), units, sets, Visits, "u long, v long"))
    out = components(groups.select("u", F.col("c").alias("v")).union(more)) if more.head(1) else groups
    for df in (pairs, sets, judged, odd, units, more):
        freed(df)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for every row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    signed = saved(_sketched(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")  # an id before none
    texts = signed.filter("k IS NOT NULL").groupBy("k").agg(first, F.count(F.lit(1)).alias("copies"), F.any_value(F.struct("n_sh", "bands")).alias("own"))
    texts = saved(texts.select("k", "first.t", F.col("first.doc_id").alias("rep"), "copies", "own.*"))
    groups = _linked(docs, texts)
    named = texts.select("k", "rep", "copies").join(groups.withColumnRenamed("u", "k"), "k", "left").withColumn("c", F.coalesce("c", "k"))
    tops = saved(named.groupBy("c").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("texts")))
    known = saved(met(named, tops, ["c"], "texts").select("k", "copies", "component_id"))
    told = met(signed.filter("k IS NOT NULL").select("doc_id", "n_sh", "k"), known, ["k"], "copies").select("doc_id", "n_sh", "component_id")
    alone = signed.filter("k IS NULL").select("doc_id", "n_sh", F.col("doc_id").alias("component_id"))
    return told.union(alone).select("doc_id", F.col("n_sh").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
