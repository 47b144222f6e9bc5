"""Near-duplicate join: word five-grams, Jaccard 0.8 and more, Bayesian candidate pruning.

1. Each text's words (lower case) are hashed to 64 bits; runs of five are its shingles (fewer than five
   words: all of them are one).  Texts with the same words are one text with copies from here on.
2. BANDS bands of ROWS MinHash values propose candidates; a pair at the threshold is missed with a
   probability of (1 - 0.8**6)**40 = 5e-6.  Each bucket proposes its members against one member, chosen
   by a hash of bucket and member; members that stay apart from it, by other buckets too, are compared with
   the whole bucket, in blocks.  So no group of near copies is expanded into pairs.
3. Pruning: MinHash values are compared STEP at a time, and a pair is dropped once the probability that
   its similarity reaches the threshold, given the matches so far and a uniform prior, falls below
   TOLERANCE.  What survives is joined to groups (large-star and small-star steps).
4. In each group the pairs go through the same pruning, and those that survive are verified exactly by
   their shingle sets, block by block; blocks give counts of links and the edges of spanning forests, not
   pairs.  About PIVOTS texts of a group meet every pair of blocks: what they link counts as joined there, so
   that blocks tell their edges to them once, and beyond these only what joins parts.  Groups of the verified
   edges are the classes.  (Shingles and texts are identified by 64-bit hashes.)  A block holds at most BLOCK
   texts and about MASS shingles.

Result: doc_id, class_id (least doc_id of the class), n_links (other documents that are similar, copies
counted), n_copies (documents with the same words).

Edge cases: texts that are null or have no words are a class of their own, without links; repeated
rows are copies of each other; documents without a doc_id take part like the others, and a class of them
alone has a null class_id; a doc_id may stand for several texts, each of which has its own class; very
long texts are taken whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, freed, give_back, partitions, saved, ship
from .repetition import _mix, batches, code_points, prefix_hashes, word_spans

THRESHOLD, WORDS = 0.8, 5
ROWS, BANDS, KEPT, STEP, TOLERANCE = 6, 40, 128, 32, 1e-6
BLOCK, MASS = 96, 45_000  # texts, and shingles, of a group verified against as many others at a time
BUCKET_BLOCK = 512
PIVOTS = 16
SALT = 4096  # members of a bucket that stay together in a join by bucket
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a, b = rng.integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' shingles one after another (in order, repeats kept), where each text's begin (with
    the end), and a hash of each text's words."""
    cp, starts = code_points([t.lower() for t in texts])
    n_docs = len(texts)
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64), np.zeros(n_docs, np.uint64)
    sums, inverse = prefix_hashes(cp)
    begin, end, doc = word_spans(cp, starts)
    word = _mix((sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64))
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n_words = np.diff(first)
    place = np.arange(len(word)) - np.repeat(first[:-1], n_words)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(word + _mix(place)), dtype=np.uint64)))
    key = run[first[1:]] - run[first[:-1]]
    n_sh = np.where(n_words >= WORDS, n_words - WORDS + 1, (n_words > 0).astype(np.int64))
    at = np.zeros(n_docs + 1, np.int64)
    np.cumsum(n_sh, out=at[1:])
    source = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n_sh)  # each shingle's first word
    size = np.repeat(np.minimum(n_words, WORDS), n_sh)
    out = np.zeros(len(source), np.uint64)
    padded = np.concatenate((word, np.zeros(WORDS, np.uint64)))
    for j in range(WORDS):
        out = out * _ODD + np.where(size > j, padded[source + j], np.uint64(j + 1))
    return _mix(out), at, key


def signatures(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, ROWS * BANDS) MinHash values; texts must have shingles."""
    a, b = _functions()
    out = np.empty((len(a), len(at) - 1), np.uint32)
    for j in range(len(a)):
        out[j] = np.minimum.reduceat((sh * a[j] + b[j]) >> np.uint64(32), at[:-1])
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sig), BANDS), np.uint64)
    rows = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        key = _mix(key * _ODD + rows[:, :, r])
    return _mix(key ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


@cache
def least_matches() -> tuple[tuple[int, int], ...]:
    """(n, m): after n values a pair with fewer than m matches is dropped.

    With a uniform prior the similarity has a Beta(m + 1, n - m + 1) posterior, whose upper tail from
    the threshold on is the chance of at most m successes in n + 1 throws of that probability.
    """
    out = []
    for n in range(STEP, KEPT + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if tail >= TOLERANCE:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of KEPT values outlive the pruning, STEP values at a time."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in least_matches():
        matches[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _bytes(column: list, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column]


def spanning(n: int, pairs: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a forest over n nodes that spans the pairs; an edge names each part that it joins by the least node.

    What the known pairs join is joined already, without an edge.
    """
    top, out = list(range(n)), []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for some, told in ((known, []), (pairs, out)):
        for a, b in [] if some is None else some.tolist():
            ra, rb = find(a), find(b)
            if ra != rb:
                top[max(ra, rb)] = min(ra, rb)
                told.append((ra, rb))
    return out


def _by_unit(df: DataFrame, each, schema: str, keys: int) -> DataFrame:
    """each(first `keys` values, lists of the other columns) for the rows that share those values.

    The rows of a unit are gathered in one task; callers bound them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(it):
        give_back(None)
        unit, rows = None, []

        def done():
            out = each(unit, [list(c) for c in zip(*rows)])
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out), arrow.types)], schema=arrow) if out else None

        for b in it:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[:keys] != unit:
                    if rows and (got := done()):
                        yield got
                    unit, rows = r[:keys], []
                rows.append(r[keys:])
        if rows and (got := done()):
            yield got

    names = df.columns[:keys]
    return df.repartition(partitions(df.sparkSession), *names).sortWithinPartitions(*names).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(u, c): the least node of each node's component, for edges (u, v) of two longs.

    Large-star and small-star steps in turn until the edges are stars; each round is written to the
    shared folder, and only two numbers of it reach the driver.
    """
    now, mark = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"), None
    while True:
        before = now
        # An edge (u, v) has u > v and gives one row to each step: u goes to the least neighbour of v (v itself if none is
        # less); then v goes to the least m that u has, and u itself by the row where v is m.
        least = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = saved(small.distinct())
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        freed(before)
        if tuple(got) == mark:
            break
        mark = tuple(got)
    stars = now.select("u", F.col("v").alias("c"))
    return stars.union(stars.select("c", "c").distinct())


def _signed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), k (hash of the words; null without words), n_sh (shingles), bands and sig."""

    def make():
        def run(ids, hashes, texts):
            texts = [t or "" for t in texts]
            ks, sizes, bands, sigs = [], [], [], []
            for a, b in batches(texts, 300_000):
                sh, at, key = shingles(texts[a:b])
                full = np.diff(at) > 0
                sig = signatures(sh, np.concatenate((at[:-1][full], at[-1:]))) if full.any() else np.zeros((0, ROWS * BANDS), np.uint32)
                rows = iter(zip(key[full].view(np.int64).tolist(), band_keys(sig).tolist(), sig[:, :KEPT]))
                for has in full.tolist():
                    k, band, s = next(rows) if has else (None, None, None)
                    ks.append(k)
                    bands.append(band)
                    sigs.append(s.tobytes() if has else None)
                sizes += np.diff(at).tolist()
            return [ids, hashes, ks, sizes, bands, sigs]

        return run

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("t"), "text"), make, "doc_id long, t long, k long, n_sh long, bands array<long>, sig binary")


def _groups(texts: DataFrame) -> DataFrame:
    """(u, c): the components of whatever the pruning leaves of the buckets' pairs."""
    sigs = texts.select("k", "sig")
    rows = texts.select("k", F.explode("bands").alias("bk"))
    choice = F.min(F.struct(F.xxhash64("bk", "k").alias("h"), "k")).alias("lead")
    leads = rows.groupBy("bk").agg(choice, F.count(F.lit(1)).alias("n")).filter("n > 1").select("bk", F.col("lead.k").alias("l"), "n")
    members = saved(rows.join(leads, "bk").filter("k <> l"))
    pairs = members.select("k", "l").distinct()
    both = pairs.join(sigs, "k").join(sigs.select(F.col("k").alias("l"), F.col("sig").alias("sig2")), "l").select("k", "l", "sig", "sig2")

    def make():
        def run(k, l, a, b):
            return [k, l, survive(np.array(_bytes(a, np.uint32)), np.array(_bytes(b, np.uint32))).tolist()]

        return run

    judged = saved(arrow_map(both, make, "k long, l long, ok boolean"))
    groups = components(judged.filter("ok").select(F.col("k").alias("u"), F.col("l").alias("v")))
    top = lambda k, c: groups.select(F.col("u").alias(k), F.col("c").alias(c))
    # Members in another component than their bucket's lead meet the whole bucket.  A bucket's size is known to all its
    # members, so a large one is cut into parts of SALT members wherever rows meet by bucket.
    failed = judged.filter("NOT ok").select("k", "l").join(top("k", "ck"), "k", "left").join(top("l", "cl"), "l", "left")
    odd = saved(failed.filter(F.coalesce("ck", "k") != F.coalesce("cl", "l")).select("k", "l", F.lit(True).alias("odd")))
    parts = (F.floor(F.col("n") / SALT) + 1).cast("int")
    told = members.filter("n > 2").join(odd, ["k", "l"], "left").select("bk", "k", "n", F.coalesce("odd", F.lit(False)).alias("odd")).withColumn("part", F.pmod(F.xxhash64(F.lit(17), "k"), parts).cast("int"))
    crowd = told.filter("odd").select("bk", "n").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    own = told.join(crowd, ["bk", "part"], "left_semi")
    blocks = own.withColumn("n", (F.floor(F.col("n") / BUCKET_BLOCK) + 1).cast("int"))
    units = _units(blocks.join(sigs, "k").join(top("k", "c"), "k", "left").withColumn("c", F.coalesce("c", "k")), "bk", ["odd", "c", "sig"])

    def each(unit, cols):
        side, odd_, c, sig = cols
        sig, odd_, side = np.array(_bytes(sig, np.uint32)), np.array(odd_), np.array(side)
        c, own = np.unique(np.array(c), return_inverse=True)
        found = []
        same = unit[1] == unit[2]
        right = np.arange(len(own)) if same else np.flatnonzero(side == unit[2])
        left = np.flatnonzero(odd_) if same else np.flatnonzero(side == unit[1])
        for i in left.tolist():
            j = right[(own[right] != own[i]) & (odd_[right] | odd_[i])]
            ok = survive(np.broadcast_to(sig[i], (len(j), KEPT)), sig[j])
            found += [(own[i], x) for x in own[j[ok]].tolist()]
        return [(int(c[a]), int(c[b])) for a, b in spanning(len(c), np.array(found, np.int64).reshape(-1, 2))]

    more = saved(_by_unit(units, each, "u long, v long", 3))
    out = components(groups.select("u", F.col("c").alias("v")).union(more)) if more.head(1) else groups
    for df in (members, judged, odd, more):
        freed(df)
    return out


def _units(df: DataFrame, group: str, cols: list[str], pivot: str = "false") -> DataFrame:
    """Rows (group, k, n, ...) dealt out to the pairs i <= j of the group's n blocks: group, i, j, the
    row's own block, cols.  Pivots go to all pairs besides, where their block is -1."""
    own = F.pmod(F.xxhash64(F.lit(13), "k"), F.col("n").cast("long")).cast("int")
    by_own = "transform(sequence(0, n - 1), x -> struct(least(side, x) AS i, greatest(side, x) AS j, side AS side))"
    by_all = "flatten(transform(sequence(0, n - 1), x -> transform(sequence(x, n - 1), y -> struct(x AS i, y AS j, -1 AS side))))"
    dealt = df.withColumn("side", own).withColumn("at", F.explode(F.expr(f"if({pivot}, concat({by_own}, {by_all}), {by_own})")))
    return dealt.select(group, "at.i", "at.j", "at.side", *cols)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections of sorted sets, from products of incidence matrices."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    rows, column = rows[common], column[common]
    if len(column):
        column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
        wide = 4096
        for a in range(0, int(column[-1]) + 1, wide):
            lo, hi = np.searchsorted(column, (a, a + wide))
            part = np.zeros((n, wide), np.float32)
            part[rows[lo:hi], column[lo:hi] - a] = 1
            out += part @ part.T
    return out


def candidates(sig: np.ndarray, side: np.ndarray, same: bool) -> np.ndarray:
    """(n, n) whether two texts of a unit may be similar, by the pruning; pairs of one side only if `same`."""
    n = len(sig)
    out = np.zeros((n, n), bool)
    for i in range(n):
        j = np.arange(i + 1, n) if same else i + 1 + np.flatnonzero(side[i + 1 :] != side[i])
        if len(j):
            out[i, j[survive(np.broadcast_to(sig[i], (len(j), KEPT)), sig[j])]] = True
    return out | out.T


def _verified(docs: DataFrame, texts: DataFrame, groups: DataFrame) -> DataFrame:
    """k, links (documents of other texts that are similar) and the far end of a spanning edge, or null.

    An edge joins k's part with another's, so its ends need not be similar themselves.
    """
    own = groups.withColumnRenamed("u", "k").join(texts.select("k", "t", "rep", "copies", "n_sh", "sig"), "k")
    blocks = F.greatest(F.floor(F.count(F.lit(1)) / BLOCK), F.floor(F.sum("n_sh") / MASS))
    n = own.groupBy("c").agg((blocks + 1).cast("int").alias("n"), F.count(F.lit(1)).alias("size"))
    pivot = (F.col("n") > 1) & (F.pmod(F.xxhash64(F.lit(19), "k"), "size") < PIVOTS)
    wanted = own.drop("n_sh").join(n, "c").withColumn("pivot", pivot).drop("size")
    # A text is read from a row with its least doc_id (null only if none of its rows has one).
    body = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = body.join(wanted, (body["t"] == wanted["t"]) & body["doc_id"].eqNullSafe(wanted["rep"])).select("c", "k", "n", "pivot", "copies", "sig", "text")

    def make():
        def run(cs, ks, ns, pivots, copies, sigs, bodies):
            sh, at, key = shingles(bodies)
            same = (key.view(np.int64) == np.array(ks)).tolist()  # else another text with the same hash
            sets = [np.unique(sh[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            return [[x for x, ok in zip(c, same) if ok] for c in (cs, ks, ns, pivots, copies, sigs, sets)]

        return run

    whole = arrow_map(found, make, "c long, k long, n int, pivot boolean, copies long, sig binary, sets binary").dropDuplicates(["c", "k"])
    units = _units(whole, "c", ["k", "copies", "sig", "sets"], "pivot")

    def each(unit, cols):
        # Pivots come first, so parts that have one are named by it.
        side, ks, copies, sig, sets = zip(*sorted(zip(*cols), key=lambda r: r[:2]))
        same, first = unit[1] == unit[2], side.count(-1)
        sets = _bytes(sets, np.uint64)
        near = candidates(np.array(_bytes(sig, np.uint32)).reshape(-1, KEPT), np.array(side), same)
        size = np.array([len(s) for s in sets], np.float64)
        pairs = np.argwhere(np.triu(near))
        if len(pairs) <= 4 * len(ks):
            shared = np.array([len(np.intersect1d(sets[a], sets[b], True)) for a, b in pairs.tolist()], np.float64)
        else:
            shared = shared_counts(sets)[pairs[:, 0], pairs[:, 1]]
        pairs = pairs[shared >= THRESHOLD * (size[pairs[:, 0]] + size[pairs[:, 1]] - shared) - 1e-9]
        by_pivot, pairs = pairs[pairs[:, 0] < first], pairs[pairs[:, 0] >= first]
        copies, links = np.array(copies), np.zeros(len(ks), np.int64)
        np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
        # A block's own unit (i = j) tells what its texts have with pivots; the others know it.
        edges = spanning(len(ks), np.concatenate((by_pivot, pairs))) if same else spanning(len(ks), pairs, by_pivot)
        return [(k, int(x), None) for k, x in zip(ks, links.tolist()) if x] + [(ks[a], 0, ks[b]) for a, b in edges if ks[a] != ks[b]]

    return saved(_by_unit(units, each, "k long, links long, v long", 3))


def _told(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """signed: doc_id, t, k of every row; known: k, copies, n_links, c (the class: its least k), rep (the
    text's least doc_id) and class_id."""
    signed = saved(_signed_texts(docs))
    has = signed.filter("k is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")  # an id before none
    # One row for each text: all its rows have the same signature, so any of them is taken, before the shuffle too.
    texts = has.groupBy("k").agg(first, F.count(F.lit(1)).alias("copies"), F.any_value(F.struct("n_sh", "bands", "sig")).alias("own"))
    texts = saved(texts.select("k", "first.t", F.col("first.doc_id").alias("rep"), "copies", "own.*"))
    checked = _verified(docs, texts, _groups(texts))
    links = checked.groupBy("k").agg(F.sum("links").alias("links"))
    classes = components(checked.filter("v is not null").select(F.col("k").alias("u"), "v").distinct())
    named = texts.select("k", "t", "rep", "copies").join(links, "k", "left").join(classes.withColumnRenamed("u", "k"), "k", "left")
    named = named.withColumn("c", F.coalesce("c", "k"))
    head = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("class_id"), F.col("t").alias("head_t"))).alias("head")
    tops = named.groupBy("c").agg(head).select("c", "head.class_id", "head.head_t")
    known = named.join(tops, "c").select("k", "copies", "class_id", "head_t", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "t", "k"), known


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for every row of docs(doc_id, text): doc_id, class_id, n_links, n_copies."""
    signed, known = _told(docs)
    return signed.join(known, "k", "left").select(
        "doc_id", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (with doc_id and text) with one row of each class: one with its least doc_id (null if it has none).

    Rows are told apart by doc_id and text, so another text with the same doc_id stays; rows with the same
    doc_id and text are one.  Texts without words are a class each, rows with a null doc_id included.
    """
    signed, known = _told(docs)
    # xxhash64 of a null text is its seed; coalesce keeps null and empty texts of one doc_id apart.
    gone = signed.join(known, "k").filter(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("head_t"))))
    keys = lambda df, t: df.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull(), "_t": t})
    on = ["_id", "_none", "_t"]
    gone = keys(gone.select("doc_id", "t"), F.col("t")).select(*on).distinct()
    return keys(docs, F.xxhash64("text")).join(gone, on, "left_anti").dropDuplicates([*on]).drop(*on)


def jaccard_classes(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
