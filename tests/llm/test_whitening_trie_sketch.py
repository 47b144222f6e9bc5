"""Embedding whitening, the conversations' prefix trie and sketch near-dedup against plain computations."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftgraph.llm import sketch_dedup, trie, whitening
from weftgraph.llm.common import met

NAMES = ("h", "k", "t", "n", "b", "u", "c", "l", "w", "y", "part", "state", "turns", "depth", "component", "rep", "set", "id", "none", "_met", "tops", "own")


# --- whitening


def plain_whitening(rows):
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in fine], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    v = np.cov((fit - fit.mean(0)).T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, len(values))
    return [i for i, _ in fine], n, ((n * x - total) ** 2).sum(1), ((n * x - total) / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(frame, rows):
    got = whitening.whitening_digest(frame).orderBy("vec_id", "component").collect()
    ids, n, deviation, white, explained = plain_whitening(sorted(rows, key=lambda r: r[0]))
    k = white.shape[1]
    assert [(r.vec_id, r.component) for r in got] == [(i, j + 1) for i in ids for j in range(k)]
    assert {r.n for r in got} == {n} and [r.deviation for r in got[::k]] == deviation.tolist()
    mine = np.array([r.whitened for r in got]).reshape(-1, k)
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-8
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_whitening(spark, parts):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 20)) @ rng.normal(size=(20, 20))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist()) for i in range(80)]  # a hot vector
    rows += [(2000, None), (2001, [None, *base[0][1:].tolist()]), (2002, [float("nan"), *base[0][1:].tolist()]), (2003, [float("inf"), *base[0][1:].tolist()])]
    check_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in NAMES}).repartition(parts), rows)


def test_whitening_awkward_tables(spark):
    make = lambda rows: whitening.whitening_digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == 0
    assert make([(1, [0.5, 1.0])]).count() == 0  # one vector has no variance
    assert make([(1, []), (2, []), (3, None)]).count() == 0
    got = make([(1, [0.5, 1.0]), (2, [0.7, 1.0]), (None, [0.7, 1.0]), (4, [1.0]), (5, [2.0])]).collect()  # one direction varies; two lengths
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 2), (1, 1, 2), (2, 1, 2), (4, 1, 2), (5, 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) for r in got)
    huge = make([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and {r.deviation for r in huge if r.vec_id < 3} == {None}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(np.arange(n, dtype=float)), np.ones((n, n)), np.zeros((n, n)), rng.normal(size=(n, 1)) * 1e-200):
        a = a @ a.T if a.shape[1] == 1 else a + a.T
        values, vectors = whitening.symmetric_qr(a)
        scale = np.abs(a).max() or 1
        assert np.allclose(vectors.T @ np.diag(values) @ vectors, a, atol=1e-12 * scale * n)
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12) and (np.diff(values) <= 1e-12 * scale).all()


def test_moments_merge_as_one():
    rng = np.random.default_rng(9)
    rows = rng.integers(-(1 << 56), 1 << 56, (60, 5))
    whole, merged = whitening.Moments(5), whitening.Moments(5)
    whole.add(rows)
    for part in np.array_split(rows, 7):
        m = whitening.Moments(5)
        m.add(part)
        merged.merge(m)
    assert whole.n == merged.n == 60 and whole.total.tolist() == merged.total.tolist() == [sum(c) for c in zip(*rows.tolist())]
    assert np.allclose(whole.covariance(), merged.covariance()) and np.allclose(whole.covariance(), np.cov(rows.T, bias=True))


# --- trie


def plain_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}
    whole = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(conv.get(c - c % 5, [])[:h] + v[h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, spared, out = {}, {}, collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        spared[p] = sum(spared[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], spared[p], sha] += 1
    return out


TURNS = "conv_id long, turn long, role string, text string"


def check_trie(spark, rows, chunk=3, parts=3):
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in NAMES}).repartition(parts)
    got = trie.trie_nodes(frame, chunk)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == plain_trie(rows)


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_trie(spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rng = random.Random(ranges)
        for lengths, texts in (([3], ["x"]), ([0, 1, 2, 9, 12], ["x"]), ([1, 2, 5, 20], ["x", "x", "x", "yé", None])):
            check_trie(spark, [(c, t, "u", rng.choice(texts)) for c in range(150) for t in range(rng.choice(lengths))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_awkward_rows(spark):
    assert trie.trie_nodes(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 2, "user", ""), (None, 1, "user", "lost"), (6, 5, "a", "z" * 300_000), (7, 5, "a", "z" * 300_000)]
    rows += [(9, t, "u", f"turn {t}") for t in range(3000)] + [(9_000_000_000, 1, "u", "big id")] + [(c, 0, "u", "same") for c in range(20, 60)]
    check_trie(spark, rows)
    check_trie(spark, rows, chunk=1000, parts=1)


def test_common_turns():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(2))
        b = a[: rng.randrange(len(a) + 1)] + b
        wide = lambda x: b"".join(bytes([c]) * trie.WIDTH for c in x)
        assert trie.common_turns(wide(a), wide(b)) == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


# --- sketches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def check_components(spark, rows, parts=4):
    got = sketch_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in NAMES}).repartition(parts)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(rng, n, size, most):
    """n edited copies of a text of `size` words; up to `most` words of each are other words."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(size)] = f"v{rng.randrange(10**6)}"
        yield " ".join(own)


def test_sketch_components(spark, monkeypatch):
    monkeypatch.setattr(sketch_dedup, "SALT", 8)  # many units a group
    rng = random.Random(6)
    texts = [t for n, size, most in ((90, 60, 9), (40, 30, 3), (60, 100, 14), (10, 3, 1)) for t in family(rng, n, size, most)]
    texts += ["", None, " \t", "one", "ONE", "É one", "é one", texts[0].upper(), texts[5], texts[5], "a b a b a b", "A B A", "long " * 60_000]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[60]), (3, texts[60]), (None, "nobody's own words here"), (None, "nobody's own words here")]
    check_components(spark, rows)
    assert sketch_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 5, 100, 3000)]
    got = sketch_dedup.sketches(sets)
    assert (got < np.iinfo(np.uint64).max).all() and ((got >> np.uint64(32)) < 2 * sketch_dedup.COORDINATES).all()
    assert (sketch_dedup.sketches(sets[2:3]) == got[2]).all()  # whatever it is batched with
    whole = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    shares = []
    for _ in range(40):
        other = np.sort(np.concatenate((rng.permutation(whole)[:450], rng.integers(0, 1 << 63, 50).astype(np.uint64))))
        a, b = sketch_dedup.sketches([whole, other])
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 450 / 550) < 0.02 and np.std(shares) < 0.05


def test_visits_find_what_no_lead_links():
    """Texts apart from their lead, but similar to each other, are linked through the unit's residents."""
    rng = random.Random(1)
    base = [rng.randrange(1 << 63) for _ in range(100)]
    sets = {k: np.unique(np.array(base[k * 3 : k * 3 + 80], np.uint64)) for k in range(7)}
    visits = sketch_dedup.Visits()
    lead = np.unique(np.array(base, np.uint64))
    rows = [(1, 0, lead)] + [(k, 1, s) for k, s in sets.items()] + [(k, 2, s) for k, s in sets.items()]
    out = visits([9] * len(rows), [1] * len(rows), [0] * len(rows), [r[1] for r in rows], [r[0] for r in rows], [r[2].tobytes() for r in rows])
    more = visits.flush()
    edges = [*zip(*out), *zip(*more)]
    similar = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
    assert edges and all(similar(a, b) for a, b in edges)
    top = {k: k for k in sets}
    for a, b in edges:
        top = {k: (min(top[a], top[b]) if t in (top[a], top[b]) else t) for k, t in top.items()}
    assert len(set(top.values())) == 1


def test_met_joins_hot_and_other_keys(spark, monkeypatch):
    monkeypatch.setattr("weftgraph.llm.common.HOT", 10)
    rows = [(1, i) for i in range(100)] + [(k, k) for k in range(2, 20)] + [(None, 5), (99, 6)]
    left = spark.createDataFrame(rows, "k long, x long")
    facts = spark.createDataFrame([(k, f"f{k}", 100 if k == 1 else 1) for k in range(1, 20)], "k long, f string, weight long")
    for how in ("left", "inner"):
        want = collections.Counter((k, x, f"f{k}" if k and k < 20 else None) for k, x in rows if how == "left" or (k and k < 20))
        assert collections.Counter(map(tuple, met(left, facts, ["k"], "weight", how).select("k", "x", "f").collect())) == want


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_sketch_dedup", "base_op11_whitening"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    try:
        for t in ("documents", "conversations", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    except duckdb.IOException:
        pytest.skip("the driver's tables are not here")
    mine = entry.queries()[name](spark, data)
    theirs = c.execute(entry.oracle_sql()[name])
    assert [d[0] for d in theirs.description] == mine.columns
    assert collections.Counter(map(tuple, mine.collect())) == collections.Counter(theirs.fetchall())
