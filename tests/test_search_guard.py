import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import extract as EX
from weftgraph.operators import containment as C
from weftgraph.operators import guard as GU
from weftgraph.operators import incremental as I
from weftgraph.operators import postings as PO
from weftgraph.operators import reports as P
from weftgraph.operators import search as S
from weftgraph.operators import store as ST
from weftgraph.plans import every
from weftgraph.sources import files as FI
from weftgraph.streaming import logs, state

NODE = "id string, label string, kind string, source_file string, confidence_score double, metadata string, query_count long"


def graph(spark, seed=1, n=40, m=90):
    rng = random.Random(seed)
    kinds = ["function", "class", "concept", "concept", "mistake"]
    nodes = [(f"n{i:02d}", f"label {i}", kinds[i % 5], f"src/f{i % 6}.ts", 0.5 + i % 5 / 10, '{"subkind":"keyword"}' if i % 10 == 2 else '{"subkind":"skill"}' if i % 10 in (3, 7) else "{}", i % 7) for i in range(n)]
    edges = sorted({(f"n{rng.randrange(n + 3):02d}", f"n{rng.randrange(n):02d}", rng.choice(["calls", "triggered_by", "similar_to"])) for _ in range(m)})
    return nodes, edges, spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "source string, target string, relation string")


def steps(nodes, edges):
    """From each node where an edge leads: (other, relation, source, target), sorted."""
    known, keyword = {n[0] for n in nodes}, {n[0] for n in nodes if n[2] == "concept" and "keyword" in n[5]}
    out = {}
    for s, t, r in edges:
        for a, b in {(s, t), (t, s)}:
            if a in known and b in known and (r != "triggered_by" or a in keyword):
                out.setdefault(a, []).append((b, r, s, t))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("depth", [1, 3])
def test_walk_against_a_loop(spark, depth):
    nodes, edges, n, e = graph(spark)
    seeds = ["n00", "n02"]
    seen, taken = S.walk(n, e, spark.createDataFrame([(x,) for x in seeds], "id string"), depth)
    visited, front, want, level = set(seeds), set(seeds), [], dict.fromkeys(seeds, 0)
    go = steps(nodes, edges)
    for d in range(1, depth + 1):
        new = set()
        for a in front:
            for b, r, s, t in go.get(a, ()):
                if b not in visited:
                    new.add(b)
                    want.append((s, t, r, d))
        level |= dict.fromkeys(new, d)
        visited |= new
        front = new
    assert {r.id: r.level for r in seen.collect()} == level
    assert sorted(tuple(r) for r in taken.collect()) == sorted(want)


def test_depth_first_against_a_loop(spark):
    nodes, edges, n, e = graph(spark, 5)
    got = [tuple(r) for r in S.depth_first(n, e, spark.createDataFrame([("n00",), ("n13",)], "id string"), 2).orderBy("place").collect()]
    go, visited, want = steps(nodes, edges), {"n00", "n13"}, [("n00", 0, None, None, None), ("n13", 0, None, None, None)]
    stack = [("n13", 0), ("n00", 0)]
    while stack:
        at, d = stack.pop()
        if d > 2:
            continue
        for b, r, s, t in go.get(at, ()):
            if b not in visited:
                visited.add(b)
                stack.append((b, d + 1))
                want.append((b, d + 1, s, t, r))
    assert [x[1:] for x in got] == want and max(x[2] for x in got) == 3  # one level beyond the depth
    lone = S.depth_first(n, e.limit(0), spark.createDataFrame([("n00",)], "id string"), 2).collect()
    assert [(r.id, r.level) for r in lone] == [("n00", 0)]
    with pytest.raises(ValueError, match="depth-first"):
        S.depth_first(n, e, spark.createDataFrame([("n00",)], "id string"), 2, most=1)


def test_shown_order(spark):
    nodes = [("hub", "hub()", "function", "a.ts", 0.9, "{}", 0), ("x", "x()", "function", "a.ts", 0.9, "{}", 0), ("y", "y()", "function", "b.ts", 0.9, "{}", 0), ("m", "m" * 600, "mistake", "b.ts", 0.6, "{}", 0)]
    nodes += [("k", "key", "concept", "", 0.9, '{"subkind":"keyword"}', 0), ("s1", "skill 1", "concept", "", 0.9, '{"subkind":"skill"}', 0), ("s2", "skill 2", "concept", "", 0.9, '{"subkind":"skill"}', 0)]
    edges = [("x", "hub", "calls"), ("y", "hub", "calls"), ("k", "s1", "triggered_by"), ("s1", "s2", "similar_to"), ("x", "s1", "similar_to")]
    got = S.shown(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "source string, target string, relation string"), spark.createDataFrame([("x",)], "id string")).collect()
    lines = [r.line for r in sorted(got, key=lambda r: (["mistake", "node", "edge"].index(r.section), r.place))]
    assert lines[0].startswith("  - mmm") and lines[0].endswith("… (from b.ts) [confidence 0.60]") and len(lines[0]) < 560
    assert [x.split()[1] for x in lines if x.startswith("NODE")][:3] == ["x()", "skill", "hub()"] and not any("key" in x for x in lines)
    assert [x for x in lines if x.startswith("EDGE")] == ["EDGE x() --calls--> hub()", "EDGE x() --similar_to--> skill 1", "EDGE y() --calls--> hub()"]


def test_keyword_choice_against_a_loop(spark):
    import math

    labels = ["authService", "auth flow", "cache store", "cache warm", "store", "graph", "the graph store", "ab"] + [f"common{i}" for i in range(20)]
    prompts = [(1, 0, "why does the auth cache fail"), (1, 1, "the common thing"), (2, 0, "graph"), (2, 1, "zzz yyy xxx"), (3, 0, "graph store auth cache warm flow authservice"), (3, 1, None), (4, 0, "common common1 graph")]
    nodes = spark.createDataFrame([(str(i), x) for i, x in enumerate(labels)], "id string, label string")
    got = {(r.conv_id, r.turn): r.keywords for r in S.keyword_choice(spark.createDataFrame(prompts, "conv_id long, turn long, text string"), nodes).collect()}
    from weftgraph.functions import text as X

    want = {}
    for c, t, p in prompts:
        words = [w for w in dict.fromkeys(__import__("re").split("[^a-z0-9_]+", (p or "").lower())) if len(w) >= 3 and w not in X.STOPWORDS]
        df = {w: sum(w in x.lower() for x in labels) for w in words}
        idf = {w: round(math.log(len(labels) / n), 8) if n else 0 for w, n in df.items()}
        if len(words) >= 2 and max(idf.values()) >= 1.386:
            want[c, t] = sorted((w for w in words if idf[w] > 0), key=lambda w: (-idf[w], words.index(w)))[:5]
    assert got == want and len(want) >= 3


def plain_served(reads):
    noted, out = {}, {}
    for session, seq, at, path, mtime, size, reset in sorted(reads, key=lambda r: (r[2], r[1])):
        own = noted.setdefault(session, {})
        if reset:
            own.clear()
            continue
        had = own.get(path)
        again = bool(had) and had[:2] == (mtime, size) and size >= 400 and at - had[2] < 1_800_000
        if not again:
            own[path] = (mtime, size, at)
            if len(own) > 256:
                del own[min(own, key=lambda p: (own[p][2], p))]
        out[session, seq] = again
    return out


def test_served_reads(spark, tmp_path):
    rng = random.Random(3)
    reads, at = [], 0
    for i in range(1500):
        at += rng.choice([1, 1000, 60_000, 400_000])
        reads.append((rng.randrange(3), i, at, f"p{rng.randrange(8) if i < 700 else rng.randrange(600)}", rng.randrange(2), rng.choice([100, 4000]), rng.random() < 0.01))
    schema = "session long, seq long, at long, path string, mtime long, size long, reset boolean"
    want = plain_served(reads)
    frame = spark.createDataFrame(reads, schema)
    assert {(r.session, r.seq): r.again for r in GU.served_reads(frame.repartition(4)).collect()} == want and any(want.values())
    # As a stream, in three batches, with the state kept between them.
    got = {}
    for low in (0, 500, 1000):
        frame.filter(F.col("seq").between(low, low + 499)).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        out = logs.drained(state.served_stream(logs.log_stream(spark, str(tmp_path / "log"), schema)), str(tmp_path / "out"), empty_batches=False)
        got = {(r.session, r.seq): r.again for r in out.collect()}
    assert got == want


def test_warning_rows_and_text(spark):
    day = GU.DAY
    cols = "seq long, id string, label string, source_file string, last_verified long, then_believed string, found_false_at long, truth_now string, applies_to string"
    rows = [(1, "a", "A", "f.ts", 3 * day, None, None, None, None), (2, "b", "B", "g.ts", 10 * day, "old", 2 * day, None, "the cache")]
    rows += [(3, f"m{i}", f"M{i}", "h.ts", i * day, None, None, None, None) for i in range(7)]
    warned = GU.warnings(spark.createDataFrame(rows, cols), 10 * day)
    got = sorted((r.seq, r.place, r.id, r.what, r.age, r.found_false, r.believed, r.more) for r in warned.collect())
    assert got[0] == (1, 1, "a", "A", "7d ago", None, None, 0) and got[1] == (2, 1, "b", "the cache", "today", "1970-01-03", "old", 0)
    assert [g[2] for g in got[2:]] == ["m6", "m5", "m4", "m3", "m2"] and {g[-1] for g in got[2:]} == {2}
    text = {r.seq: r.text for r in GU.told(warned).collect()}
    assert text[2] == "the cache in g.ts, last seen today; believed: old; found false on 1970-01-03" and text[3].endswith("\n2 further ones") and text[3].count("\n") == 5
    assert {r.decision for r in GU.warnings(spark.createDataFrame(rows, cols), 0, strict=True).collect()} == {"deny"}
    ages = spark.createDataFrame([(-1,), (0,), (day,), (29 * day,), (65 * day,)], "ms long").select(GU.age(F.col("ms")).alias("a")).collect()
    assert [r.a for r in ages] == ["unknown", "today", "yesterday", "29d ago", "2mo ago"]


def test_only_sure_and_valid_mistakes_warn(spark):
    cols = "id string, source_file string, metadata string, valid_until long, confidence_score double"
    rows = [("ok", "src/a.ts", '{"commandPattern":"make all"}', None, 0.8), ("late", "src/a.ts", "{}", 101, 0.9), ("gone", "src/a.ts", "{}", 100, 1.0), ("unsure", "src/a.ts", "{}", None, 0.79), ("short", "a.ts", '{"commandPattern":"make"}', None, 1.0)]
    own = spark.createDataFrame(rows, cols)
    files = spark.createDataFrame([("./src/a.ts",), ("src/b.ts",)], "path string")
    assert sorted(r.id for r in GU.by_file(own, files, 100).collect()) == ["late", "ok"]
    commands = spark.createDataFrame([(1, "MAKE ALL"), (2, "vim SRC/a.ts"), (3, "make a.ts"), (3, None), (4, "vim src/a.ts; make all")], "seq long, command string")
    assert sorted((r.seq, r.id) for r in GU.by_command(own, commands, 100).collect()) == [(1, "ok"), (2, "late"), (2, "ok"), (4, "late"), (4, "ok")]


@pytest.mark.parametrize("plan", ["automaton", "grams", "chosen by size"])
def test_containment_against_brute_force(spark, plan):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [(i if i % 9 else None, word(rng.randrange(60))) for i in range(200)] + [(500, None), (501, ""), (502, "x" * 10_000 + "needle"), (3, "abcabc"), (3, "abcabc")]
    patterns = [word(rng.randrange(1, 6)) for _ in range(150)] + ["needle", "abc", "bca", "abcabc", "x" * 9_000, "", None, "nowhere"]
    if plan == "grams":
        patterns = [p for p in patterns if p and len(p) >= C.GRAM]
    want = collections.Counter((i, p) for i, t in texts if t for p in {p for p in patterns if p} if p in t)
    left, right = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    if plan == "automaton":
        got = C.contained(left, right)
    elif plan == "grams":
        got = C.by_grams(left, right.distinct())
    else:
        got = C.contained(left, right, most_letters=10)
    assert collections.Counter((r.id, r.pattern) for r in got.collect()) == want and len(want) > 100


def test_labels_of_any_shape_are_named(spark):
    texts = spark.createDataFrame([(1, "see Mistake 3 of f1!"), (2, "THE CACHE is stale"), (3, "nothing"), (4, None)], "id long, text string")
    labels = spark.createDataFrame([("mistake 3 of f1",), ("the Cache",), (None,)], "label string")
    assert {r.id: r.named for r in GU.named(texts, labels).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_rebuilt_calls_equal_a_cold_rebuild(spark):
    parsed = []

    def parse(files):
        parsed.append(sorted(r.file for r in files.collect()))
        return files.select("file", F.posexplode(F.split("text", " ")).alias("pos", "name")).filter("name <> ''")

    one = spark.createDataFrame([("a", 1, "x y"), ("b", 1, "z"), ("c", 1, "")], "file string, mtime long, text string")
    two = spark.createDataFrame([("a", 2, "x w"), ("b", 1, "z"), ("d", 1, "q"), ("c", 1, "")], "file string, mtime long, text string")
    empty = spark.createDataFrame([], "file string, mtime long, refs array<struct<pos:int,name:string>>")
    _, cache = I.rebuilt_calls(empty, one, parse)
    warm, _ = I.rebuilt_calls(cache, two, parse)
    cold, _ = I.rebuilt_calls(empty, two, parse)
    assert sorted(warm.collect()) == sorted(cold.collect()) and parsed[1] == ["a", "d"]


def test_front_matter_and_shell():
    text = "---\nname: 'it''s'\n# note\ndescription: |\n  a\n\n  b\nmeta:\n  v: \"1\\n\"\n---\nUse when the build breaks, badly.\nSay “run it now” or \"no\".\n## Related Skills\n- one-two\n* `Three`\n- one-two\n\n## Next\n- four\n"
    fields, body = EX.front_matter(text)
    assert fields == {"name": "it's", "description": "a\n\nb", "meta": {"v": "1\n"}} and body.startswith("Use when")
    assert EX.triggers(body) == ["run it now", "the build breaks, badly"] and EX.related_skills(body) == ["one-two", "three"]
    assert EX.front_matter("---\n- no key\n---\nx") == (None, "x") and EX.front_matter("no front") == (None, "no front") and EX.front_matter("---\nopen") == (None, "---\nopen")
    reads = {"cat a.ts": "a.ts", "head -5 a": None, " cat a": None, "cat a b": None, "cat $(x)": None, "less 'a'": None, "": None, None: None, "more x/y.md": "x/y.md", "cat " + "x" * 300: None}
    assert {c: EX.read_path(c) for c in reads} == reads
    greps = {"rg foo": "foo", "grep -rn 'foo' src": "foo", "grep -l foo": None, "rg -A 3 foo": None, "rg -e foo": "foo", "rg -e -v": None, "rg --color --regexp a b": "a", "egrep": None, "grep a | wc": None, "rg --max foo": None}
    assert {c: EX.grep_pattern(c) for c in greps} == greps
    ops = {"rm -rf a b": [("prune", "a"), ("prune", "b")], "mv a b": [("prune", "a"), ("reindex", "b")], "cp -r a b": [("reindex", "b")], "mv a": [], "git rm x": [("prune", "x")], "git add x": [], "git rm": [], "echo a > b.ts": [("reindex", "b.ts")], "rm a; ls": [], "rm $(x)": [], "ls": [], "rm a*": []}
    assert {c: EX.file_ops(c) for c in ops} == ops


def test_python_symbols_and_json():
    names, calls = EX.python_symbols("import os\nclass A:\n    def m(self):\n        def inner():\n            deep()\n        return os.path.join(f())\nasync def g():\n    await h()\nx()\n")
    assert [(n, k) for n, k, _, _ in names] == [("A", "class"), ("m", "method"), ("inner", "function"), ("g", "function")]
    assert {(o, c) for o, c, _ in calls} == {("inner", "deep"), ("m", "join"), ("m", "f"), ("g", "h"), ("", "x")} and EX.python_symbols("def (") == ([], [])
    assert EX.canonical({"b": [1.0, -0.0, 1e21, 1.5e-7, 1e-7, 0.1, True, None], "a": {"é": "\n\"", "Z": 10}}) == '{"a":{"Z":10,"é":"\\n\\""},"b":[1,0,1e+21,1.5e-7,1e-7,0.1,true,null]}'
    with pytest.raises(ValueError, match="finite"):
        EX.canonical(float("nan"))


def test_spliced_and_rotated(spark, tmp_path):
    block = f"{P.START}\nnew\n{P.END}"
    assert P.spliced("", "new") == block + "\n" and P.spliced("a\n", "new") == f"a\n\n{block}\n"
    assert P.spliced(f"a\n{P.START}\nold\n{P.END}\nb", "new") == f"a\n{block}\nb"
    fenced = f"```\n{P.START}\n{P.END}\n```"
    assert P.spliced(fenced, "new") == f"{fenced}\n\n{block}\n" and P.spliced(f"{P.START} x", "new").startswith(f"{P.START} x\n\n")
    at = str(tmp_path / "log")
    for i in range(3):
        FI.append_log(spark.createDataFrame([(i,)], "i long").coalesce(1), at, most_bytes=15)  # a row has 8 bytes
    assert sorted(r.i for r in spark.read.json(at).collect()) == [2] and sorted(r.i for r in spark.read.json(at + ".1").collect()) == [0, 1]
    assert FI.log_lines(spark, "i long", str(tmp_path / "none")).count() == 0 and FI.whole(spark, str(tmp_path / "none")).count() == 0


def test_index_equals_the_scan_after_changes(spark, tmp_path):
    rng, word = random.Random(4), lambda n: "".join(rng.choice("abcdEF-") for _ in range(n))
    cols = "id string, label string, query_count long"
    nodes = {f"n:{i}": (word(rng.randrange(1, 9)), rng.randrange(5)) for i in range(150)}
    frame = lambda ids: spark.createDataFrame([(i, *nodes[i]) for i in ids], cols)
    index = PO.SearchIndex(spark, str(tmp_path / "index"), buckets=16)
    index.build(frame(nodes))

    def same():
        own = frame(nodes)
        for text in ("abc", "e", "n:1", "abcd"):
            got, want = index.search(own, text, 30), ST.search(own, text, 30)
            assert [r.id for r in got.collect()] == [r.id for r in want.collect()], text

    same()
    changed = rng.sample(sorted(nodes), 40)
    nodes |= {i: (word(8), 9) for i in changed[:20]} | {"n:new": ("abcabc", 1)}
    for i in changed[20:]:
        del nodes[i]
    index.change(frame([*changed[:20], "n:new"]), spark.createDataFrame([(i,) for i in changed[20:]], "id string"))
    same()
    back = changed[20]
    nodes[back] = ("abcd again", 3)
    index.change(frame([back]))
    index.change(deletes=spark.createDataFrame([("n:new",), ("n:none",)], "id string"))
    del nodes["n:new"]
    same()
    index.compact()
    assert index.tables.read("gone").count() == index.tables.read("delta").count() == 0
    same()
    # A search opens the folders of its own runs, and no label.
    opened, every = index.ids("abcd").inputFiles(), index.tables.read("base").inputFiles()
    assert 0 < len(opened) <= 2 + len(index.tables.read("delta").inputFiles()) + len(index.tables.read("gone").inputFiles()) < len(every)
    index.build(frame([]))
    assert index.search(frame([]), "abc").count() == 0


def test_mistakes_are_listed_whatever_their_confidence(spark, tmp_path):
    day = dt.datetime(2024, 1, 7)
    rows = [(k, day, 1, "error", 5.0, f'{{"k":{k}}}') for k in (7, 27, 87)]
    rows += [(10, day - dt.timedelta(days=2), 1, "error", 5.0, '{"k":10}')]  # no longer valid
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(7,), (10,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: [r.id for r in every.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(run("F5_mistakes")) == ["mistake:27", "mistake:7", "mistake:87"]
    assert sorted(run("J14_mistakes_of_files")) == ["mistake:10", "mistake:27", "mistake:7", "mistake:87"]


def test_commands_of_one_text_are_looked_at_once(spark, monkeypatch):
    own = spark.createDataFrame([(f"m{i}", "src/a.ts", None, None, 0.9, i) for i in range(7)], "id string, source_file string, metadata string, valid_until long, confidence_score double, last_verified long")
    own = own.selectExpr("*", "id label", "'b' then_believed", "1L found_false_at", "'t' truth_now", "'w' applies_to")
    commands = spark.range(40).selectExpr("id seq", "'vim src/A.ts' command")
    seen, real = [], GU.contained
    monkeypatch.setattr(GU, "contained", lambda texts, patterns: seen.append(texts.count()) or real(texts, patterns))
    assert GU.by_command(own, commands, 100).distinct().count() == 280
    told = GU.warned(own, commands, 100).collect()
    assert seen == [1, 1] and len(told) == 200 and {r.more for r in told} == {2} and {r.id for r in told} == {"m2", "m3", "m4", "m5", "m6"}


def test_copies_of_mistakes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(GU, "LOT", 3, raising=False)
    own = spark.createDataFrame([(f"m{i}", f"src/f{i % 2}.ts", None, None, 0.9) for i in range(20)], "id string, source_file string, metadata string, valid_until long, confidence_score double")
    commands = spark.range(90).selectExpr("id seq", "concat('vim src/F', id % 3, '.ts') command")
    got = GU.by_command(own, commands, 100)
    assert sorted((r.seq, r.id) for r in got.collect()) == sorted((s, f"m{i}") for s in range(90) for i in range(20) if s % 3 == i % 2)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    tasks = []
    monkeypatch.setattr(GU, "dealt", lambda df, rows, *keys: tasks.append(-(-rows // 5)) or df.repartition(4, *keys))
    monkeypatch.setattr(GU, "ROWS", 5, raising=False)
    many = spark.range(20_000).selectExpr("id seq", "'vim src/f0.ts' command")
    assert GU.by_command(own, many, 100).count() == 200_000 and tasks == [2 * GU.COPIES]
    assert GU.by_command(own, commands.filter("seq < 0"), 100).count() == 0
    nameless = own.union(own.filter("id = 'm0'").withColumn("id", F.lit(None).cast("string")))
    assert sorted((r.seq, r.id or "") for r in GU.by_command(nameless, commands.filter("seq = 3"), 100).collect()) == sorted([(3, "")] + [(3, f"m{i}") for i in range(0, 20, 2)])
