import threading

import pytest
from pyspark.sql import functions as F

from weftgraph import Graph
from weftgraph.operators import evaluation as E
from weftgraph.operators.providers import Provider, Registry
from weftgraph.operators.store import bulk_upsert, current, opened, swapped
from weftgraph.operators.tables import Conflict, TableSet, migrate

NODES = "id string, label string, kind string, source_file string, confidence_score double, metadata string, query_count long, last_verified long, valid_until long"
ROWS = [
    ("hub", "hub()", "function", "src/hub.ts", 0.9, "{}", 3, 1, None), ("a", "aFn()", "function", "src/a.ts", 0.9, "{}", 0, 1, None), ("b", "bFn()", "class", "src/b.ts", 0.9, "{}", 0, 1, None),
    ("m1", "hub breaks 😀", "mistake", "src/hub.ts", 0.6, "{}", 0, 9, None), ("m2", "old", "mistake", "src/b.ts", 0.6, "{}", 0, 5, None),
]
EDGES = [("a", "hub", "calls", "EXTRACTED"), ("b", "a", "calls", "INFERRED"), ("m1", "hub", "depends_on", "EXTRACTED")]


@pytest.fixture(scope="module")
def own(spark):
    return Graph(spark.createDataFrame(ROWS, NODES), spark.createDataFrame(EDGES, "source string, target string, relation string, confidence string"))


def test_questions(own, spark, tmp_path):
    said = own.query("what about hub")
    assert said.startswith("Known mistakes") and "hub breaks 😀 (from src/hub.ts) [confidence 0.60]" in said and "EDGE aFn() --calls--> hub()" in said
    assert own.query("zzz nothing") == own.query("a b") == "Nothing in the graph matches."
    assert own.query("hub", mode="dfs").count("NODE") == 3
    short = own.query("hub", budget=20)
    assert len(short) <= 80 and short.endswith("tokens]")
    assert [r.label for r in own.gods(2).collect()] == ["aFn()", "hub()"] and own.stats().first().nodes == 5
    assert [r.id for r in own.path("bfn", "hub()").orderBy("step").collect()] == ["b", "a", "hub"] and own.path("zzz", "hub").count() == 0
    assert [r.id for r in own.mistakes().collect()] == ["m1", "m2"] and own.mistakes("src/b.ts", 6).count() == 0
    files = spark.createDataFrame([("src/hub.ts", "x" * 400), ("src/other.ts", "y" * 4000)], "file string, text string")
    row = own.benchmark(files, "hub").first()
    assert (row["all"], row.relevant) == (1100, 100) and row.ratio_all == round(1100 / row.answer, 1)
    assert {r.section for r in own.summary("bug-fix").collect()} == {"mistakes", "gods"}
    own.save(str(tmp_path / "g"))
    again = Graph.open(spark, str(tmp_path / "g"))
    assert again.nodes.count() == 5 and "truth_now" in again.nodes.columns


def test_providers(spark):
    own = Registry()
    own.add(Provider("size", lambda path, c: (f"{path} {c['n']}", 0.5), budget=9))
    own.add(Provider("fails", lambda path, c: (str(1 // 0), 1.0)))
    own.add(Provider("slow", lambda path, c: ("later", 0.1), tier=2))
    for taken in (Provider("git", print), Provider("size", print)):
        with pytest.raises(ValueError, match="provider"):
            own.add(taken)
    asked = spark.createDataFrame([(1, "a.ts", {"n": "1"}), (2, "b.ts", None)], "request long, path string, context map<string,string>")
    assert {(r.request, r.provider, r.content) for r in own.resolved(asked).collect()} == {(1, "size", "a.ts 1"), (1, "slow", "later"), (2, "slow", "later")}
    assert own.resolved(asked, enabled=("slow",), tiers=(1,)).count() == 0 and own.budgets()["size"] == 9


def test_holdout_against_a_loop(spark):
    import random

    rng = random.Random(2)
    commits = [(c, c // 2, f) for c in range(40) for f in {rng.randrange(12) for _ in range(rng.randint(1, 5))}]
    folders = [(f, f % 3, f // 2) for f in range(12)]
    got = {r.predictor: (r.trials, round(r.recall, 9)) for r in E.holdout(spark.createDataFrame(commits, "commit long, ts long, file long"), spark.createDataFrame(folders, "file long, folder long, pair long"), newest=30, k=3).collect()}
    order = sorted({(t, c) for c, t, _ in commits})[-30:]
    files = {c: sorted({f for x, _, f in commits if x == c}) for _, c in order}
    cut = int(len(order) * 0.7)
    train, test = [files[c] for _, c in order[:cut]], [files[c] for _, c in order[cut:]]
    known = {f for x in files.values() for f in x}
    count = lambda f, g: sum(f in x and g in x for x in train)
    co = {f: sorted((g for g in range(12) if g != f and count(f, g)), key=lambda g: (-count(f, g), g)) for f in range(12)}  # noqa: B023
    path = {f: sorted((g for g in known if g != f and g % 3 == f % 3), key=lambda g: (g // 2 != f // 2, g)) for f in range(12)}  # noqa: B023
    pop = sorted({f for x in train for f in x}, key=lambda f: (-sum(f in x for x in train), f))
    rank = {"co_change": co, "path": path, "combined": {f: list(dict.fromkeys([*co[f], *path[f]])) for f in range(12)}, "popularity": {f: [g for g in pop if g != f] for f in range(12)}}
    trials = [(f, [g for g in x if g != f]) for x in test for f in x if len(x) > 1]
    for name, r in rank.items():
        recall = sum(len(set(r[f][:3]) & set(g)) / len(g) for f, g in trials) / len(trials)
        assert got[name] == (len(trials), round(recall, 9)), name


def test_versions_are_swapped(spark, tmp_path):
    at = str(tmp_path / "t")
    assert current(spark, at) is None
    row = lambda i, x: spark.createDataFrame([(i, x)], "id long, x string")
    bulk_upsert(at, row(1, "a").union(row(2, "b")), "id")
    assert {tuple(r) for r in bulk_upsert(at, row(2, "c").union(row(3, "d")), "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    with pytest.raises(Conflict):
        swapped(at, row(9, "late"), TableSet(spark, at).version(1))
    assert current(spark, at).count() == 3
    base = spark.createDataFrame([("i", "l", "k", "f", 5)], "id string, label string, kind string, source_file string, query_count int")
    base.write.parquet(str(tmp_path / "whole"))
    up = opened(spark, str(tmp_path / "whole"))
    assert up.columns[-1] == "applies_to" and up.first().metadata == "{}" and up.first().query_count == 5
    base.drop("kind").write.parquet(str(tmp_path / "n"))
    with pytest.raises(ValueError, match="kind"):
        opened(spark, str(tmp_path / "n"))


def test_a_reader_never_sees_no_table(spark, tmp_path):
    own, stop, seen, wrong = TableSet(spark, str(tmp_path / "set")), threading.Event(), set(), []
    frame = lambda n: spark.range(n).select(F.col("id"))
    own.commit({"nodes": frame(1), "edges": frame(1)})

    def reader():
        while not stop.is_set():
            try:
                v = own.version()
                sizes = {own.read(t, v.number).count() for t in ("nodes", "edges")}
                seen.add(v.number)
                wrong.extend([sizes] if sizes != {v.number} else [])
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    t = threading.Thread(target=reader)
    t.start()
    for n in range(2, 12):
        own.commit({"nodes": frame(n), "edges": frame(n)})
    stop.set()
    t.join()
    assert not wrong and len(seen) > 1 and own.version().number == 11
    with pytest.raises(Conflict):
        own.commit({"nodes": frame(99)}, base=own.version(10))
    assert own.read("nodes").count() == 11 and own.read("nodes", 3).count() == 3
    assert own.restore(4).number == 12 and own.read("edges").count() == 4
    assert own.vacuum(2) == 18 and own.numbers() == [11, 12] and own.read("nodes").count() == 4
    with pytest.raises(ValueError, match="keeps no version"):
        own.restore(3)


def test_schema_up_and_down(spark, tmp_path):
    own = TableSet(spark, str(tmp_path / "set"))
    assert migrate(own) == (10, 0) and own.version().schema == 10
    assert set(own.version().tables) == {"nodes", "edges", "stats", "provider_cache", "config", "query_cache", "pattern_cache", "co_change"}
    assert {"valid_until", "applies_to"} <= set(own.read("nodes").columns) and own.read("co_change").columns == ["file_a", "file_b", "count"]
    assert migrate(own) == (0, 1) and own.version().number == 1  # nothing to do
    row = spark.createDataFrame([("a", "A", "file", "f", 3)], "id string, label string, kind string, source_file string, query_count long")
    own.commit({"nodes": row, "co_change": spark.createDataFrame([("x", "y", 2)], "file_a string, file_b string, count long")}, schema=10)
    steps, backup = migrate(own, 5)
    assert (steps, backup) == (5, 2) and set(own.version().tables) == {"nodes", "edges", "stats", "provider_cache"}
    assert own.read("nodes").first().query_count == 3
    assert migrate(own, 10)[0] == 5 and own.read("co_change").count() == 0 and own.read("nodes").first().then_believed is None
    own.restore(backup)
    assert own.read("co_change").first()["count"] == 2
    assert migrate(own, 0)[0] == 10 and own.version().tables == {}
    for wrong in (-1, 11):
        with pytest.raises(ValueError, match="no schema"):
            migrate(own, wrong)
