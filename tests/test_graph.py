from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import mining as M


def links(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, weight double")


def ranks(spark, rows, seeds=None):
    s = spark.createDataFrame([(x,) for x in seeds], "id string") if seeds else None
    return {r.id: r["rank"] for r in G.pagerank(links(spark, rows), s).collect()}


def test_pagerank_sums_to_one_and_orders(spark):
    r = ranks(spark, [("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0), ("C", "C", 1.0)])
    assert abs(sum(r.values()) - 1) < 1e-9 and r["C"] > r["B"] > r["A"]


def test_pagerank_seed_raises(spark):
    cycle = [("A", "B", 1.0), ("B", "C", 1.0), ("C", "A", 1.0)]
    assert ranks(spark, cycle, ["A"])["A"] > ranks(spark, cycle)["A"]


def test_closure_bfs_path(spark):
    e = links(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0)])
    got = {(r.origin, r.id) for r in G.closure(e.select("a", "b"), spark.createDataFrame([("a",)], "origin string")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d")}
    levels = {r.id: r.level for r in G.bfs_levels(e, spark.createDataFrame([("d",)], "id string"), 2).collect()}
    assert levels == {"d": 0, "c": 1, "a": 2, "b": 2}
    assert [r.id for r in G.shortest_path(e, "b", "d").orderBy("step").collect()] == ["b", "c", "d"]
    assert G.shortest_path(e, "b", "nowhere").count() == 0


def test_degrees_of_self_loop(spark):
    e = spark.createDataFrame([("x", "x", "calls")], "source string, target string, relation string")
    assert G.endpoints(e).count() == 1
    assert G.subgraph_degree(e).first().degree == 2


def test_co_change_counts_distinct_files(spark):
    c = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "commit long, file string")
    got = {(r.file_a, r.file_b): r.n for r in M.co_change(c).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert M.co_change(c.filter(F.lit(False))).count() == 0


def test_related_files_of_every_part(spark, tmp_path):
    import collections

    from weftgraph.plans import registry

    parts = [(i, f"b{i % 3}", i % 2) for i in range(1, 121)]  # groups of 20
    orders = {o: sorted({1 + (o * 7 + j * j * 11) % 120 for j in range(4)} | ({1, 7, 13} if o < 6 else set())) for o in range(40)}
    orders |= {100 + o: [19, *range(1, 110, 6)] for o in range(2)}  # parts whose own group changes with them
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, 1, None) for o in orders], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(o, p) for o, ps in orders.items() for p in ps], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    n = collections.Counter((a, b) for ps in orders.values() for a in set(ps) for b in set(ps) if a != b)
    want = set()
    for i, brand, size in parts:
        co = sorted((-c, b) for (a, b), c in n.items() if a == i and c >= 2)
        near = [(2, b) for _, b in co] + [(4, p) for p, x, y in parts if (x, y) == (brand, size) and p != i and p not in {b for _, b in co}]
        want |= {(i, f, t, place) for place, (t, f) in enumerate(near[:10], 1)}
    got = {tuple(r) for r in registry.queries()["G17_related_files"](spark, str(tmp_path)).select("focal", "file", "tier", "place").collect()}
    assert got == want and len({f for f, *_ in got}) == 120


def test_closure_goes_on_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert G.closure(chain, spark.createDataFrame([(0,)], "origin long")).count() == 60
