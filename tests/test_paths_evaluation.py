import math

from pyspark.sql import functions as F

from weftgraph.operators import evaluation as E
from weftgraph.operators import paths as P


def generator(seed):
    """mulberry32, step by step, as a brute-force version."""
    mask, a = 0xFFFFFFFF, seed
    while True:
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ a >> 15) * (a | 1)) & mask
        t = ((t + (((t ^ t >> 7) * (t | 61)) & mask)) & mask) ^ t
        yield (t ^ t >> 14) / 4294967296


def linear(values, p):
    at = p * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def test_generator_draws_by_number(spark):
    got = [r[0] for r in spark.range(500).select(E.mulberry32(7, F.col("id")).alias("x"), "id").orderBy("id").collect()]
    want = generator(7)
    assert got == [next(want) for _ in range(500)]


def test_bootstrap_equals_a_loop(spark):
    values = [float(i * i % 17) for i in range(23)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(3)
    row = E.bootstrap(df, "id", "v", rounds=200).first()
    draw = generator(1)
    means = sorted(sum(values[int(next(draw) * 23)] for _ in range(23)) / 23 for _ in range(200))
    assert row["n"] == 23 and math.isclose(row["mean"], sum(values) / 23)
    assert math.isclose(row["lo"], linear(means, 0.025), abs_tol=1e-9) and math.isclose(row["hi"], linear(means, 0.975), abs_tol=1e-9)


def test_bootstrap_of_no_and_one_cluster(spark):
    none = spark.createDataFrame([], "id long, v double")
    assert E.bootstrap(none, "id", "v", rounds=5).first()[1:] == (None, None, 0)
    one = E.bootstrap(spark.createDataFrame([(1, 4.0)], "id long, v double"), "id", "v", rounds=5).first()
    assert tuple(one) == (4.0, 4.0, 4.0, 1)


def test_reach_of_paths(spark):
    paths = ["src/foo.ts", "src/foo.test.ts", "tests/foo.spec.ts", "lib/foo.test.ts", "a.ts", "b.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {tuple(r) for r in P.counterparts(files).collect()} == {
        ("src/foo.ts", "src/foo.test.ts"), ("src/foo.test.ts", "src/foo.ts"), ("src/foo.ts", "tests/foo.spec.ts"), ("tests/foo.spec.ts", "src/foo.ts"),
    }
    assert ("a.ts", "b.ts") in {tuple(r) for r in P.siblings(files).collect()}
    assert {r[0] for r in files.filter(P.is_source(F.col("path"))).collect()} == {"src/foo.ts", "a.ts", "b.ts"}


def test_retrieval(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query long, item string")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 9)], "query long, item string, place int")
    got = {r["query"]: (r["hits"], r["recall"], r["reciprocal_rank"]) for r in E.retrieval(gold, ranked, 5).collect()}
    assert got == {1: (1, 0.5, 0.5), 2: (0, 0.0, 0.0)}
