"""What plans must look like to hold at any size."""

import re
import pytest

from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import guard as GU
from weftgraph.operators import mining as M
from weftgraph.operators import search as S
from weftgraph.operators import telemetry as T
from weftgraph.plans import every
from weftgraph.sources import adapters as A


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_a_round_reads_the_ranks_once(spark, monkeypatch):
    leaves, real = [], G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: leaves.append(plan(df).count("Relation [")) or real(df))
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "a string, b string, weight double")
    G.pagerank(real(links), rounds=6)
    rounds = leaves[2:]
    assert len(rounds) == 6 and max(rounds) <= 3 and rounds[1:] == [3] * 5  # base, the last round's flow, share


def test_medians_sort_counts_not_rows(spark):
    text = plan(T.upper_median(spark.range(10).select((F.col("id") % 2).alias("k"), "id"), "k", "id"))
    assert text.index("Window") < text.index("Aggregate")  # the windows stand above the counts


def test_requests_stay_small(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = A.results(spark, str(tmp_path)).groupBy("request").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert tuple(sizes) == (20, 25)


def test_no_cross_products(spark):
    notes = spark.createDataFrame([("m", "x", "mistake", "src/a.ts", '{"commandPattern":"make all"}', None, 0.9)], "id string, label string, kind string, source_file string, metadata string, valid_until long, confidence_score double")
    commands = spark.createDataFrame([(1, "make all")], "seq long, command string")
    prompts = spark.createDataFrame([(1, 0, "graph store")], "conv_id long, turn long, text string")
    for df in (GU.by_command(notes, commands), M.co_change(spark.createDataFrame([(1, "a")], "commit long, file string"))):
        assert not re.search("CartesianProduct|NestedLoop", plan(df, "executedPlan"))
    text = plan(S.keyword_choice(prompts, notes), "executedPlan")
    assert "CartesianProduct" not in text and text.count("NestedLoop") <= 2  # the one row that counts the nodes


def test_scans_are_pruned_and_filtered(spark, tmp_path):
    spark.range(9).selectExpr("cast(id as string) id", "'l' label", "'k' kind", "concat('f', id % 3) source_file", "'x' unused").write.parquet(str(tmp_path / "n"))
    n = spark.read.parquet(str(tmp_path / "n"))
    text = plan(n.filter(F.col("source_file") == "f1").select("id"), "executedPlan")
    assert "EqualTo(source_file,f1)" in text and "unused" not in text and "label" not in text


def test_tasks_grow_with_the_commits(spark, tmp_path):
    """Lines and their pairs are dealt by number, not joined to few tasks because they have few bytes."""
    spark.range(4_000).selectExpr("id div 4 l_orderkey", "id % 97 l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1_000).selectExpr("id o_orderkey", "id o_custkey", "timestamp_seconds(id) o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    for name, n in (("J9_co_change", 16), ("A6_hot_files", 0)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr("weftgraph.deal.ROWS", 1_000)
            m.setattr(type(spark.sparkContext), "defaultParallelism", 1)
            text = plan(every.queries()[name](spark, str(tmp_path)), "executedPlan")
        assert re.search(r"hashpartitioning\(commit#\d+L?, 4\), REPARTITION_BY_NUM", text)
        assert n == 0 or re.search(rf"hashpartitioning\(file_a#\d+L?, file_b#\d+L?, {n}\), REPARTITION_BY_NUM", text)
