from pyspark.sql import functions as F

from weftgraph.functions import parse as Q
from weftgraph.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_identifiers_and_versions(spark):
    assert one(spark, Q.bare_identifier(F.lit("a.b.run(x.y)"))) == "run"
    assert one(spark, Q.bare_identifier(F.lit("a.9b"))) is None
    assert one(spark, Q.semver(F.lit("v1.10.0")) > Q.semver(F.lit("1.9.3")))


def test_markers_skip_fences(spark):
    state = lambda s: one(spark, Q.markers(F.lit(s), "<a>", "</a>"))
    assert [state("x"), state("<a>y</a>"), state("<a>"), state("```<a>```")] == ["none", "balanced", "unbalanced", "none"]


def test_cut_lines(spark):
    assert one(spark, Q.cut_lines(F.lit("abcd\nabcd\nabcd"), 4)) == "abcd\nabcd"
    assert one(spark, Q.cut_lines(F.lit("x" * 100), 4)) == "x" * 16
    assert one(spark, Q.cut_lines(F.lit(None).cast("string"), 4)) is None


def test_entropy_of_a_key(spark):
    assert one(spark, X.entropy(F.lit("abcdefghijklmnop"))) == 4.0
    assert one(spark, X.entropy(F.lit("aaaa"))) == 0.0


def test_json_and_reverts(spark):
    assert one(spark, Q.canonical_json(F.lit('{"b": 2, "a": 1}'))) == '{"a":1,"b":2}'
    assert one(spark, Q.revert_subject(F.lit('revert "x"'))) == "x"
