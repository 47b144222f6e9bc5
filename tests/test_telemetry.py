import datetime as dt

from pyspark.sql import functions as F

from weftgraph.operators import store as S
from weftgraph.operators import telemetry as T


def test_gap_is_strict(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 7), (2, t + dt.timedelta(seconds=60), 7), (3, t + dt.timedelta(seconds=121), 7)]
    got = T.session_sizes(spark.createDataFrame(rows, "seq long, ts timestamp, session long"), 60).orderBy("sid").collect()
    assert [r.n for r in got] == [2, 1]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)], "k string, v long")
    assert T.upper_median(df, "k", "v").first()["median"] == 3


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, x string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, x string, seq int")
    assert {r.id: r.x for r in S.upsert(old, new, "id").collect()} == {1: "a", 2: "c", 3: "d"}


CALLS = "session long, seq long, ts timestamp, tool string, decision string, path string, command string, would_have long, injected long"


def calls(spark, *rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(1, i, t + dt.timedelta(seconds=i), *r) for i, r in enumerate(rows)], CALLS)


def test_buckets_are_exclusive(spark):
    got = T.buckets(calls(spark, ("Grep", "deny", None, None, 400, 50), ("Read", "deny", "p1", None, 200, 40), ("Read", "passthrough", "p2", None, 120, None), ("Read", "deny", "p1", None, 200, 40)))
    b = got.first()
    assert (b.intercepted, b.packet, b.passed, b.dedup, b.dedup_cost, b.calls, b.events) == (600, 90, 120, 200, 40, 3, 4)
    curve = {r.p: r for r in T.p_curve(got).collect()}
    assert [round(curve[p].reduction, 3) for p in (0.0, 0.5, 1.0)] == [70.833, 29.167, -12.5]
    assert curve[0.0].tokens == 210 and curve[0.0].break_even == 0.85 and round(curve[0.0].session_reduction, 3) == 72.826


def test_buckets_of_incomplete_calls(spark):
    b = T.buckets(calls(
        spark, ("Read", "deny", "p", None, None, 5), ("Read", "deny", "p", None, 100, None), ("Read", None, "p", None, 70, 3), ("Read", None, None, None, 10, 1), ("Read", None, None, None, 10, 1),
        ("Bash", "deny", None, None, 50, 1), ("Bash", "deny", None, "", 50, 1), ("Bash", "deny", None, "grep x", 50, 2), ("Bash", "allow", None, "ls", 7, 2), ("Edit", "deny", "p", None, 99, 1), (None, "deny", "p", None, 99, 1),
    )).first()
    # The first read of p has no cost, so the second one is the first that counts; a missing packet costs the whole.
    assert (b.intercepted, b.packet, b.passed, b.dedup, b.dedup_cost) == (150, 102, 27, 70, 70)
    assert (b.calls, b.bash_counted, b.bash_skipped, b.events) == (2, 1, 2, 11)


def test_log_summary_of_incomplete_rows(spark):
    rows = [("PreToolUse", "Read", "deny", 5), ("PostToolUse", "Read", "deny", -3), (None, None, None, None), ("PreToolUse", "Read", "allow", 2), ("PreToolUse", "Grep", "deny", None)]
    log = spark.createDataFrame(rows, "event string, tool string, decision string, displaced long").withColumn("ts", F.lit("2024-01-01"))
    counts = {(r.dimension, r.value): r.n for r in T.count_by(log, "event", "tool", "decision").collect()}
    assert counts == {("event", "PreToolUse"): 3, ("event", "PostToolUse"): 1, ("event", "unknown"): 1, ("tool", "Read"): 3, ("tool", "Grep"): 1, ("tool", "unknown"): 1, ("decision", "deny"): 3, ("decision", "allow"): 1}
    t = T.log_totals(log).first()
    assert (t.rows, t.read_denies, t.est_tokens, t.displaced) == (5, 1, 1200, 7)


def test_tuning_names_silent_providers(spark):
    rows = [("PreToolUse", "deny", "structure", 0.8)] * 19 + [("PreToolUse", "deny", None, None), ("PostToolUse", "deny", "git", 0.1), ("PreToolUse", "allow", "team", 0.1)]
    log = spark.createDataFrame(rows, "event string, decision string, provider string, confidence double")
    got = {r.provider: (r.hits, r.proposal, r.budget) for r in T.hit_rates(log).collect()}
    assert got == {"structure": (19, "raise", 240)} | {p: (0, "disable", 200) for p in ("mistakes", "git", "mempalace", "context7", "obsidian")}
    assert T.hit_rates(log.limit(19)).count() == 0
    assert [(r.proposed, r.n) for r in T.threshold_proposal(log).collect()] == [(0.8, 19)]
    assert T.threshold_proposal(log, now=0.75).count() == 0 and T.threshold_proposal(log.limit(9)).count() == 0
