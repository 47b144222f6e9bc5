import datetime as dt
import random
import time

from pyspark.sql import functions as F

from weftgraph.operators import guard as GU
from weftgraph.operators import telemetry as T
from weftgraph.streaming import logs, state


def test_stream_sessions_equal_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=m), s, 1) for i, (s, m) in enumerate([(1, 0), (1, 10), (1, 100), (2, 5), (2, 600)])]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, session long, saved long")
    df.coalesce(1).write.json(str(tmp_path / "log"))
    got = logs.sessions(logs.log_stream(spark, str(tmp_path / "log"), df.schema))
    q = got.writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = sorted((r.session, r.n) for r in spark.table("s").collect())
    assert streamed == sorted((r.session, r.n) for r in T.session_sizes(df, 1800).collect())


READS = "session long, seq long, at long, path string, mtime long, size long, reset boolean"


def test_state_entries_expire(spark, tmp_path):
    """A path read again is known, unless its entry was dropped from the store (here after a second)."""

    def answers(name, ttl_ms, pause):
        got = {}
        for i in range(2):
            spark.createDataFrame([(1, i, 1000 + i, "p", 1, 4000, False)], READS).coalesce(1).write.mode("append").json(str(tmp_path / name))
            out = logs.drained(state.served_stream(logs.log_stream(spark, str(tmp_path / name), READS), ttl_ms), str(tmp_path / f"{name}-out"), empty_batches=False)
            got = {r.seq: r.again for r in out.collect()}
            time.sleep(pause)
        return got

    assert answers("kept", 600_000, 0) == {0: False, 1: True}
    assert answers("gone", 1000, 2.5) == {0: False, 1: False}


def test_a_long_session_streams_through_one_small_state(spark):
    """A session of 200,000 reads: the answers of a loop, one path at a time."""
    n = 200_000
    reads = spark.range(n).selectExpr("1 session", "id seq", "id * 10 at", "concat('p', id % 300) path", "0 mtime", "4000 size", "false reset")
    # 300 paths in turn: MOST_KEPT = 256 entries never hold one until it comes again.
    assert GU.served_reads(reads).filter("again").count() == 0
    few = reads.withColumn("path", F.expr("concat('p', id % 200)".replace("id", "seq")))
    last, again = {}, 0
    for i in range(n):
        hit = i % 200 in last and i * 10 - last[i % 200] < 1_800_000
        again += hit
        if not hit:
            last[i % 200] = i * 10
    assert GU.served_reads(few).filter("again").count() == again


def test_bursts_cut_by_batches_debounce_as_one(spark, tmp_path):
    rng, t = random.Random(5), dt.datetime(2024, 1, 1)
    rows, ms = [], 0
    for i in range(300):
        ms += rng.choice([0, 1, 100, 299, 300, 301, 5000])
        rows.append((f"k{rng.randrange(3)}", ms, i))
    want = set()
    for k in ("k0", "k1", "k2"):
        newest = {}
        for key, at, seq in rows:
            if key == k:
                newest[at] = max(seq, newest.get(at, -1))
        times = sorted(newest)
        want |= {(k, a, newest[a]) for a, b in zip(times, [*times[1:], None]) if b is None or b - a >= 300}
    got = None
    for part in (rows[:100], rows[100:200], rows[200:], [("", ms + 60_000, 0)]):
        frame = spark.createDataFrame([(k, t + dt.timedelta(milliseconds=a), s) for k, a, s in part], "key string, ts timestamp, seq long")
        frame.repartition(2).write.mode("append").json(str(tmp_path / "log"))
        got = logs.drained(state.debounced(logs.log_stream(spark, str(tmp_path / "log"), frame.schema)), str(tmp_path / "out"))
    base = int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert {(r.key, r.ms - base, r.seq) for r in got.collect() if r.key} == want and len(want) > 20
