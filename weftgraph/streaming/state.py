"""Keyed state machines over streams: reads that a session had, and quiet times of a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.guard import MOST_KEPT, TTL_MS, read_again
from ..ship import ship

SERVED = "session long, seq long, again boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(stream: DataFrame) -> DataFrame:
    """stream, once its session keeps state in RocksDB, which map state, timers and expiry need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    ship(stream.sparkSession)
    return stream


class ServedReads(StatefulProcessor):
    """What a session has noted: one entry a path, which the store drops ttl_ms after it was written.

    At most MOST_KEPT entries are read at the beginning of a batch, and those that changed are written at its end.  A
    batch's reads of a session are put in the order of (at, seq) first; the trigger's size bounds them.
    """

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.noted = handle.getMapState("noted", "path string", "mtime long, size long, at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(map(int, v)) for k, v in self.noted.iterator()}
        now, out = dict(before), []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples(index=False):
            if r.reset:
                now.clear()
            else:
                out.append((key[0], r.seq, read_again(now, r.path, int(r.mtime), int(r.size), int(r.at))))
        for path in before.keys() - now.keys():
            self.noted.removeKey((path,))
        for path, version in now.items():
            if before.get(path) != version:
                self.noted.updateValue((path,), version)
        yield pd.DataFrame(out, columns=["session", "seq", "again"])

    def close(self) -> None:
        pass


def served_stream(reads: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """(session, seq, again) of a stream of reads(session, seq, at ms, path, mtime, size, reset).

    An entry counts for TTL_MS of the reads' own time; the store drops it ttl_ms after it was written, so that a
    session that ended leaves nothing behind (a replay slower than its log serves such paths anew).  What reads(…) are answered
    equals guard.served_reads if batches come in the order of time.
    """
    return _keyed(reads).groupBy("session").transformWithStateInPandas(ServedReads(ttl_ms), SERVED, "append", "processingTime")


class Quiet(StatefulProcessor):
    """Events of a key that are not yet decided; each is given on if none follows it within wait_ms.

    One timer a key is set wait_ms after its first undecided event.  Once the watermark has passed a time, no event from
    before can come any more, so what lies wait_ms before it is given on or dropped, and the timer moves on.  A key holds its
    events of the watermark's delay and wait_ms.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ms array<long>, seq array<long>")

    def _known(self) -> dict[int, int]:
        if not self.open.exists():
            return {}
        ms, seq = self.open.get()
        return dict(zip(map(int, ms), map(int, seq)))

    def _keep(self, known: dict[int, int]) -> None:
        if not known:
            return self.open.clear()
        self.handle.registerTimer(min(known) + self.wait_ms)
        return self.open.update((list(known), list(known.values())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        if known:
            self.handle.deleteTimer(min(known) + self.wait_ms)
        for batch in rows:
            for ms, seq in batch.groupby("ms")["seq"].max().items():
                known[int(ms)] = max(int(seq), known.get(int(ms), int(seq)))
        self._keep(known)
        yield self._told([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sure, known, out = timerValues.getCurrentWatermarkInMs() - self.wait_ms, self._known(), []
        times = sorted(known)
        for ms, later in zip(times, [*times[1:], None]):
            if ms > sure:
                break
            if later is None or later - ms >= self.wait_ms:
                out.append((key[0], ms, known[ms]))
            del known[ms]
        self._keep(known)
        yield self._told(out)

    def _told(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "ms", "seq"]).astype({"key": str, "ms": "int64", "seq": "int64"})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, wait_ms: int = 300, late: str = "10 seconds") -> DataFrame:
    """(key, ms, seq) of those events of a stream(key, ts timestamp, seq) that no other of their key follows within wait_ms.

    Batches may cut a burst anywhere, and events may come late by `late`; of events at one time (in ms) the greatest
    seq counts.  What is quiet is told once the watermark is wait_ms past it.
    """
    own = events.select(F.col("key").cast("string").alias("key"), "ts", F.unix_millis("ts").alias("ms"), F.col("seq").cast("long").alias("seq"))
    return _keyed(own.withWatermark("ts", late)).groupBy("key").transformWithStateInPandas(Quiet(wait_ms), "key string, ms long, seq long", "append", "eventTime")
