"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..ship import ship

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker keeps from task to task: the tables of one operator at most.
_RESIDENT: dict = {}


def resident(key: str, build: Callable):
    """build()'s object, kept for the next task with the same key; a new key drops the old object."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def give_back(key: str | None) -> None:
    """Return a worker's unused memory to the system, and the tables of other operators with it."""
    for k in [k for k in _RESIDENT if k != key]:
        del _RESIDENT[k]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def parts(batch: pa.RecordBatch, most_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about most_bytes each; whole if None."""
    rows = max(1, batch.num_rows if most_bytes is None else batch.num_rows * most_bytes // max(1, batch.nbytes))
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def arrow_map(df: DataFrame, make: Callable, schema: str, key: str | None = None, raw: bool = False, most_bytes: int | None = None) -> DataFrame:
    """Batches of df through make()(list, list, ...) -> lists, one for each output column.

    key names the tables that make keeps in the worker (see resident).  raw: Arrow arrays instead of lists
    go in; lists or Arrow arrays come out.  A generator's lists are given on one by one.
    most_bytes: batches are cut into parts of about so many bytes (a row at least), so that lists and output stay small.

    make runs once in each task, so what it returns may keep state between batches.  If what it
    returns has a method flush, its lists follow the last batch.  Never shuffles.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(key)
        f = make()
        to = lambda c, t: c if isinstance(c, pa.Array) and c.type == t else pa.array(c, type=t)
        build = lambda cols: pa.RecordBatch.from_arrays([to(c, t) for c, t in zip(cols, arrow.types)], schema=arrow)
        for b in (part for whole in batches for part in parts(whole, most_bytes)):
            if b.num_rows:
                got = f(*(b.columns if raw else [c.to_pylist() for c in b.columns]))
                yield from map(build, got) if isinstance(got, Iterator) else (build(got),)
        if hasattr(f, "flush"):
            yield build(f.flush())
        del f
        give_back(key)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where it is unset and everything runs in one process
    (tests), one of our own; on a cluster an error, for executors would not share a local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if not one_process(sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(sc, "_weftgraph_dir", None):
        sc._weftgraph_dir = tempfile.mkdtemp(prefix="weftgraph-")
    return sc._weftgraph_dir


def one_process(master: str) -> bool:
    """Whether driver and executors are one process: `local`, `local[n]`, `local[n,m]`, not `local-cluster`."""
    return master == "local" or master.startswith("local[")


def saved(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage is cut, and a lost
    executor costs no recomputation.  The table goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftgraph_path = path
    return out


#: Keys met by more than one in HOT of all rows are broadcast: fewer than HOT of them can be.
HOT = 1000


def met(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows joined (left or inner) to facts, which has one row a key and says (weight) how many rows the key will meet.

    Keys that meet over a thousandth of all rows are broadcast, so no task gets them whole; the others are shuffled.
    facts is read three times: a saved table is best.  The shuffled join merges at every size: what small tables would
    save by a broadcast says nothing of large ones.
    """
    least = (facts.agg(F.sum(weight)).first()[0] or 0) / HOT
    mark, told = "_met", [c for c in facts.columns if c not in (*on, weight)]
    hot = facts.filter(F.col(weight) > least).drop(weight).withColumn(mark, F.lit(True))
    first = rows.join(F.broadcast(hot), on, "left")
    rest = first.filter(F.col(mark).isNull()).drop(mark, *told).join(facts.filter(F.col(weight) <= least).drop(weight).hint("merge"), on, how)
    return first.filter(mark).drop(mark).unionByName(rest)


def freed(df: DataFrame) -> None:
    """Remove the files of a saved table that nothing will read again."""
    if path := getattr(df, "_weftgraph_path", None):
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context is gone: nothing can be reached any more
        pass


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n (null: as of an empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def env_path(name: str) -> str:
    """Place of a public vocabulary file: in the folder that WEFTGRAPH_TOKENIZERS names, else the installed package's."""
    if top := os.environ.get("WEFTGRAPH_TOKENIZERS"):
        return f"{top}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
