"""Sets of tables that change together, and the steps of their schema.

A set is a folder: `data` holds tables, each written once and never changed, and `history` a small file for each
version, which names the tables that belong to it and its schema.  A version is there as soon as its file has its
name; renaming a file to a name that is taken fails, so of two writers that start from one version the second one is told,
and a reader sees some version whole at any time.  Older versions stay until vacuum.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    schema: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)  # name -> folder below data, columns
    note: str = ""


class TableSet:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def numbers(self) -> list[int]:
        """The versions that are kept, oldest first."""
        top = self._at(f"{self.path}/history")
        if not self._fs.exists(top):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(top))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest; an empty set has version 0."""
        if number is None:
            number = max(self.numbers(), default=0)
        if number == 0:
            return Version()
        file = self._fs.open(self._at(f"{self.path}/history/{number:012d}.json"))
        try:
            return Version(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")))
        finally:
            file.close()

    def read(self, name: str, number: int | None = None, folders: list[str] | None = None) -> DataFrame | None:
        """A table as of a version, or None; of one that lies in folders, only these (`column=value`), and no other is opened."""
        own = self.version(number).tables.get(name)
        if own is None:
            return None
        # Its columns are told, for a table without rows that lies in folders has no file to ask.
        at, read = f"{self.path}/data/{own[0]}", self.spark.read.schema(StructType.fromJson(json.loads(own[1])))
        if folders is None:
            return read.parquet(at)
        found = [f"{at}/{f}" for f in folders if self._fs.exists(self._at(f"{at}/{f}"))]
        return read.option("basePath", at).parquet(*found) if found else self.spark.createDataFrame([], StructType.fromJson(json.loads(own[1])))

    def commit(self, tables: dict[str, DataFrame | None], base: Version | None = None, schema: int | None = None, note: str = "", layout: dict[str, list[str]] | None = None) -> Version:
        """The version after base (default: the newest) with these tables in place of its own; None takes one out.
        layout: columns by whose values a table's files lie in folders."""
        base = self.version() if base is None else base
        now, written = dict(base.tables), []
        for name, df in tables.items():
            now.pop(name, None)
            if df is not None:
                folder = f"{name}-{uuid.uuid4().hex}"
                now[name] = [folder, df.schema.json()]
                written.append(folder)
                df.write.partitionBy(*(layout or {}).get(name, [])).parquet(f"{self.path}/data/{folder}")
        out = Version(base.number + 1, base.schema if schema is None else schema, now, note)
        try:
            self._publish(out)
        except Conflict:
            for folder in written:
                self._fs.delete(self._at(f"{self.path}/data/{folder}"), True)
            raise
        return out

    def _publish(self, version: Version) -> None:
        body = json.dumps({"number": version.number, "schema": version.schema, "tables": version.tables, "note": version.note})
        temp, name = self._at(f"{self.path}/history/.{uuid.uuid4().hex}"), self._at(f"{self.path}/history/{version.number:012d}.json")
        out = self._fs.create(temp, False)
        out.write(bytearray(body, "utf-8"))
        out.close()
        try:
            self._files.rename(temp, name, self._no_overwrite)
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(name):
                raise Conflict(f"version {version.number} of {self.path} was made by another writer") from e
            raise

    def restore(self, number: int) -> Version:
        """A new version with the tables and schema of a kept one."""
        if number and number not in self.numbers():
            raise ValueError(f"{self.path} keeps no version {number}")
        base, old = self.version(), self.version(number)
        out = Version(base.number + 1, old.schema, dict(old.tables), f"version {number} again")
        self._publish(out)
        return out

    def vacuum(self, keep: int = 2) -> int:
        """Drop all versions but the newest `keep`, and the tables that none of these names; how many tables went.  No
        writer may be at work."""
        kept = self.numbers()[-keep:]
        used = {folder for n in kept for folder, _ in self.version(n).tables.values()}
        for n in self.numbers()[:-keep]:
            self._fs.delete(self._at(f"{self.path}/history/{n:012d}.json"), False)
        top, gone = self._at(f"{self.path}/data"), 0
        for s in self._fs.listStatus(top) if self._fs.exists(top) else ():
            if s.getPath().getName() not in used:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


# What each schema version adds, a table or columns of one, with a column's default.
TABLES = {
    1: {
        "nodes": "id string, label string, kind string, source_file string DEFAULT '', source_location string, confidence string DEFAULT 'EXTRACTED', confidence_score double DEFAULT 1.0, last_verified bigint DEFAULT 0, query_count bigint DEFAULT 0, metadata string DEFAULT '{}'",
        "edges": "source string, target string, relation string, confidence string DEFAULT 'EXTRACTED', confidence_score double DEFAULT 1.0, source_file string DEFAULT '', source_location string, last_verified bigint DEFAULT 0, metadata string DEFAULT '{}'",
        "stats": "key string, value string",
    },
    5: {"provider_cache": "provider string, file_path string, content string, query_used string DEFAULT '', cached_at bigint, ttl bigint DEFAULT 3600"},
    6: {"config": "key string, value string, updated_at bigint"},
    7: {
        "query_cache": "key string, result string, file_path string, file_mtime double, created_at bigint, hit_count bigint DEFAULT 0",
        "pattern_cache": "pattern string, result string, graph_version bigint, hit_count bigint DEFAULT 0",
    },
    10: {"co_change": "file_a string, file_b string, count bigint"},
}
COLUMNS = {8: {"nodes": "valid_until bigint, invalidated_by_commit string"}, 9: {"nodes": "then_believed string, found_false_at bigint, truth_now string, applies_to string"}}
NEWEST = 10


def _columns(spec: str) -> list[tuple[str, str, str]]:
    """(name, type, default) of a list of columns."""
    out = []
    for part in spec.split(", "):
        own, _, default = part.partition(" DEFAULT ")
        name, kind = own.split(" ")
        out.append((name, kind, default or "NULL"))
    return out


def completed(df: DataFrame | None, spec: str, spark: SparkSession) -> DataFrame:
    """df with the columns of a list that it lacks, at their defaults; without df an empty table of them."""
    own = _columns(spec)
    if df is None:
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k, _ in own))
    for name, kind, default in own:
        if name not in df.columns:
            df = df.withColumn(name, F.expr(f"CAST({default} AS {kind})"))
    return df


def migrate(tables: TableSet, to: int = NEWEST) -> tuple[int, int]:
    """Bring a set to a schema, up or down, in one version; (steps taken, version to restore to undo them).

    Up adds the tables and columns that are missing, and leaves what is there.  Down takes out the tables that a step has
    added; columns stay, as rows may need them.  The version before is the backup.
    """
    if not 0 <= to <= NEWEST:
        raise ValueError(f"there is no schema {to}: 0 to {NEWEST}")
    base = tables.version()
    if to == base.schema:
        return 0, base.number
    changed: dict[str, DataFrame | None] = {}
    for step in range(base.schema + 1, to + 1):
        for name, spec in (TABLES.get(step, {}) | COLUMNS.get(step, {})).items():
            now = changed[name] if name in changed else tables.read(name, base.number) if base.number else None
            changed[name] = completed(now, spec, tables.spark)
    for step in range(base.schema, to, -1):
        changed |= dict.fromkeys(TABLES.get(step, {}))
    # Tables that lack nothing are not written again.
    for name in [n for n, df in changed.items() if df is not None and n in base.tables and df.columns == tables.read(n, base.number).columns]:
        del changed[name]
    tables.commit(changed, base, schema=to, note=f"schema {base.schema} to {to}")
    return abs(to - base.schema), base.number
