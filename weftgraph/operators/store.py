"""Store operators: lookups, upserts, deletes, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import COLUMNS, TABLES, TableSet, Version, completed

ROWS = "rows"  # the one table of a set that is used as a table


def by_id(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.filter(F.col("id") == id_)


def by_file(nodes: DataFrame, file: str, most: int = 500) -> DataFrame:
    return nodes.filter(F.col("source_file") == file).orderBy("id").limit(most)


def search(nodes: DataFrame, text: str, k: int = 20) -> DataFrame:
    """Labels or ids that hold text, in either case; the most asked for first."""
    t = text.lower()
    order = [F.desc("query_count")] if "query_count" in nodes.columns else []
    return nodes.filter(F.lower("label").contains(t) | F.lower("id").contains(t)).orderBy(*order, "id").limit(k)


def mistakes(notes: DataFrame, file: str | None = None, since_ms: int | None = None, as_of_ms: int | None = None, k: int = 20, least: float | None = None) -> DataFrame:
    """Mistakes, newest first: of one file, not older than since_ms, not invalid at as_of_ms, of a confidence of at least `least`."""
    own = notes.filter("kind = 'mistake'")
    if least is not None:
        own = own.filter(F.col("confidence_score") >= least)
    if file is not None:
        own = own.filter(F.col("source_file") == file)
    if since_ms is not None:
        own = own.filter(F.col("last_verified") >= since_ms)
    if as_of_ms is not None:
        own = own.filter(F.col("valid_until").isNull() | (F.col("valid_until") > as_of_ms))
    return own.orderBy(F.desc("last_verified"), "id").limit(k)


def bulk_upsert(path: str, new: DataFrame, *key: str) -> DataFrame:
    """The table at path with new rows in place of those with their key; Conflict if another writer comes between."""
    tables = TableSet(new.sparkSession, path)
    base = tables.version()
    old = tables.read(ROWS, base.number) if base.number else None
    both = new.withColumn("seq", F.lit(1)) if old is None else old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    return swapped(path, upsert(both, both.limit(0), *key).drop("seq"), base)


def swapped(path: str, table: DataFrame, base: Version | None = None) -> DataFrame:
    """A table in the place of the one at path: a reader sees the old table or the new one (see TableSet)."""
    tables = TableSet(table.sparkSession, path)
    return tables.read(ROWS, tables.commit({ROWS: table}, base).number)


def current(spark, path: str) -> DataFrame | None:
    """The table that was swapped in last, or None."""
    return TableSet(spark, path).read(ROWS)


def opened(spark, path: str) -> DataFrame:
    """The nodes table at a path, checked and brought to the newest schema."""
    nodes = spark.read.parquet(path)
    missing = {"id", "label", "kind", "source_file"} - set(nodes.columns)
    if missing:
        raise ValueError(f"{path} is no nodes table: it lacks {', '.join(sorted(missing))}")
    for steps in (TABLES, COLUMNS):
        for _, added in sorted(steps.items()):
            if "nodes" in added:
                nodes = completed(nodes, added["nodes"], spark)
    return nodes


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an endpoint in ids(id), once each."""
    a = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    b = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    return a.select(*edges.columns).unionByName(b).dropDuplicates(["source", "target", "relation"])


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of both with new ones (higher seq) instead of old ones of the same key; both have `seq`."""
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    return old.unionByName(new).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def without_file(df: DataFrame, file: str) -> DataFrame:
    return df.filter(~F.col("source_file").eqNullSafe(F.lit(file)))


def cascade(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Nodes without the file's, and edges without those that touch them."""
    gone = nodes.filter(F.col("source_file") == file).select("id")
    left = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return without_file(nodes, file), left.select(*edges.columns)


def replace_relation(edges: DataFrame, relation: str, new: DataFrame) -> DataFrame:
    return edges.filter(F.col("relation") != relation).unionByName(new)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    share = lambda c: F.floor(F.count_if(F.col("confidence") == c) * 100 / F.greatest(F.count(F.lit(1)), F.lit(1)) + 0.5).cast("long")
    got = edges.agg(F.count(F.lit(1)).alias("edges"), *(share(c).alias(c.lower() + "_pct") for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(got)  # one row by one row


def fresh(as_of_ms: int) -> Column:
    """cached_at (ms) plus ttl (s) lies after as_of."""
    return F.col("cached_at") + F.col("ttl") * 1000 > as_of_ms


def active_mistakes(events: DataFrame, as_of) -> DataFrame:
    """Errors not yet made invalid by the same user's next sign-up."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    until = F.first(F.when(F.col("event_type") == "signup", F.col("ts")), ignorenulls=True).over(w)
    own = events.withColumn("valid_until", until).filter("event_type = 'error'")
    return own.filter(F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(as_of)))
