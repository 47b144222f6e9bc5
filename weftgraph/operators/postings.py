"""A stored search index over labels and ids: postings of runs of GRAM letters, kept up by upserts and deletes.

`base` holds a row for each run, field and node, laid out in folders by the run's hash and sorted by run inside, so a search
opens the folders of its own runs alone and Parquet's statistics skip the rest of each file.  Changes go to a small
`delta`, with the changed nodes' ids in `gone`: their rows in base no longer count.  compact() merges them.
All of it is one TableSet, so a search sees the index before a change or after it.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .containment import GRAM
from .tables import TableSet

SPREAD = 8  # files of a bucket at most


def bucket(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram) % buckets).cast("int")


def postings(nodes: DataFrame, buckets: int) -> DataFrame:
    """(gram, field, id, bucket): the runs of GRAM letters of nodes' labels (field 0) and ids (1), in lower case."""
    fields = F.posexplode(F.array(F.lower("label"), F.lower("id"))).alias("field", "text")
    starts = F.sequence(F.lit(1), F.length("text") - GRAM + 1)
    runs = F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("text", i, F.lit(GRAM)))))
    return nodes.select("id", fields).filter(F.length("text") >= GRAM).select(runs.alias("gram"), "field", "id").withColumn("bucket", bucket(F.col("gram"), buckets))


class SearchIndex:
    """buckets: more of them for more labels; an index keeps those it was built with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.tables, self.buckets = spark, TableSet(spark, path), buckets

    def _laid_out(self, base: DataFrame) -> DataFrame:
        return base.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram")

    def build(self, nodes: DataFrame) -> None:
        rows = postings(nodes, self.buckets)
        self.tables.commit({"base": self._laid_out(rows), "delta": rows.limit(0), "gone": nodes.select("id").limit(0)}, layout={"base": ["bucket"]})

    def change(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Nodes(id, label) that are new or changed, and nodes(id) that are gone."""
        now = self.tables.version()
        read = lambda name: self.tables.read(name, now.number)
        ids = [df.select("id") for df in (upserts, deletes) if df is not None]
        if not ids:
            return
        touched = (ids[0] if len(ids) == 1 else ids[0].union(ids[1])).distinct()
        delta = read("delta").join(touched, "id", "left_anti").select("gram", "field", "id", "bucket")
        if upserts is not None:
            fresh = upserts if deletes is None else upserts.join(deletes.select("id"), "id", "left_anti")
            delta = delta.union(postings(fresh, self.buckets))
        self.tables.commit({"delta": delta, "gone": read("gone").union(touched).distinct()}, now)

    def compact(self) -> None:
        now = self.tables.version()
        every = self._live(now.number, None)
        self.tables.commit({"base": self._laid_out(every), "delta": every.limit(0), "gone": self.tables.read("gone", now.number).limit(0)}, now, layout={"base": ["bucket"]})

    def _live(self, number: int, grams: list[str] | None) -> DataFrame:
        """The rows that count, of some runs alone where these are given."""
        cols = ["gram", "field", "id", "bucket"]

        if grams is None:
            base, delta = self.tables.read("base", number), self.tables.read("delta", number)
        else:
            own = sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})
            base = self.tables.read("base", number, [f"bucket={b}" for b in own]).filter(F.col("gram").isin(*grams))
            delta = self.tables.read("delta", number).filter(F.col("gram").isin(*grams))
        return base.join(self.tables.read("gone", number), "id", "left_anti").select(*cols).union(delta.select(*cols))

    def ids(self, text: str) -> DataFrame:
        """id of the nodes whose label or id holds all runs of text: those that hold text, and a few more to be compared.
        A text shorter than a run is looked for in the runs, which reads all of them."""
        low, now = text.lower(), self.tables.version().number
        if len(low) < GRAM:
            return self._live(now, None).filter(F.col("gram").contains(low)).select("id").distinct()
        grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        held = self._live(now, grams).groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"))
        return held.filter(F.col("n") == len(grams)).select("id").distinct()

    def search(self, nodes: DataFrame, text: str, k: int | None = 20) -> DataFrame:
        """store.search by the index: nodes whose label or id holds text, in either case, the most asked for first.  Labels
        shorter than a run are not in the index: a text that short also looks at these."""
        low = text.lower()
        holds = F.lower("label").contains(low) | F.lower("id").contains(low)
        found = nodes.join(self.ids(text), "id", "left_semi")
        if len(low) < GRAM:
            short = (F.length("label") < GRAM) | (F.length("id") < GRAM)
            found = found.filter(~short).union(nodes.filter(short))
        found = found.filter(holds)
        if k is None:
            return found
        order = [F.desc("query_count")] if "query_count" in nodes.columns else []
        return found.orderBy(*order, "id").limit(k)
