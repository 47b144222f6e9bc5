"""Keeping a graph up to date: what changed, what is extracted again, what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(known: DataFrame, now: DataFrame, prune: bool = True) -> DataFrame:
    """(file, action) of known(file, mtime) against now(file, mtime): index what is new or changed, skip what is not, and
    prune what is gone (an initial run prunes nothing)."""
    both = known.select("file", F.col("mtime").alias("old")).join(now.select("file", "mtime"), "file", "full")
    action = F.when(F.col("mtime").isNull(), "prune").when(F.col("mtime").eqNullSafe(F.col("old")), "skip").otherwise("index")
    got = both.select("file", action.alias("action"))
    return got if prune else got.filter("action <> 'prune'")


def synced(nodes: DataFrame, edges: DataFrame, actions: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges after the actions(file, action): those of indexed and pruned files go, with the edges that touch
    them; of the new rows the indexed files' come in their place."""
    gone = actions.filter("action IN ('index', 'prune')").select(F.col("file").alias("source_file"))
    fresh = actions.filter("action = 'index'").select(F.col("file").alias("source_file"))
    old = nodes.join(gone, "source_file", "left_semi").select("id")
    left = edges.join(old.withColumnRenamed("id", "source"), "source", "left_anti").join(old.withColumnRenamed("id", "target"), "target", "left_anti")
    come = new_nodes.join(fresh, "source_file", "left_semi")
    own = come.select(F.col("id").alias("source"))
    return nodes.join(gone, "source_file", "left_anti").unionByName(come.select(*nodes.columns)), left.select(*edges.columns).unionByName(new_edges.join(own, "source", "left_semi").select(*edges.columns))


def initial(known_nodes: DataFrame, known: DataFrame, files: DataFrame, extract) -> DataFrame:
    """Nodes after a run over files(file, mtime, ...): extract(files) is asked for new and changed ones alone, whose old
    nodes are cleared; the others stay, those of files that are gone too."""
    again = files.join(changes(known, files, prune=False).filter("action = 'index'").select("file"), "file", "left_semi")
    kept = known_nodes.join(again.select(F.col("file").alias("source_file")), "source_file", "left_anti")
    return kept.unionByName(extract(again).select(*known_nodes.columns))


def rebuilt_calls(cache: DataFrame, files: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """(refs, cache): refs(file, name, pos) of all files(file, mtime, ...), those of cached (file, mtime) taken from the
    cache(file, mtime, refs array), the others' from parse(files) -> (file, name, pos).  Equal to parsing everything."""
    hit = files.join(cache, ["file", "mtime"]).select("file", "mtime", "refs")
    miss = files.join(cache.select("file", "mtime"), ["file", "mtime"], "left_anti")
    made = parse(miss).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("refs"))
    empty = F.array().cast(made.schema["refs"].dataType)
    fresh = miss.select("file", "mtime").join(made, "file", "left").withColumn("refs", F.coalesce("refs", empty))
    whole = hit.unionByName(fresh)
    return whole.select("file", F.explode("refs").alias("r")).select("file", "r.name", "r.pos"), whole
