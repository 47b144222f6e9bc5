"""Graph operators over nodes(id, label, kind, source_file) and edges(source, target, relation, ...).

Neighbour lookups are equi-joins on one endpoint after laying both directions side by side; nothing
joins on an OR of endpoints.  Iterative operators write each round where the caller's checkpoint
folder is, so lineage stays short.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_GODS = ("file", "import", "module", "concept")


def endpoints(edges: DataFrame) -> DataFrame:
    """(id, other, relation) for both directions; a self-loop appears once."""
    fwd = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "relation")
    back = edges.filter("source <> target").select(F.col("target").alias("id"), F.col("source").alias("other"), "relation")
    return fwd.unionAll(back)


def neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Neighbours of ids(id) with their nodes; edges to missing nodes vanish."""
    near = endpoints(edges).join(ids, "id", "left_semi")
    return near.join(nodes.withColumnRenamed("id", "other"), "other").select("id", "other", "relation", "label", "kind")


def god_nodes(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The nodes of most edges; ties by id."""
    degree = endpoints(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    own = nodes.filter(~F.col("kind").isin(*NOT_GODS))
    return own.join(degree, "id").orderBy(F.desc("degree"), "id").limit(n).select("id", "label", "kind", "degree")


def subgraph_degree(edges: DataFrame) -> DataFrame:
    """Degrees in which a self-loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written below the folder that spark.checkpoint.dir names and read again: lineage is cut, a lost
    executor costs no recomputation, and (unlike checkpoint()) it is computed once.  Where the folder is unset and
    everything runs in one process (tests), one of our own; on a cluster that is an error, for executors share no local
    folder.  The table goes when the driver's process ends."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        sc = spark.sparkContext
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not getattr(sc, "_weftgraph_ckpt", None):
            sc._weftgraph_ckpt = tempfile.mkdtemp(prefix="weftgraph-ckpt-")
        top = sc._weftgraph_ckpt
    path = f"{top}/weftgraph-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the context is gone: nothing can be reached any more
        pass


def bfs_levels(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, level): how far the nodes lie from the seeds(id), over links(a, b) in both directions."""
    both = checkpointed(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = seeds.select("id").distinct().withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        front = seen.filter(F.col("level") == level - 1).select(F.col("id").alias("a"))
        new = both.join(front, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = checkpointed(seen.unionAll(new.withColumn("level", F.lit(level))))
    return seen


def closure(links: DataFrame, start: DataFrame) -> DataFrame:
    """(origin, id): all that links(a, b) reach from start(origin), however far, the origin left out."""
    links = checkpointed(links.distinct())
    seen = start.select("origin", F.col("origin").alias("id")).distinct()
    front = seen
    while True:
        new = front.join(links, front["id"] == links["a"]).select("origin", F.col("b").alias("id")).distinct().join(seen, ["origin", "id"], "left_anti")
        front = checkpointed(new)
        if not front.limit(1).count():
            break
        seen = checkpointed(seen.unionAll(front))
    return seen.filter("origin <> id")


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, rounds: int = 20, damping: float = 0.85, ids: DataFrame | None = None) -> DataFrame:
    """(id, rank) for edges(a, b, weight): personalised on seeds(id) if given; ids(id) are further nodes.

    Self-loops and weights of 0 or less are dropped, parallel edges add up, ranks start as the teleport
    vector, and the rank of nodes without out-edges goes to the teleport vector.  A round reads the ranks once:
    its flow is written to the checkpoint folder, and what the flow lacks of 1 is the hanging nodes' rank.
    """
    kept = edges.filter("a <> b AND weight > 0").groupBy("a", "b").agg(F.sum("weight").alias("w"))
    total = kept.groupBy("a").agg(F.sum("w").alias("t"))
    share = checkpointed(kept.join(total, "a").select("a", "b", (F.col("w") / F.col("t")).alias("p")))
    known = edges.select(F.col("a").alias("id")).union(edges.select("b"))
    known = (known.union(ids.select("id")) if ids is not None else known).distinct()
    own = seeds.select("id", F.lit(1).alias("s")).distinct() if seeds is not None else known.select("id", F.lit(1).alias("s"))
    base = known.join(own, "id", "left").select("id", F.coalesce("s", F.lit(0)).alias("s"))
    n = base.agg(F.sum("s")).first()[0] or 1
    base = checkpointed(base.select("id", (F.col("s") / n).alias("tele")))
    rank = base.withColumn("rank", F.col("tele"))
    for _ in range(rounds):
        flow = checkpointed(rank.join(share, rank["id"] == share["a"]).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow")))
        lost = 1 - (flow.agg(F.sum("flow")).first()[0] or 0.0)
        rank = base.join(flow, "id", "left").select("id", "tele", (F.lit(1 - damping) * F.col("tele") + F.lit(damping) * (F.coalesce("flow", F.lit(0.0)) + F.lit(lost) * F.col("tele"))).alias("rank"))
    return rank.select("id", "rank")


def shortest_path(links: DataFrame, source, target, hops: int = 8) -> DataFrame:
    """(step, id): one shortest undirected path, parents being the least ids; empty beyond hops."""
    spark = links.sparkSession
    kind = links.schema["a"].dataType
    both = checkpointed(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(None).cast(kind).alias("parent"))
    front, found = seen, source == target
    for _ in range(hops):
        if found:
            break
        new = both.join(front.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent")).join(seen, "id", "left_anti")
        front = checkpointed(new)
        seen = checkpointed(seen.unionAll(front))
        found = front.filter(F.col("id") == target).limit(1).count() > 0
    path, at = [], target if found else None
    while at is not None:  # at most hops + 1 lookups
        path.append(at)
        at = seen.filter(F.col("id") == at).first()["parent"]
    rows = [(i, x) for i, x in enumerate(reversed(path))]
    return spark.createDataFrame(rows, f"step int, id {kind.simpleString()}")


def related_files(adjacent: DataFrame, co_change: DataFrame, counterparts: DataFrame, siblings: DataFrame, k: int = 10) -> DataFrame:
    """Tiered related files: frames (focal, file, rank) in tier order; a file's first tier wins."""
    from pyspark.sql import Window

    tiers = [df.select("focal", "file", "rank", F.lit(i).alias("tier")) for i, df in enumerate((adjacent, co_change, counterparts, siblings), 1)]
    all_ = tiers[0].unionAll(tiers[1]).unionAll(tiers[2]).unionAll(tiers[3]).filter("focal <> file")
    best = all_.groupBy("focal", "file").agg(F.min(F.struct("tier", "rank")).alias("m")).select("focal", "file", "m.*")
    w = Window.partitionBy("focal").orderBy("tier", "rank", "file")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("focal", "file", "tier", "place")
