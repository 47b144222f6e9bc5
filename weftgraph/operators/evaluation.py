"""Retrieval figures, linear percentiles and a seeded cluster bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

MASK = 0xFFFFFFFF
MOST_SENT = 2_000_000


def retrieval(gold: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """query, n_gold, hits, recall, reciprocal_rank of `ranked` (query, item, place from 1) against `gold` (query, item)."""
    found = gold.join(ranked, ["query", "item"], "left")
    got = found.groupBy("query").agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(F.col("place") <= k).alias("hits"), F.min("place").alias("first"))
    return got.select("query", "n_gold", "hits", (F.col("hits") / F.col("n_gold")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def percentiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    return df.groupBy(by).agg(*(F.percentile(value, s).alias(f"p{round(s * 100)}") for s in shares))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without passing 63 bits."""
    high = F.shiftrightunsigned(a, 16) * b
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def mulberry32(seed: int, nth: Column) -> Column:
    """The nth (from 0) number in [0, 1) of the public-domain mulberry32 generator. Its state is a
    counter, so any draw is computed by itself, in any task."""
    a = (F.lit(seed & MASK) + _times((nth + 1).bitwiseAND(F.lit(MASK)), F.lit(0x6D2B79F5))).bitwiseAND(F.lit(MASK))
    t = _times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = ((t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK))).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def numbered(df: DataFrame, *order) -> tuple[DataFrame, int]:
    """Rows with their number in the order (`at`, from 0), and their count. Rows are sorted into ranges and
    each range numbers its own, so no window runs over all of them; a count a range goes to the driver."""
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offset = F.create_map(*(F.lit(x) for pair in starts for x in pair)) if starts else F.create_map(F.lit(0), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("at", (offset[F.col("_range")] + nth).cast("long")).drop("_range"), total


def bootstrap(clusters: DataFrame, order: str, value: str, rounds: int = 2000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """mean, lo, hi, n: mean of `value` over clusters and its interval by drawing clusters with replacement.

    Clusters are numbered in the order of `order`. `rounds` times n draws are made in tasks and joined to
    the values by number. No cluster: null bounds; a single one: its value."""
    own, n = numbered(clusters.select(order, value), order)
    draws = clusters.sparkSession.range(rounds * n).select(F.expr(f"id div {max(n, 1)}").alias("round"), F.floor(mulberry32(seed, F.col("id")) * n).cast("long").alias("at"))
    # MOST_SENT values take some 50 MB; more are met by a shuffle of the draws.
    means = draws.join(F.broadcast(own.select("at", value)) if n <= MOST_SENT else own, "at").groupBy("round").agg(F.avg(value).alias("m"))
    bounds = means.agg(F.percentile("m", alpha / 2).alias("lo"), F.percentile("m", 1 - alpha / 2).alias("hi"))
    whole = clusters.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return whole.crossJoin(bounds).select("mean", "lo", "hi", "n")  # a row by a row


def holdout(commits: DataFrame, folders: DataFrame, newest: int = 600, share: float = 0.7, k: int = 10) -> DataFrame:
    """(predictor, trials, recall) of four ways to foretell a commit's other files from one of them.

    The newest commits(commit, ts, file) are split by time.  Co-change and popularity learn from the older share;
    paths come from folders(file, folder, pair): the file's pair first, then its folder; `combined` is co-change and
    then paths.  recall: the mean over test files of the share of the commit's other files among the first k.
    """
    heads = commits.select("commit", "ts").distinct().orderBy(F.desc("ts"), F.desc("commit")).limit(newest)
    placed = checkpointed(heads.withColumns({"rn": F.row_number().over(Window.orderBy("ts", "commit")), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))}))  # `newest` rows
    own = checkpointed(commits.select("commit", "file").distinct().join(placed, "commit"))
    cut = F.floor(F.col("n") * share)
    train, test = own.filter(F.col("rn") <= cut).select("commit", "file"), own.filter(F.col("rn") > cut).select("commit", F.col("file").alias("query"))
    gold = test.join(test.withColumnRenamed("query", "item"), "commit").filter("query <> item")
    trials = gold.groupBy("commit", "query").agg(F.count(F.lit(1)).alias("gold"))
    place = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    pairs = train.withColumnRenamed("file", "query").join(train.withColumnRenamed("file", "item"), "commit").filter("query <> item")
    co = pairs.groupBy("query", "item").agg(F.count(F.lit(1)).alias("c")).select("query", "item", place(F.desc("c"), "item").alias("place"))
    asked = trials.select("query").distinct()
    most = train.groupBy("file").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "file").limit(k + 1)
    popular = asked.crossJoin(F.broadcast(most)).filter("query <> file").select("query", F.col("file").alias("item"), place(F.desc("c"), "file").alias("place"))  # k + 1 rows
    known = folders.join(own.select("file").distinct(), "file", "left_semi")
    a = known.join(asked.withColumnRenamed("query", "file"), "file").select(F.col("file").alias("query"), "folder", "pair")
    near = a.join(known.select(F.col("file").alias("item"), "folder", F.col("pair").alias("other")), "folder").filter("query <> item")
    path = near.select("query", "item", place(F.when(F.col("pair") == F.col("other"), 0).otherwise(1), "item").alias("place"))
    both = co.withColumn("tier", F.lit(0)).unionByName(path.withColumn("tier", F.lit(1))).groupBy("query", "item").agg(F.min(F.struct("tier", "place")).alias("m"))
    ranked = {"co_change": co, "path": path, "combined": both.select("query", "item", place("m.tier", "m.place", "item").alias("place")), "popularity": popular}
    out = None
    for name, r in ranked.items():
        hits = gold.join(r.filter(F.col("place") <= k), ["query", "item"]).groupBy("commit", "query").agg(F.count(F.lit(1)).alias("hits"))
        got = trials.join(hits, ["commit", "query"], "left").agg(F.count(F.lit(1)).alias("trials"), F.avg(F.coalesce("hits", F.lit(0)) / F.col("gold")).alias("recall")).withColumn("predictor", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def traces(calls: DataFrame, top: int = 15, reads: int = 5) -> DataFrame:
    """(session, seq, tool, path, ts) of what an agent does for the `top` symbols of most callers: a search, its callers'
    files one by one (at most `reads`), and the first of them once more."""
    n = calls.groupBy("callee").agg(F.countDistinct("caller").alias("n")).orderBy(F.desc("n"), "callee").limit(top)
    files = calls.join(F.broadcast(n.select("callee")), "callee", "left_semi").select("callee", "caller").distinct()
    nth = F.row_number().over(Window.partitionBy("callee").orderBy("caller"))
    few = files.withColumn("nth", nth).filter(F.col("nth") <= reads).groupBy("callee").agg(F.sort_array(F.collect_list("caller")).alias("files"))
    event = lambda tool, path: F.struct(F.lit(tool).alias("tool"), path.alias("path"))
    text = F.transform("files", lambda f: f.cast("string"))
    steps = F.concat(F.array(event("Grep", F.col("callee").cast("string"))), F.transform(text, lambda f: event("Read", f)), F.array(event("Read", F.get(text, F.lit(0)))))
    told = few.select(F.col("callee").alias("session"), F.posexplode(steps).alias("seq", "e"))
    return told.select("session", "seq", "e.tool", "e.path", F.timestamp_seconds(F.col("seq") * 60).alias("ts"))


def reduction(tasks: DataFrame, base: str, packet: str, target: float = 85.0) -> DataFrame:
    """Of all tasks together the share of tokens saved, in percent, and whether it meets the target."""
    got = tasks.agg(F.sum(base).alias("b"), F.sum(packet).alias("p"), F.count(F.lit(1)).alias("tasks"))
    saved = F.when(F.col("b") == 0, 0.0).otherwise((F.col("b") - F.col("p")) / F.col("b") * 100)
    return got.select("tasks", F.round(saved, 6).alias("percent"), (saved >= target).alias("met"))
