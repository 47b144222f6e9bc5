"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Sources get weights in turn, share 150 % of all words by weight, and stop at twice their own size, the
excess going to the others.  Every source's documents stand in a fixed random order (a 64-bit hash)
that is cut into 256 blocks by the hash's first byte; whole epochs of a source are taken as often as
its target holds them, and of one more epoch the blocks, and in the last block the documents, up to
the target.  The cut is found by descending the hash byte by byte, with 256 sums for each source and
level, so no task or driver ever holds a source's documents.  The exact numbers of blocks of all
sources are then split among the output shards by a tree: each node draws its left half's share from a
multivariate hypergeometric distribution.  A shard takes its numbers of blocks from the source's
permuted blocks, disjoint from the other shards', and shuffles them locally by a second hash.

Edge cases: null texts have no words; the null source is a source and comes last; sources without words
have target 0; the order is by a hash of doc_id (null too) and text, and of its number for
each further row equal in both, so copies are drawn apart like other documents; other columns are not read; an empty table gives no rows.  The
driver keeps two numbers for each source, and 256 sums for each of at most max_sources of them at a time;
the plan (256 rows a source) is broadcast for max_sources sources, and joined by a shuffle beyond.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, partitions, saved

BLOCKS = 256
SALTS = 64  # stretches in which equal rows are numbered
ORDER_SEED, SHUFFLE_SEED = 7, 11


def targets(sizes: dict, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Words to take of each source: shares by weight, none above most times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, rest, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        rest -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards rows that add up to the quotas, each of nearly the same total."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    draw = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.vstack([split_tree(draw, left, rng), split_tree(quotas - draw, shards - left, rng)])


def _key(c: Column) -> Column:
    """The source as text that is never null: nulls differ from all sources."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def _byte(level: int) -> Column:
    return F.shiftrightunsigned("h", 56 - 8 * level).bitwiseAND(F.lit(255))


def _cuts(sized: DataFrame, sums: dict, rest: dict) -> tuple[dict, dict]:
    """Of each source the hash (as unsigned) below which the last epoch's documents lie, and the words below it."""
    spark = sized.sparkSession
    cut, below, todo = {s: 0 for s in rest}, dict.fromkeys(rest, 0), {s: sums[s] for s in rest if rest[s] > 0}
    for level in range(8):
        nxt = {}
        for s, row in todo.items():
            run = below[s] + np.cumsum(row[:, 0])
            b = int(np.searchsorted(run, rest[s], "right"))  # the first byte that would pass the target
            below[s] = int(run[b - 1]) if b else below[s]
            if b == 256:
                cut[s] += 256 << (56 - 8 * level)
            else:
                cut[s] += b << (56 - 8 * level)
                if row[b, 1] > 1 and level < 7:
                    nxt[s] = cut[s] >> (56 - 8 * level)
        if not nxt:
            break
        at = spark.createDataFrame([(s, _signed(p)) for s, p in nxt.items()], "key string, prefix long")
        got = (
            sized.join(F.broadcast(at), (sized["key"] == at["key"]) & (F.shiftrightunsigned("h", 56 - 8 * level) == at["prefix"]))
            .groupBy(sized["key"], _byte(level + 1).alias("b")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        )
        todo = _sums(got)
    return cut, below


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sums(rows: list) -> dict:
    out: dict = {}
    for key, b, w, n in rows:
        out.setdefault(key, np.zeros((BLOCKS, 2), np.int64))[b] = w, n
    return out


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows(key, h, salt, ...) with another hash for each further row of those that share one: the second, the third, ...

    Rows are numbered in each salt, from where the salts before end, so no task has all copies of a row.
    """
    counts = rows.groupBy("key", "h", "salt").agg(F.count(F.lit(1)).alias("m"))
    before = counts.withColumn("before", F.sum("m").over(Window.partitionBy("key", "h").orderBy("salt")) - F.col("m")).drop("m")  # SALTS rows a hash at most
    nth = F.col("before") + F.row_number().over(Window.partitionBy("key", "h", "salt").orderBy("size"))
    told = rows.join(before, ["key", "h", "salt"]).withColumn("nth", nth)
    return told.withColumn("h", F.when(F.col("nth") > 1, F.xxhash64("h", "nth")).otherwise(F.col("h"))).select(*rows.columns)


def mix(docs: DataFrame, shards: int = 16, seed: int = 1, weights: tuple = (5, 2, 1), share: float = 1.5, max_sources: int = 2000, carry: list[str] | None = None) -> DataFrame:
    """A row for each of docs(doc_id, text, source): doc_id, source, size, source_size, target and
    draws, an array of (epoch, shard, place): the shards that take it and its place in their shuffles.

    carry: columns of docs that come with each row, as the struct `row`."""
    spark = docs.sparkSession
    keys = docs.select("doc_id", "source", *([F.struct(*carry).alias("row")] if carry else []), _key(F.col("source")).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(ORDER_SEED), "doc_id", "text").alias("h"))
    # Equal rows share a hash; which task a row came from is written with it, so that their numbers stay as they are.
    sized = saved(keys.drop("row").withColumn("salt", (F.spark_partition_id() % SALTS).cast("int")))
    if sized.groupBy("key", "h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").head(1):
        keys = _told_apart(saved(keys.withColumn("salt", (F.spark_partition_id() % SALTS).cast("int"))) if carry else sized)
        sized = saved(keys.drop("row"))
    total = {s: int(w) for s, w in sized.groupBy("key").agg(F.sum("size")).collect()}
    aim = targets({(s[1:] if s else None): n for s, n in total.items()}, weights, share)
    aim = {s: aim[s[1:] if s else None] for s in total}
    epochs = {s: int(aim[s] // n) if n else 0 for s, n in total.items()}
    order = sorted(total)
    groups = [order[i : i + max_sources] for i in range(0, len(order), max_sources)]
    cut: dict = {}
    for own in groups:
        part = sized if len(groups) == 1 else sized.join(F.broadcast(spark.createDataFrame([(s,) for s in own], "key string")), "key", "left_semi")
        sums = _sums(part.groupBy("key", _byte(0).alias("b")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect())
        cut |= _cuts(part, sums, {s: aim[s] - epochs[s] * total[s] for s in own})[0]
    last = {s: [b for b in range(BLOCKS) if b << 56 < cut[s]] for s in order}  # blocks that the last epoch reaches
    rng = np.random.default_rng(seed)
    tree = split_tree(np.array([epochs[s] * BLOCKS + len(last[s]) for s in order], np.int64), shards, rng) if order else None
    flip = 1 << 63  # turns unsigned order into signed
    kind = "key string, block int, source_size long, target double, epochs int, cut long, whole boolean, units array<struct<epoch:int,shard:int>>"
    tables, at = [], 0
    for own in groups:
        plan: dict = {(s, b): [] for s in own for b in range(BLOCKS)}
        for i, s in enumerate(own, at):
            units = [(e, b) for e in range(epochs[s]) for b in range(BLOCKS)] + [(epochs[s], b) for b in last[s]]
            shard_of = np.repeat(np.arange(shards), tree[:, i])
            for shard, u in zip(shard_of.tolist(), rng.permutation(len(units)).tolist()):
                e, b = units[u]
                plan[s, b].append((e, shard))
        at += len(own)
        rows = [(s, b, total[s], float(aim[s]), epochs[s], _signed(min(cut[s], (1 << 64) - 1) ^ flip), cut[s] >= 1 << 64, sorted(x)) for (s, b), x in plan.items()]
        tables.append(spark.createDataFrame(rows, kind) if len(groups) == 1 else saved(spark.createDataFrame(rows, kind)))
    table = reduce(DataFrame.union, tables) if tables else spark.createDataFrame([], kind)
    taken = F.filter("units", lambda u: (u["epoch"] < F.col("epochs")) | F.col("whole") | (F.col("h").bitwiseXOR(F.lit(_signed(flip))) < F.col("cut")))
    return (
        (keys if carry else sized).withColumn("block", _byte(0).cast("int")).join(F.broadcast(table) if len(groups) < 2 else table, ["key", "block"])
        .select("doc_id", "source", *(["row"] if carry else []), "size", "source_size", "target", F.transform(taken, lambda u: F.struct(u["epoch"].alias("epoch"), u["shard"].alias("shard"), F.xxhash64(F.lit(SHUFFLE_SEED + seed), "doc_id", "h", u["epoch"]).alias("place"))).alias("draws"))
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.size("draws").cast("long").alias("n_draws"), "draws")


def write_shards(docs: DataFrame, mixed: DataFrame, path: str) -> None:
    """The mix's rows with the columns of docs, one folder a shard, shuffled inside: a shard's files hold
    consecutive stretches of its order, so no task holds a shard.  doc_id must be unique; where it is not, carry
    the columns through mix."""
    drawn = mixed.select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*")
    n = partitions(docs.sparkSession)
    (
        drawn.join(docs, "doc_id").repartitionByRange(n, "shard", "place").sortWithinPartitions("shard", "place")
        .drop("place").write.partitionBy("shard").parquet(path)
    )
