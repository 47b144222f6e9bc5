"""Mining commits: pairs, hot files, holdout, name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deal import dealt


PAIRS = 4  # that are reckoned with for each file of a commit; with 50 files 24.5 at most


def co_change(commits: DataFrame, most_files: int = 50, rows: int | None = None) -> DataFrame:
    """(file_a, file_b, n): commits(commit, file) that hold both, file_a < file_b.

    Of a commit its first most_files files count (in the order of the column `pos`, else of their names), so a
    huge commit adds a bounded number of pairs.  rows: how many rows commits have, about; the
    pairs are dealt over as many tasks as these ask for.
    """
    order = "pos" if "pos" in commits.columns else "file"
    nth = F.row_number().over(Window.partitionBy("commit").orderBy(order, "file"))
    own = commits.select("commit", "file", *(["pos"] if order == "pos" else [])).dropDuplicates(["commit", "file"]).withColumn("nth", nth)
    files = own.filter((F.col("nth") <= most_files) & F.col("commit").isNotNull() & F.col("file").isNotNull()).groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    each = files.select(F.posexplode("files").alias("at", "file_a"), "files")
    pairs = each.select("file_a", F.explode(F.slice("files", F.col("at") + 2, most_files)).alias("file_b"))
    if rows is not None:
        pairs = dealt(pairs, PAIRS * rows, "file_a", "file_b")
    return pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n"))


def co_change_neighbours(pairs: DataFrame, file, k: int = 10) -> DataFrame:
    own = pairs.filter((F.col("file_a") == file) | (F.col("file_b") == file))
    return own.select(F.when(F.col("file_a") == file, F.col("file_b")).otherwise(F.col("file_a")).alias("file"), "n").orderBy(F.desc("n"), "file").limit(k)


def hot_files(commits: DataFrame, least: int = 5, k: int = 20) -> DataFrame:
    # Commits that come dealt by commit are counted where they are.
    counts = commits.select("commit", "file").filter("commit IS NOT NULL").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("changes"))
    return counts.filter(F.col("changes") >= least).orderBy(F.desc("changes"), "file").limit(k)


def depends_on(pairs: DataFrame, stem=None) -> DataFrame:
    """Inferred edges of pairs seen three times or more, more certain the more often; stem (of a column) gives the
    ends' ids, and pairs whose files have the same one are left out."""
    score = F.round(F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.05) * F.col("n")), 4)
    ends = [(stem or (lambda c: c))(F.col(c)) for c in ("file_a", "file_b")]
    got = pairs.filter("n >= 3").select(ends[0].alias("source"), ends[1].alias("target"), score.alias("confidence_score"))
    return got.filter("source <> target")


def file_churn(commits: DataFrame, as_of) -> DataFrame:
    """Last commit, commits in the 30 days before as_of, and a class by commits a day."""
    recent = F.count_if((F.col("ts") > F.lit(as_of) - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") <= F.lit(as_of)))
    got = commits.groupBy("file").agg(F.max(F.struct("ts", "commit")).alias("last"), recent.alias("recent"))
    rate = F.col("recent") / F.lit(30.0)
    return got.select("file", F.col("last.commit").alias("last_commit"), "recent", F.when(rate > 0.3, "high").when(rate > 0.1, "moderate").otherwise("stable").alias("churn"))


def resolve_names(refs: DataFrame, defs: DataFrame, most_defs: int = 10, most_per_file: int = 60) -> DataFrame:
    """refs(file, name, pos) against defs(name, def_id, def_file): names of too many definitions and
    references inside a file are dropped; a file keeps its first ones."""
    few = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_defs).select("name")
    hit = refs.join(defs.join(few, "name", "left_semi"), "name").filter("file <> def_file")
    first = hit.groupBy("file", "def_id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("file").orderBy("pos", "def_id")
    return first.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most_per_file).drop("rn")


def reverse_dependencies(calls: DataFrame) -> DataFrame:
    """(a, b): files of calls(caller, callee, owner) that b calls into a."""
    return calls.select(F.col("owner").alias("a"), F.col("caller").alias("b")).filter("a <> b").distinct()


def callers(calls: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """(callee, caller_file) of calls(caller, callee) to what defs(callee) define: the calling file's label in
    files(caller, label), or its id where it has none."""
    own = calls.join(defs, "callee", "left_semi").join(files, "caller", "left")
    return own.select("callee", F.coalesce("label", F.col("caller").cast("string")).alias("caller_file")).distinct()
