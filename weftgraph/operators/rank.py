"""Ranking, packing and redundancy removal for provider results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as X
from ..ship import ship


def blended(results: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """score = 0.6 * confidence + 0.4 * priority; place among a request's results."""
    n = len(priority)
    weight = F.coalesce(*(F.when(F.col("provider") == p, F.lit((n - i) / n)) for i, p in enumerate(priority)), F.lit(0.0))
    index = F.coalesce(*(F.when(F.col("provider") == p, F.lit(i)) for i, p in enumerate(priority)), F.lit(99))
    got = results.withColumns({"score": F.round(0.6 * F.col("confidence") + 0.4 * weight, 8), "idx": index})
    w = Window.partitionBy("request").orderBy(F.desc("score"), F.desc("confidence"), "idx", "seq")
    return got.withColumn("place", F.row_number().over(w)).drop("idx")


def packed(ranked: DataFrame, budget: int) -> DataFrame:
    """The results before the first that overflows the request's token budget."""
    w = Window.partitionBy("request").orderBy("place")
    return ranked.withColumn("tokens", X.tokens(F.col("content"))).withColumn("running", F.sum("tokens").over(w)).filter(F.col("running") <= budget)


def deduplicated(ranked: DataFrame, section: float = 0.85, line: float = 0.9) -> DataFrame:
    """request, seq, place, content and displaced of what stays of ranked(request, seq, place, content).

    In rank order, a result too similar to one that is kept goes; of the others, lines too similar to one already
    given out go, earlier lines of the same result included, and with its last line the result.  Results and lines
    that hold nothing to compare pass.  displaced: tokens that the result has lost.  The rule is recursive, so it is a
    grouped function: a request has a result for each provider, and its results are gathered in one task.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, given, rows = [], X.Runs(), []
        for r in pdf.sort_values("place").itertuples(index=False):
            if r.content is None:
                continue
            plain = X.normalised(r.content)
            runs = X.word_runs(plain)
            if plain and any(X.alike(runs, k, section) for k in kept):
                continue
            left = []
            for x in r.content.split("\n") if plain else ():
                own = X.word_runs(X.normalised(x))
                if own and given.holds(own, line):
                    continue
                left.append(x)
                if own:
                    given.add(own)
            content = "\n".join(left) if plain else r.content
            if plain and not X.normalised(content):
                continue
            if plain:
                kept.append(runs)
            lost = -(-len(r.content) // 4) - -(-len(content) // 4)
            rows.append((r.request, r.seq, r.place, content, max(0, lost)))
        return pd.DataFrame(rows, columns=["request", "seq", "place", "content", "displaced"])

    own = ranked.select("request", "seq", "place", "content")
    ship(ranked.sparkSession)
    return own.groupBy("request").applyInPandas(greedy, "request long, seq long, place int, content string, displaced long")


def over_structure(results: DataFrame) -> DataFrame:
    """Without the results of kind `structure` where the request has one of kind `ast`."""
    w = Window.partitionBy("request")
    return results.withColumn("_ast", F.max(F.col("provider") == "ast").over(w)).filter(~(F.col("_ast") & (F.col("provider") == "structure"))).drop("_ast")


def within_budget(results: DataFrame, budget: Column) -> DataFrame:
    """Results cut to their provider's budget: whole lines, else characters, with a mark where something was cut."""
    mark = "… [truncated]"
    c = F.col("content")
    lines = P.cut_lines(c, budget)
    few = F.concat(F.substring(c, F.lit(1), (budget * 4 - 20).cast("int")), F.lit(mark))
    cut = F.when(P.kept_lines(c, budget) > 0, F.concat(lines, F.lit("\n" + mark))).otherwise(few)
    return results.withColumn("content", F.when(X.tokens(c) <= budget, c).otherwise(cut))


def boosted(results: DataFrame, by: float = 1.5) -> DataFrame:
    """Confidence times `by`, at most 1, of the results that name a label of the request's result of provider `mistakes`
    (lines `! label (flagged ...)`); that result itself stays as it is."""
    lines = F.split("content", "\n")
    named = F.filter(F.transform(lines, lambda x: F.lower(F.trim(F.regexp_extract(x, r"^\s*!\s+(.+?)\s+\(flagged", 1)))), lambda x: x != "")
    own = F.col("provider") == "mistakes"
    labels = F.flatten(F.collect_list(F.when(own, named)).over(Window.partitionBy("request")))
    told = results.withColumn("_labels", labels)
    hit = ~own & F.exists("_labels", lambda x: F.lower("content").contains(x))
    return told.withColumn("confidence", F.when(hit, F.least(F.lit(1.0), F.col("confidence") * by)).otherwise(F.col("confidence"))).drop("_labels")


def rich_packet(results: DataFrame, priority: tuple[str, ...], budgets: dict[str, int], budget: int, default: int = 200) -> DataFrame:
    """One row for each request of results(request, seq, provider, content, confidence): providers, tokens, displaced
    and text.  Structure gives way to syntax trees, each result is cut to its provider's budget, those that name a
    known mistake rise, ranks blend confidence and priority, repeated content is displaced, and what fits is joined."""
    own = F.coalesce(*(F.when(F.col("provider") == p, F.lit(n)) for p, n in budgets.items()), F.lit(default))
    ready = boosted(within_budget(over_structure(results), own))
    ranked = blended(ready, priority)
    left = deduplicated(ranked).withColumnRenamed("content", "left")
    w = Window.partitionBy("request").orderBy("place")
    full = ranked.join(left.drop("place"), ["request", "seq"], "left").withColumn("tokens", F.coalesce(X.tokens(F.col("left")), F.lit(0)))
    fits = full.withColumn("running", F.sum("tokens").over(w)).withColumn("shown", F.col("left").isNotNull() & (F.col("running") <= budget))
    part = F.struct("place", "provider", F.concat(F.upper("provider"), F.lit(" ("), F.col("provider"), F.lit("):\n"), F.col("left")).alias("text"))
    before = F.sum(X.tokens(F.col("content")))
    got = fits.groupBy("request").agg(
        F.sort_array(F.collect_list(F.when(F.col("shown"), part))).alias("parts"), F.coalesce(F.sum(F.when(F.col("shown"), F.col("tokens"))), F.lit(0)).alias("tokens"), (before - F.sum("tokens")).alias("displaced")
    )
    return got.filter(F.size("parts") > 0).select(
        "request", F.col("parts.provider").alias("providers"), "tokens", F.greatest("displaced", F.lit(0).cast("long")).alias("displaced"), F.array_join("parts.text", "\n\n").alias("text")
    )
