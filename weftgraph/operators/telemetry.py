"""Telemetry over the hook log: summaries, costs, sessions, replay, tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USD_PER_MILLION = 3.0
READ_DENY_TOKENS = 1200


def count_by(log: DataFrame, *cols: str, known: tuple[str, ...] = ("decision",)) -> DataFrame:
    """One row for each value of each column, in one pass over the log.  A missing value counts as `unknown`; in the
    columns of `known` it does not count."""
    value = lambda c: F.col(c).cast("string") if c in known else F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    sets = [F.struct(F.lit(c).alias("dimension"), value(c).alias("value")) for c in cols]
    return log.select(F.explode(F.array(*sets)).alias("d")).filter("d.value IS NOT NULL").groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))


def log_totals(log: DataFrame) -> DataFrame:
    """Rows, reads denied before the tool ran, what these saved at READ_DENY_TOKENS each, displaced tokens (positive
    ones), first and last time of log(event, tool, decision, displaced, ts)."""
    deny = F.count_if(F.coalesce((F.col("event") == "PreToolUse") & (F.col("tool") == "Read") & (F.col("decision") == "deny"), F.lit(False)))
    displaced = F.coalesce(F.sum(F.when(F.col("displaced") > 0, F.col("displaced"))), F.lit(0))
    return log.agg(F.count(F.lit(1)).alias("rows"), deny.alias("read_denies"), (deny * READ_DENY_TOKENS).alias("est_tokens"), displaced.alias("displaced"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _no_negative(c: str) -> Column:
    return F.when(F.col(c) >= 0, F.col(c))


def cost_summary(log: DataFrame, *by: str) -> DataFrame:
    """Saved, injected and would-have tokens, the saved share, and dollars."""
    got = log.groupBy(*by).agg(*(F.coalesce(F.sum(_no_negative(c)), F.lit(0)).alias(c) for c in ("saved", "injected", "would_have")))
    base = F.when(F.col("would_have") > 0, F.col("would_have")).otherwise(F.col("saved") + F.col("injected"))
    return got.withColumns({"ratio": F.round(F.when(base > 0, F.col("saved") / base).otherwise(0.0), 8), "usd": F.round(F.col("saved") / 1e6 * USD_PER_MILLION, 8)})


def heat_map(log: DataFrame, k: int = 10) -> DataFrame:
    return log.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("saved").alias("saved")).orderBy(F.desc("n"), "path").limit(k)


def denied_paths(log: DataFrame, k: int = 10) -> DataFrame:
    return log.filter("decision = 'deny'").groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(k)


def sessions_by_gap(log: DataFrame, gap_seconds: int) -> DataFrame:
    """log with `sid`, counted up in each session's rows; a gap must be longer to begin a new one."""
    w = Window.partitionBy("session").orderBy("ts", "seq")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > gap_seconds * 1_000_000
    return log.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("sid", F.sum("new").over(w)).drop("new")


def session_sizes(log: DataFrame, gap_seconds: int) -> DataFrame:
    return sessions_by_gap(log, gap_seconds).groupBy("session", "sid").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def re_reads(log: DataFrame) -> DataFrame:
    """Reads of a path that the session has read before."""
    w = Window.partitionBy("session", "path").orderBy("ts", "seq")
    again = log.filter("tool = 'Read'").withColumn("nth", F.row_number().over(w))
    return again.filter("nth > 1").select("seq", "session", "path", "nth")


def buckets(log: DataFrame) -> DataFrame:
    """Each session's tokens by what became of its calls, every call in one bucket.

    log(session, seq, ts, tool, decision, path, command, would_have, injected).  Reads, searches and commands count if
    they say what they would have cost; a command must be known, or it is only counted as skipped.  A read of a path
    that a counted read of the session had before is `dedup` (at its packet's cost if denied, else whole); other denied
    calls are `intercepted`, at the cost of their `packet`; the rest is `passed`.  A missing packet costs the whole.
    """
    bash = F.col("tool") == "Bash"
    told = F.coalesce(F.length("command") > 0, F.lit(False))
    counted = F.coalesce(F.col("tool").isin("Read", "Grep") | (bash & told), F.lit(False)) & F.col("would_have").isNotNull()
    read = counted & (F.col("tool") == "Read") & F.col("path").isNotNull()
    # Rows with paths and without are told apart, so that only reads of known paths are ordered together.
    w = Window.partitionBy("session", F.when(read, F.col("path")), F.when(read, F.lit(1)).otherwise(F.col("seq"))).orderBy("ts", "seq")
    own = log.withColumns({"counted": counted, "read": read, "deny": F.coalesce(F.col("decision") == "deny", F.lit(False)), "told": told})
    own = own.withColumn("again", F.col("read") & (F.row_number().over(w) > 1))
    kind = F.when(F.col("again"), "dedup").when(F.col("counted") & F.col("deny"), "intercepted").when(F.col("counted"), "passed")
    own = own.withColumns({"kind": kind, "cost": F.when(F.col("deny"), F.coalesce("injected", "would_have")).otherwise(F.col("would_have"))})
    total = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    return own.groupBy("session").agg(
        total("intercepted", "would_have").alias("intercepted"), total("intercepted", "cost").alias("packet"), total("passed", "would_have").alias("passed"),
        total("dedup", "would_have").alias("dedup"), total("dedup", "cost").alias("dedup_cost"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("counted") & F.col("deny")).alias("calls"), F.count_if(F.coalesce(bash, F.lit(False)) & F.col("told") & F.col("deny")).alias("bash_counted"),
        F.count_if(F.coalesce(bash, F.lit(False)) & ~F.col("told")).alias("bash_skipped"),
    )


def p_curve(session_buckets: DataFrame, grid: tuple = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Tokens and percent saved if a share p of what was intercepted is read after all: over first calls (passed + packet +
    p * intercepted), and over whole sessions with their repeated reads; the share p below which interception pays; and
    repeated reads in percent of all."""
    names = ("intercepted", "packet", "passed", "dedup", "dedup_cost")
    t = session_buckets.agg(*(F.sum(c).alias(c) for c in names)).withColumn("p", F.explode(F.array(*(F.lit(p) for p in grid))))
    base = F.col("passed") + F.col("intercepted")
    cost = F.col("passed") + F.col("packet") + F.col("p") * F.col("intercepted")
    share = lambda part, of: F.round(F.when(of > 0, part / of).otherwise(0.0), 8)
    whole = base + F.col("dedup")
    return t.select(
        "p", F.round(cost, 6).alias("tokens"), share((base - cost) * 100, base).alias("reduction"), share((whole - cost - F.col("dedup_cost")) * 100, whole).alias("session_reduction"),
        share((F.col("intercepted") - F.col("packet")).cast("double"), F.col("intercepted")).alias("break_even"), share(F.col("dedup") * 100.0, whole).alias("dedup_share"),
    )


#: The providers that a tuner knows.
PROVIDERS = ("structure", "mistakes", "git", "mempalace", "context7", "obsidian")


def _denied(log: DataFrame) -> DataFrame:
    return log.filter("event = 'PreToolUse' AND decision = 'deny'")


def hit_rates(log: DataFrame, providers: tuple[str, ...] = PROVIDERS, least: int = 20, budget: int = 200) -> DataFrame:
    """Tuning proposals for each provider of the list, and each that a denied call of log(event, decision, provider)
    names, once there are enough denied calls: off for one of the list that never contributed, a fifth more budget for one
    that did so in nine of ten."""
    spark = log.sparkSession
    hits = _denied(log).groupBy("provider").agg(F.count(F.lit(1)).alias("hits"))
    n = hits.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("denied"))  # one row; calls without a provider are one of its groups
    known = spark.createDataFrame([(p,) for p in providers], "provider string").withColumn("listed", F.lit(True))
    both = hits.filter("provider IS NOT NULL").join(known, "provider", "full").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    rate = F.col("hits") / F.col("denied")
    raised = F.greatest(rate, F.lit(0.0)) >= 0.9
    return both.crossJoin(F.broadcast(n)).filter(F.col("denied") >= least).select(
        "provider", "hits", "denied", F.round(rate, 8).alias("rate"), F.when((F.col("hits") == 0) & F.col("listed"), "disable").when(raised, "raise").otherwise("keep").alias("proposal"),
        F.when(raised, F.round(F.lit(budget * 1.2)).cast("long")).otherwise(F.lit(budget).cast("long")).alias("budget"),
    )


def threshold_proposal(log: DataFrame, now: float = 0.6, least: int = 10, margin: float = 0.1) -> DataFrame:
    """The confidence threshold to be raised to: the upper median of denied calls' confidence in log(event, decision,
    confidence), if there are `least` of them and it lies over `margin` above the present one; else no row."""
    own = _denied(log).filter("confidence IS NOT NULL").select(F.lit(1).alias("one"), "confidence")
    n = own.groupBy("one").agg(F.count(F.lit(1)).alias("n"))
    got = upper_median(own, "one", "confidence").join(n, "one").filter((F.col("n") >= least) & (F.col("median") > now + margin))
    return got.select(F.lit(now).alias("current"), F.round("median", 2).alias("proposed"), "n")


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place floor(n / 2) of the sorted values.

    Equal values are counted before anything is sorted, so a group costs its distinct values, not its rows.
    """
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(value)
    run = counts.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(by))})
    place = F.floor(F.col("all") / 2) + 1
    return run.filter((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place)).select(by, F.col(value).alias("median"))


def interception_rate(log: DataFrame) -> DataFrame:
    deny = F.count_if((F.col("decision") == "deny") & (F.col("tool") == "Read"))
    return log.agg(deny.alias("denied"), F.count(F.lit(1)).alias("decisions"), F.floor(deny * 100 / F.count(F.lit(1)) + 0.5).cast("long").alias("percent"))


def days_spanned(log: DataFrame) -> DataFrame:
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400_000_000
    return log.agg(F.when(F.count("ts") < 2, 0).otherwise(F.ceil(span)).cast("long").alias("days"))


def weekly(log: DataFrame) -> DataFrame:
    """Totals by ISO week, with the grand total recomputed from sums (week null)."""
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "ts").cast("int"), F.weekofyear("ts"))
    return log.withColumn("week", week).rollup("week").agg(F.count(F.lit(1)).alias("n"), F.sum("saved").alias("saved"), F.sum("would_have").alias("would_have")).withColumn("ratio", F.round(F.col("saved") / F.col("would_have"), 8))


def warnings(log: DataFrame) -> DataFrame:
    """Denied rows whose reason speaks of a past mistake."""
    told = F.lower("reason").rlike("mistake|landmine")
    return log.agg(F.count_if((F.col("decision") == "deny") & told).alias("warnings"))


def symbol_wins(rows: DataFrame) -> DataFrame:
    """Of rows(raw, packet, intercepted, recall): the searches whose packet is smaller, their reduction, their share of all
    searches and their mean recall, in percent."""
    win = F.col("intercepted") & (F.col("packet") < F.col("raw"))
    whole = lambda c: F.floor(c * 100 + 0.5).cast("long")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins"), *(F.sum(F.when(win, F.col(c))).alias(c) for c in ("raw", "packet")), F.avg(F.when(win, F.col("recall"))).alias("recall"))
    return got.select("wins", whole(1 - F.col("packet") / F.col("raw")).alias("reduction"), whole(F.col("wins") / F.col("n")).alias("rate"), whole(F.col("recall")).alias("recall"))


def runs(log: DataFrame, gap_seconds: int) -> DataFrame:
    """(seq, run) of log(path, ts, seq, sid): rows with a session id belong to it, the others to runs by gap; a path
    whose rows are mixed has both kinds."""
    w = Window.partitionBy("path", F.col("sid").isNull()).orderBy("ts", "seq")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    told = log.withColumn("new", F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)).withColumn("g", F.sum("new").over(w))
    name = F.when(F.col("sid").isNull(), F.concat(F.lit(" gap "), F.col("g").cast("string"))).otherwise(F.concat(F.lit(" id "), F.col("sid").cast("string")))
    return told.select("seq", F.concat("path", name).alias("run"))


def session_lines(log: DataFrame) -> DataFrame:
    """(session, line): reads, warnings, tokens and displaced tokens of each session; none where all of them are 0."""
    warned = (F.col("decision") == "deny") & F.lower("reason").rlike("mistake|landmine")
    t = log.groupBy("session").agg(F.count_if(F.col("tool") == "Read").alias("reads"), F.count_if(warned).alias("warnings"), F.sum("saved").alias("saved"), F.sum("displaced").alias("displaced"))
    text = F.format_string("%d reads, %d warnings, %d tokens, %d displaced", "reads", "warnings", "saved", "displaced")
    return t.filter("reads + warnings + saved + displaced > 0").select("session", text.alias("line"))


def health(findings: DataFrame, by: str) -> DataFrame:
    """Of each group the worst severity (ok, warn, fail) of findings(severity), and how many findings are not ok."""
    levels = F.array(F.lit("ok"), F.lit("warn"), F.lit("fail"))
    worst = F.max(F.array_position(levels, F.col("severity")))
    return findings.groupBy(by).agg(F.element_at(levels, worst.cast("int")).alias("health"), F.count_if(F.col("severity") != "ok").alias("findings"))


def cache_stats(entries: DataFrame, live: DataFrame) -> DataFrame:
    """Entries, hits and hit rate of entries(hits) that were kept, and of one row live(live, misses): the larger of the
    kept and the running number of hits counts."""
    kept = entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("persisted"))
    both = kept.crossJoin(live).withColumn("hits", F.greatest("persisted", "live"))  # a row by a row
    total = F.col("hits") + F.col("misses")
    return both.select("entries", "persisted", "hits", F.round(F.when(total > 0, F.col("hits") / total).otherwise(0.0), 8).alias("rate"))


def packet_wins(rows: DataFrame, by: str) -> DataFrame:
    """Of rows(would_have, injected): how many packets are smaller, the reduction with and without passing larger ones
    through, and the upper median of the single guarded reductions."""
    low = F.least("injected", "would_have")
    own = rows.filter("would_have > 0").withColumn("reduction", F.round(1 - low / F.col("would_have"), 6))
    got = own.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("injected") < F.col("would_have")).alias("wins"),
        F.round(1 - F.sum(low) / F.sum("would_have"), 8).alias("guarded"), F.round(1 - F.sum("injected") / F.sum("would_have"), 8).alias("raw"),
    )
    return got.join(upper_median(own, by, "reduction"), by)
