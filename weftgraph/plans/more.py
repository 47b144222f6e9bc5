"""Further queries of the engine's own operators: paths, evaluation, sessions, packets and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..deal import dealt
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import paths as P
from ..operators import telemetry as T
from ..sources import adapters as A
from .registry import co_changes, oracle_sql, queries, spec  # noqa: F401  (the whole table is read through this module)

def _count():
    return F.count(F.lit(1))


# Kinds that can be called, and words too common to be looked up as a symbol.
CALLABLE = ("function", "class", "method", "interface", "type", "variable")
STOPWORDS = (
    "true", "false", "null", "undefined", "function", "return", "import", "export", "const", "class", "async", "await", "string",
    "number", "boolean", "value", "error", "result", "data", "type", "interface", "todo", "fixme", "console", "test", "default",
)

#: Parts as paths: a folder a size, a name a half key, every second one a test, every third in a tests folder.
FILES = "files AS (SELECT 'src/s' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '/tests' ELSE '' END || '/m' || (p_partkey // 2) || CASE WHEN p_partkey % 2 = 1 THEN '.test.ts' ELSE '.ts' END AS path FROM part)"
KEYED = "kd AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(test|spec)\\.', '.'), '\\.ts$', '') AS key, path LIKE '%.test.ts' AS test FROM files)"


def _files(s, d):
    key = F.col("p_partkey")
    folder = F.when(key % 3 == 0, "/tests").otherwise("")
    return A.table(s, d, "part").select(F.concat(F.lit("src/s"), F.col("p_size").cast("string"), folder, F.lit("/m"), F.floor(key / 2).cast("string"), F.when(key % 2 == 1, ".test.ts").otherwise(".ts")).alias("path"))


# Scans
@spec("S2_scan_nodes", ("nodes",), "SELECT * FROM nodes")
def _(s, d):
    return A.nodes(s, d)


@spec("S10_replay_scan", ("log",), "SELECT seq, coalesce(ts, TIMESTAMP '1970-01-01 00:00:00') AS ts, tool, path, session, would_have FROM log")
def _(s, d):
    return A.log(s, d).select("seq", F.coalesce("ts", F.timestamp_seconds(F.lit(0))).alias("ts"), "tool", "path", "session", "would_have")


@spec("S11_commit_files", ("commits",), ", newest AS (SELECT o_orderkey AS commit_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) SELECT commit_id, file FROM (SELECT commit_id, file, row_number() OVER (PARTITION BY commit_id ORDER BY file) AS nth FROM commits WHERE commit_id IN (SELECT commit_id FROM newest)) WHERE nth <= 50")
def _(s, d):
    newest = A.table(s, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select(F.col("o_orderkey").alias("commit"))
    nth = F.row_number().over(Window.partitionBy("commit").orderBy("file"))
    return A.commit_files(s, d).join(newest, "commit", "left_semi").withColumn("nth", nth).filter("nth <= 50").select(F.col("commit").alias("commit_id"), "file")


# Store
@spec("K7_hit_counts", ("nodes",), ", hits AS (SELECT 'part:' || l_partkey AS id, count(*) AS n FROM lineitem GROUP BY l_partkey) SELECT n.id, coalesce(h.n, 0) AS query_count FROM nodes n LEFT JOIN hits h ON h.id = n.id")
def _(s, d):
    hits = A.table(s, d, "lineitem").groupBy("l_partkey").agg(_count().alias("n")).select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"), "n")
    return A.nodes(s, d).select("id").join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("query_count"))


CACHE_AT = "TIMESTAMP '2024-01-15 00:00:00'"


def _cache(s, d):
    """Log rows as cache entries of k hours; `live` until that time, not including it."""
    ends = F.col("ts") + F.make_dt_interval(F.lit(0), F.col("k").cast("int"))
    return A.log(s, d).withColumn("live", ends > F.expr(CACHE_AT))


LIVE = f"cache AS (SELECT *, epoch_us(ts) + k * 3600000000 > epoch_us({CACHE_AT}) AS live FROM log)"


@spec("F6_ttl_valid", ("log",), f", {LIVE} SELECT seq, path FROM cache WHERE live")
def _(s, d):
    return _cache(s, d).filter("live").select("seq", "path")


@spec("K9_prune_stale", ("log",), f", {LIVE} SELECT count(*) AS pruned FROM cache WHERE NOT live")
def _(s, d):
    return _cache(s, d).filter("NOT live").agg(_count().alias("pruned"))


@spec("A3_cache_stats", ("log",), f", {LIVE} SELECT tool AS provider, count(*) AS total, count(CASE WHEN NOT live THEN 1 END) AS stale FROM cache GROUP BY tool")
def _(s, d):
    return _cache(s, d).groupBy(F.col("tool").alias("provider")).agg(_count().alias("total"), F.count_if(~F.col("live")).alias("stale"))


@spec("T8_hot_warm", ("log",), f", {LIVE} SELECT path, count(*) AS hits FROM cache WHERE live GROUP BY path ORDER BY hits DESC, path LIMIT 5")
def _(s, d):
    return _cache(s, d).filter("live").groupBy("path").agg(_count().alias("hits")).orderBy(F.desc("hits"), "path").limit(5)


# Filters
@spec("F3_callable", ("nodes",), f"SELECT id, kind FROM nodes WHERE kind IN {CALLABLE}")
def _(s, d):
    return A.nodes(s, d).filter(F.col("kind").isin(*CALLABLE)).select("id", "kind")


@spec("F8_test_paths", (), f"WITH {FILES} SELECT path FROM files WHERE path LIKE '%.test.ts' OR path LIKE '%/tests/%'")
def _(s, d):
    return _files(s, d).filter(P.is_test(F.col("path")))


@spec("F14_source_files", (), f"WITH {FILES} SELECT path FROM files WHERE path NOT LIKE '%.test.ts' AND path NOT LIKE '%/tests/%'")
def _(s, d):
    return _files(s, d).filter(P.is_source(F.col("path")))


@spec("F12_symbol_gate", (), f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM conversations) SELECT w FROM w WHERE regexp_full_match(w, '[A-Za-z_$][A-Za-z0-9_$]{{2,}}') AND lower(w) NOT IN {STOPWORDS}")
def _(s, d):
    w = A.table(s, d, "conversations").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return w.filter(F.col("w").rlike(r"\A[A-Za-z_$][A-Za-z0-9_$]{2,}\z") & ~F.lower("w").isin(*STOPWORDS))


@spec("F13_never_worse", ("log",), "SELECT seq FROM log WHERE injected < would_have")
def _(s, d):
    return A.log(s, d).filter("injected < would_have").select("seq")


@spec("F15_clamp", (), "SELECT event_id, CAST(least(greatest(floor(value), 1), 50) AS BIGINT) AS n FROM events")
def _(s, d):
    return A.table(s, d, "events").select("event_id", F.least(F.greatest(F.floor("value"), F.lit(1)), F.lit(50)).cast("long").alias("n"))


@spec("F16_stale_files", ("commits",), ", m AS (SELECT file, max(ts) AS mtime FROM commits GROUP BY file) SELECT p.p_partkey AS file, coalesce(m.mtime > TIMESTAMP '1997-01-01 00:00:00', false) AS stale FROM part p LEFT JOIN m ON m.file = p.p_partkey")
def _(s, d):
    m = A.commit_files(s, d).groupBy("file").agg(F.max("ts").alias("mtime"))
    p = A.table(s, d, "part").select(F.col("p_partkey").alias("file"))
    return p.join(m, "file", "left").select("file", F.coalesce(F.col("mtime") > F.expr("TIMESTAMP '1997-01-01 00:00:00'"), F.lit(False)).alias("stale"))


# Joins
@spec("J3_definitions", ("nodes",), "SELECT id FROM nodes WHERE trim(regexp_replace(label, '[(<].*', '')) IN (SELECT p_name FROM part WHERE p_size > 40) AND kind = 'function'")
def _(s, d):
    names = A.table(s, d, "part").filter("p_size > 40").select(F.col("p_name").alias("name"))
    return A.nodes(s, d).filter("kind = 'function'").withColumn("name", X.bare_name(F.col("label"))).join(names, "name", "left_semi").select("id")


@spec("J5_callees", ("calls",), "SELECT DISTINCT c.caller, p.p_name AS name, c.owner FROM calls c JOIN part p ON p.p_partkey = c.callee")
def _(s, d):
    names = A.table(s, d, "part").select(F.col("p_partkey").alias("callee"), F.col("p_name").alias("name"))
    return A.calls(s, d).join(names, "callee").select("caller", "name", "owner").distinct()


@spec("J6_importers", ("nodes", "edges"), "SELECT DISTINCT e.target AS file, e.source AS importer FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.relation = 'imports' AND e.source <> e.target")
def _(s, d):
    n, e = A.nodes(s, d).select("id"), A.edges(s, d).filter("relation = 'imports' AND source <> target")
    known = e.join(n.withColumnRenamed("id", "source"), "source", "left_semi").join(n.withColumnRenamed("id", "target"), "target", "left_semi")
    return known.select(F.col("target").alias("file"), F.col("source").alias("importer")).distinct()


@spec("G13_coverage", ("nodes",), ", sc AS (SELECT source_file, count(*) AS n, avg(CASE kind WHEN 'class' THEN 0.7::DOUBLE ELSE 0.85::DOUBLE END) AS c FROM nodes WHERE kind NOT IN ('file', 'module') GROUP BY source_file) SELECT source_file, round(least(n / 3.0::DOUBLE, 1.0) * c, 8) AS coverage FROM sc")
def _(s, d):
    score = F.when(F.col("kind") == "class", 0.7).otherwise(0.85)
    got = A.nodes(s, d).filter("kind NOT IN ('file', 'module')").groupBy("source_file").agg(_count().alias("n"), F.avg(score).alias("c"))
    return got.select("source_file", F.round(F.least(F.col("n") / 3, F.lit(1.0)) * F.col("c"), 8).alias("coverage"))


# Aggregations
@spec("A1_count_by_file", ("nodes",), "SELECT source_file, count(*) AS n FROM nodes GROUP BY source_file")
def _(s, d):
    return A.nodes(s, d).groupBy("source_file").agg(_count().alias("n"))


@spec("A9_files_by_folder", (), f"WITH {FILES}, {KEYED} SELECT dir, string_agg(path, ',' ORDER BY path) AS labels FROM (SELECT DISTINCT dir, path FROM kd) GROUP BY dir")
def _(s, d):
    p = _files(s, d).distinct().withColumn("dir", X.dirname(F.col("path")))
    return p.groupBy("dir").agg(F.concat_ws(",", F.sort_array(F.collect_list("path"))).alias("labels"))


@spec("A10_extensions", (), f"WITH {FILES} SELECT regexp_extract(path, '\\.([^./]+)$', 1) AS ext, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, ext LIMIT 6")
def _(s, d):
    return _files(s, d).groupBy(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext")).agg(_count().alias("n")).orderBy(F.desc("n"), "ext").limit(6)


SUMS = "CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(would_have) AS BIGINT) AS would_have, min(ts) AS first_at, max(ts) AS last_at"


@spec("A13_totals", ("log",), f", t AS (SELECT coalesce(tool, '*') AS project, {SUMS} FROM log GROUP BY ROLLUP (tool)) SELECT *, round(saved::DOUBLE / would_have, 8) AS ratio FROM t")
def _(s, d):
    got = A.log(s, d).rollup("tool").agg(F.sum("saved").alias("saved"), F.sum("would_have").alias("would_have"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return got.select(F.coalesce("tool", F.lit("*")).alias("project"), "saved", "would_have", "first_at", "last_at", F.round(F.col("saved") / F.col("would_have"), 8).alias("ratio"))


@spec("A16_cumulative", ("log",), ", t AS (SELECT count(DISTINCT session) AS sessions, CAST(sum(would_have) AS BIGINT) AS naive, CAST(sum(saved) AS BIGINT) AS saved FROM log) SELECT *, floor(saved::DOUBLE / naive * 1000 + 0.5) / 10 AS reduction, floor(saved::DOUBLE / 1000000 * 3 * 100 + 0.5) / 100 AS cost FROM t")
def _(s, d):
    got = A.log(s, d).agg(F.countDistinct("session").alias("sessions"), F.sum("would_have").alias("naive"), F.sum("saved").alias("saved"))
    return got.select("*", (F.floor(F.col("saved") / F.col("naive") * 1000 + 0.5) / 10).alias("reduction"), (F.floor(F.col("saved") / 1000000 * 3 * 100 + 0.5) / 100).alias("cost"))


@spec("A24_trust", (), "SELECT s_suppkey, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * (s_acctbal / 10000) + 0.2::DOUBLE * (s_suppkey % 2) + 0.2::DOUBLE * (s_nationkey / 25.0::DOUBLE) + 0.2::DOUBLE)), 8) AS trust FROM supplier")
def _(s, d):
    raw = 0.4 * (F.col("s_acctbal") / 10000) + 0.2 * (F.col("s_suppkey") % 2) + 0.2 * (F.col("s_nationkey") / 25) + 0.2
    return A.table(s, d, "supplier").select("s_suppkey", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 8).alias("trust"))


# Sessions
@spec("W2_sessions_by_id", ("log",), "SELECT session, count(*) AS n, min(seq) AS first_seq FROM log GROUP BY session")
def _(s, d):
    return A.log(s, d).groupBy("session").agg(_count().alias("n"), F.min("seq").alias("first_seq"))


# Scalars
@spec("X4_path_parts", (), f"WITH {FILES}, {KEYED} SELECT path, dir, regexp_extract(path, '[^/]*$') AS base, key FROM kd")
def _(s, d):
    p = F.col("path")
    return _files(s, d).select(p, X.dirname(p).alias("dir"), X.basename(p).alias("base"), P.base_key(p).alias("key"))


@spec("X28_cost_fields", ("log",), "SELECT seq, nullif(would_have, 0) AS would_have, nullif(injected, 0) AS injected, nullif(greatest(0, would_have - injected), 0) AS saved FROM log")
def _(s, d):
    zero = F.lit(0).cast("long")
    return A.log(s, d).select("seq", F.nullif("would_have", zero).alias("would_have"), F.nullif("injected", zero).alias("injected"), F.nullif(F.greatest(zero, F.col("would_have") - F.col("injected")), zero).alias("saved"))


# Evaluation: the parts of a test commit are sought among the parts that share commits with its first part
HELD = "co AS (SELECT file_a AS a, file_b AS b, n FROM co_change UNION ALL SELECT file_b, file_a, n FROM co_change), rk AS (SELECT a AS query, b AS item, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM co), gold AS (SELECT a AS query, b AS item FROM co WHERE n >= 2), ev AS (SELECT g.query, count(*) AS n_gold, count(CASE WHEN place <= 10 THEN 1 END) AS hits, min(place) AS first FROM gold g JOIN rk USING (query, item) GROUP BY g.query)"


def _retrieved(s, d):
    pairs = G.checkpointed(co_changes(s, d))
    both = pairs.select(F.col("file_a").alias("query"), F.col("file_b").alias("item"), "n").unionAll(pairs.select("file_b", "file_a", "n"))
    # Items that are sought are ranked among all; the others then need not be looked up.
    ranked = dealt(both, 2 * pairs.count(), "query").select("query", "item", "n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "item")).alias("place")).filter("n >= 2").drop("n")
    return E.retrieval(both.filter("n >= 2").select("query", "item"), ranked, 10)


@spec("E2_recall", ("commits",), f", {HELD} SELECT query, n_gold, hits, round(hits::DOUBLE / n_gold, 8) AS recall, round(1.0::DOUBLE / first, 8) AS reciprocal_rank FROM ev")
def _(s, d):
    return _retrieved(s, d).select("query", "n_gold", "hits", F.round("recall", 8).alias("recall"), F.round("reciprocal_rank", 8).alias("reciprocal_rank"))


@spec("E4_percentiles", ("log",), "SELECT tool, round(quantile_cont(would_have, 0.5), 8) AS p50, round(quantile_cont(would_have, 0.95), 8) AS p95 FROM log GROUP BY tool")
def _(s, d):
    got = E.percentiles(A.log(s, d), "tool", "would_have", (0.5, 0.95))
    return got.select("tool", F.round("p50", 8).alias("p50"), F.round("p95", 8).alias("p95"))


@spec("E5_bootstrap")
def _(s, d):
    sizes = T.session_sizes(A.log(s, d), 21600).groupBy("session").agg(F.avg("n").alias("size"))
    return E.bootstrap(sizes, "session", "size", rounds=200)


# Reports
@spec("P14_weekly_digest", ("log",), ", w AS (SELECT CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week, tool, saved FROM log) SELECT week, coalesce(tool, '*') AS project, CAST(sum(saved) AS BIGINT) AS saved, round(sum(saved)::DOUBLE / 1000000 * 3, 8) AS usd FROM w GROUP BY GROUPING SETS ((week, tool), (week))")
def _(s, d):
    week = F.concat(F.expr("extract(yearofweek from ts)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    log = A.log(s, d).select(week.alias("week"), "tool", "saved")
    got = log.groupingSets([("week", "tool"), ("week",)], "week", "tool").agg(F.sum("saved").alias("saved"))
    return got.select("week", F.coalesce("tool", F.lit("*")).alias("project"), "saved", F.round(F.col("saved") / 1000000 * 3, 8).alias("usd"))
