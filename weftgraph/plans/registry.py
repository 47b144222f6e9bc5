"""All queries of the engine's own operators with their SQL, from one table of specs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import mining as M
from ..operators import rank as R
from ..operators import search as SE
from ..operators import store as S
from ..operators import telemetry as T
from ..sources import adapters as A

SPECS: dict[str, tuple[Callable, str | None]] = {}


def spec(name: str, with_: tuple[str, ...] = (), sql: str | None = None, recursive: bool = False):
    def add(f):
        head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(A.SQL[w] for w in with_)
        full = None if sql is None else (f"{head}, {sql[1:]}" if sql.startswith(",") and with_ else f"{head}\n{sql}" if with_ else sql)
        SPECS[name] = (f, full)
        return f

    return add


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in SPECS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in SPECS.items() if s}


AS_OF = dt.datetime(1997, 1, 1)
BOTH = "both_ AS (SELECT source AS id, target AS other, relation FROM edges UNION ALL SELECT target, source, relation FROM edges WHERE source <> target)"


# Scans, store
@spec("S2_scan_edges", ("edges",), "SELECT * FROM edges")
def _(s, d):
    return A.edges(s, d)


@spec("S3_id_to_file", ("nodes",), "SELECT id, source_file FROM nodes")
def _(s, d):
    return A.nodes(s, d).select("id", "source_file")


@spec("S4_point_lookup", ("nodes",), "SELECT * FROM nodes WHERE id = 'part:7'")
def _(s, d):
    return S.by_id(A.nodes(s, d), "part:7")


@spec("S5_by_file", ("nodes",), "SELECT * FROM nodes WHERE source_file = 'nation:3' ORDER BY id LIMIT 500")
def _(s, d):
    return S.by_file(A.nodes(s, d), "nation:3")


@spec("S6_edges_touching", ("nodes", "edges"), "SELECT DISTINCT * FROM edges WHERE source IN (SELECT id FROM nodes WHERE kind = 'file') OR target IN (SELECT id FROM nodes WHERE kind = 'file')")
def _(s, d):
    return S.touching(A.edges(s, d), A.nodes(s, d).filter("kind = 'file'").select("id"))


@spec("S18_page", ("nodes",), "SELECT id, label, (SELECT count(*) FROM nodes) AS total FROM nodes ORDER BY id LIMIT 25 OFFSET 50")
def _(s, d):
    n = A.nodes(s, d)
    page = n.orderBy("id").offset(50).limit(25).select("id", "label")
    return page.crossJoin(n.agg(F.count(F.lit(1)).alias("total")))  # 25 rows by one


@spec("K1_upsert", (), "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS label FROM part")
def _(s, d):
    p = A.table(s, d, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit(0).alias("seq"))
    new = p.filter("p_size > 25").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("label"), F.lit(1).alias("seq"))
    return S.upsert(old, new, "id").drop("seq")


@spec("K3_delete_by_file", ("nodes",), "SELECT * FROM nodes WHERE source_file <> 'nation:3'")
def _(s, d):
    return S.without_file(A.nodes(s, d), "nation:3")


@spec("K4_cascade", ("nodes", "edges"), "SELECT * FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE source_file = 'nation:3') AND target NOT IN (SELECT id FROM nodes WHERE source_file = 'nation:3')")
def _(s, d):
    return S.cascade(A.nodes(s, d), A.edges(s, d), "nation:3")[1]


@spec("K5_replace_relation", ("edges",), "SELECT * FROM edges WHERE relation <> 'calls' UNION ALL SELECT source, target, 'calls', 'INFERRED', 0.5::DOUBLE FROM edges WHERE relation = 'exports'")
def _(s, d):
    e = A.edges(s, d)
    new = e.filter("relation = 'exports'").withColumns({"relation": F.lit("calls"), "confidence": F.lit("INFERRED"), "confidence_score": F.lit(0.5)})
    return S.replace_relation(e, "calls", new)


# Filters
@spec("F4_active_mistakes", (), "WITH x AS (SELECT event_id, user_id, event_type, ts, min(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS valid_until FROM events) SELECT event_id, user_id FROM x WHERE event_type = 'error' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-05 00:00:00')")
def _(s, d):
    return S.active_mistakes(A.table(s, d, "events"), dt.datetime(2024, 1, 5)).select("event_id", "user_id")


# Joins and graph
@spec("J1_neighbours", ("nodes", "edges"), f", {BOTH} SELECT b.id, b.other, b.relation, n.label, n.kind FROM both_ b JOIN nodes n ON n.id = b.other WHERE b.id IN (SELECT id FROM nodes WHERE kind = 'class')")
def _(s, d):
    n = A.nodes(s, d)
    return G.neighbours(n, A.edges(s, d), n.filter("kind = 'class'").select("id"))


@spec("G9_god_nodes", ("nodes", "edges"), f", {BOTH} SELECT n.id, n.label, n.kind, count(*) AS degree FROM both_ b JOIN nodes n ON n.id = b.id WHERE n.kind NOT IN ('file', 'import', 'module', 'concept') GROUP BY n.id, n.label, n.kind ORDER BY degree DESC, n.id LIMIT 10")
def _(s, d):
    return G.god_nodes(A.nodes(s, d), A.edges(s, d))


@spec("G10_subgraph_degree", ("edges",), "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def _(s, d):
    return G.subgraph_degree(A.edges(s, d))


def co_changes(s, d, of: str = "true"):
    """Pairs of the commits that `of` holds for."""
    return M.co_change(A.commit_files(s, d).filter(of), rows=A.table(s, d, "lineitem").count())


def _links(s, d, least=2):
    return co_changes(s, d).filter(F.col("n") >= least).select(F.col("file_a").alias("a"), F.col("file_b").alias("b"), "n")


PAIRS = "pg AS (SELECT file_a AS a, file_b AS b, n FROM co_change WHERE n >= 2), ln AS (SELECT a, b, n FROM pg UNION ALL SELECT b, a, n FROM pg)"


def _rounds(n: int) -> str:
    out = []
    for i in range(n):
        out.append(f"lost{i} AS (SELECT coalesce(sum(rank), 0.0) AS l FROM r{i} WHERE id NOT IN (SELECT a FROM share)), f{i} AS (SELECT s.b AS id, sum(r.rank * s.p) AS f FROM r{i} r JOIN share s ON s.a = r.id GROUP BY s.b), r{i + 1} AS (SELECT t.id, 0.15::DOUBLE * t.tele + 0.85::DOUBLE * (coalesce(f.f, 0.0) + l.l * t.tele) AS rank FROM tele t LEFT JOIN f{i} f ON f.id = t.id CROSS JOIN lost{i} l)")
    return ", ".join(out)


@spec("G6_pagerank", ("commits",), f", {PAIRS}, tot AS (SELECT a, sum(n) AS t FROM pg GROUP BY a), share AS (SELECT pg.a, pg.b, pg.n::DOUBLE / tot.t AS p FROM pg JOIN tot ON tot.a = pg.a), ids AS (SELECT a AS id FROM pg UNION SELECT b FROM pg), tele AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS tele FROM ids), r0 AS (SELECT id, tele AS rank FROM tele), {_rounds(20)} SELECT id, round(rank, 8) AS rank FROM r20")
def _(s, d):
    e = _links(s, d).select("a", "b", F.col("n").cast("double").alias("weight"))
    return G.pagerank(G.checkpointed(e)).select("id", F.round("rank", 8).alias("rank"))


@spec("J7_reverse_dependency", ("calls",), "SELECT DISTINCT owner AS a, caller AS b FROM calls")
def _(s, d):
    return M.reverse_dependencies(A.calls(s, d))


@spec("J8_resolve_names", (), "WITH refs AS (SELECT DISTINCT l_orderkey // 300 AS file, l_partkey % 700 AS name FROM lineitem), pos AS (SELECT l_orderkey // 300 AS file, l_partkey % 700 AS name, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), defs AS (SELECT p_partkey AS def_id, p_partkey % 700 AS name, p_size % 50 AS def_file FROM part), few AS (SELECT name FROM defs GROUP BY name HAVING count(*) <= 10), hit AS (SELECT p.file, d.def_id, min(p.pos) AS pos FROM pos p JOIN defs d ON d.name = p.name JOIN few ON few.name = p.name WHERE p.file <> d.def_file GROUP BY p.file, d.def_id) SELECT file, def_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos, def_id) AS rn FROM hit) WHERE rn <= 60")
def _(s, d):
    line = A.table(s, d, "lineitem")
    refs = line.select(F.floor(F.col("l_orderkey") / 300).alias("file"), (F.col("l_partkey") % 700).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    defs = A.table(s, d, "part").select(F.col("p_partkey").alias("def_id"), (F.col("p_partkey") % 700).alias("name"), (F.col("p_size") % 50).cast("long").alias("def_file"))
    return M.resolve_names(refs, defs)


@spec("G17_related_files", ("commits",), ", foc AS (SELECT p_partkey AS focal FROM part), ln AS (SELECT file_a AS focal, file_b AS file, n FROM co_change UNION ALL SELECT file_b, file_a, n FROM co_change), co AS (SELECT l.focal, l.file, -n AS rnk, 2 AS tier FROM ln l JOIN foc ON foc.focal = l.focal WHERE n >= 2), sib AS (SELECT f.focal, p2.p_partkey AS file, p2.p_partkey AS rnk, 4 AS tier FROM foc f JOIN part p1 ON p1.p_partkey = f.focal JOIN part p2 ON p2.p_brand = p1.p_brand AND p2.p_size = p1.p_size AND p2.p_partkey <> p1.p_partkey), al AS (SELECT * FROM co UNION ALL SELECT * FROM sib), best AS (SELECT focal, file, tier, rnk FROM (SELECT *, row_number() OVER (PARTITION BY focal, file ORDER BY tier, rnk) AS q FROM al) WHERE q = 1) SELECT focal, file, tier, place FROM (SELECT focal, file, tier, row_number() OVER (PARTITION BY focal ORDER BY tier, rnk, file) AS place FROM best) WHERE place <= 10")
def _(s, d):
    p = A.table(s, d, "part")
    focal = p.select(F.col("p_partkey").alias("focal"), "p_brand", "p_size")
    pairs = co_changes(s, d).filter("n >= 2")
    both = pairs.select(F.col("file_a").alias("focal"), F.col("file_b").alias("file"), "n").unionAll(pairs.select("file_b", "file_a", "n"))
    co = both.join(focal.select("focal"), "focal", "left_semi").select("focal", "file", (-F.col("n")).alias("rank"))
    # Of the k places none goes past the first k + 1 siblings: the focal part itself is passed over, and each
    # sibling that is a co-change already takes a place there.  So no group is expanded into pairs.
    k = 10
    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    first = p.withColumn("n", F.dense_rank().over(w)).filter(F.col("n") <= k + 1).select(F.col("p_partkey").alias("file"), "p_brand", "p_size")
    sib = focal.join(first, ["p_brand", "p_size"]).select("focal", "file", F.col("file").alias("rank"))
    none = co.limit(0)
    return G.related_files(none, co, none, sib, k)


# Mining
@spec("J9_co_change", ("commits",), "SELECT file_a, file_b, n FROM co_change WHERE n >= 2")
def _(s, d):
    return co_changes(s, d).filter("n >= 2")


@spec("A6_hot_files", ("commits",), "SELECT file, count(*) AS changes FROM commits GROUP BY file HAVING count(*) >= 5 ORDER BY changes DESC, file LIMIT 20")
def _(s, d):
    return M.hot_files(A.commit_files(s, d))


@spec("T2_co_change_neighbours", ("commits",), "SELECT file, n FROM (SELECT file_b AS file, n FROM co_change WHERE file_a = 42 UNION ALL SELECT file_a, n FROM co_change WHERE file_b = 42) ORDER BY n DESC, file LIMIT 10")
def _(s, d):
    return M.co_change_neighbours(co_changes(s, d), 42)


@spec("A25_churn", ("commits",), "SELECT file, last_commit, recent, CASE WHEN recent / 30.0 > 0.3 THEN 'high' WHEN recent / 30.0 > 0.1 THEN 'moderate' ELSE 'stable' END AS churn FROM (SELECT file, max(CASE WHEN rn = 1 THEN commit_id END) AS last_commit, count(CASE WHEN ts > TIMESTAMP '1996-12-02 00:00:00' AND ts <= TIMESTAMP '1997-01-01 00:00:00' THEN 1 END) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, commit_id DESC) AS rn FROM commits) GROUP BY file)")
def _(s, d):
    return M.file_churn(A.commit_files(s, d), AS_OF)


@spec("W13_temporal_split", (), "SELECT o_orderkey AS commit_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)")
def _(s, d):
    # The cut row comes from a bounded sort of days, so no window runs over all commits.
    o = A.table(s, d, "orders").select(F.col("o_orderkey").alias("commit_id"), "o_orderdate")
    from pyspark.sql import Window

    days = o.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    run = days.withColumn("before", F.sum("n").over(Window.orderBy("o_orderdate")) - F.col("n"))  # a row a day
    total = o.count()
    w = Window.partitionBy("o_orderdate").orderBy("commit_id")
    got = o.join(run.select("o_orderdate", "before"), "o_orderdate").withColumn("rn", F.col("before") + F.row_number().over(w))
    return got.select("commit_id", F.when(F.col("rn") <= int(total * 0.7 + 1e-9), "train").otherwise("test").alias("part"))


# Telemetry
@spec("A2_graph_stats", ("nodes", "edges"), "SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, CAST(floor(count(CASE WHEN confidence = 'EXTRACTED' THEN 1 END) * 100.0 / count(*) + 0.5) AS BIGINT) AS extracted_pct, CAST(floor(count(CASE WHEN confidence = 'INFERRED' THEN 1 END) * 100.0 / count(*) + 0.5) AS BIGINT) AS inferred_pct, CAST(0 AS BIGINT) AS ambiguous_pct FROM edges")
def _(s, d):
    return S.graph_stats(A.nodes(s, d), A.edges(s, d))


@spec("A8_most_imported", ("nodes", "edges"), "SELECT e.target AS id, coalesce(n.label, e.target) AS label, e.n FROM (SELECT target, count(*) AS n FROM edges WHERE relation = 'imports' GROUP BY target) e LEFT JOIN nodes n ON n.id = e.target ORDER BY e.n DESC, e.target LIMIT 10")
def _(s, d):
    n = A.edges(s, d).filter("relation = 'imports'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(A.nodes(s, d).select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "n").orderBy(F.desc("n"), "id").limit(10)


@spec("A11_log_counts", ("log", "hooks"), "SELECT 'event' AS dimension, coalesce(event, 'unknown') AS value, count(*) AS n FROM hooks GROUP BY 2 UNION ALL SELECT 'tool', coalesce(tool, 'unknown'), count(*) FROM hooks GROUP BY 2 UNION ALL SELECT 'decision', decision, count(*) FROM hooks WHERE decision IS NOT NULL GROUP BY 2")
def _(s, d):
    return T.count_by(A.hooks(s, d), "event", "tool", "decision")


@spec("A11_log_totals", ("log", "hooks"), 'SELECT count(*) AS "rows", count(*) FILTER (event = \'PreToolUse\' AND tool = \'Read\' AND decision = \'deny\') AS read_denies, count(*) FILTER (event = \'PreToolUse\' AND tool = \'Read\' AND decision = \'deny\') * 1200 AS est_tokens, CAST(coalesce(sum(displaced) FILTER (displaced > 0), 0) AS BIGINT) AS displaced, min(ts) AS first_ts, max(ts) AS last_ts FROM hooks')
def _(s, d):
    return T.log_totals(A.hooks(s, d))


COST = "sum(saved) AS saved, sum(injected) AS injected, sum(would_have) AS would_have"


@spec("A12_cost", ("log",), f"SELECT tool, CAST(saved AS BIGINT) AS saved, CAST(injected AS BIGINT) AS injected, CAST(would_have AS BIGINT) AS would_have, round(saved::DOUBLE / CASE WHEN would_have > 0 THEN would_have ELSE saved + injected END, 8) AS ratio, round(saved::DOUBLE / 1000000 * 3.0, 8) AS usd FROM (SELECT tool, {COST} FROM log GROUP BY tool)")
def _(s, d):
    return T.cost_summary(A.log(s, d), "tool")


@spec("A14_heat_map", ("log",), "SELECT path, count(*) AS n, CAST(sum(saved) AS BIGINT) AS saved FROM log GROUP BY path ORDER BY n DESC, path LIMIT 10")
def _(s, d):
    return T.heat_map(A.log(s, d))


@spec("A15_denied_paths", ("log",), "SELECT path, count(*) AS n FROM log WHERE decision = 'deny' GROUP BY path ORDER BY n DESC, path LIMIT 10")
def _(s, d):
    return T.denied_paths(A.log(s, d))


@spec("A18_upper_median", ("log",), "SELECT tool, would_have AS median FROM (SELECT tool, would_have, row_number() OVER (PARTITION BY tool ORDER BY would_have) AS rn, count(*) OVER (PARTITION BY tool) AS n FROM log) WHERE rn = floor(n / 2) + 1")
def _(s, d):
    return T.upper_median(A.log(s, d).select("tool", "would_have"), "tool", "would_have")


@spec("A20_days", ("log",), "SELECT CAST(ceil((epoch(max(ts)) - epoch(min(ts))) / 86400.0) AS BIGINT) AS days FROM log")
def _(s, d):
    return T.days_spanned(A.log(s, d))


@spec("A26_interception_rate", ("log",), "SELECT count(CASE WHEN tool = 'Read' AND decision = 'deny' THEN 1 END) AS denied, count(*) AS decisions, CAST(floor(count(CASE WHEN tool = 'Read' AND decision = 'deny' THEN 1 END) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM log")
def _(s, d):
    return T.interception_rate(A.log(s, d))


def _sess(sec: int) -> str:
    return f", g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, seq) <= {sec * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM log), h AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g) SELECT session, CAST(sid AS BIGINT) AS sid, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM h GROUP BY session, sid"


@spec("W1_sessions_30m", ("log",), _sess(1800))
def _(s, d):
    return T.session_sizes(A.log(s, d), 1800)


@spec("W1_sessions_6h", ("log",), _sess(21600))
def _(s, d):
    return T.session_sizes(A.log(s, d), 21600)


@spec("W4_re_reads", ("log",), "SELECT seq, session, path, nth FROM (SELECT seq, session, path, CAST(row_number() OVER (PARTITION BY session, path ORDER BY ts, seq) AS INTEGER) AS nth FROM log WHERE tool = 'Read') WHERE nth > 1")
def _(s, d):
    return T.re_reads(A.log(s, d))


#: A counted read is one again if an earlier counted read of its session and path is found.
BUCKETS = """c AS (SELECT *, coalesce(decision = 'deny', FALSE) AS dn FROM hooks WHERE would_have IS NOT NULL AND (tool IN ('Read', 'Grep') OR (tool = 'Bash' AND command <> ''))),
 f AS (SELECT session, path, min({'t': ts, 's': seq}) AS m FROM c WHERE tool = 'Read' AND path IS NOT NULL GROUP BY ALL),
 g AS (SELECT c.*, coalesce({'t': ts, 's': seq} > f.m, FALSE) AS again FROM c LEFT JOIN f ON f.session = c.session AND f.path = c.path AND c.tool = 'Read'),
 b AS (SELECT session, sum(would_have) FILTER (dn AND NOT again) AS i, sum(coalesce(injected, would_have)) FILTER (dn AND NOT again) AS k, sum(would_have) FILTER (NOT dn AND NOT again) AS p,
  sum(would_have) FILTER (again) AS r, sum(CASE WHEN dn THEN coalesce(injected, would_have) ELSE would_have END) FILTER (again) AS rc, count(*) FILTER (dn) AS calls FROM g GROUP BY session),
 e AS (SELECT session, count(*) AS events, count(*) FILTER (tool = 'Bash' AND command <> '' AND decision = 'deny') AS bash_counted, count(*) FILTER (tool = 'Bash' AND coalesce(command, '') = '') AS bash_skipped FROM hooks GROUP BY session),
 bk AS (SELECT e.session, CAST(coalesce(i, 0) AS BIGINT) AS intercepted, CAST(coalesce(k, 0) AS BIGINT) AS packet, CAST(coalesce(p, 0) AS BIGINT) AS passed, CAST(coalesce(r, 0) AS BIGINT) AS dedup,
  CAST(coalesce(rc, 0) AS BIGINT) AS dedup_cost, events, coalesce(calls, 0) AS calls, bash_counted, bash_skipped FROM e LEFT JOIN b ON b.session = e.session)"""


@spec("W5_buckets", ("log", "hooks"), f", {BUCKETS} SELECT * FROM bk")
def _(s, d):
    return T.buckets(A.hooks(s, d))


@spec("W6_p_curve", ("log", "hooks"), f""", {BUCKETS}, t AS (SELECT sum(intercepted)::DOUBLE AS i, sum(packet)::DOUBLE AS k, sum(passed)::DOUBLE AS p, sum(dedup)::DOUBLE AS r, sum(dedup_cost)::DOUBLE AS rc FROM bk),
 v AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p) SELECT v.p, round(t.p + k + v.p * i, 6) AS tokens, round((t.p + i - (t.p + k + v.p * i)) * 100 / (t.p + i), 8) AS reduction,
 round((t.p + i + r - (t.p + k + v.p * i) - rc) * 100 / (t.p + i + r), 8) AS session_reduction, round((i - k) / i, 8) AS break_even, round(r * 100 / (t.p + i + r), 8) AS dedup_share FROM t CROSS JOIN v""")
def _(s, d):
    return T.p_curve(T.buckets(A.hooks(s, d)))


@spec("W8_recent_paths", ("log",), "SELECT path, max(ts) AS last_at FROM log WHERE tool = 'Read' GROUP BY path ORDER BY last_at DESC, path LIMIT 8")
def _(s, d):
    return A.log(s, d).filter("tool = 'Read'").groupBy("path").agg(F.max("ts").alias("last_at")).orderBy(F.desc("last_at"), "path").limit(8)


@spec("W9_recent", ("log",), "SELECT seq, tool, path FROM log ORDER BY ts DESC, seq DESC LIMIT 20")
def _(s, d):
    return A.log(s, d).orderBy(F.desc("ts"), F.desc("seq")).limit(20).select("seq", "tool", "path")


@spec("W10_weekly", ("log",), ", w AS (SELECT CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week, saved, would_have FROM log) SELECT week, count(*) AS n, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(would_have) AS BIGINT) AS would_have, round(sum(saved)::DOUBLE / sum(would_have), 8) AS ratio FROM w GROUP BY week UNION ALL SELECT NULL, count(*), CAST(sum(saved) AS BIGINT), CAST(sum(would_have) AS BIGINT), round(sum(saved)::DOUBLE / sum(would_have), 8) FROM w")
def _(s, d):
    return T.weekly(A.log(s, d))


# Text and ranking
@spec("X1_make_id", (), "SELECT p_partkey, substr(lower(regexp_replace(regexp_replace(p_brand || '_' || p_name, '[^a-zA-Z0-9]+', '_', 'g'), '^_|_$', '', 'g')), 1, 120) AS id FROM part")
def _(s, d):
    return A.table(s, d, "part").select("p_partkey", X.make_id(F.col("p_brand"), F.col("p_name")).alias("id"))


@spec("X5_tokens", (), "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def _(s, d):
    return A.table(s, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))


KEYWORDS = ("brand#1", "1", "part", "zzz")


@spec("A21_idf", ("nodes",), ", kw AS (SELECT unnest(['brand#1', '1', 'part', 'zzz']) AS kw), n AS (SELECT count(*) AS n FROM nodes), f AS (SELECT kw.kw, count(x.id) AS df FROM kw LEFT JOIN nodes x ON contains(lower(x.label), kw.kw) GROUP BY kw.kw) SELECT f.kw, f.df, CASE WHEN f.df = 0 THEN 0.0::DOUBLE ELSE round(ln(n.n::DOUBLE / f.df), 8) END AS idf FROM f CROSS JOIN n")
def _(s, d):
    return SE.inverse_frequency(A.nodes(s, d), s.createDataFrame([(k,) for k in KEYWORDS], "kw string"))


PRIORITY = ("src3", "src1", "src7", "src12")
RANKED = ", rk AS (SELECT *, round(0.6::DOUBLE * confidence + 0.4::DOUBLE * CASE provider WHEN 'src3' THEN 1.0 WHEN 'src1' THEN 0.75 WHEN 'src7' THEN 0.5 WHEN 'src12' THEN 0.25 ELSE 0.0 END, 8) AS score, CASE provider WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src7' THEN 2 WHEN 'src12' THEN 3 ELSE 99 END AS idx FROM results), ra AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, confidence DESC, idx, seq) AS place FROM rk)"


@spec("T3_blended_rank", ("results",), f"{RANKED} SELECT request, seq, score, CAST(place AS INTEGER) AS place FROM ra")
def _(s, d):
    return R.blended(A.results(s, d), PRIORITY).select("request", "seq", "score", "place")


@spec("T4_packing", ("results",), f"{RANKED}, tk AS (SELECT request, seq, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, place FROM ra), ru AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY request ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM tk) SELECT request, seq, tokens, running FROM ru WHERE running <= 4000")
def _(s, d):
    return R.packed(R.blended(A.results(s, d), PRIORITY), 4000).select("request", "seq", "tokens", "running")
