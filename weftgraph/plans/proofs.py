"""Queries of evaluation programmes and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import telemetry as T
from ..operators.providers import Provider, Registry, cached
from ..sources import adapters as A
from ..sources import notes as N
from .registry import spec

A.SQL.update(N.SQL)

HOLD = """
 hd AS (SELECT o_orderkey AS c, o_orderdate AS ts FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 600), od AS (SELECT c, row_number() OVER (ORDER BY ts, c) AS rn, count(*) OVER () AS n FROM hd),
 cf AS (SELECT DISTINCT c, rn, n, l_partkey AS f FROM od JOIN lineitem ON l_orderkey = c), tr AS (SELECT c, f FROM cf WHERE rn <= floor(n * 0.7)), te AS (SELECT c, f FROM cf WHERE rn > floor(n * 0.7)),
 gold AS (SELECT a.c, a.f AS q, b.f AS i FROM te a JOIN te b ON a.c = b.c AND a.f <> b.f), tl AS (SELECT c, q, count(*) AS gold FROM gold GROUP BY c, q),
 co AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY n DESC, i) AS place FROM (SELECT a.f AS q, b.f AS i, count(*) AS n FROM tr a JOIN tr b ON a.c = b.c AND a.f <> b.f GROUP BY 1, 2)),
 pm AS (SELECT f, count(*) AS n FROM tr GROUP BY f ORDER BY n DESC, f LIMIT 11), po AS (SELECT q, f AS i, row_number() OVER (PARTITION BY q ORDER BY n DESC, f) AS place FROM (SELECT DISTINCT q FROM tl), pm WHERE q <> f),
 kn AS (SELECT p_partkey AS f, p_size AS folder, p_partkey // 2 AS pair FROM part WHERE p_partkey IN (SELECT f FROM cf)),
 pa AS (SELECT a.f AS q, b.f AS i, row_number() OVER (PARTITION BY a.f ORDER BY CASE WHEN a.pair = b.pair THEN 0 ELSE 1 END, b.f) AS place FROM kn a JOIN kn b ON a.folder = b.folder AND a.f <> b.f WHERE a.f IN (SELECT q FROM tl)),
 bo AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY tier, place, i) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q, i ORDER BY tier, place) AS best FROM (SELECT *, 0 AS tier FROM co UNION ALL SELECT *, 1 FROM pa)) WHERE best = 1),
 al AS (SELECT 'co_change' AS predictor, * FROM co UNION ALL SELECT 'path', * FROM pa UNION ALL SELECT 'combined', * FROM bo UNION ALL SELECT 'popularity', * FROM po),
 ht AS (SELECT predictor, g.c, g.q, count(*) AS hits FROM gold g JOIN al ON al.q = g.q AND al.i = g.i AND al.place <= 10 GROUP BY ALL), pr(predictor) AS (VALUES ('co_change'), ('path'), ('combined'), ('popularity'))"""


@spec("E3_holdout", (), f"WITH {HOLD} SELECT pr.predictor, count(*) AS trials, round(avg(coalesce(ht.hits, 0) / tl.gold::DOUBLE), 8) AS recall FROM pr CROSS JOIN tl LEFT JOIN ht ON ht.predictor = pr.predictor AND ht.c = tl.c AND ht.q = tl.q GROUP BY pr.predictor")
def _(s, d):
    folders = A.table(s, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("folder"), F.floor(F.col("p_partkey") / 2).alias("pair"))
    return E.holdout(A.commit_files(s, d), folders).withColumn("recall", F.round("recall", 8))


@spec("E11_traces", ("calls",), ", t AS (SELECT callee FROM calls GROUP BY callee ORDER BY count(DISTINCT caller) DESC, callee LIMIT 15), f AS (SELECT callee, count(DISTINCT caller) AS n FROM calls WHERE callee IN (SELECT callee FROM t) GROUP BY callee) SELECT callee AS session, CAST(300 + least(n, 5) * 1000 + 1000 AS BIGINT) AS base, CAST(1000 AS BIGINT) AS repeat FROM f")
def _(s, d):
    told = E.traces(A.calls(s, d))
    cost = F.when(F.col("tool") == "Grep", 300).otherwise(1000).cast("long")
    own = told.withColumns({"would_have": cost, "injected": F.lit(100).cast("long"), "decision": F.lit("deny"), "command": F.lit(None).cast("string")})
    return T.buckets(own).select("session", (F.col("passed") + F.col("intercepted") + F.col("dedup")).alias("base"), F.col("dedup").alias("repeat"))


@spec("E12_fixture_benchmark", ("log",), "SELECT count(*) AS tasks, round((sum(would_have) - sum(injected))::DOUBLE / sum(would_have) * 100, 6) AS percent, (sum(would_have) - sum(injected))::DOUBLE / sum(would_have) * 100 >= 85 AS met FROM log WHERE would_have > 20")
def _(s, d):
    return E.reduction(A.log(s, d).filter("would_have > 20"), "would_have", "injected")


def _shape(path: str, context: dict) -> tuple[str, float] | None:
    return (f"{path} of {context['brand']}", 0.5) if context["size"] != "1" else None


def _risky(path: str, context: dict) -> tuple[str, float]:
    return f"ratio {100 // (int(context['size']) - 7)}", 0.9


@spec("E1_providers", (), "SELECT p_partkey AS request, 0::BIGINT AS seq, 'shape' AS provider, 'm' || p_partkey || ' of ' || p_brand AS content, 0.5::DOUBLE AS confidence FROM part WHERE p_size <> 1 UNION ALL SELECT p_partkey, 1, 'risky', 'ratio ' || CAST(floor(100.0::DOUBLE / (p_size - 7)) AS BIGINT), 0.9 FROM part WHERE p_size <> 7")
def _(s, d):
    own = Registry()
    own.add(Provider("shape", _shape))
    own.add(Provider("risky", _risky, tier=2))
    p = A.table(s, d, "part")
    context = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return own.resolved(p.select(F.col("p_partkey").alias("request"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("path"), context.alias("context")))


@spec("S17_cached_providers", (), "SELECT p_partkey AS request, 'shape' AS provider, CASE WHEN p_partkey % 3 = 0 THEN 'kept' ELSE 'm' || p_partkey || ' of ' || p_brand END AS content FROM part WHERE p_partkey % 3 = 0 OR p_size <> 1")
def _(s, d):
    own = Registry()
    own.add(Provider("shape", _shape, tier=2))
    p = A.table(s, d, "part")
    path = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    asked = p.select(F.col("p_partkey").alias("request"), path.alias("path"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("context"))
    # Two thirds were kept, but half of them too long ago.
    age = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(9_000_000)
    cache = p.filter("p_partkey % 3 < 2").select(F.lit("shape").alias("provider"), path.alias("path"), F.lit("kept").alias("content"), F.lit(0.7).alias("confidence"), (F.lit(10_000_000) - age).cast("long").alias("cached_at"), F.lit(60).cast("long").alias("ttl"))
    return cached(own, asked, cache, 10_000_000)[0].select("request", "provider", "content")


@spec("E6_tools", ("notes", "note_edges"), "SELECT 'gods' AS tool, id AS answer FROM (SELECT n.id, count(*) AS c FROM (SELECT source AS id FROM note_edges UNION ALL SELECT target FROM note_edges WHERE source <> target) b JOIN notes n ON n.id = b.id WHERE n.kind NOT IN ('file', 'import', 'module', 'concept') GROUP BY n.id ORDER BY c DESC, n.id LIMIT 5) UNION ALL SELECT 'mistakes', id FROM (SELECT id FROM notes WHERE kind = 'mistake' AND source_file = 'src/f3.ts' ORDER BY last_verified DESC, id LIMIT 20) UNION ALL SELECT 'stats', (SELECT count(*) FROM notes) || ' ' || (SELECT count(*) FROM note_edges)")
def _(s, d):
    from ..api import Graph

    edges = N.note_edges(s, d).withColumn("confidence", F.lit("EXTRACTED"))
    own = Graph(N.notes(s, d), edges)
    answer = lambda tool, df, c: df.select(F.lit(tool).alias("tool"), c.alias("answer"))
    stats = own.stats()
    return answer("gods", own.gods(5), F.col("id")).unionAll(answer("mistakes", own.mistakes("src/f3.ts"), F.col("id"))).unionAll(answer("stats", stats, F.concat_ws(" ", F.col("nodes").cast("string"), F.col("edges").cast("string"))))
