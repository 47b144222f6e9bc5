"""Queries over notes, messages and files: stores, predicates, joins, the question, packets, guards and extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as Q
from ..functions import text as X
from ..operators import extract as EX
from ..operators import graph as G
from ..operators import guard as GU
from ..operators import incremental as I
from ..operators import mining as M
from ..operators import paths as PA
from ..operators import postings as PO
from ..operators import rank as R
from ..operators import reports as P
from ..operators import search as S
from ..operators import store as ST
from ..operators import tables as TS
from ..operators import telemetry as T
from ..sources import adapters as A
from ..sources import files as FI
from ..sources import notes as N
from ..ship import ship
from .registry import PAIRS, PRIORITY, co_changes, oracle_sql, queries, spec  # noqa: F401  (the whole table is read through this module)
A.SQL.update(N.SQL)
from . import more, proofs, wider  # noqa: E402, F401  isort: skip

AS_OF = 1704672000000  # 2024-01-08 in milliseconds
JSON = "json_extract_string(metadata, '$.{}')"
HIDDEN = "(kind = 'concept' AND metadata = '{\"subkind\":\"keyword\"}')"
HOT = "(kind = 'pattern' AND metadata LIKE '{\"type\":\"hot_file\"%')"


def _count():
    return F.count(F.lit(1))


# Stores and sinks
@spec("S1_open", ("nodes",), "SELECT id, label, kind, source_file, CAST(0 AS BIGINT) AS query_count, '{}' AS metadata FROM nodes")
def _(s, d):
    at = FI.scratch(s)
    A.nodes(s, d).write.parquet(at)
    return ST.opened(s, at).select("id", "label", "kind", "source_file", "query_count", "metadata")


@spec("K2_bulk_upsert", ("notes",), "SELECT id, kind, CASE WHEN kind = 'mistake' THEN 0 ELSE query_count END AS query_count FROM notes")
def _(s, d):
    n, at = N.notes(s, d).select("id", "kind", "query_count"), FI.scratch(s)
    ST.bulk_upsert(at, n, "id")
    return ST.bulk_upsert(at, n.filter("kind = 'mistake'").withColumn("query_count", F.lit(0).cast("long")), "id")


@spec("K8_cache_put", ("log",), "SELECT path, arg_max(ts, seq) AS cached_at, arg_max(injected, seq) AS size FROM log GROUP BY path")
def _(s, d):
    rows = A.log(s, d).select("path", F.col("ts").alias("cached_at"), F.col("injected").alias("size"), "seq")
    newest = rows.groupBy("path").agg(F.max_by(F.struct("cached_at", "size"), "seq").alias("r")).select("path", "r.*", F.lit(1).alias("seq"))
    old = rows.groupBy("path").agg(F.min_by(F.struct("cached_at", "size"), "seq").alias("r")).select("path", "r.*", F.lit(0).alias("seq"))
    return ST.upsert(old, newest, "path").drop("seq")


@spec("K10_append_rotate", ("log",), "SELECT tool, count(*) AS n FROM log WHERE k >= 50 GROUP BY tool")
def _(s, d):
    at, rows = FI.scratch(s) + "/log.jsonl", A.log(s, d).select("seq", "tool", "k")
    FI.append_log(rows.filter("k < 50"), at, 1)
    FI.append_log(rows.filter("k >= 50 AND k < 80"), at, 1)  # the log has reached its size: the first part is moved, then the second
    FI.append_log(rows.filter("k >= 80"), at, 1)
    return FI.log_lines(s, "seq long, tool string, k long", at + ".1", at).groupBy("tool").agg(_count().alias("n"))


@spec("K11_migrate", ("notes", "note_edges"), "SELECT id, kind, query_count, applies_to, CAST(NULL AS VARCHAR) AS invalidated_by_commit, CAST(6 AS BIGINT) AS n_tables, (SELECT count(*) FROM note_edges) AS n_edges FROM notes")
def _(s, d):
    own = TS.TableSet(s, FI.scratch(s))
    own.commit({"nodes": N.notes(s, d), "edges": N.note_edges(s, d)}, schema=1)
    TS.migrate(own)
    TS.migrate(own, 6)
    TS.migrate(own, 9)  # up again: caches come back empty, co-change stays away
    return own.read("nodes").select("id", "kind", "query_count", "applies_to", "invalidated_by_commit", F.lit(len(own.version().tables)).cast("long").alias("n_tables"), F.lit(own.read("edges").count()).cast("long").alias("n_edges"))


@spec("K11_restore", ("notes",), "SELECT kind, count(*) AS n FROM notes GROUP BY kind")
def _(s, d):
    own, n = TS.TableSet(s, FI.scratch(s)), N.notes(s, d)
    kept = own.commit({"nodes": n}, schema=1).number
    own.commit({"nodes": n.filter("kind = 'mistake'")})
    own.restore(kept)
    own.vacuum(1)
    return own.read("nodes").groupBy("kind").agg(_count().alias("n"))


@spec("K12_report_file", ("notes",), "SELECT line FROM (SELECT '- ' || label AS line FROM notes WHERE kind = 'mistake' ORDER BY query_count DESC, id LIMIT 5) UNION ALL SELECT '## Known issues'")
def _(s, d):
    rows = P._top(N.notes(s, d).filter("kind = 'mistake'"), "mistakes", F.concat(F.lit("- "), "label"), F.desc("query_count"), "id", k=5)
    at = FI.scratch(s) + "/report.md"
    FI.write_text(s, at, P.spliced("# Mine\n", P.document(rows, "Index", {"mistakes": "Known issues"})))
    lines = FI.whole(s, at).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line LIKE '- %' OR line LIKE '## %'")


# Files
@spec("S7_walk", (), "SELECT 'src/r' || n_regionkey || '/' || lower(replace(n_name, ' ', '_')) || '.ts' AS path, CAST(length('export class ' || n_name || ' {}') AS BIGINT) AS size, 'export class ' || n_name || ' {}' AS text FROM nation")
def _(s, d):
    at = FI.scratch(s)
    rows = A.table(s, d, "nation").collect()  # 25 rows
    for r in rows:
        text, name = f"export class {r['n_name']} {{}}", r["n_name"].lower().replace(" ", "_")
        for path in (f"src/r{r['n_regionkey']}/{name}.ts", f"src/node_modules/{name}.ts", f"src/.hidden/{name}.ts", f"src/old/{name}.ts", f"src/r{r['n_regionkey']}/{name}.md"):
            FI.write_text(s, f"{at}/{path}", text)
    return FI.walk(s, at, (".ts",), ignore=("old",)).select("path", "size", "text")


def _log_files(s, d) -> str:
    """The log as JSON lines in two projects' folders: the current file, and one rotated by k; every tenth line is torn."""
    at, line = FI.scratch(s), F.to_json(F.struct("seq", "path", "injected"))
    rows = A.log(s, d).select(F.when(F.col("seq") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"), "k")
    for p in (0, 1):
        for name, low, high in (("log.jsonl", 0, 50), ("log.jsonl.1", 50, 1000)):
            rows.filter((F.col("k") % 2 == p) & F.col("k").between(low, high - 1)).select("value").write.text(f"{at}/{name}/project{p}")
    return at


FIELDS = "seq long, path string, injected long"


@spec("S8_jsonl_scan", ("log",), "SELECT seq, path, injected FROM log WHERE seq % 10 <> 0")
def _(s, d):
    at, line = FI.scratch(s), F.to_json(F.struct("seq", "path", "injected"))
    # Every tenth line is torn, as a writer that was stopped leaves it.
    A.log(s, d).select(F.when(F.col("seq") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(f"{at}/log.jsonl")
    return FI.log_lines(s, FIELDS, f"{at}/log.jsonl").drop("project")


@spec("S9_jsonl_projects", ("log",), "SELECT 'project' || (k % 2) AS project, count(*) AS n, CAST(sum(injected) AS BIGINT) AS injected FROM log WHERE seq % 10 <> 0 GROUP BY 1")
def _(s, d):
    at = _log_files(s, d)
    got = FI.log_lines(s, FIELDS, *(f"{at}/{name}/project{p}" for name in ("log.jsonl", "log.jsonl.1") for p in (0, 1, 7)))
    return got.groupBy("project").agg(_count().alias("n"), F.sum("injected").alias("injected"))


NOTE_TEXT = "'We decided to move; went with plan ' || p_size || ' because of cost. Error: the cache of part ' || p_partkey || ' is stale' || chr(10) || 'Don''t use globals here. Our approach is to log every call of ' || p_brand || chr(10) || 'ERROR: the cache of part ' || p_partkey || ' is stale'"


def _note_files(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.expr(NOTE_TEXT.replace("''", "\\'").replace("chr(10)", "char(10)")).alias("text"))


def _note_sql() -> str:
    parts = [f"SELECT file, {n} AS n, '{k}' AS kind, {c} AS confidence_score, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1), 1) AS i FROM f" for n, (k, c, p) in enumerate(EX.NOTE_PATTERNS)]
    return f"WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS file, {NOTE_TEXT} AS text FROM part), m AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, trim(raw) AS label, row_number() OVER (PARTITION BY file, lower(trim(raw)) ORDER BY n, i) AS q FROM m WHERE length(trim(raw)) >= 5) SELECT file, label, kind, confidence_score::DOUBLE AS confidence_score FROM r WHERE q = 1"


@spec("X19_notes", (), _note_sql())
def _(s, d):
    return EX.notes_of(_note_files(s, d))


@spec("S13_note_files", (), "SELECT 'the cache of ' || lower(n_name) || ' is stale' AS label, 'mistake' AS kind FROM nation")
def _(s, d):
    at = FI.scratch(s)
    for r in A.table(s, d, "nation").collect():  # 25 rows
        FI.write_text(s, f"{at}/notes{r['n_nationkey']}.md", f"# Notes\n\nError: the cache of {r['n_name']} is stale\nERROR: The cache of {r['n_name']} is stale")
    return EX.notes_of(FI.whole(s, f"{at}/*.md", f"{at}/missing.md")).filter("kind = 'mistake'").select(F.lower("label").alias("label"), "kind")


SKILL = "'---' || chr(10) || 'name: ' || lower(replace(n_name, '_', '-')) || chr(10) || 'description: >' || chr(10) || '  About ' || n_name || chr(10) || '  Use when region ' || n_regionkey || ' is meant.' || chr(10) || 'metadata:' || chr(10) || '  version: \"1.' || n_nationkey || '\"' || chr(10) || '---' || chr(10) || 'Say \"go to ' || n_name || '\" here.' || chr(10) || chr(10) || '## Related Skills' || chr(10) || '- `nation-3`' || chr(10) || '* nowhere' || chr(10)"


def _skills(s, d):
    at = FI.scratch(s)
    for r in A.table(s, d, "nation").select("n_nationkey", F.expr(SKILL.replace("chr(10)", "char(10)")).alias("text")).collect():  # 25 rows
        FI.write_text(s, f"{at}/s{r['n_nationkey']}/SKILL.md", r["text"])
    return FI.skill_files(s, at)


@spec("S14_skill_files", (), f"SELECT 's' || n_nationkey AS folder, {SKILL} AS text FROM nation")
def _(s, d):
    return _skills(s, d).select(F.element_at(F.split("path", "/"), -2).alias("folder"), "text")


@spec("X17_front_matter", (), "SELECT lower(replace(n_name, '_', '-')) AS name, 'About ' || n_name || ' Use when region ' || n_regionkey || ' is meant.' AS description, true AS parsed FROM nation")
def _(s, d):
    return EX.skills(_skills(s, d)).select("name", "description", "parsed")


@spec("X18_triggers", (), "SELECT lower(replace(n_name, '_', '-')) AS name, unnest(['go to ' || n_name, 'region ' || n_regionkey || ' is meant', 'related nation-3', 'related nowhere']) AS said FROM nation")
def _(s, d):
    own = EX.skills(_skills(s, d))
    return own.select("name", F.explode(F.concat("triggers", F.transform("related", lambda x: F.concat(F.lit("related "), x)))).alias("said"))


@spec("J13_related_skills", (), "SELECT lower(replace(n_name, '_', '-')) AS source, 'nation-3' AS target FROM nation WHERE n_name <> 'NATION_3'")
def _(s, d):
    return EX.related_edges(EX.skills(_skills(s, d)))


HEADS = ("Decisions", "Known issues", "Architecture", "Other things", "Design")


@spec("S15_index_import", (), "SELECT n_name AS label, CASE n_regionkey WHEN 0 THEN 'decision' WHEN 1 THEN 'mistake' WHEN 3 THEN 'concept' ELSE 'pattern' END AS kind FROM nation")
def _(s, d):
    at, rows = FI.scratch(s), A.table(s, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    text = "# Index\r\n" + "".join(f"## {h}\r\n\r\ntext\r\n" + "".join(f"{'-*'[r['n_nationkey'] % 2]} {r['n_name']}\r\n" for r in rows if r["n_regionkey"] == i) for i, h in enumerate(HEADS))
    FI.write_text(s, f"{at}/index.md", text)
    return FI.index_entries(FI.whole(s, f"{at}/index.md")).select("label", "kind")


def _memory(s, d):
    at, rows = FI.scratch(s), A.table(s, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    FI.write_text(s, f"{at}/MEMORY.md", "# Memory\n" + "".join(f"- [{r['n_name']}](m/{r['n_nationkey']}.md) — of region {r['n_regionkey']}\n- no link\n" for r in rows))
    return FI.memory_entries(FI.whole(s, f"{at}/MEMORY.md"))


@spec("S16_memory_index", (), "SELECT n_name AS title, 'm/' || n_nationkey || '.md' AS file, 'of region ' || n_regionkey AS description FROM nation")
def _(s, d):
    return _memory(s, d).select("title", "file", "description")


@spec("X24_memory_score", (), "SELECT n_name AS title, CAST(CASE WHEN contains(lower(n_name), 'nation_1') THEN 3 ELSE 0 END + CASE WHEN n_regionkey = 2 OR contains(lower(n_name), 'n_2') THEN 2 ELSE 0 END + CASE WHEN contains(lower(n_name), 'on_') THEN 1 ELSE 0 END AS INTEGER) AS score FROM nation")
def _(s, d):
    return _memory(s, d).select("title", Q.memory_score(F.col("title"), F.col("description"), "on_/Nation_1.ts", ("ab", "n_2", "region 2")).alias("score"))


# Predicates
@spec("F1_search", ("notes",), "SELECT id, label, query_count FROM notes WHERE contains(lower(label), 'of f1') OR contains(lower(id), 'of f1') ORDER BY query_count DESC, id LIMIT 20")
def _(s, d):
    return ST.search(N.notes(s, d), "OF f1").select("id", "label", "query_count")


CHANGED = "nn AS (SELECT id, CASE WHEN kind = 'class' THEN label || ' renewed' ELSE label END AS label FROM nodes WHERE kind <> 'interface')"


@spec("F1_index_search", ("nodes",), f", {CHANGED}, q(t) AS (VALUES ('renewed'), ('asia'), ('#4'), ('customer'), ('part:12'), ('azure')) SELECT t AS term, id FROM q JOIN nn ON contains(lower(label), t) OR contains(lower(id), t)")
def _(s, d):
    # Built over all nodes; then classes get other labels and interfaces go.
    n, index = A.nodes(s, d).select("id", "label", "kind"), PO.SearchIndex(s, FI.scratch(s))
    index.build(n)
    renewed = F.concat("label", F.lit(" renewed"))
    index.change(n.filter("kind = 'class'").withColumn("label", renewed), n.filter("kind = 'interface'"))
    now = n.filter("kind <> 'interface'").withColumn("label", F.when(F.col("kind") == "class", renewed).otherwise(F.col("label")))
    found = [index.search(now, t, None).select(F.lit(t).alias("term"), "id") for t in ("renewed", "asia", "#4", "customer", "part:12", "azure")]
    return reduce(DataFrame.unionAll, found)


@spec("F2_hidden_keywords", ("notes",), f"SELECT id FROM notes WHERE {HIDDEN}")
def _(s, d):
    return N.notes(s, d).filter(S.hidden()).select("id")


@spec("F5_mistakes", ("notes",), f"SELECT id, label, last_verified FROM notes WHERE kind = 'mistake' AND source_file = 'src/f7.ts' AND last_verified >= {AS_OF - 5 * 86_400_000} AND (valid_until IS NULL OR valid_until > {AS_OF}) ORDER BY last_verified DESC, id LIMIT 20")
def _(s, d):
    return ST.mistakes(N.notes(s, d), "src/f7.ts", AS_OF - 5 * 86_400_000, AS_OF).select("id", "label", "last_verified")


PATHS = "CASE p_partkey % 9 WHEN 0 THEN '/proc/' || p_partkey WHEN 1 THEN '/w/node_modules/a.ts' WHEN 2 THEN '/w/img' || p_partkey || '.PNG' WHEN 3 THEN '/w/.env.local' WHEN 4 THEN 'C:/Windows/x.ini' WHEN 5 THEN '/w/certs/a' || p_partkey || '.pem' WHEN 6 THEN '/w/ID_RSA' WHEN 7 THEN '/w/.git/HEAD' ELSE '/w/src/m' || p_partkey || '.ts' END"


@spec("F7_path_safety", (), f"SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'system' WHEN 1 THEN 'exempt' WHEN 2 THEN 'binary' WHEN 3 THEN 'secret' WHEN 4 THEN 'system' WHEN 5 THEN 'secret' WHEN 6 THEN 'secret' WHEN 7 THEN 'exempt' ELSE 'safe' END AS state FROM part")
def _(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").alias("id"), Q.path_state(F.expr(PATHS)).alias("state"))


@spec("F9_fix_subject", ("messages",), "SELECT sha FROM messages WHERE (regexp_matches(trim(subject), '(?i)^(fix|bugfix|hotfix)(\\([^)]+\\))?!?:\\s') OR regexp_matches(trim(subject) || chr(10) || body, '(?i)\\b(fix(es|ed)?|close[sd]?|resolve[sd]?)\\s+#[0-9]+')) AND NOT regexp_matches(trim(subject), '(?i)^(revert\\b|(fixup|squash)!)')")
def _(s, d):
    return N.messages(s, d).filter(X.is_fix(F.col("subject"), F.col("body"))).select("sha")


@spec("F10_revert", ("messages",), "SELECT sha FROM messages WHERE regexp_matches(body, '(?i)This reverts commit\\s+[0-9a-f]{7,40}')")
def _(s, d):
    return N.messages(s, d).filter(X.is_revert(F.col("subject"), F.col("body"))).select("sha")


@spec("F11_hot_file", ("notes",), f"SELECT id FROM notes WHERE {HOT}")
def _(s, d):
    return N.notes(s, d).filter(P.is_hot()).select("id")


@spec("S12_newest_messages", ("messages",), "SELECT sha, subject, body FROM messages ORDER BY ts DESC, sha LIMIT 300")
def _(s, d):
    return N.messages(s, d).orderBy(F.desc("ts"), "sha").limit(300).select("sha", "subject", "body")


# Joins
@spec("J12_revert_pairs", ("messages",), "SELECT r.sha, o.sha AS original, regexp_replace(o.subject, '(?i)^Revert\\s+', '') AS believed FROM (SELECT sha, lower(regexp_extract(body, '(?i)This reverts commit\\s+([0-9a-f]{7,40})', 1)) AS p FROM messages) r JOIN messages o ON substr(o.sha, 1, 7) = substr(r.p, 1, 7) AND starts_with(o.sha, r.p) WHERE r.p <> ''")
def _(s, d):
    m = N.messages(s, d)
    made = m.filter(X.is_revert(F.col("subject"), F.col("body"))).select("sha", F.lower(X.reverted_sha(F.col("body"))).alias("p")).withColumn("k", F.substring("p", 1, 7))
    old = m.select(F.col("sha").alias("original"), Q.revert_subject(F.col("subject")).alias("believed"), F.substring("sha", 1, 7).alias("k"))
    return made.join(old, "k").filter(F.col("original").startswith(F.col("p"))).select("sha", "original", "believed")


@spec("X23_revert_pattern", ("messages",), "SELECT sha, CASE WHEN regexp_matches(subject, '(?i)^Revert\\s+\"(.+)\"\\s*$') THEN regexp_extract(subject, '(?i)^Revert\\s+\"(.+)\"\\s*$', 1) ELSE regexp_replace(subject, '(?i)^Revert\\s+', '') END AS subject, CASE author % 3 WHEN 0 THEN 'git revert in src/a' || (author % 5) || '/' WHEN 1 THEN 'git revert touching m' || author ELSE 'git revert' END AS pattern FROM messages")
def _(s, d):
    a = F.col("author").cast("string")
    folder = F.concat(F.lit("src/a"), (F.col("author") % 5).cast("string"))
    files = F.when(F.col("author") % 3 == 0, F.array(F.concat(folder, F.lit("/x.ts")), F.concat(folder, F.lit("/y.ts")))).when(F.col("author") % 3 == 1, F.array(F.concat(F.lit("src/m"), a, F.lit(".ts")), F.lit("lib/z.ts"))).otherwise(F.array().cast("array<string>"))
    return N.messages(s, d).select("sha", Q.revert_subject(F.col("subject")).alias("subject"), Q.revert_pattern(files).alias("pattern"))


SURE = f"kind = 'mistake' AND confidence_score >= 0.8 AND (valid_until IS NULL OR valid_until > {AS_OF})"


@spec("J14_mistakes_of_files", ("notes",), ", fl AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN './' ELSE '' END || 'src/f' || (p_partkey % 30) || '.ts' AS path FROM part) SELECT n.id, fl.path FROM notes n JOIN fl ON regexp_replace(fl.path, '^\\./', '') = n.source_file WHERE n.kind = 'mistake'")
def _(s, d):
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "./").otherwise(""), F.lit("src/f"), (F.col("p_partkey") % 30).cast("string"), F.lit(".ts"))
    return GU.of_files(N.notes(s, d).filter("kind = 'mistake'"), A.table(s, d, "part").select(path.alias("path")).distinct()).select("id", "path")


COMMAND = "CASE WHEN o_orderkey % 3 = 0 THEN 'cd x && MAKE f' || (o_orderkey % 120) WHEN o_orderkey % 3 = 1 THEN 'vim src/F' || (o_orderkey % 25) || '.ts' ELSE 'ls -la' END"
GUARDED = f"""cmd AS (SELECT o_orderkey AS seq, lower({COMMAND}) AS c FROM orders), mi AS (SELECT id, lower(json_extract_string(metadata, '$.commandPattern')) AS pat, lower(source_file) AS file FROM notes WHERE {SURE}),
 hit AS (SELECT k.c, m.id FROM (SELECT DISTINCT c FROM cmd) k JOIN mi m ON (length(m.pat) > 4 AND contains(k.c, m.pat)) OR (length(m.file) > 5 AND contains(k.c, m.file))), mt AS (SELECT cmd.seq, hit.id FROM cmd JOIN hit ON hit.c = cmd.c)"""


def _commands(s, d):
    return A.table(s, d, "orders").select(F.col("o_orderkey").alias("seq"), F.expr(COMMAND).alias("command"))


@spec("J15_mistakes_of_commands", ("notes",), f", {GUARDED} SELECT seq, id FROM mt")
def _(s, d):
    return GU.by_command(N.notes(s, d).filter("kind = 'mistake'"), _commands(s, d), AS_OF)


@spec("P11_pre_mortem", ("notes",), f""", {GUARDED}, pl AS (SELECT mt.seq, n.*, row_number() OVER (PARTITION BY mt.seq ORDER BY n.last_verified DESC, n.id) AS place, count(*) OVER (PARTITION BY mt.seq) AS total FROM mt JOIN notes n ON n.id = mt.id)
 SELECT seq, 'allow' AS decision, CAST(place AS INTEGER) AS place, id, coalesce(applies_to, label) AS what, source_file AS file, CASE WHEN found_false_at > 0 THEN strftime(make_timestamp(found_false_at * 1000), '%Y-%m-%d') END AS found_false,
 then_believed AS believed, truth_now AS truth, greatest(total - 5, 0) AS more FROM pl WHERE place <= 5""")
def _(s, d):
    own = N.notes(s, d).filter("kind = 'mistake'")
    return GU.warned(own, _commands(s, d), AS_OF).drop("age")


@spec("J16_label_boost", ("notes", "results"), ", lb AS (SELECT DISTINCT lower(label) AS l FROM notes WHERE kind = 'mistake') SELECT r.seq, EXISTS (SELECT 1 FROM lb WHERE contains(lower(r.content || ' Mistake ' || r.seq || ' of f' || (r.seq % 20)), lb.l)) AS named FROM results r")
def _(s, d):
    body = F.concat("content", F.lit(" Mistake "), F.col("seq").cast("string"), F.lit(" of f"), (F.col("seq") % 20).cast("string"))
    return GU.named(A.results(s, d).select(F.col("seq").alias("id"), body.alias("text")), N.notes(s, d).filter("kind = 'mistake'")).withColumnRenamed("id", "seq")


@spec("J17_node_context", ("notes", "note_edges"), ", imp AS (SELECT n.source_file, string_split(e.target, ':')[-1] AS name FROM notes n JOIN note_edges e ON (e.source = n.id OR e.target = n.id) AND e.relation = 'depends_on') SELECT f.source_file, f.n, coalesce(i.imports, 0) AS imports, EXISTS (SELECT 1 FROM part WHERE contains(lower(p_name), regexp_extract(f.source_file, '([0-9]+)', 1))) AS has_tests FROM (SELECT source_file, count(*) AS n FROM notes GROUP BY source_file) f LEFT JOIN (SELECT source_file, count(DISTINCT name) AS imports FROM imp GROUP BY source_file) i ON i.source_file = f.source_file")
def _(s, d):
    n, e = N.notes(s, d).select("id", "source_file"), N.note_edges(s, d).filter("relation = 'depends_on'")
    ends = e.select(F.explode(F.array("source", "target")).alias("id"), F.element_at(F.split("target", ":"), -1).alias("name"))
    imports = ends.join(n, "id").groupBy("source_file").agg(F.countDistinct("name").alias("imports"))
    files = n.groupBy("source_file").agg(_count().alias("n")).withColumn("key", F.regexp_extract("source_file", "([0-9]+)", 1))
    # Names are met by their runs of digits, each with all its parts.
    digits = A.table(s, d, "part").select(F.explode(F.regexp_extract_all("p_name", F.lit("[0-9]+"), F.lit(0))).alias("run")).distinct()
    starts = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.array(F.substr("run", i, F.lit(1)), F.substr("run", i, F.lit(2))))))
    tests = digits.select(starts.alias("key")).distinct().withColumn("has", F.lit(True))
    return files.join(imports, "source_file", "left").join(tests, "key", "left").select("source_file", "n", F.coalesce("imports", F.lit(0).cast("long")).alias("imports"), F.coalesce("has", F.lit(False)).alias("has_tests"))


CODE_LINES = "'import \"fmt\"' || chr(10) || 'const a = run' || (p_partkey % 40) || '(1)' || chr(10) || '  return $run' || (p_partkey % 40) || chr(10) || 'x.run' || (p_partkey % 40) || 'x()' || chr(10) || 'run' || (p_partkey % 40) || ';'"


def _code_files(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").alias("file"), F.expr(CODE_LINES.replace("chr(10)", "char(10)")).alias("text"))


@spec("J10_call_sites", (), f"WITH f AS (SELECT p_partkey AS file, 'run' || (p_partkey % 40) AS symbol, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS nth FROM part), l AS (SELECT symbol, file, unnest([2, 5]) AS line FROM f WHERE nth <= 15), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY file, line) AS q FROM l) SELECT symbol, file, CAST(line AS BIGINT) AS line, CASE line WHEN 2 THEN 'const a = ' || symbol || '(1)' ELSE symbol || ';' END AS text FROM r WHERE q <= 25")
def _(s, d):
    callers = A.table(s, d, "part").select(F.concat(F.lit("run"), (F.col("p_partkey") % 40).cast("string")).alias("symbol"), F.col("p_partkey").alias("file"))
    return EX.call_sites(callers, _code_files(s, d))


# Calls and paths
@spec("J4_callers", ("nodes", "calls"), "SELECT DISTINCT c.callee, coalesce(f.label, 'supplier:' || c.caller) AS caller_file FROM calls c LEFT JOIN (SELECT * FROM nodes WHERE kind = 'class') f ON f.id = 'supplier:' || c.caller WHERE 'part:' || c.callee IN (SELECT id FROM nodes WHERE kind = 'function')")
def _(s, d):
    n = A.nodes(s, d).select("id", "label", "kind")
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias(c)
    calls = A.calls(s, d).select(named("part", "callee"), named("supplier", "caller"))
    got = M.callers(calls, n.filter("kind = 'function'").select(F.col("id").alias("callee")), n.filter("kind = 'class'").select(F.col("id").alias("caller"), "label"))
    return got.select(F.expr("cast(substr(callee, 6) as bigint)").alias("callee"), "caller_file")


@spec("G8_callers", ("calls",), "SELECT p.p_name AS name, CAST(count(DISTINCT c.caller) AS BIGINT) AS n, string_agg(DISTINCT lpad(CAST(c.caller AS VARCHAR), 9, '0'), ',' ORDER BY lpad(CAST(c.caller AS VARCHAR), 9, '0')) AS files FROM calls c JOIN part p ON p.p_partkey = c.callee GROUP BY p.p_name")
def _(s, d):
    names = A.table(s, d, "part").select(F.col("p_partkey").alias("callee"), F.col("p_name").alias("name"))
    files = F.sort_array(F.collect_set(F.lpad(F.col("caller").cast("string"), 9, "0")))
    return A.calls(s, d).join(names, "callee").groupBy("name").agg(F.countDistinct("caller").alias("n"), F.array_join(files, ",").alias("files"))


@spec("G8_callees", ("calls",), "SELECT DISTINCT c.caller, p.p_name AS name, c.owner AS file FROM calls c JOIN part p ON p.p_partkey = c.callee ORDER BY c.caller, name, file")
def _(s, d):
    names = A.table(s, d, "part").select(F.col("p_partkey").alias("callee"), F.col("p_name").alias("name"))
    return A.calls(s, d).join(names, "callee").select("caller", "name", F.col("owner").alias("file")).distinct().orderBy("caller", "name", "file")


@spec("G7_impact", ("calls",), ", dep AS (SELECT DISTINCT owner AS a, caller AS b FROM calls WHERE owner <> caller), og AS (SELECT a AS origin FROM dep GROUP BY a ORDER BY count(*) DESC, a LIMIT 10), reach(origin, id) AS (SELECT origin, origin FROM og UNION SELECT r.origin, dep.b FROM reach r JOIN dep ON dep.a = r.id) SELECT origin, id FROM reach WHERE origin <> id", recursive=True)
def _(s, d):
    # An origin's impact is asked for; here those of the ten files that most depend on.
    dep = G.checkpointed(M.reverse_dependencies(A.calls(s, d)))
    return G.closure(dep, dep.groupBy(F.col("a").alias("origin")).agg(_count().alias("n")).orderBy(F.desc("n"), "origin").limit(10).select("origin"))


PATHED = "fk AS (SELECT p_partkey AS key0, 'src/s' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '/tests' ELSE '' END || '/m' || (p_partkey // 2) || CASE WHEN p_partkey % 2 = 1 THEN '.test.ts' ELSE '.ts' END AS path FROM part), files AS (SELECT path FROM fk)"
FOCAL = "kf AS (SELECT * FROM kd WHERE path IN (SELECT path FROM fk WHERE key0 IN (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(DISTINCT l_orderkey) DESC, 1 LIMIT 20)))"
SIB = "sib AS (SELECT a.path AS focal, b.path AS file FROM kf a JOIN kd b ON a.dir = b.dir AND a.path <> b.path)"
CPT = "cpt AS (SELECT a.path AS focal, b.path AS file FROM kf a JOIN kd b ON a.key = b.key AND a.test <> b.test WHERE a.dir = b.dir OR CASE WHEN a.test THEN a.path ELSE b.path END LIKE '%/tests/%')"
NEAR = f"WITH {PATHED}, {more.KEYED}, {FOCAL}, {SIB}, {CPT}"


def _focal(s, d):
    """All files, and those of the twenty parts that change most."""
    hot = M.hot_files(A.commit_files(s, d), 1).select(F.col("file").alias("p_partkey"))
    p = A.table(s, d, "part").select("p_partkey", "p_size")
    key, folder = F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "/tests").otherwise("")
    path = F.concat(F.lit("src/s"), F.col("p_size").cast("string"), folder, F.lit("/m"), F.floor(key / 2).cast("string"), F.when(key % 2 == 1, ".test.ts").otherwise(".ts"))
    files = p.select("p_partkey", path.alias("path"))
    return files.select("path"), files.join(F.broadcast(hot), "p_partkey", "left_semi").select("path")


@spec("G14_siblings", (), f"{NEAR} SELECT focal, file FROM sib")
def _(s, d):
    return PA.siblings(*_focal(s, d))


@spec("G15_counterparts", (), f"{NEAR} SELECT focal, file FROM cpt")
def _(s, d):
    return PA.counterparts(*_focal(s, d))


@spec("G16_path_reach", (), f"{NEAR} SELECT focal, file FROM sib UNION SELECT focal, file FROM cpt")
def _(s, d):
    return PA.reach(*_focal(s, d))


@spec("G17_four_tiers", (), f"{NEAR}, kp AS (SELECT fk.key0, kf.path FROM kf JOIN fk ON fk.path = kf.path), lk AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), ad AS (SELECT kp.path AS focal, fk.path AS file, abs(fk.key0 - kp.key0) AS rank, 1 AS tier FROM kp JOIN fk ON abs(fk.key0 - kp.key0) = 7), cc AS (SELECT kp.path AS focal, fk.path AS file, -count(*) AS rank, 2 AS tier FROM kp JOIN lk a ON a.f = kp.key0 JOIN lk b ON b.c = a.c AND b.f <> a.f JOIN fk ON fk.key0 = b.f GROUP BY 1, 2 HAVING count(*) >= 2), al AS (SELECT * FROM ad UNION ALL SELECT * FROM cc UNION ALL SELECT focal, file, 0, 3 FROM cpt UNION ALL SELECT focal, file, 0, 4 FROM sib), be AS (SELECT *, row_number() OVER (PARTITION BY focal, file ORDER BY tier, rank) AS q FROM al WHERE focal <> file) SELECT focal, file, tier, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY tier, rank, file) AS place FROM be WHERE q = 1) WHERE place <= 10")
def _(s, d):
    files, focal = _focal(s, d)
    key, folder = F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "/tests").otherwise("")
    path = F.concat(F.lit("src/s"), F.col("p_size").cast("string"), folder, F.lit("/m"), F.floor(key / 2).cast("string"), F.when(key % 2 == 1, ".test.ts").otherwise(".ts"))
    named = A.table(s, d, "part").select(key.alias("key"), path.alias("path"))
    own = named.join(F.broadcast(focal), "path", "left_semi").select("key", F.col("path").alias("focal"))
    near = own.select("focal", F.explode(F.array(F.col("key") - 7, F.col("key") + 7)).alias("key")).join(named.select("key", F.col("path").alias("file")), "key").select("focal", "file", F.lit(7).cast("long").alias("rank"))
    lines = A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("key")).distinct()
    mine = lines.join(F.broadcast(own), "key").select("c", F.col("key").alias("own"), "focal")
    co = lines.join(mine, "c").filter("key <> own").groupBy("focal", "key").agg(_count().alias("n")).filter("n >= 2").join(named.select("key", F.col("path").alias("file")), "key").select("focal", "file", (-F.col("n")).alias("rank"))
    flat = lambda df: df.withColumn("rank", F.lit(0).cast("long"))
    return G.related_files(near, co, flat(PA.counterparts(files, focal)), flat(PA.siblings(files, focal)))


def _path_sql(hops: int) -> str:
    out = ["s0 AS (SELECT CAST(42 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, 0 AS lvl)"]
    out += [f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT l.b, min(l.a), {i} FROM ln l JOIN s{i - 1} f ON f.id = l.a AND f.lvl = {i - 1} WHERE l.b NOT IN (SELECT id FROM s{i - 1}) GROUP BY l.b)" for i in range(1, hops + 1)]
    back = f"bk(id, lvl) AS (SELECT id, lvl FROM s{hops} WHERE id = 1000 UNION ALL SELECT p.parent, bk.lvl - 1 FROM bk JOIN s{hops} p ON p.id = bk.id WHERE p.parent IS NOT NULL)"
    return f", {PAIRS}, {', '.join(out)}, {back} SELECT lvl AS step, id FROM bk"


@spec("G5_shortest_path", ("commits",), _path_sql(8), recursive=True)
def _(s, d):
    pairs = co_changes(s, d).filter("n >= 2").select(F.col("file_a").alias("a"), F.col("file_b").alias("b"))
    return G.shortest_path(G.checkpointed(pairs), 42, 1000)


# The question
TERMS = ("mistake", "f1", "keyword")
LOW = "low AS (SELECT id, kind, metadata, query_count, lower(label) AS label, lower(source_file) AS file FROM notes)"
SCORES = (
    LOW + ", tm(t) AS (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + "), hit AS (SELECT DISTINCT id FROM (SELECT low.id, row_number() OVER (PARTITION BY t ORDER BY query_count DESC, low.id) AS n FROM low JOIN tm ON contains(label, t) OR contains(lower(low.id), t)) WHERE n <= 200),"
    " both_ AS (SELECT source AS id, target AS other, relation, source, target FROM note_edges UNION ALL SELECT target, source, relation, source, target FROM note_edges WHERE source <> target), cand AS (SELECT id FROM hit UNION SELECT other FROM both_ WHERE id IN (SELECT id FROM hit)),"
    " sc AS (SELECT id, (" + " + ".join(f"CASE WHEN contains(label, '{t}') THEN 2 ELSE 0 END + CASE WHEN contains(file, '{t}') THEN 1 ELSE 0 END" for t in TERMS) + f") * CASE WHEN kind = 'mistake' THEN 2.5::DOUBLE WHEN {HIDDEN} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM low WHERE id IN (SELECT id FROM cand))"
)


@spec("G1_seed_scores", ("notes", "note_edges"), f", {SCORES} SELECT id, score FROM sc WHERE score > 0")
def _(s, d):
    return S.seed_scores(N.notes(s, d), N.note_edges(s, d), TERMS)


def _seeds(s, d):
    return G.checkpointed(S.seed_scores(N.notes(s, d), N.note_edges(s, d), TERMS).orderBy(F.desc("score"), "id").limit(3).select("id"))


def _walk_sql(depth: int) -> str:
    out = [f"kw AS (SELECT id, {HIDDEN} AS keyword FROM notes)", "lk AS (SELECT b.* FROM both_ b JOIN kw ON kw.id = b.id WHERE (b.relation <> 'triggered_by' OR kw.keyword) AND b.other IN (SELECT id FROM kw))", "v0 AS (SELECT id, 0 AS level FROM (SELECT id FROM sc WHERE score > 0 ORDER BY score DESC, id LIMIT 3))"]
    for i in range(1, depth + 1):
        out.append(f"e{i} AS (SELECT source, target, relation, other, {i} AS level FROM lk WHERE id IN (SELECT id FROM v{i - 1} WHERE level = {i - 1}) AND other NOT IN (SELECT id FROM v{i - 1}))")
        out.append(f"v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT DISTINCT other, {i} FROM e{i})")
    return ", ".join(out)


@spec("G2_bfs", ("notes", "note_edges"), f", {SCORES}, {_walk_sql(3)} SELECT id, level FROM v3")
def _(s, d):
    return S.walk(N.notes(s, d), N.note_edges(s, d), _seeds(s, d))[0]


@spec("G2_bfs_edges", ("notes", "note_edges"), f", {SCORES}, {_walk_sql(3)} SELECT source, target, relation, level FROM e1 UNION ALL SELECT source, target, relation, level FROM e2 UNION ALL SELECT source, target, relation, level FROM e3")
def _(s, d):
    return S.walk(N.notes(s, d), N.note_edges(s, d), _seeds(s, d))[1]


@spec("G3_dfs", ("notes", "note_edges"), None)
def _(s, d):
    return S.depth_first(N.notes(s, d), N.note_edges(s, d), _seeds(s, d))


@spec("G4_suppressed", ("notes", "note_edges"), f", b AS (SELECT source AS id, relation FROM note_edges UNION ALL SELECT target, relation FROM note_edges WHERE source <> target) SELECT n.kind, count(*) AS walked FROM b JOIN notes n ON n.id = b.id WHERE b.relation <> 'triggered_by' OR n.id IN (SELECT id FROM notes WHERE {HIDDEN}) GROUP BY n.kind")
def _(s, d):
    own = N.notes(s, d).select("id", "kind", S.hidden().alias("keyword"))
    return S.both_ways(N.note_edges(s, d)).join(own, "id").filter("relation <> 'triggered_by' OR keyword").groupBy("kind").agg(_count().alias("walked"))


@spec("G11_shown", ("notes", "note_edges"), None)
def _(s, d):
    n, seeds = N.notes(s, d), _seeds(s, d)
    seen, edges = S.walk(n, N.note_edges(s, d), seeds, 2)
    return S.shown(n.join(seen, "id", "left_semi"), edges.select("source", "target", "relation"), seeds)


@spec("G12_structure", ("notes", "note_edges"), f", own AS (SELECT * FROM notes WHERE NOT {HIDDEN}), ends AS (SELECT source AS id, source, target, relation FROM note_edges UNION ALL SELECT target, source, target, relation FROM note_edges), tc AS (SELECT e.*, o.source_file FROM ends e JOIN own o ON o.id = e.id), dg AS (SELECT id, count(*) AS degree FROM tc GROUP BY id), rk AS (SELECT o.source_file, row_number() OVER (PARTITION BY o.source_file ORDER BY CASE o.kind WHEN 'decision' THEN 9 WHEN 'pattern' THEN 10 WHEN 'mistake' THEN 11 ELSE 12 END, coalesce(dg.degree, 0) DESC, o.id) AS place, 'NODE ' || label || ' [' || kind || ']' AS line, count(*) OVER (PARTITION BY o.source_file) AS n, round(avg(confidence_score) OVER (PARTITION BY o.source_file), 6) AS confidence FROM own o LEFT JOIN dg ON dg.id = o.id), wt AS (SELECT tc.source_file, tc.source, tc.target, tc.relation, sum(dg.degree) AS weight FROM tc JOIN dg ON dg.id = tc.id GROUP BY ALL), be AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY weight DESC, source, target, relation) AS place FROM wt) SELECT source_file, CAST(place AS INTEGER) AS place, line, n, confidence FROM rk UNION ALL SELECT be.source_file, CAST(be.place + 1000000 AS INTEGER), 'EDGE ' || a.label || ' --' || be.relation || '--> ' || b.label, NULL, NULL FROM be JOIN notes a ON a.id = be.source JOIN notes b ON b.id = be.target WHERE be.place <= 10")
def _(s, d):
    return S.structure(N.notes(s, d), N.note_edges(s, d))


CHOSEN = (
    f"c AS (SELECT conv_id, turn, list_reduce(list_filter(regexp_split_to_array(lower(text || ' brand#1 supplier asia' || (conv_id % 3)), '[^a-z0-9_]+'), lambda x: length(x) >= 3 AND x NOT IN {X.STOPWORDS}), lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, CAST([] AS VARCHAR[])) AS ks FROM conversations),"
    " w AS (SELECT conv_id, turn, unnest(ks) AS kw, generate_subscripts(ks, 1) AS pos FROM c WHERE len(ks) >= 2), kn AS (SELECT DISTINCT kw FROM w), lb AS (SELECT lower(label) AS l, count(*) AS n FROM nodes GROUP BY 1), df AS (SELECT kw, sum(n) AS df FROM kn JOIN lb ON contains(l, kw) GROUP BY kw),"
    " sc AS (SELECT w.*, CASE WHEN df.df > 0 THEN round(ln((SELECT count(*) FROM nodes)::DOUBLE / df.df), 8) ELSE 0.0::DOUBLE END AS idf FROM w LEFT JOIN df ON df.kw = w.kw), gr AS (SELECT conv_id, turn, max(idf) AS most, list(kw ORDER BY idf DESC, pos) FILTER (WHERE idf > 0) AS ks FROM sc GROUP BY conv_id, turn)"
)


@spec("D8_keyword_choice", ("nodes",), f", {CHOSEN} SELECT conv_id, turn, array_to_string(ks[1:5], ' ') AS keywords FROM gr WHERE most >= 1.386")
def _(s, d):
    said = F.concat("text", F.lit(" brand#1 supplier asia"), (F.col("conv_id") % 3).cast("string"))
    chosen = S.keyword_choice(A.table(s, d, "conversations").select("conv_id", "turn", said.alias("text")), A.nodes(s, d))
    return chosen.withColumn("keywords", F.array_join("keywords", " "))


# Text
@spec("X6_fnv1a", (), "SELECT p_partkey, CAST(list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS BIGINT) AS h FROM part")
def _(s, d):
    return A.table(s, d, "part").select("p_partkey", X.fnv1a(F.col("p_name")).alias("h"))


@spec("X7_normalised", (), "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower('# ' || text || ' [x y]'), '(?m)^#+\\s*', '', 'g'), '\\[[^\\]\\n]*\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents")
def _(s, d):
    ship(s)
    plain = F.udf(X.normalised, "string", useArrow=True)
    return A.table(s, d, "documents").select("doc_id", plain(F.concat(F.lit("# "), "text", F.lit(" [x y]"))).alias("plain"))


@spec("X8_shingles", (), "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS INTEGER) AS n FROM w")
def _(s, d):
    return A.table(s, d, "conversations").select("conv_id", "turn", F.size(X.shingles(F.col("text"))).alias("n"))


@spec("X9_jaccard", (), "WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w, b.w AS v FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(w) = 0 AND len(v) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(w, v))::DOUBLE / (len(w) + len(v) - len(list_intersect(w, v))) END, 8) AS likeness FROM p")
def _(s, d):
    w = A.table(s, d, "conversations").select("conv_id", "turn", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("w"))
    v = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return w.join(v, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("v")), 8).alias("likeness"))


@spec("X10_keywords", (), f"SELECT conv_id, turn, array_to_string(list_reduce(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 3 AND x NOT IN {X.STOPWORDS}), lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, CAST([] AS VARCHAR[])), ' ') AS keywords FROM (SELECT conv_id, turn, text || ' The Cat and the cat_2 sat' AS text FROM conversations)")
def _(s, d):
    text = F.concat("text", F.lit(" The Cat and the cat_2 sat"))
    return A.table(s, d, "conversations").select("conv_id", "turn", F.array_join(X.keywords(text), " ").alias("keywords"))


@spec("X11_formats", (), "WITH n AS (SELECT o_orderkey AS id, o_totalprice * (o_orderkey % 7) AS v, o_orderkey % 90 AS days, o_orderdate FROM orders) SELECT id, CASE WHEN v >= 1000000 THEN format('{:.2f}M', round(v / 1000000, 2)) WHEN v >= 1000 THEN format('{:.1f}K', round(v / 1000, 1)) ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) END AS number, CASE days WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE CASE WHEN days < 30 THEN days || 'd ago' ELSE (days // 30) || 'mo ago' END END AS age, format('{:,}', CAST(floor(v) AS BIGINT)) AS thousands, format('{:.1f}%', round(days / 90.0::DOUBLE * 100, 1)) AS pct, strftime(o_orderdate, '%Y-%m-%d') AS day FROM n")
def _(s, d):
    v, days = F.col("o_totalprice") * (F.col("o_orderkey") % 7), F.col("o_orderkey") % 90
    return A.table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), Q.number(v).alias("number"), GU.age(days * GU.DAY).alias("age"), F.format_number(F.floor(v), 0).alias("thousands"), Q.percent(days / 90).alias("pct"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@spec("X12_ratio_phrase", (), "WITH r AS (SELECT p_partkey, round((p_size - 5) / 10.0::DOUBLE, 1) AS r FROM part) SELECT p_partkey, CASE WHEN r <= 0 THEN 'n/a' WHEN r >= 1 THEN r || 'x smaller packet' ELSE (floor(1 / r * 10 + 0.5) / 10) || 'x LARGER: passed through' END AS phrase FROM r")
def _(s, d):
    return A.table(s, d, "part").select("p_partkey", Q.ratio_phrase(F.round((F.col("p_size") - 5) / 10, 1)).alias("phrase"))


def _pii_sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    out, names = ["t0 AS (SELECT doc_id, text AS t, CAST([] AS VARCHAR[]) AS f FROM documents)"], []
    for i, (name, p) in enumerate(X.PII):
        out.append(f"t{i + 1} AS (SELECT doc_id, regexp_replace(t, {quote(p)}, '[REDACTED]', 'g') AS t, CASE WHEN regexp_matches(t, {quote(p)}) THEN list_append(f, '{name}') ELSE f END AS f FROM t{i})")
    n = len(X.PII)
    luhn = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(g[-i] AS INT) ELSE (2 * CAST(g[-i] AS INT)) // 10 + (2 * CAST(g[-i] AS INT)) % 10 END)) % 10 = 0".replace("g[", "regexp_replace(x, '[^0-9]', '', 'g')[").replace("length(g)", "length(regexp_replace(x, '[^0-9]', '', 'g'))")
    out.append(f"e AS (SELECT doc_id, t, f, list_filter(regexp_extract_all(t, {quote(X.TOKEN)}), lambda x: list_entropy(string_split(x, '')) >= 4.0) AS h FROM t{n})")
    out.append("e2 AS (SELECT doc_id, list_reduce(h, lambda a, x: replace(a, x, '[REDACTED]'), t) AS t, CASE WHEN len(h) > 0 THEN list_append(f, 'high-entropy-token') ELSE f END AS f FROM e)")
    out.append(f"c AS (SELECT doc_id, t, f, list_filter(regexp_extract_all(t, {quote(X.CARD)}), lambda x: {luhn}) AS h FROM e2)")
    out.append("c2 AS (SELECT doc_id, list_reduce(h, lambda a, x: replace(a, x, '[REDACTED]'), t) AS t, CASE WHEN len(h) > 0 THEN list_append(f, 'credit-card') ELSE f END AS f FROM c)")
    names = list(dict.fromkeys(n for n, _ in X.PII)) + ["high-entropy-token", "credit-card"]
    return f"WITH {', '.join(out)} SELECT doc_id, t AS redacted, array_to_string(list_filter({names}, lambda x: list_contains(f, x)), ',') AS categories FROM c2"


@spec("X15_pii", (), _pii_sql())
def _(s, d):
    return X.pii_strip(A.table(s, d, "documents").select("doc_id", "text")).select("doc_id", "redacted", F.array_join("categories", ",").alias("categories"))


def _pii_deep_sql() -> str:
    # The texts of every conversation, stripped one by one; their categories united.
    flat = _pii_sql().replace("SELECT doc_id, text AS t, CAST([] AS VARCHAR[]) AS f FROM documents", "SELECT conv_id * 1000 + turn AS doc_id, text || CASE WHEN turn % 3 = 0 THEN ' from u' || conv_id || '@mail.example' ELSE '' END AS t, CAST([] AS VARCHAR[]) AS f FROM conversations")
    return f"SELECT doc_id // 1000 AS conv_id, string_agg(redacted, '|' ORDER BY doc_id) AS texts, bool_or(categories LIKE '%email%') AS email FROM ({flat}) GROUP BY 1"


@spec("X15_pii_deep", (), _pii_deep_sql())
def _(s, d):
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" from u"), F.col("conv_id").cast("string"), F.lit("@mail.example"))).otherwise(""))
    nested = A.table(s, d, "conversations").withColumn("text", text).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.struct("role", "text").alias("said")))).alias("turns"))
    out = X.pii_strip_deep(nested, "turns")
    return out.select("conv_id", F.array_join(F.transform("turns", lambda t: t["said"]["text"]), "|").alias("texts"), F.array_contains("categories", "email").alias("email"))


DECLARED = {"ts": "export async function f{k}(x) {{", "python": "    def g{k}(self):", "go": "func (s *Store) Save{k}() error {{", "rust": "pub(crate) fn walk{k}() {{", "java": "  public static int get{k}(int a) {{", "ruby": "  def self.ok{k}?(a)", "php": "  public function run{k}() {{"}
NAMES = {"ts": "f{k}", "python": "g{k}", "go": "Save{k}", "rust": "walk{k}", "java": "get{k}", "ruby": "ok{k}?", "php": "run{k}"}


def _by_lang(table: dict[str, str], join: str) -> str:
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{v.format(k=join)}'" for i, v in enumerate(table.values())) + " ELSE '// class No' || p_partkey END"


@spec("X16_canonical_json", (), """SELECT event_id, '{"a":{"m":' || CAST(floor(value) AS BIGINT) || ',"n":[true,null,"' || event_type || '"]},"z":' || event_id || '}' AS body FROM events""")
def _(s, d):
    import json

    inner = F.concat(F.lit(' {"n": [true, null, "'), "event_type", F.lit('"], "m": '), F.floor("value").cast("string"), F.lit(".0}"))
    raw = F.concat(F.lit('{"z": '), F.col("event_id").cast("string"), F.lit(', "a":'), inner, F.lit("}"))
    ship(s)
    canonical = F.udf(lambda t: EX.canonical(json.loads(t)), "string", useArrow=True)
    return A.table(s, d, "events").select("event_id", canonical(raw).alias("body"))


@spec("X20_declarations", (), f"SELECT CAST(p_partkey AS VARCHAR) AS file, 'function' AS kind, {_by_lang(NAMES, chr(39) + ' || p_partkey || ' + chr(39))} AS name FROM part WHERE p_partkey % 8 <> 7")
def _(s, d):
    lang = F.element_at(F.array(*map(F.lit, [*DECLARED, "ts"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    text = F.expr(_by_lang(DECLARED, "' || p_partkey || '"))
    return EX.declarations(A.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("file"), lang.alias("lang"), F.lit(1).alias("line"), text.alias("text"))).select("file", "kind", "name")


SOURCE = "'class C' || p_partkey || ':' || chr(10) || '    def m(self):' || chr(10) || '        return helper' || (p_partkey % 5) || '(self.m())' || chr(10) || 'def helper' || (p_partkey % 5) || '(x): pass' || chr(10)"


def _python_files(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.lit("python").alias("lang"), F.expr(SOURCE.replace("chr(10)", "char(10)")).alias("text"))


@spec("X21_callees", (), "SELECT CAST(p_partkey AS VARCHAR) AS file, 'm' AS owner, unnest(['helper' || (p_partkey % 5), 'm']) AS name FROM part")
def _(s, d):
    return EX.symbols(_python_files(s, d)).filter("what = 'call'").select("file", "owner", "name")


@spec("X22_symbols", (), "SELECT CAST(p_partkey AS VARCHAR) AS file, unnest(['C' || p_partkey, 'm', 'helper' || (p_partkey % 5)]) AS name, unnest(['class', 'method', 'function']) AS kind, CAST(unnest([1, 2, 4]) AS BIGINT) AS line FROM part")
def _(s, d):
    return EX.symbols(_python_files(s, d)).filter("what = 'symbol'").select("file", "name", "kind", "line")


@spec("X25_shell", (), "SELECT o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN 'src/m' || o_orderkey || '.ts' END AS reads, CASE o_orderkey % 6 WHEN 1 THEN 'run' || o_orderkey END AS greps, CASE o_orderkey % 6 WHEN 2 THEN 'prune a' || o_orderkey || ',reindex b' WHEN 3 THEN 'reindex out.ts' ELSE '' END AS ops FROM orders")
def _(s, d):
    k = F.col("o_orderkey").cast("string")
    told = (F.concat(F.lit("cat src/m"), k, F.lit(".ts")), F.concat(F.lit('grep -rn "run'), k, F.lit('" src')), F.concat(F.lit("git mv -f a"), k, F.lit(" b")), F.lit("echo x >> out.ts"), F.lit("cat a.ts | head"), F.lit("rg -l foo"))
    command = F.coalesce(*(F.when(F.col("o_orderkey") % 6 == i, c) for i, c in enumerate(told)))
    got = EX.shell(A.table(s, d, "orders").select(F.col("o_orderkey").alias("seq"), command.alias("command")))
    return got.select("seq", "reads", "greps", F.array_join(F.transform("ops", lambda o: F.concat_ws(" ", o["action"], o["path"])), ",").alias("ops"))


@spec("X29_metadata", ("notes",), f"SELECT id, {JSON.format('type')} AS type, CAST({JSON.format('changeCount')} AS BIGINT) AS changes, replace(metadata, '}}', CASE WHEN metadata = '{{}}' THEN '' ELSE ',' END || '\"seen\":true}}') AS written FROM notes".replace("{{}}", "{}").replace("}}", "}"))
def _(s, d):
    m = F.col("metadata")
    written = F.concat(F.expr("substr(metadata, 1, length(metadata) - 1)"), F.when(m == "{}", "").otherwise(","), F.lit('"seen":true}'))
    return N.notes(s, d).select("id", F.get_json_object(m, "$.type").alias("type"), F.get_json_object(m, "$.changeCount").cast("long").alias("changes"), written.alias("written"))


@spec("X31_markers", (), "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'balanced' WHEN 1 THEN 'none' WHEN 2 THEN 'unbalanced' ELSE 'none' END AS state FROM documents")
def _(s, d):
    a, b = "<!-- weft:start -->", "<!-- weft:end -->"
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(a), "text", F.lit(b))).when(F.col("doc_id") % 4 == 2, F.concat("text", F.lit(a))).when(F.col("doc_id") % 4 == 3, F.concat("text", F.lit(f"\n```\n{a}\n```\n"))).otherwise(F.col("text"))
    return A.table(s, d, "documents").select("doc_id", Q.markers(text, a, b).alias("state"))


@spec("X32_injected_tokens", ("log",), "SELECT seq, CAST(CASE k % 3 WHEN 0 THEN ceil((k + 3) / 4.0) WHEN 1 THEN ceil(length(path) / 4.0) ELSE 0 END AS BIGINT) AS tokens FROM log")
def _(s, d):
    reason = F.to_json(F.struct(F.struct(F.repeat(F.lit("x"), (F.col("k") + 3).cast("int")).alias("permissionDecisionReason")).alias("hookSpecificOutput")))
    context = F.to_json(F.struct(F.struct(F.lit("").alias("permissionDecisionReason"), F.col("path").alias("additionalContext")).alias("hookSpecificOutput")))
    response = F.when(F.col("k") % 3 == 0, reason).when(F.col("k") % 3 == 1, context).otherwise(F.lit("{}"))
    return A.log(s, d).select("seq", Q.injected_tokens(response).alias("tokens"))


@spec("T6_cut_units", (), "SELECT p_partkey, substr(p_name, 1, 5) AS cut, CASE WHEN length(p_name) > 5 THEN substr(p_name, 1, 4) || '…' ELSE p_name END AS short FROM part")
def _(s, d):
    ship(s)
    cut, short = (F.udf(lambda t, f=f: f(t, 5), "string", useArrow=True) for f in (X.cut_units, X.shortened))
    return A.table(s, d, "part").select("p_partkey", cut("p_name").alias("cut"), short("p_name").alias("short"))


@spec("T1_top_k", ("notes",), "SELECT kind, id, place FROM (SELECT kind, id, CAST(row_number() OVER (PARTITION BY kind ORDER BY query_count DESC, id) AS INTEGER) AS place FROM notes) WHERE place <= CASE kind WHEN 'mistake' THEN 20 WHEN 'pattern' THEN 20 ELSE 10 END")
def _(s, d):
    most = F.when(F.col("kind").isin("mistake", "pattern"), 20).otherwise(10)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("query_count"), "id"))
    return N.notes(s, d).withColumn("place", place).filter(F.col("place") <= 20).filter(F.col("place") <= most).select("kind", "id", "place")


@spec("W12_go_imports", (), "SELECT CAST(p_partkey AS VARCHAR) AS file, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['fmt', 'os' || p_partkey] ELSE ['one'] END) AS module FROM part")
def _(s, d):
    k = F.col("p_partkey").cast("string")
    block = F.concat(F.lit('package a\nimport (\n  "fmt"\n  // "no"\n  "x/os'), k, F.lit('"\n)\nvar a = (\n  "b"\n)'))
    text = F.when(F.col("p_partkey") % 2 == 0, block).otherwise(F.lit('import "a/one"\n"two"'))
    lines = A.table(s, d, "part").select(k.alias("file"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return EX.go_imports(lines).select("file", "module")


# Mining, telemetry
@spec("A7_authors", ("commits",), "SELECT file, CAST(count(DISTINCT author) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(list(author))), ',') AS authors FROM commits GROUP BY file")
def _(s, d):
    own = A.commit_files(s, d).groupBy("file").agg(F.sort_array(F.collect_set("author")).alias("a"))
    return own.select("file", F.size("a").cast("long").alias("n"), F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("authors"))


@spec("A4_context_cache", ("log",), "SELECT count(*) AS entries, CAST(coalesce(sum(hits), 0) AS BIGINT) AS persisted, CAST(greatest(coalesce(sum(hits), 0), (SELECT count(*) FROM log WHERE tool = 'Grep')) AS BIGINT) AS hits, round(greatest(coalesce(sum(hits), 0), (SELECT count(*) FROM log WHERE tool = 'Grep'))::DOUBLE / (greatest(coalesce(sum(hits), 0), (SELECT count(*) FROM log WHERE tool = 'Grep')) + (SELECT count(*) FROM log WHERE decision = 'deny')), 8) AS rate FROM (SELECT path, count(CASE WHEN k >= 50 THEN 1 END) AS hits FROM log GROUP BY path)")
def _(s, d):
    log = A.log(s, d)
    entries = log.groupBy("path").agg(F.count_if(F.col("k") >= 50).alias("hits"))
    live = log.agg(F.count_if(F.col("tool") == "Grep").alias("live"), F.count_if(F.col("decision") == "deny").alias("misses"))
    return T.cache_stats(entries, live)


@spec("A22_packet_benchmark", (), "WITH q AS (SELECT string_agg(t, chr(10) ORDER BY doc_id) AS packet FROM (SELECT doc_id, substr(text, 1, 80) AS t FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20)), t AS (SELECT CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS whole, CAST(sum(CASE WHEN contains(lower(text), 'license') THEN ceil(length(text) / 4.0) ELSE 0 END) AS BIGINT) AS relevant, (SELECT CAST(ceil(length(packet) / 4.0) AS BIGINT) FROM q) AS packet FROM documents) SELECT *, round(whole::DOUBLE / packet, 1) AS ratio_whole, round(relevant::DOUBLE / packet, 1) AS ratio_relevant FROM t")
def _(s, d):
    docs = A.table(s, d, "documents").select("doc_id", "text")
    hit = F.lower("text").contains("license")
    lines = docs.filter(hit).orderBy("doc_id").limit(20).agg(F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", F.substring("text", 1, 80).alias("t"))))["t"], "\n").alias("packet"))
    sums = docs.agg(F.sum(X.tokens(F.col("text"))).alias("whole"), F.sum(F.when(hit, X.tokens(F.col("text"))).otherwise(0)).alias("relevant"))
    got = sums.crossJoin(lines.select(X.tokens(F.col("packet")).alias("packet")))  # a row by a row
    return got.select("*", *(F.round(F.col(c) / F.col("packet"), 1).alias(f"ratio_{c}") for c in ("whole", "relevant")))


@spec("A27_output_size", ("log",), "SELECT seq, CAST(CASE k % 3 WHEN 0 THEN length(path) WHEN 1 THEN k + 1 ELSE length('{\"rows\":' || k || '}') END AS BIGINT) AS size, k % 4 = 1 AS failed FROM log")
def _(s, d):
    k = F.col("k")
    told = F.when(k % 3 == 0, F.to_json(F.struct(F.col("path").alias("v")))).when(k % 3 == 1, F.to_json(F.struct(F.struct(F.repeat(F.lit("o"), (k + 1).cast("int")).alias("output")).alias("v")))).otherwise(F.to_json(F.struct(F.struct(k.alias("rows")).alias("v"))))
    error = F.when(k % 4 == 1, "boom")
    return A.log(s, d).select("seq", Q.output_size(told).alias("size"), error.isNotNull().alias("failed"))


@spec("A5_depends_on", ("commits",), "SELECT source, target, confidence_score FROM (SELECT file_a % 1500 AS source, file_b % 1500 AS target, round(least(0.95::DOUBLE, 0.5::DOUBLE + 0.05::DOUBLE * n), 4) AS confidence_score FROM co_change WHERE n >= 3) WHERE source <> target")
def _(s, d):
    return M.depends_on(co_changes(s, d), lambda c: c % 1500)


@spec("A17_warnings", ("log",), "SELECT count(*) AS warnings FROM log WHERE decision = 'deny' AND k % 7 = 0")
def _(s, d):
    reason = F.when(F.col("k") % 7 == 0, "Known MISTAKE in this file").otherwise("summary instead")
    return T.warnings(A.log(s, d).withColumn("reason", reason))


ASKED = "lg AS (SELECT *, CASE WHEN k % 10 = 0 THEN NULL WHEN k >= 97 THEN 'notes' WHEN k < 38 THEN 'structure' WHEN k = 38 THEN 'git' WHEN k < 42 THEN 'team' END AS provider, CASE WHEN k % 3 > 0 THEN round(k / 50.0::DOUBLE, 2) END AS confidence FROM hooks)"


def _asked(s, d):
    k = F.col("k")
    provider = F.when(k % 10 == 0, None).when(k >= 97, "notes").when(k < 38, "structure").when(k == 38, "git").when(k < 42, "team")
    return A.hooks(s, d).withColumns({"provider": provider, "confidence": F.when(k % 3 > 0, F.round(k / 50, 2))})


@spec("A19_hit_rates", ("log", "hooks"), f", {ASKED}, dn AS (SELECT provider FROM lg WHERE event = 'PreToolUse' AND decision = 'deny'), n AS (SELECT count(*) AS denied FROM dn), ks(provider) AS (VALUES ('structure'), ('mistakes'), ('git'), ('mempalace'), ('context7'), ('obsidian')), u AS (SELECT provider FROM ks UNION SELECT provider FROM dn WHERE provider IS NOT NULL), h AS (SELECT u.provider, count(dn.provider) AS hits FROM u LEFT JOIN dn ON dn.provider = u.provider GROUP BY u.provider) SELECT provider, hits, denied, round(hits::DOUBLE / denied, 8) AS rate, CASE WHEN hits = 0 THEN 'disable' WHEN hits::DOUBLE / denied >= 0.9 THEN 'raise' ELSE 'keep' END AS proposal, CAST(CASE WHEN hits::DOUBLE / denied >= 0.9 THEN 240 ELSE 200 END AS BIGINT) AS budget FROM h, n WHERE denied >= 20")
def _(s, d):
    return T.hit_rates(_asked(s, d))


@spec("A19_threshold", ("log", "hooks"), f", {ASKED}, c AS (SELECT confidence, row_number() OVER (ORDER BY confidence) - 1 AS i, count(*) OVER () AS n FROM lg WHERE event = 'PreToolUse' AND decision = 'deny' AND confidence IS NOT NULL) SELECT 0.25::DOUBLE AS current, round(confidence, 2) AS proposed, n FROM c WHERE i = n // 2 AND n >= 10 AND confidence > 0.35")
def _(s, d):
    return T.threshold_proposal(_asked(s, d), now=0.25)


@spec("A23_symbol_wins", ("log",), ", w AS (SELECT * FROM log WHERE injected < would_have AND decision <> 'passthrough') SELECT count(*) AS wins, CAST(floor((1 - sum(injected)::DOUBLE / sum(would_have)) * 100 + 0.5) AS BIGINT) AS reduction, CAST(floor(count(*)::DOUBLE / (SELECT count(*) FROM log) * 100 + 0.5) AS BIGINT) AS rate, CAST(floor(avg(k / 100.0::DOUBLE) * 100 + 0.5) AS BIGINT) AS recall FROM w")
def _(s, d):
    rows = A.log(s, d).select(F.col("would_have").alias("raw"), F.col("injected").alias("packet"), (F.col("decision") != "passthrough").alias("intercepted"), (F.col("k") / 100).alias("recall"))
    return T.symbol_wins(rows)


@spec("E13_packet_wins", ("log",), ", r AS (SELECT tool, would_have, injected, round(1 - least(injected, would_have)::DOUBLE / would_have, 6) AS red FROM log WHERE would_have > 0), m AS (SELECT tool, red AS median FROM (SELECT tool, red, row_number() OVER (PARTITION BY tool ORDER BY red) AS rn, count(*) OVER (PARTITION BY tool) AS n FROM r) WHERE rn = floor(n / 2) + 1) SELECT r.tool, count(*) AS n, count(CASE WHEN injected < would_have THEN 1 END) AS wins, round(1 - sum(least(injected, would_have))::DOUBLE / sum(would_have), 8) AS guarded, round(1 - sum(injected)::DOUBLE / sum(would_have), 8) AS raw, any_value(m.median) AS median FROM r JOIN m ON m.tool = r.tool GROUP BY r.tool")
def _(s, d):
    return T.packet_wins(A.log(s, d).select("tool", "would_have", "injected"), "tool")


@spec("W3_mode", ("log",), ", md AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE session % 7 END AS sid FROM log), gp AS (SELECT seq, sid, CASE WHEN sid IS NULL THEN sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path, sid IS NULL ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) END AS g, path FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY path, sid IS NULL ORDER BY ts, seq)) AS gap FROM md)) SELECT seq, path || CASE WHEN sid IS NULL THEN ' gap ' || g ELSE ' id ' || sid END AS run FROM gp")
def _(s, d):
    log = A.log(s, d).withColumn("sid", F.when(F.col("k") % 5 != 0, F.col("session") % 7))
    return T.runs(log, 21600)


@spec("W7_served_reads", (), None)
def _(s, d):
    return GU.served_reads(_reads(s, d))


def _reads(s, d):
    k = F.col("k")
    return A.log(s, d).select("session", "seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "path", (k % 2).alias("mtime"), F.when(k % 9 == 0, 100).otherwise(4000).cast("long").alias("size"), (F.col("tool") == "Write").alias("reset"))


# Packets
def _results(s, d):
    """Results with the providers' names: of each request one of each kind, more of `notes`."""
    place = F.col("seq") % 20
    provider = F.when(place == 0, "ast").when(place == 1, "structure").when(place == 2, "mistakes").when(place < 8, "git").otherwise("notes")
    said = F.when(F.col("seq") % 20 == 2, F.concat(F.lit("  ! License (flagged today)\n! Word"), (F.col("request") % 9).cast("string"), F.lit(" (flagged 3d ago)"))).otherwise(F.concat("content", F.when(F.col("seq") % 20 == 5, F.concat(F.lit("\nword"), (F.col("request") % 9).cast("string"))).otherwise("")))
    return A.results(s, d).withColumns({"provider": provider, "content": said})


PROVIDED = "rs AS (SELECT request, seq, confidence, CASE WHEN seq % 20 = 0 THEN 'ast' WHEN seq % 20 = 1 THEN 'structure' WHEN seq % 20 = 2 THEN 'mistakes' WHEN seq % 20 < 8 THEN 'git' ELSE 'notes' END AS provider, CASE WHEN seq % 20 = 2 THEN '  ! License (flagged today)' || chr(10) || '! Word' || (request % 9) || ' (flagged 3d ago)' ELSE content || CASE WHEN seq % 20 = 5 THEN chr(10) || 'word' || (request % 9) ELSE '' END END AS content FROM results)"


@spec("D1_section_dedup", ("results",), None)
def _(s, d):
    return R.deduplicated(R.blended(A.results(s, d), PRIORITY)).select("request", "seq", "place")


@spec("D2_line_dedup", ("results",), None)
def _(s, d):
    return R.deduplicated(R.blended(A.results(s, d), PRIORITY)).select("request", "seq", "content")


@spec("D3_displacement", ("results",), None)
def _(s, d):
    ranked = R.blended(A.results(s, d), PRIORITY)
    left = R.deduplicated(ranked).groupBy("request").agg(F.sum(X.tokens(F.col("content"))).alias("left"))
    return ranked.groupBy("request").agg(F.sum(X.tokens(F.col("content"))).alias("before")).join(left, "request", "left").select("request", F.greatest(F.lit(0).cast("long"), F.col("before") - F.coalesce("left", F.lit(0))).alias("displaced"))


@spec("D4_ast_over_structure", ("results",), f", {PROVIDED} SELECT request, seq FROM rs WHERE provider <> 'structure' OR request NOT IN (SELECT request FROM rs WHERE provider = 'ast')")
def _(s, d):
    return R.over_structure(_results(s, d)).select("request", "seq")


@spec("D5_mistake_boost", ("results",), f", {PROVIDED} SELECT r.seq, CASE WHEN provider <> 'mistakes' AND EXISTS (SELECT 1 FROM rs m WHERE m.request = r.request AND m.provider = 'mistakes') AND (contains(lower(content), 'license') OR contains(lower(content), 'word' || (request % 9))) THEN least(1.0::DOUBLE, confidence * 1.5::DOUBLE) ELSE confidence END AS confidence FROM rs r")
def _(s, d):
    return R.boosted(_results(s, d)).select("seq", "confidence")


KINDS = ("ast", "structure", "mistakes", "git", "notes")


@spec("D6_rich_packet", ("results",), None)
def _(s, d):
    return R.rich_packet(_results(s, d), KINDS, {"ast": 300, "mistakes": 100, "git": 250}, 1500)


@spec("D7_streaming_packet", ("results",), f", {PROVIDED} SELECT request, seq, provider, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM rs")
def _(s, d):
    from ..streaming import logs

    at, rows = FI.scratch(s), _results(s, d).select("request", "seq", "provider", "content")
    rows.write.json(f"{at}/in")
    came = logs.packets(logs.log_stream(s, f"{at}/in", "request long, seq long, provider string, content string"), f"{at}/out")
    return came.select("request", "seq", "provider", X.tokens(F.col("content")).alias("tokens"))


# Reports
def _graph(s, d):
    return A.nodes(s, d), A.edges(s, d), N.notes(s, d)


GOD = "bt AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges WHERE source <> target), gd AS (SELECT n.id, n.label, n.kind, n.source_file, count(*) AS c FROM bt JOIN nodes n ON n.id = bt.id WHERE n.kind NOT IN ('file', 'import', 'module', 'concept') GROUP BY ALL)"
GOD_TEXT = "'- `' || label || '` (' || kind || ', ' || c || ' connections)'"


def _section(section: str, text: str, source: str, order: str, k: int | None = None) -> str:
    limit = f" ORDER BY {order} LIMIT {k}" if k else ""
    return f"SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, {text} AS text FROM (SELECT * FROM {source}{limit})"


def _god_rows(k: int) -> str:
    return _section("gods", GOD_TEXT, "gd", "c DESC, id", k)


BULLET = "'- ' || label"
DEPS = "dp AS (SELECT e.target AS id, coalesce(n.label, e.target) AS label, e.n FROM (SELECT target, count(*) AS n FROM edges WHERE relation = 'imports' GROUP BY target) e LEFT JOIN nodes n ON n.id = e.target)"
FOLDERS = "SELECT 'structure' AS section, 0 AS place, '- `' || coalesce(nullif(regexp_extract(source_file, '^(.*)/[^/]*$', 1), ''), '.') || '/` — ' || string_agg(label, ', ' ORDER BY label) AS text FROM nodes WHERE kind = 'file' AND source_file <> '' GROUP BY coalesce(nullif(regexp_extract(source_file, '^(.*)/[^/]*$', 1), ''), '.')"
CHANGES = "CAST(json_extract_string(metadata, '$.changeCount') AS BIGINT) DESC, id"


def _noted(kind: str, k: int) -> str:
    return _section(kind + "s", BULLET, f"notes WHERE kind = '{kind}' AND NOT {HOT}", "id", k)


def _view_sql(name: str) -> str:
    make = {
        "gods": _god_rows, "structure": lambda k: FOLDERS, "hot": lambda k: _section("hot", BULLET, f"notes WHERE {HOT}", CHANGES, k), "mistakes": lambda k: _noted("mistake", k), "decisions": lambda k: _noted("decision", k),
        "patterns": lambda k: _noted("pattern", k), "deps": lambda k: _section("deps", "'- `' || label || '` (imported by ' || n || ' files)'", "dp", "n DESC, id", k),
    }
    return f", {GOD}, {DEPS} " + " UNION ALL ".join(f"SELECT *, '{h}' AS heading, {i} AS part FROM ({make[s](k)})" for i, (s, k, h) in enumerate(P.VIEWS[name]))


for _name in P.VIEWS:
    spec(f"P1_view_{_name.replace('-', '_')}", ("nodes", "edges", "notes"), _view_sql(_name))(lambda s, d, v=_name: P.view(v, *_graph(s, d)))

SURE = f"notes WHERE kind = 'pattern' AND confidence_score >= 0.8 AND NOT {HOT}"
RULES = {
    "patterns": _section("patterns", BULLET, SURE, "id"), "decisions": _section("decisions", BULLET, f"notes WHERE kind = 'decision' AND last_verified >= {AS_OF - P.MONTH}", "last_verified DESC, id"),
    "mistakes": _section("mistakes", BULLET, "notes WHERE kind = 'mistake'", "query_count DESC, id", 5), "gods": _god_rows(10), "hot": _section("hot", BULLET, f"notes WHERE {HOT}", CHANGES, 10),
}
GLOBS = _section("globs", "'**/*.' || ext", "(SELECT regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1) AS ext, count(*) AS n FROM notes GROUP BY 1) WHERE ext <> ''", "n DESC, ext", 6)
ALL_HOT = _section("hot", BULLET, f"notes WHERE {HOT}", CHANGES)


@spec("P2_editor_rules", ("nodes", "edges", "notes"), f", {GOD} " + " UNION ALL ".join([*(v for k, v in RULES.items() if k != "hot"), ALL_HOT, GLOBS]))
def _(s, d):
    n, e, notes = _graph(s, d)
    both = n.select("id", "label", "kind", "source_file").unionByName(notes.select("id", "label", "kind", "source_file"))
    return P.editor_rules(both, e, notes, AS_OF)


@spec("P3_chat_context", ("nodes", "edges", "notes"), f", {GOD} " + " UNION ALL ".join(RULES.values()))
def _(s, d):
    return P.chat_context(*_graph(s, d), AS_OF)


@spec("P4_agent_rules", ("nodes", "edges", "notes"), f", {GOD} " + " UNION ALL ".join(f"SELECT *, {i} AS part FROM ({RULES[k]})" for i, k in enumerate(("gods", "patterns", "decisions", "mistakes", "hot"))))
def _(s, d):
    return P.agent_rules(*_graph(s, d), AS_OF)


@spec("P5_context_index", ("notes",), " UNION ALL ".join([f", z AS (SELECT 1) {_section('patterns', BULLET, SURE, 'query_count DESC, id')}", _section("decisions", BULLET, "notes WHERE kind = 'decision'", "last_verified DESC, id"), _section("issues", BULLET, "notes WHERE kind = 'mistake'", "query_count DESC, id"), _section("concepts", BULLET, "notes WHERE kind = 'concept' AND query_count > 0", "query_count DESC, id", 10)]))
def _(s, d):
    return P.context_index(*_graph(s, d))


@spec("P5_context_index_fresh", ("nodes", "edges"), ", dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id), cd AS (SELECT n.*, coalesce(dg.degree, 0) AS degree FROM nodes n LEFT JOIN dg ON dg.id = n.id WHERE kind IN ('class', 'interface', 'type', 'function', 'method')) " + _section("code", BULLET, "cd", "degree DESC, label", 20))
def _(s, d):
    n, e, notes = _graph(s, d)
    return P.context_index(n, e, notes.limit(0))


@spec("P9_subagent_slice", ("nodes", "edges"), f", {GOD}, tp AS (SELECT *, source_file LIKE 'nation:1%' AS test FROM gd ORDER BY c DESC, id LIMIT 15) " + _section("gods", "label || ' [' || kind || '] (' || c || ' conn)'", "tp WHERE NOT test OR (SELECT bool_and(test) FROM tp)", "c DESC, id", 5))
def _(s, d):
    n, e, _notes = _graph(s, d)
    return P.subagent_slice(n, e, F.col("source_file").startswith("nation:1"))


STATS = "SELECT 'stats' AS section, 1 AS place, (SELECT count(*) FROM nodes) || ' nodes, ' || (SELECT count(*) FROM edges) || ' edges' AS text"
NEWEST = "notes WHERE kind = 'mistake'"
RECENT = _section("reads", "path", "(SELECT path, max(ts) AS last_at FROM log GROUP BY path)", "last_at DESC, path", 8)


@spec("P6_memory_section", ("nodes", "edges", "notes"), f", {GOD} {STATS} UNION ALL {_god_rows(10)} UNION ALL {_section('mistakes', BULLET, NEWEST, 'last_verified DESC, id', 5)}")
def _(s, d):
    return P.brief(*_graph(s, d), 10, 5)


@spec("P7_session_brief", ("nodes", "edges", "notes"), f", {GOD} {STATS} UNION ALL {_god_rows(10)} UNION ALL {_section('mistakes', BULLET, NEWEST, 'last_verified DESC, id', 3)}")
def _(s, d):
    return P.brief(*_graph(s, d), 10, 3)


@spec("P8_compaction_brief", ("nodes", "edges", "notes", "log"), f", {GOD} {STATS} UNION ALL {_god_rows(5)} UNION ALL {_section('mistakes', BULLET, NEWEST, 'last_verified DESC, id', 3)} UNION ALL {RECENT}")
def _(s, d):
    return P.brief(*_graph(s, d), 5, 3, A.log(s, d))


@spec("P10_switch_brief", ("nodes", "edges"), f", {GOD} {STATS} UNION ALL {_god_rows(5)}")
def _(s, d):
    return P.brief(*_graph(s, d), 5, 0)


@spec("P12_pre_edit", ("notes",), "SELECT source_file, id FROM (SELECT source_file, id, row_number() OVER (PARTITION BY source_file ORDER BY last_verified DESC, id) AS r FROM notes WHERE kind = 'mistake' AND confidence_score >= 0.8) WHERE r <= 5")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("last_verified"), "id"))
    return N.notes(s, d).filter("kind = 'mistake' AND confidence_score >= 0.8").withColumn("r", r).filter("r <= 5").select("source_file", "id")


@spec("P13_session_line", ("log",), ", t AS (SELECT session, count(CASE WHEN tool = 'Read' THEN 1 END) AS reads, count(CASE WHEN decision = 'deny' AND k % 7 = 0 THEN 1 END) AS warnings, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(CASE WHEN k > 90 THEN k ELSE 0 END) AS BIGINT) AS displaced FROM log GROUP BY session) SELECT session, reads || ' reads, ' || warnings || ' warnings, ' || saved || ' tokens, ' || displaced || ' displaced' AS line FROM t WHERE reads + warnings + saved + displaced > 0")
def _(s, d):
    told = A.log(s, d).withColumns({"reason": F.when(F.col("k") % 7 == 0, "a landmine").otherwise(""), "displaced": F.when(F.col("k") > 90, F.col("k")).otherwise(0)})
    return T.session_lines(told)


@spec("P15_health", ("log",), "SELECT path, CASE max(CASE WHEN k > 97 THEN 2 WHEN k > 90 THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS health, count(CASE WHEN k > 90 THEN 1 END) AS findings FROM log GROUP BY path")
def _(s, d):
    severity = F.when(F.col("k") > 97, "fail").when(F.col("k") > 90, "warn").otherwise("ok")
    return T.health(A.log(s, d).withColumn("severity", severity), "path")


# Keeping up to date
def _versions(s, d):
    p = A.table(s, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file"), "p_size")
    known = p.filter("p_size < 45").select("file", F.lit(1).cast("long").alias("mtime"))
    now = p.filter("p_size > 10").select("file", F.when(F.col("p_size") <= 30, 2).otherwise(1).cast("long").alias("mtime"), "p_size")
    return known, now


def _file_nodes(files, tag: str):
    return files.select(F.concat("file", F.lit(tag)).alias("id"), F.col("file").alias("source_file"), F.lit(tag).alias("kind"))


ACT = "act AS (SELECT 'f' || p_partkey AS file, CASE WHEN p_size <= 10 THEN 'prune' WHEN p_size <= 30 OR p_size >= 45 THEN 'index' ELSE 'skip' END AS action FROM part)"


@spec("R2_sync", (), f"WITH {ACT} SELECT file || CASE action WHEN 'index' THEN ':new' ELSE ':old' END AS id, file AS source_file FROM act WHERE action <> 'prune'")
def _(s, d):
    known, now = _versions(s, d)
    nodes = _file_nodes(known, ":old")
    none = s.createDataFrame([], "source string, target string")
    return I.synced(nodes, none, I.changes(known, now), _file_nodes(now, ":new"), none)[0].select("id", "source_file")


@spec("R2_sync_edges", (), f"WITH {ACT} SELECT file || CASE action WHEN 'index' THEN ':new' ELSE ':old' END AS source, 'hub' AS target FROM act WHERE action <> 'prune'")
def _(s, d):
    known, now = _versions(s, d)
    edges = lambda n: n.select(F.col("id").alias("source"), F.lit("hub").alias("target"))
    old, new = _file_nodes(known, ":old"), _file_nodes(now, ":new")
    return I.synced(old, edges(old), I.changes(known, now), new, edges(new))[1]


@spec("R4_incremental_init", (), f"WITH {ACT} SELECT file || CASE action WHEN 'index' THEN ':new' ELSE ':old' END AS id, file AS source_file FROM act")
def _(s, d):
    known, now = _versions(s, d)
    return I.initial(_file_nodes(known, ":old"), known, now, lambda f: _file_nodes(f, ":new")).select("id", "source_file")


@spec("R3_rebuild_calls", (), "SELECT 'f' || p_partkey AS file, 'call' || unnest([p_size, p_size + 1]) AS name FROM part WHERE p_size > 10")
def _(s, d):
    known, now = _versions(s, d)
    refs = lambda f: f.select("file", F.posexplode(F.array(F.concat(F.lit("call"), F.col("p_size").cast("string")), F.concat(F.lit("call"), (F.col("p_size") + 1).cast("string")))).alias("pos", "name"))
    first = now.select("file", F.lit(1).cast("long").alias("mtime"), "p_size")
    _, cache = I.rebuilt_calls(s.createDataFrame([], "file string, mtime long, refs array<struct<pos:int,name:string>>"), first, refs)
    return I.rebuilt_calls(cache.join(known, ["file", "mtime"], "left_semi"), now, refs)[0].select("file", "name")


# Events of one millisecond are one, and the newest of them is given on.
@spec("R1_debounce_stream", ("log",), ", e AS (SELECT path, epoch_us(ts) // 1000 AS ms, max(seq) AS seq FROM log GROUP BY ALL) SELECT path, ms, seq FROM (SELECT *, lead(ms) OVER (PARTITION BY path ORDER BY ms) - ms AS gap FROM e) WHERE gap IS NULL OR gap >= 300")
def _(s, d):
    from ..streaming import logs, state

    # The log arrives in three parts, so bursts are cut; a last event of no path, a day later, lets all timers fire.
    at, rows = FI.scratch(s), A.log(s, d).select(F.col("path").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "seq")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return rows.select(F.col("key").alias("path"), F.unix_millis("ts").alias("ms"), "seq")
    out = None
    for part in range(4):
        edge = lambda i: F.lit(first) + F.expr(f"make_dt_interval(0, 0, 0, {(last - first).total_seconds() / 3 * i:.6f})")
        own = rows.filter((F.col("ts") >= edge(part)) & ((F.col("ts") < edge(part + 1)) | F.lit(part == 2))) if part < 3 else rows.filter("seq IS NULL")
        end = s.range(1).select(F.lit("").alias("key"), (F.lit(last) + F.expr("make_dt_interval(1)")).alias("ts"), F.lit(0).cast("long").alias("seq"))
        (own if part < 3 else end).write.mode("append").json(f"{at}/log")
        out = logs.drained(state.debounced(logs.log_stream(s, f"{at}/log", "key string, ts timestamp, seq long")), f"{at}/out")
    return out.filter("key <> ''").select(F.col("key").alias("path"), "ms", "seq")


@spec("R5_log_tail", ("log",), "SELECT tool, count(*) AS n FROM log WHERE seq % 10 <> 0 GROUP BY tool")
def _(s, d):
    from ..streaming import logs

    at = FI.scratch(s)
    line = F.to_json(F.struct("seq", "tool"))
    A.log(s, d).select(F.when(F.col("seq") % 10 == 0, F.lit('{"seq": 1, "to')).otherwise(line).alias("value")).write.text(f"{at}/log")
    return logs.drained(logs.log_stream(s, f"{at}/log", "seq long, tool string").filter("seq IS NOT NULL"), f"{at}/out").groupBy("tool").agg(_count().alias("n"))


@spec("R6_resume", ("log",), "SELECT seq, tool FROM log")
def _(s, d):
    from ..streaming import logs

    # Two runs with one checkpoint: the second takes up where the first ended, and nothing comes twice.
    at, rows = FI.scratch(s), A.log(s, d).select("seq", "tool", "k")
    out = None
    for low, high in ((0, 50), (50, 1000)):
        rows.filter(F.col("k").between(low, high - 1)).write.mode("append").json(f"{at}/log")
        out = logs.drained(logs.log_stream(s, f"{at}/log", "seq long, tool string, k long"), f"{at}/out")
    return out.select("seq", "tool")


@spec("R7_replay_window", ("log",), "SELECT count(DISTINCT k) AS messages FROM log")
def _(s, d):
    from ..streaming import logs

    at = FI.scratch(s)
    A.log(s, d).select(F.col("k").alias("message_id"), F.expr("TIMESTAMP '2024-01-08 00:00:00' + make_dt_interval(0, 0, 0, k)").alias("ts")).write.json(f"{at}/log")
    guarded = logs.replay_guard(logs.log_stream(s, f"{at}/log", "message_id long, ts timestamp"))
    return logs.drained(guarded, f"{at}/out").agg(_count().alias("messages"))


@spec("R8_session_state", (), None)
def _(s, d):
    from ..streaming import logs, state

    at = FI.scratch(s)
    _reads(s, d).write.json(f"{at}/log")
    schema = "session long, seq long, at long, path string, mtime long, size long, reset boolean"
    return logs.drained(state.served_stream(logs.log_stream(s, f"{at}/log", schema)), f"{at}/out", empty_batches=False)
