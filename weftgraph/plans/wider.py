"""Further queries: set operations, parsers, packets, caches and replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parse as Q
from ..functions import text as X
from ..operators import store as S
from ..sources import adapters as A
from ..sources import files as FI
from .more import _count
from .registry import BOTH, co_changes, oracle_sql, queries, spec  # noqa: F401  (the whole table is read through this module)


# Stores and scans
@spec("K6_replace_co_change", ("commits",), "SELECT file_a, file_b, n FROM co_change WHERE n >= 2")
def _(s, d):
    # The pairs of some commits are stored; those mined from all of them take their place.
    at = FI.scratch(s)
    S.swapped(at, co_changes(s, d, "commit % 2 = 0").filter("n >= 2"))
    return S.swapped(at, co_changes(s, d).filter("n >= 2"))


# Predicates
# Joins
@spec("J2_degree_join", ("nodes", "edges"), f", {BOTH} SELECT n.id, count(*) AS degree FROM nodes n JOIN both_ b ON b.id = n.id GROUP BY n.id")
def _(s, d):
    e = A.edges(s, d)
    ends = e.select(F.explode(F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))).alias("id"))
    return ends.groupBy("id").agg(_count().alias("degree")).join(A.nodes(s, d).select("id"), "id", "left_semi")


@spec("J11_adjacent_files", ("nodes", "edges"), f", {BOTH} SELECT DISTINCT f.source_file AS focal, n.source_file AS file FROM nodes f JOIN both_ b ON b.id = f.id JOIN nodes n ON n.id = b.other WHERE f.kind = 'class' AND f.source_file <> n.source_file")
def _(s, d):
    n, e = A.nodes(s, d), A.edges(s, d)
    both = e.select(F.col("source").alias("id"), F.col("target").alias("other")).union(e.select("target", "source"))
    focal = n.filter("kind = 'class'").select("id", F.col("source_file").alias("focal"))
    return both.join(focal, "id").join(n.select(F.col("id").alias("other"), F.col("source_file").alias("file")), "other").filter("focal <> file").select("focal", "file").distinct()


# Set operations
@spec("U1_both_directions", ("commits",), "SELECT file_a AS a, file_b AS b FROM co_change WHERE n >= 2 UNION ALL SELECT file_b, file_a FROM co_change WHERE n >= 2")
def _(s, d):
    p = queries()["K6_replace_co_change"](s, d)
    return p.select(F.explode(F.array(F.struct(F.col("file_a").alias("a"), F.col("file_b").alias("b")), F.struct(F.col("file_b").alias("a"), F.col("file_a").alias("b")))).alias("p")).select("p.*")


@spec("U2_last_wins", ("nodes",), "SELECT id, CASE WHEN kind = 'class' THEN 'mined' ELSE kind END AS kind FROM nodes")
def _(s, d):
    n = A.nodes(s, d).select("id", "kind")
    both = n.withColumn("miner", F.lit(0)).union(n.filter("kind = 'class'").select("id", F.lit("mined"), F.lit(1)))
    return both.groupBy("id").agg(F.max_by("kind", "miner").alias("kind"))


SETS = {"U3_union": ("union", "UNION"), "U4_intersect": ("intersect", "INTERSECT"), "U6_except": ("subtract", "EXCEPT")}
for _name, (_method, _word) in SETS.items():

    @spec(_name, (), f"SELECT l_partkey AS part FROM lineitem WHERE l_quantity >= 45 {_word} SELECT l_partkey FROM lineitem WHERE l_discount >= 0.08")
    def _(s, d, method=_method):
        line = A.table(s, d, "lineitem")
        return getattr(line.filter("l_quantity >= 45").select(F.col("l_partkey").alias("part")), method)(line.filter("l_discount >= 0.08D").select("l_partkey")).distinct()


@spec("U5_intersect_lines", (), "SELECT l_orderkey || ':' || l_linenumber AS place FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_quantity > 25")
def _(s, d):
    line, at = A.table(s, d, "lineitem"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("place")
    return line.filter("l_returnflag = 'R'").select(at).intersect(line.filter("l_quantity > 25").select(at))


# Text
@spec("X3_bare_identifier", (), "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'm.9bad(x)' ELSE 'm' || p_size || '.run' || p_partkey || '(a.b)' END AS c FROM part), y AS (SELECT p_partkey AS id, trim(string_split(regexp_replace(c, '\\(.*', ''), '.')[-1]) AS name FROM x) SELECT id, CASE WHEN regexp_full_match(name, '[A-Za-z_$][A-Za-z0-9_$]*') THEN name END AS name FROM y")
def _(s, d):
    c = F.when(F.col("p_partkey") % 7 == 0, "m.9bad(x)").otherwise(F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit(".run"), F.col("p_partkey").cast("string"), F.lit("(a.b)")))
    return A.table(s, d, "part").select(F.col("p_partkey").alias("id"), Q.bare_identifier(c).alias("name"))


@spec("X2_bare_name", (), "SELECT p_partkey AS id, trim(regexp_extract(p_name || CASE WHEN p_size > 25 THEN '<T>(x)' ELSE ' (y)' END, '^[^(<]*')) AS name FROM part")
def _(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").alias("id"), X.bare_name(F.concat(F.col("p_name"), F.when(F.col("p_size") > 25, "<T>(x)").otherwise(" (y)"))).alias("name"))


@spec("X13_entropy", (), "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{24,}')) AS token FROM documents) SELECT doc_id, token FROM w WHERE list_entropy(string_split(token, '')) >= 4.0")
def _(s, d):
    w = A.table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{24,}"), F.lit(0))).alias("token"))
    return w.filter(X.entropy(F.col("token")) >= 4.0)


@spec("X14_luhn", (), "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{13,19}\\b')) AS digits FROM documents), v AS (SELECT doc_id, digits, list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INT) ELSE (2 * CAST(digits[-i] AS INT)) // 10 + (2 * CAST(digits[-i] AS INT)) % 10 END)) AS total FROM w) SELECT doc_id, digits FROM v WHERE total % 10 = 0")
def _(s, d):
    w = A.table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{13,19}\b"), F.lit(0))).alias("digits"))
    return w.filter(F.expr("luhn_check(digits)"))


@spec("X26_template", ("log",), "SELECT seq, 'read ' || path || ' by ' || tool || ' {other}' AS arg FROM log")
def _(s, d):
    return A.log(s, d).select("seq", Q.fill("read {path} by {tool} {other}", path=F.col("path"), tool=F.col("tool")).alias("arg"))


@spec("X27_semver", (), "SELECT p_partkey AS id, [p_size, p_partkey % 10, p_partkey % 3] > [25, 3, 1] AS newer FROM part")
def _(s, d):
    v = F.concat(F.lit("v"), F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), (F.col("p_partkey") % 3).cast("string")))
    return A.table(s, d, "part").select(F.col("p_partkey").alias("id"), (Q.semver(v) > Q.semver(F.lit("25.3.1"))).alias("newer"))


@spec("X30_fingerprint", (), "SELECT doc_id, translate(regexp_replace(to_base64(unhex(sha256(text))), '=+$', ''), '+/', '-_') AS print FROM documents")
def _(s, d):
    return A.table(s, d, "documents").select("doc_id", Q.fingerprint(F.col("text")).alias("print"))


# Packets
@spec("T5_cut_lines", ("results",), ", ln AS (SELECT seq, generate_subscripts(string_split(content, chr(10)), 1) AS i, unnest(string_split(content, chr(10))) AS line FROM results), cu AS (SELECT seq, i, line, sum(ceil(length(line) / 4) + 1) OVER (PARTITION BY seq ORDER BY i) AS used FROM ln), kept AS (SELECT seq, string_agg(line, chr(10) ORDER BY i) AS cut FROM cu WHERE used <= 200 GROUP BY seq) SELECT r.seq, coalesce(k.cut, substring(r.content, 1, 800)) AS cut FROM results r LEFT JOIN kept k ON k.seq = r.seq")
def _(s, d):
    return A.results(s, d).select("seq", Q.cut_lines(F.col("content")).alias("cut"))


KIND = "CASE seq % 3 WHEN 0 THEN 'ast' WHEN 1 THEN 'structure' ELSE 'other' END"


@spec("T7_eviction", ("log",), "SELECT session, max(seq) AS used FROM log GROUP BY session ORDER BY used DESC LIMIT 50")
def _(s, d):
    return A.log(s, d).groupBy("session").agg(F.max("seq").alias("used")).orderBy(F.desc("used")).limit(50)


# Telemetry, sessions, replay
@spec("W11_carry_forward", ("log",), "SELECT seq, last_value(CASE WHEN tool = 'Edit' THEN path END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS heading FROM log")
def _(s, d):
    w = Window.partitionBy("session").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return A.log(s, d).select("seq", F.last(F.when(F.col("tool") == "Edit", F.col("path")), ignorenulls=True).over(w).alias("heading"))


@spec("R1_debounce", ("log",), "SELECT seq, path FROM (SELECT seq, path, epoch_us(lead(ts) OVER (PARTITION BY path ORDER BY ts, seq)) - epoch_us(ts) AS gap FROM log) WHERE gap IS NULL OR gap >= 300000")
def _(s, d):
    later = F.lead("ts").over(Window.partitionBy("path").orderBy("ts", "seq"))
    g = A.log(s, d).select("seq", "path", (F.unix_micros(later.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("gap"))
    return g.filter("gap IS NULL OR gap >= 300000").select("seq", "path")
