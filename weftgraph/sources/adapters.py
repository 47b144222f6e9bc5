"""Driver tables as the engine's inputs: nodes, edges, the event log, commits and provider results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deal import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, kind, source_file of every key of the star schema."""
    spec = (
        ("region", "r_regionkey", F.col("r_name"), "module", F.lit("world")),
        ("nation", "n_nationkey", F.col("n_name"), "file", _id("region", "n_regionkey")),
        ("supplier", "s_suppkey", F.col("s_name"), "class", _id("nation", "s_nationkey")),
        ("part", "p_partkey", F.col("p_name"), "function", F.col("p_brand")),
        ("customer", "c_custkey", F.col("c_name"), "interface", _id("nation", "c_nationkey")),
        ("orders", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "concept", _id("customer", "o_custkey")),
    )
    parts = [
        table(spark, sf_dir, name).select(_id(name, key).alias("id"), label.alias("label"), F.lit(kind).alias("kind"), file.alias("source_file"))
        for name, key, label, kind, file in spec
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation, confidence, confidence_score from the foreign keys, one row a triple."""
    line = table(spark, sf_dir, "lineitem")

    def part(df: DataFrame, source: Column, target: Column, relation: str, score: float = 0.85) -> DataFrame:
        confidence = "EXTRACTED" if score >= 0.85 else "INFERRED"
        return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(score).alias("confidence_score"))

    parts = [
        part(table(spark, sf_dir, "orders"), _id("customer", "o_custkey"), _id("orders", "o_orderkey"), "depends_on"),
        part(line, _id("orders", "l_orderkey"), _id("part", "l_partkey"), "contains").distinct(),
        part(line, _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "calls", 0.7).distinct(),
        part(table(spark, sf_dir, "customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "imports"),
        part(table(spark, sf_dir, "supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "imports"),
        part(table(spark, sf_dir, "nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "exports"),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Event types and the tools they stand for.
TOOLS = {"view": "Read", "click": "Grep", "purchase": "Bash", "signup": "Edit", "error": "Write"}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook log: seq, ts, tool, decision, path, session, would_have, injected, saved, k."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    tool = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(t)) for e, t in TOOLS.items()))
    would = F.floor("value").cast("long")
    return ev.select(
        F.col("event_id").alias("seq"), "ts", tool.alias("tool"),
        F.when(F.col("k") < 40, "deny").when(F.col("k") < 60, "allow").otherwise("passthrough").alias("decision"),
        F.concat(F.lit("f"), (F.col("k") % 20).cast("string")).alias("path"), F.col("user_id").alias("session"),
        would.alias("would_have"), F.col("k").alias("injected"), F.greatest(F.lit(0).cast("long"), would - F.col("k")).alias("saved"), "k",
    )


def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as hooks write it, gaps included: log's columns with event, command and displaced; any of event, tool,
    decision, would_have, injected and command may be missing."""
    k = F.col("k")
    return log(spark, sf_dir).withColumns({
        "event": F.when(k % 17 == 3, None).when(k % 5 == 0, "PostToolUse").otherwise("PreToolUse"), "tool": F.when(k % 19 != 7, F.col("tool")),
        "decision": F.when(k % 13 != 4, F.col("decision")), "command": F.when((F.col("tool") == "Bash") & (k % 3 > 0), F.concat(F.lit("grep -rn s"), k.cast("string"))),
        "would_have": F.when(k % 11 != 5, F.col("would_have")), "injected": F.when(k % 7 != 2, F.col("injected")), "displaced": F.when(k % 4 == 0, k - 10),
        "path": F.when(k % 23 != 9, F.col("path")),
    })


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, author, ts, file: an order is a commit of its distinct parts; dealt by commit."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    line = table(spark, sf_dir, "lineitem")
    files = dealt(line.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")), line.count(), "commit").distinct()
    return files.join(orders, "commit")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee, owner: a supplier's large lines call parts that another supplier owns."""
    line = table(spark, sf_dir, "lineitem")
    owner = line.groupBy(F.col("l_partkey").alias("callee")).agg(F.min("l_suppkey").alias("owner"))
    big = line.filter("l_quantity >= 49").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee")).distinct()
    return big.join(owner, "callee").filter("caller <> owner").select("caller", "callee", "owner")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider results: request, provider, content, confidence, seq.  A request has at most 20 of them."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left").select(
        F.floor(F.col("doc_id") / 20).alias("request"), F.col("source").alias("provider"), F.col("text").alias("content"),
        F.coalesce(F.lit(0.5) + F.lit(0.4) * F.col("quality"), F.lit(0.5)).alias("confidence"), F.col("doc_id").alias("seq"),
    )


#: The same adapters as SQL, for oracles.
SQL = {
    "nodes": """nodes AS (
 SELECT 'region:' || r_regionkey AS id, r_name AS label, 'module' AS kind, 'world' AS source_file FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'file', 'region:' || n_regionkey FROM nation
 UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'class', 'nation:' || s_nationkey FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, p_name, 'function', p_brand FROM part
 UNION ALL SELECT 'customer:' || c_custkey, c_name, 'interface', 'nation:' || c_nationkey FROM customer
 UNION ALL SELECT 'orders:' || o_orderkey, 'order ' || o_orderkey, 'concept', 'customer:' || o_custkey FROM orders)""",
    "edges": """edges AS (
 SELECT 'customer:' || o_custkey AS source, 'orders:' || o_orderkey AS target, 'depends_on' AS relation, 'EXTRACTED' AS confidence, 0.85::DOUBLE AS confidence_score FROM orders
 UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'contains', 'EXTRACTED', 0.85::DOUBLE FROM lineitem
 UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'calls', 'INFERRED', 0.7::DOUBLE FROM lineitem
 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'imports', 'EXTRACTED', 0.85::DOUBLE FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports', 'EXTRACTED', 0.85::DOUBLE FROM supplier
 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'exports', 'EXTRACTED', 0.85::DOUBLE FROM nation)""",
    "log": """log0 AS (SELECT event_id AS seq, ts, event_type, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
log AS (SELECT seq, ts, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Grep' WHEN 'purchase' THEN 'Bash' WHEN 'signup' THEN 'Edit' WHEN 'error' THEN 'Write' END AS tool,
 CASE WHEN k < 40 THEN 'deny' WHEN k < 60 THEN 'allow' ELSE 'passthrough' END AS decision, 'f' || (k % 20) AS path, user_id AS session,
 CAST(floor(value) AS BIGINT) AS would_have, k AS injected, greatest(0, CAST(floor(value) AS BIGINT) - k) AS saved, k FROM log0)""",
    "hooks": """hooks AS (SELECT seq, ts, CASE WHEN k % 19 <> 7 THEN tool END AS tool, CASE WHEN k % 13 <> 4 THEN decision END AS decision, CASE WHEN k % 23 <> 9 THEN path END AS path, session,
 CASE WHEN k % 11 <> 5 THEN would_have END AS would_have, CASE WHEN k % 7 <> 2 THEN injected END AS injected, CASE WHEN k % 17 = 3 THEN NULL WHEN k % 5 = 0 THEN 'PostToolUse' ELSE 'PreToolUse' END AS event,
 CASE WHEN tool = 'Bash' AND k % 3 > 0 THEN 'grep -rn s' || k END AS command, CASE WHEN k % 4 = 0 THEN k - 10 END AS displaced, k FROM log)""",
    "commits": """files AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM lineitem),
commits AS (SELECT f.commit_id, f.file, o.o_custkey AS author, o.o_orderdate AS ts FROM files f JOIN orders o ON o.o_orderkey = f.commit_id),
co_change AS (SELECT a.file AS file_a, b.file AS file_b, CAST(count(*) AS BIGINT) AS n FROM commits a JOIN commits b ON a.commit_id = b.commit_id AND a.file < b.file GROUP BY a.file, b.file)""",
    "calls": """owners AS (SELECT l_partkey AS callee, min(l_suppkey) AS owner FROM lineitem GROUP BY l_partkey),
calls AS (SELECT DISTINCT l.l_suppkey AS caller, l.l_partkey AS callee, o.owner FROM lineitem l JOIN owners o ON o.callee = l.l_partkey WHERE l.l_quantity >= 49 AND l.l_suppkey <> o.owner)""",
    "results": """lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
results AS (SELECT d.doc_id // 20 AS request, d.source AS provider, d.text AS content, coalesce(0.5::DOUBLE + 0.4::DOUBLE * l.quality, 0.5::DOUBLE) AS confidence, d.doc_id AS seq FROM documents d LEFT JOIN lab l ON l.doc_id = d.doc_id)""",
}
