"""Notes and commit messages: events as mistakes, decisions, patterns and concepts; orders as commits with a message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .adapters import table

RELATIONS = ("triggered_by", "similar_to", "calls", "depends_on")
#: Event types and the kinds of note that they stand for.
KINDS = {"error": "mistake", "signup": "decision", "purchase": "pattern", "click": "concept"}


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, kind, source_file, confidence_score, last_verified (ms), query_count, metadata, valid_until (ms),
    then_believed, found_false_at (ms), truth_now, applies_to."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(n)) for e, n in KINDS.items()))
    ms, ident = F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id").cast("string")
    json = lambda body, *cols: F.format_string(body, *cols)
    meta = (
        F.when((kind == "pattern") & (F.col("k") % 4 == 0), json('{"type":"hot_file","changeCount":%d}', F.col("k")))
        .when((kind == "concept") & (F.col("k") % 3 == 0), F.lit('{"subkind":"keyword"}')).when((kind == "concept") & (F.col("k") % 3 == 1), F.lit('{"subkind":"skill"}'))
        .when(kind == "mistake", json('{"commandPattern":"make f%d"}', F.col("k"))).otherwise(F.lit("{}"))
    )
    wrong = (kind == "mistake") & (F.col("event_id") % 2 == 0)
    return ev.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        F.concat("kind", F.lit(":"), ident).alias("id"), F.concat("kind", F.lit(" "), ident, F.lit(" of f"), (F.col("k") % 20).cast("string")).alias("label"), "kind",
        F.concat(F.lit("src/f"), (F.col("k") % 20).cast("string"), F.lit(".ts")).alias("source_file"), F.round(F.col("k") / 100, 2).alias("confidence_score"), ms.alias("last_verified"),
        F.floor("value").cast("long").alias("query_count"), meta.alias("metadata"), F.when(F.col("k") % 5 == 0, ms + 86_400_000).alias("valid_until"),
        F.when(wrong, F.concat(F.lit("value "), F.floor("value").cast("string"))).alias("then_believed"), F.when(wrong & (F.col("event_id") % 4 == 0), ms).alias("found_false_at"),
        F.when(wrong & (F.col("event_id") % 3 == 0), F.lit("another value")).alias("truth_now"), F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("f"), (F.col("k") % 20).cast("string"))).alias("applies_to"),
    )


def note_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation: a note and the same user's next one."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).filter(F.col("event_type").isin(*KINDS))
    kind = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(n)) for e, n in KINDS.items()))
    ident = F.concat(kind, F.lit(":"), F.col("event_id").cast("string"))
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("k") % 4 + 1).cast("int"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.withColumn("source", ident).select("source", F.lead("source").over(w).alias("target"), relation.alias("relation")).filter("target IS NOT NULL")


#: Messages by an order's key modulo 12: subject and body, {k} the key and {p} the short name of the order before.
MESSAGES = (
    ("fix(api)!: limits of part {k}", ""), ("Add cache {k}", "closes #12"), ('Revert "Add cache"', "This reverts commit {p}."), ("fix():missing", ""), ("fixup! fix: x", ""), ("revert the limits", "no name"),
    ("Resolves #9 in rank", ""), ("Docs", "As agreed, THIS REVERTS COMMIT {p} for now"), ("squash! closes #4", ""), ("bugfix: y", ""), ("Hotfix: z", "see src/f3.ts"), ("chore", "Fixed  #77"),
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, author, ts, subject, body: an order is a commit; its message follows from its key."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    before = F.substring(F.md5((k - 1).cast("string")), 1, 10)

    def text(i: int):
        parts = [F.when(k % 12 == n, F.replace(F.replace(F.lit(m[i]), F.lit("{k}"), k.cast("string")), F.lit("{p}"), before)) for n, m in enumerate(MESSAGES)]
        return F.coalesce(*parts)

    return o.select(F.md5(k.cast("string")).alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), text(0).alias("subject"), text(1).alias("body"))


def _case(i: int) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return "replace(replace(CASE o_orderkey % 12 " + " ".join(f"WHEN {n} THEN {quote(m[i])}" for n, m in enumerate(MESSAGES)) + " END, '{k}', CAST(o_orderkey AS VARCHAR)), '{p}', substr(md5(CAST(o_orderkey - 1 AS VARCHAR)), 1, 10))"


#: The same as SQL, for oracles.
SQL = {
    "notes": """note0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'error' THEN 'mistake' WHEN 'signup' THEN 'decision' WHEN 'purchase' THEN 'pattern' WHEN 'click' THEN 'concept' END AS kind FROM events),
notes AS (SELECT kind || ':' || event_id AS id, kind || ' ' || event_id || ' of f' || (k % 20) AS label, kind, 'src/f' || (k % 20) || '.ts' AS source_file, round(k / 100.0::DOUBLE, 2) AS confidence_score, epoch_us(ts) // 1000 AS last_verified, CAST(floor(value) AS BIGINT) AS query_count,
 CASE WHEN kind = 'pattern' AND k % 4 = 0 THEN '{"type":"hot_file","changeCount":' || k || '}' WHEN kind = 'concept' AND k % 3 = 0 THEN '{"subkind":"keyword"}' WHEN kind = 'concept' AND k % 3 = 1 THEN '{"subkind":"skill"}' WHEN kind = 'mistake' THEN '{"commandPattern":"make f' || k || '"}' ELSE '{}' END AS metadata,
 CASE WHEN k % 5 = 0 THEN epoch_us(ts) // 1000 + 86400000 END AS valid_until, CASE WHEN kind = 'mistake' AND event_id % 2 = 0 THEN 'value ' || CAST(floor(value) AS BIGINT) END AS then_believed,
 CASE WHEN kind = 'mistake' AND event_id % 4 = 0 THEN epoch_us(ts) // 1000 END AS found_false_at, CASE WHEN kind = 'mistake' AND event_id % 6 = 0 THEN 'another value' END AS truth_now, CASE WHEN event_id % 6 = 0 THEN 'f' || (k % 20) END AS applies_to
 FROM note0 WHERE kind IS NOT NULL)""",
    "note_edges": """note_edges AS (SELECT * FROM (SELECT kind || ':' || event_id AS source, lead(kind || ':' || event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target,
 CASE k % 4 WHEN 0 THEN 'triggered_by' WHEN 1 THEN 'similar_to' WHEN 2 THEN 'calls' ELSE 'depends_on' END AS relation FROM note0 WHERE kind IS NOT NULL) WHERE target IS NOT NULL)""",
    "messages": f"messages AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, o_custkey AS author, o_orderdate AS ts, {_case(0)} AS subject, {_case(1)} AS body FROM orders)",
}
