"""Reports: each is rows (section, place, text) for its document, and a writer turns rows into text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from .evaluation import numbered

MONTH = 30 * 86_400_000
#: The task views: sections with their limits and headings, in order.
VIEWS = {
    "general": (("gods", 8, "Core entities"), ("structure", 0, "Structure"), ("mistakes", 5, "Past mistakes"), ("decisions", 5, "Decisions"), ("patterns", 5, "Patterns"), ("deps", 5, "Key dependencies")),
    "bug-fix": (("hot", 10, "Hot files"), ("mistakes", 10, "Past mistakes"), ("gods", 5, "Core entities"), ("structure", 0, "Structure"), ("patterns", 5, "Patterns")),
    "feature": (("gods", 12, "Core entities"), ("structure", 0, "Structure"), ("decisions", 10, "Decisions"), ("deps", 5, "Key dependencies"), ("mistakes", 3, "Past mistakes")),
    "refactor": (("gods", 15, "Core entities"), ("structure", 0, "Structure"), ("deps", 10, "Key dependencies"), ("patterns", 10, "Patterns"), ("mistakes", 5, "Past mistakes")),
}


def _top(df: DataFrame, section: str, text: Column, *order, k: int | None = None) -> DataFrame:
    """The first k rows as a section, numbered in their order.  The limit comes first, so no window runs over more than
    it; without one, rows are numbered range by range."""
    if k:
        own = df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    else:
        own = numbered(df, *order)[0].withColumn("place", (F.col("at") + 1).cast("int"))
    return own.select(F.lit(section).alias("section"), "place", text.alias("text"))


def is_hot() -> Column:
    """Files that change often, among the patterns."""
    return (F.col("kind") == "pattern") & F.coalesce(F.get_json_object("metadata", "$.type") == "hot_file", F.lit(False))


def gods(nodes: DataFrame, edges: DataFrame, k: int, section: str = "gods") -> DataFrame:
    text = F.concat(F.lit("- `"), "label", F.lit("` ("), "kind", F.lit(", "), F.col("degree").cast("string"), F.lit(" connections)"))
    return _top(G.god_nodes(nodes, edges, k), section, text, F.desc("degree"), "id", k=k)


def noted(notes: DataFrame, kind: str, k: int, *order, section: str | None = None) -> DataFrame:
    own = notes.filter((F.col("kind") == kind) & ~is_hot())
    return _top(own, section or kind + "s", F.concat(F.lit("- "), "label"), *(order or (F.col("id"),)), k=k)


def hot(notes: DataFrame, k: int | None = 10, section: str = "hot") -> DataFrame:
    changes = F.get_json_object("metadata", "$.changeCount").cast("long")
    return _top(notes.filter(is_hot()), section, F.concat(F.lit("- "), "label"), F.desc(changes), "id", k=k)


def dependencies(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The most imported."""
    n = edges.filter("relation = 'imports'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(k)
    text = F.concat(F.lit("- `"), F.coalesce("label", "id"), F.lit("` (imported by "), F.col("n").cast("string"), F.lit(" files)"))
    return _top(n.join(nodes.select("id", "label"), "id", "left"), "deps", text, F.desc("n"), "id", k=k)


def folders(nodes: DataFrame) -> DataFrame:
    """Files by folder; a folder's names are joined in order."""
    own = nodes.filter("kind = 'file' AND source_file <> ''").withColumn("dir", F.regexp_extract("source_file", "^(.*)/[^/]*$", 1))
    got = own.groupBy(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("dir")).agg(F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("names"))
    return got.select(F.lit("structure").alias("section"), F.lit(0).alias("place"), F.concat(F.lit("- `"), "dir", F.lit("/` — "), "names").alias("text"))


def view(name: str, nodes: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """The rows of a task view, with `heading` and `part`, the section's place in it."""
    make = {
        "gods": lambda k: gods(nodes, edges, k), "structure": lambda k: folders(nodes), "hot": lambda k: hot(notes, k), "deps": lambda k: dependencies(nodes, edges, k),
        "mistakes": lambda k: noted(notes, "mistake", k), "decisions": lambda k: noted(notes, "decision", k), "patterns": lambda k: noted(notes, "pattern", k),
    }
    return reduce(DataFrame.unionByName, [make[s](k).withColumns({"heading": F.lit(h), "part": F.lit(i)}) for i, (s, k, h) in enumerate(VIEWS[name])])


def rules(nodes: DataFrame, edges: DataFrame, notes: DataFrame, as_of_ms: int, hot_files: int | None = None) -> dict[str, DataFrame]:
    """The sections that the rules documents share: sure patterns, a month's decisions, the mistakes asked for most,
    the best connected nodes, and hot files."""
    sure = notes.filter((F.col("kind") == "pattern") & (F.col("confidence_score") >= 0.8) & ~is_hot())
    recent = notes.filter((F.col("kind") == "decision") & (F.col("last_verified") >= as_of_ms - MONTH))
    bullet = F.concat(F.lit("- "), "label")
    return {
        "patterns": _top(sure, "patterns", bullet, F.col("id")), "decisions": _top(recent, "decisions", bullet, F.desc("last_verified"), "id"),
        "mistakes": _top(notes.filter("kind = 'mistake'"), "mistakes", bullet, F.desc("query_count"), "id", k=5), "gods": gods(nodes, edges, 10), "hot": hot(notes, hot_files),
    }


def editor_rules(nodes: DataFrame, edges: DataFrame, notes: DataFrame, as_of_ms: int) -> DataFrame:
    """With the globs of the commonest file types."""
    ext = nodes.select(F.regexp_extract("source_file", r"\.([A-Za-z0-9]+)$", 1).alias("ext")).filter("ext <> ''").groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    globs = _top(ext, "globs", F.concat(F.lit("**/*."), "ext"), F.desc("n"), "ext", k=6)
    return reduce(DataFrame.unionByName, [*rules(nodes, edges, notes, as_of_ms).values(), globs])


def chat_context(nodes: DataFrame, edges: DataFrame, notes: DataFrame, as_of_ms: int) -> DataFrame:
    return reduce(DataFrame.unionByName, rules(nodes, edges, notes, as_of_ms, 10).values())


def agent_rules(nodes: DataFrame, edges: DataFrame, notes: DataFrame, as_of_ms: int) -> DataFrame:
    """As chat_context with the entities first; `part` is the section's place."""
    own = rules(nodes, edges, notes, as_of_ms, 10)
    order = ("gods", "patterns", "decisions", "mistakes", "hot")
    return reduce(DataFrame.unionByName, [own[s].withColumn("part", F.lit(i)) for i, s in enumerate(order)])


# Kinds of code.
CODE = ("class", "interface", "type", "function", "method")


def context_index(nodes: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Patterns, decisions, mistakes and the concepts asked for; if there is none of them, the best connected code."""
    bullet, asked = F.concat(F.lit("- "), "label"), (F.desc("query_count"), F.col("id"))
    sure = notes.filter((F.col("kind") == "pattern") & (F.col("confidence_score") >= 0.8) & ~is_hot())
    told = reduce(DataFrame.unionByName, [
        _top(sure, "patterns", bullet, *asked), _top(notes.filter("kind = 'decision'"), "decisions", bullet, F.desc("last_verified"), "id"),
        _top(notes.filter("kind = 'mistake'"), "issues", bullet, *asked), _top(notes.filter("kind = 'concept' AND query_count > 0"), "concepts", bullet, *asked, k=10),
    ])
    if told.limit(1).count():
        return told
    code = nodes.filter(F.col("kind").isin(*CODE)).join(G.subgraph_degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return _top(code, "code", bullet, F.desc("degree"), "label", k=20)


def subagent_slice(nodes: DataFrame, edges: DataFrame, is_test: Column, related: DataFrame | None = None) -> DataFrame:
    """The five best connected nodes of fifteen, tests left out unless all are tests, and up to four related files."""
    raw = G.god_nodes(nodes, edges, 15).join(nodes.select("id", "source_file"), "id").withColumn("test", is_test)
    rows = raw.withColumn("none", F.min("test").over(Window.partitionBy(F.lit(1)))).filter("none OR NOT test")  # fifteen rows
    text = F.concat("label", F.lit(" ["), "kind", F.lit("] ("), F.col("degree").cast("string"), F.lit(" conn)"))
    first = _top(rows, "gods", text, F.desc("degree"), "id", k=5)
    return first if related is None else first.unionByName(_top(related, "related", F.col("file").cast("string"), "place", k=4))


def brief(nodes: DataFrame, edges: DataFrame, notes: DataFrame, k_gods: int, k_mistakes: int, reads: DataFrame | None = None) -> DataFrame:
    """A session's brief: graph figures, best connected nodes, newest mistakes, and the files read last."""
    figures = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("e")))  # one row by one row
    parts = [figures.select(F.lit("stats").alias("section"), F.lit(1).alias("place"), F.format_string("%d nodes, %d edges", "n", "e").alias("text")), gods(nodes, edges, k_gods)]
    if k_mistakes:
        parts.append(noted(notes, "mistake", k_mistakes, F.desc("last_verified"), "id"))
    if reads is not None:
        last = reads.groupBy("path").agg(F.max("ts").alias("at"))
        parts.append(_top(last, "reads", F.col("path"), F.desc("at"), "path", k=8))
    return reduce(DataFrame.unionByName, parts)


def document(rows: DataFrame, title: str, headings: dict[str, str]) -> str:
    """A report's text: its rows are limited by section, so they are collected."""
    order = list(headings)
    got = sorted(rows.select("section", "place", "text").collect(), key=lambda r: (order.index(r["section"]) if r["section"] in order else len(order), r["place"], r["text"]))
    out = [f"# {title}"]
    for s in order:
        if own := [r["text"] for r in got if r["section"] == s]:
            out += ["", f"## {headings[s]}", "", *own]
    return "\n".join(out) + "\n"


START, END = "<!-- weft:start -->", "<!-- weft:end -->"


def spliced(old: str, section: str) -> str:
    """A document with a section between the marks: in the place of what stands there, else at the end.  Marks inside
    fenced blocks are no marks; a document whose marks don't pair keeps its text, and the section comes at the end."""
    bare = re.sub(r"```.*?```", lambda m: " " * len(m[0]), old, flags=re.S)
    a, b = bare.find(START), bare.find(END)
    block = f"{START}\n{section.strip()}\n{END}"
    if bare.count(START) == bare.count(END) == 1 and a < b:
        return old[:a] + block + old[b + len(END) :]
    return f"{old.rstrip()}\n\n{block}\n" if old.strip() else block + "\n"
