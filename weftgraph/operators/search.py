"""Asking the graph: seeds of a question, keyword choice, bounded walks, and what is shown of the subgraph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import graph as G
from .containment import document_frequency

MISTAKE_BOOST, KEYWORD_LESS = 2.5, 0.5
MOST_SENT = 500_000  # keywords, some 20 MB
LEAST_IDF, MOST_KEYWORDS, LEAST_KEYWORDS = 1.386, 5, 2


def hidden() -> Column:
    """Keyword concepts: ways into the graph that are never shown."""
    return (F.col("kind") == "concept") & F.coalesce(F.get_json_object("metadata", "$.subkind") == "keyword", F.lit(False))


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, source, target, relation): each edge from both of its ends, a self-loop once."""
    own = edges.select("source", "target", "relation")
    back = own.filter("source <> target").select(F.col("target").alias("id"), F.col("source").alias("other"), "source", "target", "relation")
    return own.select(F.col("source").alias("id"), F.col("target").alias("other"), "source", "target", "relation").unionAll(back)


def seed_scores(nodes: DataFrame, edges: DataFrame, terms: tuple[str, ...], each: int = 200) -> DataFrame:
    """(id, score) of the nodes that a question's terms may mean: the `each` most asked for of each term, and their
    neighbours; 2 for a term in the label, 1 for one in the file, mistakes raised, hidden keywords lowered."""
    low = nodes.select("id", "kind", "metadata", "query_count", F.lower("label").alias("label"), F.lower("source_file").alias("file"))
    w = Window.partitionBy("term").orderBy(F.desc("query_count"), "id")
    hits = F.array_compact(F.array(*(F.when(F.col("label").contains(t) | F.lower("id").contains(t), F.lit(t)) for t in terms)))
    hit = low.select("id", "query_count", F.explode(hits).alias("term")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= each).select("id").distinct()
    near = both_ways(edges).join(F.broadcast(hit), "id", "left_semi").select(F.col("other").alias("id"))  # at most `each` ids a term
    score = sum((F.when(F.col("label").contains(t), 2).otherwise(0) + F.when(F.col("file").contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    factor = F.when(F.col("kind") == "mistake", MISTAKE_BOOST).when(hidden(), KEYWORD_LESS).otherwise(1.0)
    return low.join(hit.union(near).distinct(), "id", "left_semi").withColumn("score", score * factor).filter("score > 0").select("id", "score")


def keyword_choice(prompts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, keywords) of the prompts(conv_id, turn, text) worth asking the graph about: two keywords or more,
    one of them rare among the labels; the rarest ones, at most MOST_KEYWORDS of those that a label holds.

    A keyword's documents are the labels that hold it anywhere.
    """
    told = prompts.select("conv_id", "turn", X.keywords(F.col("text")).alias("all")).filter(F.size("all") >= LEAST_KEYWORDS)
    words = told.select("conv_id", "turn", F.posexplode("all").alias("pos", "kw"))
    label = nodes.select(F.lit(0).alias("id"), F.lower("label").alias("text"))
    df = document_frequency(label, words.select(F.col("kw").alias("pattern"))).withColumnRenamed("pattern", "kw")
    df = G.checkpointed(df)
    if df.count() <= MOST_SENT:  # else words are dealt by keyword, and a frequent one is one task's
        df = F.broadcast(df)
    total = nodes.agg(F.count(F.lit(1)).alias("total"))  # one row
    scored = words.join(df, "kw", "left").crossJoin(F.broadcast(total)).withColumn("idf", F.when(F.col("df") > 0, F.round(F.log(F.col("total") / F.col("df")), 8)).otherwise(0.0))
    order = F.struct((-F.col("idf")).alias("less"), "pos", "kw")
    got = scored.groupBy("conv_id", "turn").agg(F.max("idf").alias("most"), F.sort_array(F.collect_list(F.when(F.col("idf") > 0, order))).alias("ranked"))
    return got.filter(F.col("most") >= LEAST_IDF).select("conv_id", "turn", F.slice("ranked", 1, MOST_KEYWORDS)["kw"].alias("keywords"))


def inverse_frequency(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """(kw, df, idf) of words(kw): how many labels hold each, and ln(labels / df), 0 for a word that none holds."""
    label = nodes.select(F.lit(0).alias("id"), F.lower("label").alias("text"))
    df = document_frequency(label, words.select(F.lower("kw").alias("pattern"))).withColumnRenamed("pattern", "kw")
    total = nodes.agg(F.count(F.lit(1)).alias("total"))  # one row
    got = words.select(F.lower("kw").alias("kw")).distinct().join(df, "kw", "left").crossJoin(F.broadcast(total)).withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    return got.select("kw", "df", F.when(F.col("df") > 0, F.round(F.log(F.col("total") / F.col("df")), 8)).otherwise(0.0).alias("idf"))


def walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(id, level) that a bounded breadth-first walk from seeds(id) reaches, and the edges (source, target, relation,
    level) that led to what was new.  `triggered_by` is walked from hidden keywords alone; edges to missing nodes are not walked."""
    own = nodes.select("id", hidden().alias("keyword"))
    links = both_ways(edges).join(own, "id").filter("relation <> 'triggered_by' OR keyword").drop("keyword")
    links = G.checkpointed(links.join(own.select(F.col("id").alias("other")), "other", "left_semi"))
    seen = seeds.select("id").distinct().withColumn("level", F.lit(0))
    taken = None
    for level in range(1, depth + 1):
        front = seen.filter(F.col("level") == level - 1).select("id")
        new = G.checkpointed(links.join(front, "id", "left_semi").join(seen.select(F.col("id").alias("other")), "other", "left_anti"))
        found = new.select("source", "target", "relation", F.lit(level).alias("level"))
        taken = found if taken is None else taken.unionAll(found)
        seen = G.checkpointed(seen.unionAll(new.select(F.col("other").alias("id")).distinct().withColumn("level", F.lit(level))))
    return seen, taken


def depth_first(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 200_000) -> DataFrame:
    """(place, id, level, source, target, relation) in the order of a bounded depth-first walk; seeds have no edge.

    A node counts as seen once it stands on the stack; neighbours are taken by (other, relation).  The walk is
    sequential: what it may reach, depth + 1 steps of a breadth-first walk, is cut out first and must have at most
    `most` edges.
    """
    reach, _ = walk(nodes, edges, seeds, depth + 1)
    own = nodes.select("id", hidden().alias("keyword"))
    links = both_ways(edges).join(reach.select("id"), "id", "left_semi").join(reach.select(F.col("id").alias("other")), "other", "left_semi").join(own, "id").filter("relation <> 'triggered_by' OR keyword")
    links = G.checkpointed(links.select("id", "other", "source", "target", "relation"))
    n = links.count()
    if n > most:
        raise ValueError(f"a depth-first walk over {n} edges: lower the depth, or walk breadth-first")
    start = [r["id"] for r in seeds.select("id").distinct().orderBy("id").collect()]  # a question's few seeds

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        next_to = {k: list(g.itertuples(index=False)) for k, g in pdf.sort_values(["other", "relation", "source"]).groupby("id")}
        seen, stack, out = set(start), [(x, 0) for x in reversed(start)], [(x, 0, None, None, None) for x in start]
        while stack:
            at, d = stack.pop()
            if d > depth:
                continue
            for r in next_to.get(at, ()):
                if r.other not in seen:
                    seen.add(r.other)
                    stack.append((r.other, d + 1))
                    out.append((r.other, d + 1, r.source, r.target, r.relation))
        return pd.DataFrame([(i, *x) for i, x in enumerate(out)], columns=["place", "id", "level", "source", "target", "relation"])

    # One more row keeps the group when there is no edge at all.
    blank = links.sparkSession.createDataFrame([("", "", "", "", "")], links.schema)
    return links.unionAll(blank).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "place long, id string, level long, source string, target string, relation string")


def shown(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most_label: int = 500, most: int = 8000) -> DataFrame:
    """(section, place, line) of a subgraph: mistakes first, then the visible nodes by rank from the seeds and by degree,
    then the edges without hidden keywords and without skill-to-skill likeness.  Of each section `most` lines: a line
    has a letter at least, so with four letters a token no more of them fit a budget of most / 4 tokens."""

    def first(df: DataFrame, section: str, line: Column, *order) -> DataFrame:
        own = df.orderBy(*order).limit(most)
        return own.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("place"), line.alias("line"))

    own = nodes.select("id", "label", "kind", "source_file", "confidence_score", hidden().alias("hidden"), (F.get_json_object("metadata", "$.subkind") == "skill").alias("skill"))
    own = own.withColumn("skill", F.coalesce("skill", F.lit(False)) & (F.col("kind") == "concept"))
    label = F.when(F.length("label") > most_label, F.concat(F.substring("label", 1, most_label - 1), F.lit("…"))).otherwise(F.col("label"))
    sure = F.when(F.col("confidence_score") >= 0.85, "").otherwise(F.format_string(" [confidence %.2f]", "confidence_score"))
    wrong = first(own.filter("kind = 'mistake'"), "mistake", F.concat(F.lit("  - "), label, F.lit(" (from "), "source_file", F.lit(")"), sure), "id")
    visible = G.checkpointed(own.filter("kind <> 'mistake' AND NOT hidden"))
    inside = edges.join(visible.select(F.col("id").alias("source")), "source", "left_semi").join(visible.select(F.col("id").alias("target")), "target", "left_semi")
    rank = G.pagerank(inside.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(1.0).alias("weight")), seeds.join(visible, "id", "left_semi"), ids=visible)
    degree = G.subgraph_degree(edges)
    ranked = visible.join(rank, "id", "left").join(degree, "id", "left").withColumns({"rank": F.round(F.coalesce("rank", F.lit(0.0)), 10), "degree": F.coalesce("degree", F.lit(0))})
    told = first(ranked, "node", F.concat(F.lit("NODE "), "label", F.lit(" ["), "kind", F.lit("] src="), "source_file"), F.desc("rank"), F.desc("degree"), "id")
    end = lambda c: own.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"), F.col("hidden").alias(f"{c}_hidden"), F.col("skill").alias(f"{c}_skill"))
    known = edges.join(end("source"), "source").join(end("target"), "target").filter("NOT source_hidden AND NOT target_hidden AND NOT (relation = 'similar_to' AND source_skill AND target_skill)")
    lines = first(known, "edge", F.concat(F.lit("EDGE "), "source_label", F.lit(" --"), "relation", F.lit("--> "), "target_label"), "source", "target", "relation")
    return wrong.unionAll(told).unionAll(lines)


#: The order in which a file's kinds are listed.
KIND_ORDER = ("class", "interface", "type", "function", "method", "variable", "import", "module", "file", "decision", "pattern", "mistake", "concept")


def structure(nodes: DataFrame, edges: DataFrame, most_edges: int = 10) -> DataFrame:
    """(source_file, place, line) of every file: its nodes by kind and degree, then its best connected edges; with the
    file's number of nodes and their mean confidence."""
    own = nodes.filter(~hidden()).select("id", "label", "kind", "source_file", "confidence_score")
    touch = edges.select(F.posexplode(F.array("source", "target")).alias("end", "id"), "source", "target", "relation").join(own.select("id", "source_file"), "id")
    degree = touch.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KIND_ORDER)), F.lit(len(KIND_ORDER)))
    w = Window.partitionBy("source_file").orderBy("order", F.desc("degree"), "id")
    ranked = own.join(degree, "id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "order": kind})
    all_ = Window.partitionBy("source_file")
    first = ranked.select("source_file", F.row_number().over(w).alias("place"), F.concat(F.lit("NODE "), "label", F.lit(" ["), "kind", F.lit("]")).alias("line"), F.count(F.lit(1)).over(all_).alias("n"), F.round(F.avg("confidence_score").over(all_), 6).alias("confidence"))
    # An edge's weight in a file is the degree of those of its ends that lie there.
    weigh = touch.join(degree, "id").groupBy("source_file", "source", "target", "relation").agg(F.sum("degree").alias("weight"))
    w = Window.partitionBy("source_file").orderBy(F.desc("weight"), "source", "target", "relation")
    best = weigh.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most_edges)
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    told = best.join(name("source"), "source").join(name("target"), "target")
    last = told.select("source_file", (F.col("place") + 1_000_000).alias("place"), F.concat(F.lit("EDGE "), "source_label", F.lit(" --"), "relation", F.lit("--> "), "target_label").alias("line"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("confidence"))
    return first.unionAll(last)
