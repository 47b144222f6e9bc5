"""A graph as an object: the questions that tools ask.  Each method gives a DataFrame, or text where it says so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parse, text
from .operators import graph, mining, rank, reports, search, store, telemetry

__all__ = ["Graph", "graph", "mining", "parse", "rank", "reports", "search", "store", "telemetry", "text"]


class Graph:
    """nodes(id, label, kind, source_file, confidence_score, metadata, query_count, last_verified, ...) and
    edges(source, target, relation, confidence)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Graph:
        """From `<path>/nodes` and `<path>/edges`, brought to the newest schema."""
        return cls(store.opened(spark, f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    def query(self, question: str, mode: str = "bfs", depth: int = 3, budget: int = 2000) -> str:
        """What the graph says about a question, as text within a budget of tokens."""
        terms = tuple(t for t in question.lower().split() if len(t) > 2)
        scored = search.seed_scores(self.nodes, self.edges, terms) if terms else None
        seeds = graph.checkpointed(scored.orderBy(F.desc("score"), "id").limit(3).select("id")) if terms else None
        if not terms or not seeds.limit(1).count():
            return "Nothing in the graph matches."
        if mode == "dfs":
            seen = graph.checkpointed(search.depth_first(self.nodes, self.edges, seeds, depth))
            found = seen.filter("source IS NOT NULL")
        else:
            seen, found = search.walk(self.nodes, self.edges, seeds, depth)
        own = self.nodes.join(seen.select("id"), "id", "left_semi")
        most = 4 * budget  # letters
        rows = graph.checkpointed(search.shown(own, found.select("source", "target", "relation"), seeds, most=most))
        order = F.array_position(F.array(F.lit("mistake"), F.lit("node"), F.lit("edge")), F.col("section"))
        lines = [r["line"] for r in rows.orderBy(order, "place").limit(most).collect()]
        if lines and rows.filter("section = 'mistake'").limit(1).count():
            lines.insert(0, "Known mistakes about this:")
        whole, mark = "\n".join(lines), f"\n[cut at {budget} tokens]"
        return whole if len(whole) <= most else text.cut_units(whole, max(0, most - len(mark))) + mark

    def gods(self, n: int = 10) -> DataFrame:
        return graph.god_nodes(self.nodes, self.edges, n)

    def stats(self) -> DataFrame:
        return store.graph_stats(self.nodes, self.edges)

    def path(self, source: str, target: str, hops: int = 8) -> DataFrame:
        """(step, id) of a shortest path between the nodes that two names mean best; empty if there is none."""
        ends = []
        for name in (source, target):
            terms = tuple(t for t in name.lower().split() if len(t) > 2)
            best = search.seed_scores(self.nodes, self.edges, terms).orderBy(F.desc("score"), "id").first() if terms else None
            ends.append(best["id"] if best else None)
        links = self.edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
        if None in ends:
            return links.sparkSession.createDataFrame([], "step int, id string")
        return graph.shortest_path(links, *ends, hops)

    def mistakes(self, file: str | None = None, since_ms: int | None = None, limit: int = 20) -> DataFrame:
        return store.mistakes(self.nodes, file, since_ms, k=limit)

    def benchmark(self, files: DataFrame, question: str) -> DataFrame:
        """Tokens of all files(file, text), of those that a question's answer names, and of the answer itself; with ratios."""
        answer = self.query(question)
        tokens = F.coalesce(F.sum(text.tokens(F.col("text"))), F.lit(0))
        said = F.lit(answer)
        got = files.withColumn("named", said.contains(F.col("file"))).agg(tokens.alias("all"), F.coalesce(F.sum(F.when(F.col("named"), text.tokens(F.col("text")))), F.lit(0)).alias("relevant"))
        own = max(1, -(-len(answer) // 4))
        return got.select("all", "relevant", F.lit(own).alias("answer"), F.round(F.col("all") / own, 1).alias("ratio_all"), F.round(F.col("relevant") / own, 1).alias("ratio_relevant"))

    def summary(self, view: str = "general") -> DataFrame:
        """The rows of a task view; notes are nodes like the others."""
        return reports.view(view, self.nodes, self.edges, self.nodes)
