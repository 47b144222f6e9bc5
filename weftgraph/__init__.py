"""An analytics engine for code-and-knowledge graphs, the telemetry around them, and training corpora, on Spark."""

__all__ = ["Graph"]


def __getattr__(name: str):
    # Imported when it is asked for: Python workers import the package for one operator alone.
    if name == "Graph":
        from .api import Graph

        return Graph
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
