"""Providers of context: functions of a file that may give a result, run as a table function over requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

BUILT_IN = ("ast", "structure", "mistakes", "git", "notes")


@dataclass(frozen=True)
class Provider:
    """resolve(path, context) gives (content, confidence) or None; tier 1 runs at once, tier 2 may be cached."""

    name: str
    resolve: Callable[[str, dict], tuple[str, float] | None]
    budget: int = 200
    tier: int = 1
    label: str = ""


class Registry:
    def __init__(self) -> None:
        self.own: dict[str, Provider] = {}

    def add(self, provider: Provider, built_in: bool = False) -> None:
        """A name that is built in cannot be taken by another provider."""
        if not built_in and provider.name in BUILT_IN:
            raise ValueError(f"{provider.name} is a built-in provider's name")
        if provider.name in self.own:
            raise ValueError(f"there is a provider {provider.name} already")
        self.own[provider.name] = provider

    def budgets(self) -> dict[str, int]:
        return {p.name: p.budget for p in self.own.values()}

    def resolved(self, requests: DataFrame, enabled: tuple[str, ...] | None = None, tiers: tuple[int, ...] = (1, 2)) -> DataFrame:
        """(request, seq, provider, content, confidence) of requests(request, path, context): a row for each provider that
        gives a result; a provider that fails gives none.  Nothing is shuffled."""
        own = [p for p in self.own.values() if p.tier in tiers and (enabled is None or p.name in enabled)]

        def run(batches):
            for pdf in batches:
                rows = []
                for request, path, context in zip(pdf["request"], pdf["path"], pdf["context"]):
                    for i, p in enumerate(own):
                        try:
                            got = p.resolve(path, dict(context or ()))
                        except Exception:  # a provider's failure is its own
                            got = None
                        if got and got[0]:
                            rows.append((request, i, p.name, got[0], float(got[1])))
                yield pd.DataFrame(rows, columns=["request", "seq", "provider", "content", "confidence"])

        ship(requests.sparkSession)
        return requests.select("request", "path", "context").mapInPandas(run, "request long, seq long, provider string, content string, confidence double")


def cached(registry: Registry, requests: DataFrame, cache: DataFrame, as_of_ms: int, ttl: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(results, cache) of providers that are costly to ask: what cache(provider, path, content, confidence, cached_at ms,
    ttl s) holds and is still valid is taken from it, only the other requests are asked, and their results are kept."""
    names = requests.sparkSession.createDataFrame([(p, i) for i, p in enumerate(registry.own)], "provider string, seq long")
    asked = requests.select("request", "path", "context").crossJoin(F.broadcast(names))  # the registry's few names
    valid = cache.filter(F.col("cached_at") + F.col("ttl") * 1000 > as_of_ms)
    hit = asked.join(valid, ["provider", "path"]).select("request", "seq", "provider", "content", "confidence")
    miss = asked.join(valid, ["provider", "path"], "left_anti")
    fresh = [registry.resolved(miss.filter(F.col("provider") == p), enabled=(p,)).withColumn("seq", F.lit(i).cast("long")) for i, p in enumerate(registry.own)]
    new = reduce(DataFrame.unionByName, fresh)
    keep = new.join(requests.select("request", "path"), "request").select("provider", "path", "content", "confidence", F.lit(as_of_ms).alias("cached_at"), F.lit(ttl).cast("long").alias("ttl"))
    return hit.unionByName(new), valid.select(*keep.columns).unionByName(keep.dropDuplicates(["provider", "path"]))
