"""Results of searches that were asked before."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import SearchQuery, parse_params
from .index import Index, StoredIndex
from .search import Search


class ResultCache:
    """Keeps the top hits of each query for some seconds; pages are cut from them.

    An entry is the ranked top of one query (``SearchQuery.top`` rows at most), persisted on the executors, so a
    lost executor costs a recomputation. Queries that differ only in paging and display share an entry. The
    entry longest unused leaves when there are more than ``most``.
    """

    def __init__(self, index: Index | StoredIndex, lifetime: float = 600, most: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.index, self.lifetime, self.most, self.clock = index, lifetime, most, clock
        self.entries: dict[str, tuple[float, DataFrame]] = {}
        self.queries = self.hits = 0

    def run(self, q: SearchQuery | str) -> DataFrame:
        """The page of a query: id, score, sort_value. A query that asks for it (op=1) clears the cache first."""
        q = parse_params(q) if isinstance(q, str) else q
        if q.clear_cache:
            self.clear()
        return self.top(q).filter(F.col("place") > q.offset).filter(F.col("place") <= q.offset + q.count).drop("place")

    def response(self, q: SearchQuery | str) -> DataFrame:
        """id, json of the page's documents by the query's display columns."""
        q = parse_params(q) if isinstance(q, str) else q
        s = Search(self.index, q)
        s.hits = lambda: self.run(q)  # type: ignore[method-assign]
        return s.response()

    def top(self, q: SearchQuery) -> DataFrame:
        now, key = self.clock(), q.cache_key()
        self.queries += 1
        if (held := self.entries.pop(key, None)) and held[0] + self.lifetime > now:
            self.hits += 1
            self.entries[key] = held
            return held[1]
        if held:
            held[1].unpersist()
        ranked = Search(self.index, replace(q, offset=0, count=q.top)).hits()
        # One list of at most q.top narrow rows, numbered in its order.
        listed = ranked.agg(F.collect_list(F.struct("sort_value", "score", "id")).alias("all"))
        rows = F.array_sort("all", lambda a, b: _compare(a, b, q.descending))
        found = listed.select(F.posexplode(rows).alias("at", "r")).select("r.id", "r.score", "r.sort_value", (F.col("at") + 1).alias("place")).persist()
        self.entries[key] = (now, found)
        while len(self.entries) > self.most:
            self.entries.pop(next(iter(self.entries)))[1].unpersist()
        return found

    def clear(self) -> None:
        for _, df in self.entries.values():
            df.unpersist()
        self.entries.clear()

    def state(self) -> dict[str, float]:
        """Counts of queries and of those answered from the cache."""
        return {"queries": self.queries, "cache_hits": self.hits, "hits_scale": self.hits / self.queries if self.queries else 0.0}


def _compare(a, b, descending: bool):
    """Order of hits: sort value, score, then smaller ids."""
    out = F.lit(0)
    for name, down in (("id", False), ("score", descending), ("sort_value", descending)):
        less, more = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
        out = F.when(a[name] < b[name], less).when(a[name] > b[name], more).otherwise(out)
    return out
