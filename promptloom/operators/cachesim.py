"""A simulator of an encoder cache: token budget, reference counts, and eviction of the
entries that have been free for longest."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from promptloom.shipping import ship


@dataclass
class EncoderCache:
    """``capacity`` tokens in all; an entry is used by requests until they free it. Free
    entries stay until their room is needed."""

    capacity: int
    used: int = 0
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    held: dict = field(default_factory=dict)  # key -> (tokens, requests that use it)
    free_entries: OrderedDict = field(default_factory=OrderedDict)  # key -> tokens, oldest first

    def request(self, key, request, tokens: int, budget: int | None = None) -> str:
        """"hit" (cached; in use again if it was free), "miss" (put in, after evicting as much
        as it needs), or "rejected" (over the budget, or over what can be freed)."""
        if key in self.held:
            size, users = self.held[key]
            users.add(request)
            self.free_entries.pop(key, None)
            self.hits += 1
            return "hit"
        freeable = self.capacity - self.used + sum(self.free_entries.values())
        if (budget is not None and tokens > budget) or tokens > freeable:
            return "rejected"
        while self.capacity - self.used < tokens:
            old, size = self.free_entries.popitem(last=False)
            del self.held[old]
            self.used -= size
            self.evictions += 1
        self.held[key] = (tokens, {request})
        self.used += tokens
        self.misses += 1
        return "miss"

    def free(self, key, request) -> None:
        """A request needs the entry no longer; the last one makes it evictable."""
        if key in self.held:
            size, users = self.held[key]
            users.discard(request)
            if not users and key not in self.free_entries:
                self.free_entries[key] = size


def budgets(max_batch_tokens: int, longest_item: int, cache_tokens: int) -> tuple[int, int]:
    """(compute budget, cache size): both hold the longest item at least."""
    return max(max_batch_tokens, longest_item), max(cache_tokens, longest_item)


def simulate(df: DataFrame, stream: str, order: str, key: str, tokens: str, capacity: int, window: int = 1, budget: int | None = None) -> DataFrame:
    """Outcome of each request of each stream, one cache per stream: stream, order, outcome,
    used. A request is freed after ``window`` later ones. A stream is replayed in order
    in one task, as a cache server would see it; streams run in parallel."""
    ship(df.sparkSession)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        cache, recent, out = EncoderCache(capacity), [], []
        pdf = pdf.sort_values(order, kind="stable")
        for at, (k, t) in enumerate(zip(pdf[key], pdf[tokens], strict=True)):
            outcome = cache.request(k, at, int(t), budget)
            if outcome != "rejected":
                recent.append((k, at))
            if len(recent) > window:
                cache.free(*recent.pop(0))
            out.append((outcome, cache.used))
        return pd.DataFrame({stream: pdf[stream].to_numpy(), order: pdf[order].to_numpy(), "outcome": [o for o, _ in out], "used": [u for _, u in out]})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (stream, order)}
    return df.select(stream, order, key, tokens).groupBy(stream).applyInPandas(replay, f"`{stream}` {kinds[stream]}, `{order}` {kinds[order]}, outcome string, used long")
