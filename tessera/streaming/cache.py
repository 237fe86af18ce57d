"""A cache with a time to live and a capacity, as keyed state: which requests of a log it would answer.

A key's cache holds at most ``size`` entries, each for ``ttl`` seconds from when it was put in; reading one makes it the last to
be put out but doesn't prolong it. A miss puts the entry in, after what has expired is gone and, if still full, the entry that
was longest not used. Requests (key, seq, entry, at) come in order of seq; a null entry is an entry like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.streaming.fold import FoldedStream, Step, folded, folded_stream

TTL, SIZE = 600, 100
OUTCOME = "hit boolean, expired int, evicted string, held int"
START: dict = {"held": []}  # [entry, until] by last use


def cache_step(ttl: float, size: int) -> Step:
    def step(state: dict, e: dict) -> tuple:
        now, held = e["at"], state["held"]
        for k, (entry, until) in enumerate(held):
            if entry == e["entry"] and now < until:
                held.append(held.pop(k))
                return True, 0, None, len(held)
        fresh = [x for x in held if now < x[1]]
        expired = len(held) - len(fresh)
        out = fresh.pop(0)[0] if len(fresh) >= size else None
        state["held"] = [*fresh, [e["entry"], now + ttl]]
        return False, expired, out, len(state["held"])

    return step


def replayed(requests: DataFrame, key: str, ttl: float = TTL, size: int = SIZE) -> DataFrame:
    """(key, seq, hit, expired, evicted, held) of every request: whether the cache had it, how many entries had expired, which
    one was put out, and how many are held now."""
    return folded(requests, key, "seq", START, cache_step(ttl, size), OUTCOME)


def replayed_stream(requests: DataFrame, key: str, ttl: float = TTL, size: int = SIZE) -> FoldedStream:
    return folded_stream(requests, key, "seq", START, cache_step(ttl, size), OUTCOME)
