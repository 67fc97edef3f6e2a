"""Results by version and question, with a time to live. What is held is computed: rows, or written tables."""

from __future__ import annotations

import sys
import time
from typing import Any


class ResultCache:
    """Keys are (version, kind, arguments); region arguments are sorted ids, so their order doesn't matter."""

    def __init__(self, ttl_s: float = 60.0, clock=time.monotonic) -> None:
        self.ttl_s, self.clock, self.hits, self.misses = ttl_s, clock, 0, 0
        self.held: dict[tuple, tuple[float, Any]] = {}

    def get(self, key: tuple) -> Any | None:
        found = self.held.get(key)
        if found and self.clock() - found[0] <= self.ttl_s:
            self.hits += 1
            return found[1]
        self.misses += 1
        if found:
            self._drop(key)
        return None

    def put(self, key: tuple, value: Any) -> Any:
        self.held[key] = (self.clock(), value)
        return value

    def _drop(self, key: tuple) -> None:
        value = self.held.pop(key)[1]
        if hasattr(value, "unpersist"):
            value.unpersist()

    def invalidate(self, version: int) -> None:
        for key in [k for k in self.held if k[0] == version]:
            self._drop(key)

    def evict(self) -> int:
        old = [k for k, (t, _) in self.held.items() if self.clock() - t > self.ttl_s]
        for key in old:
            self._drop(key)
        return len(old)

    def clear(self) -> None:
        for key in list(self.held):
            self._drop(key)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        size = sum(v.size() if hasattr(v, "size") else sys.getsizeof(v) for _, v in self.held.values())
        return {"entries": len(self.held), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0, "bytes": size}
