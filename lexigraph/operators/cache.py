"""Results kept for a while: persisted DataFrames by key and version, renewed after a time to live."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame

# Seconds that query results and fitted models are kept.
QUERY_SECONDS, MODEL_SECONDS = 60, 300


class ResultCache:
    """``version`` stands for the data behind a result (a store's table version, a refresh count): a new one renews it."""

    def __init__(self, seconds: float = QUERY_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock = seconds, clock
        self.held: dict[Hashable, tuple[float, Hashable, DataFrame]] = {}

    def get(self, key: Hashable, make: Callable[[], DataFrame], version: Hashable = None) -> DataFrame:
        self._expire()
        found = self.held.get(key)
        if found and found[1] == version:
            return found[2]
        self.drop(key)
        result = make().persist()
        self.held[key] = (self.clock(), version, result)
        return result

    def drop(self, key: Hashable) -> None:
        if found := self.held.pop(key, None):
            found[2].unpersist()

    def clear(self) -> None:
        for key in list(self.held):
            self.drop(key)

    def _expire(self) -> None:
        for key in [k for k, (made, _, _) in self.held.items() if self.clock() - made > self.seconds]:
            self.drop(key)
