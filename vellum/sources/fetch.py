"""Fetching of payloads in partitions: spacing, retries with growing waits, and a breaker; the transport is injected.

There is no network code here. A transport is ``url -> (status, body)``; it runs in the executors.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

Transport = Callable[[str], tuple[int, str | None]]
RETRIED = frozenset((429, 500, 502, 503, 504))


@dataclass
class Fetcher:
    """One client: at least ``spacing`` seconds between requests, ``retries`` after 429, 5xx and errors with waits of
    ``2 ** attempt * 0.5`` seconds, and no more requests after ``breaker`` misses in a row."""

    transport: Transport
    spacing: float = 0.0
    retries: int = 3
    breaker: int = 5
    jitter: float = 0.1
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _last: float = field(default=float("-inf"), repr=False)
    _misses: int = field(default=0, repr=False)

    def get(self, url: str) -> tuple[int, str | None, int]:
        """Status, body and number of attempts; status 0 if nothing was sent or nothing came back."""
        if self._misses >= self.breaker:
            return 0, None, 0
        status, body, attempt = 0, None, 0
        for attempt in range(1, self.retries + 2):
            wait = self._last + self.spacing * (1 + random.random() * self.jitter) - self.clock()
            if wait > 0:
                self.sleep(wait)
            self._last = self.clock()
            try:
                status, body = self.transport(url)
            except Exception:  # a transport error is a miss like a bad status
                status, body = 0, None
            if status not in RETRIED and status != 0:
                break
            if attempt <= self.retries:
                self.sleep(2 ** (attempt - 1) * 0.5)
        self._misses = 0 if status == 200 else self._misses + 1
        return status, body if status == 200 else None, attempt


def fetch(requests: DataFrame, make: Callable[[], Fetcher], key: str = "key", url: str = "url", clients: int = 1) -> DataFrame:
    """key, status, body, attempts of each request. ``clients`` partitions each have a client of their own, so a provider's
    limit holds if its spacing is multiplied by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for b in batches:
            got = [client.get(u) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())], [key, "status", "body", "attempts"])

    kind = dict(requests.dtypes)[key]
    return requests.select(key, url).repartition(clients).mapInArrow(run, f"{key} {kind}, status int, body string, attempts int")
