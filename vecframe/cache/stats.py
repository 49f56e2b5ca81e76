"""Statistics of a live cache: sliding hit rate, counters by tier, latency histogram and percentiles."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from vecframe.operators.analytics import LATENCY_BOUNDS, prometheus


class RingWindow:
    """Hits and lookups by second over the last ``seconds``."""

    def __init__(self, seconds: int = 300, clock: Callable[[], float] = time.time) -> None:
        self.seconds, self.clock = max(1, seconds), clock
        self.stamp = [0] * self.seconds
        self.lookups = [0] * self.seconds
        self.hits = [0] * self.seconds

    def record(self, hit: bool) -> None:
        now = int(self.clock())
        i = now % self.seconds
        if self.stamp[i] != now:
            self.stamp[i], self.lookups[i], self.hits[i] = now, 0, 0
        self.lookups[i] += 1
        self.hits[i] += hit

    def totals(self) -> tuple[int, int]:
        now = int(self.clock())
        live = [i for i in range(self.seconds) if now - self.stamp[i] < self.seconds]
        return sum(self.lookups[i] for i in live), sum(self.hits[i] for i in live)

    def hit_rate(self) -> float:
        n, h = self.totals()
        return h / n if n else 0.0


class CacheStats:
    def __init__(self, window: int = 300, clock: Callable[[], float] = time.time) -> None:
        self.window = RingWindow(window, clock)
        self.counters: Counter = Counter()
        self.histogram = [0] * (len(LATENCY_BOUNDS) + 1)
        self.lock = threading.Lock()

    def lookup(self, hit: bool, tier: str, milliseconds: float) -> None:
        """``tier``: l1, l2, semantic, stale or miss."""
        with self.lock:
            self.window.record(hit)
            self.counters["lookups"] += 1
            self.counters["hits" if hit else "misses"] += 1
            if hit:
                self.counters[f"{tier}_hits"] += 1
            self.histogram[bisect_left(LATENCY_BOUNDS, milliseconds)] += 1

    def count(self, what: str, n: int = 1) -> None:
        with self.lock:
            self.counters[what] += n

    def hit_rate(self) -> float:
        return self.counters["hits"] / self.counters["lookups"] if self.counters["lookups"] else 0.0

    def percentile(self, fraction: float) -> float:
        """Upper bound of the bucket at which the running count reaches the fraction; overflow is infinite."""
        total, run = sum(self.histogram), 0
        if not total:
            return 0.0
        for n, bound in zip(self.histogram, (*LATENCY_BOUNDS, float("inf")), strict=True):
            run += n
            if run >= total * fraction:
                return bound
        return float("inf")

    def report(self) -> dict[str, float]:
        return dict(self.counters) | {"hit_rate": self.hit_rate(), "window_hit_rate": self.window.hit_rate(), **{f"p{int(100 * f)}": self.percentile(f) for f in (0.5, 0.95, 0.99)}}

    def prometheus(self, gauges: dict[str, float] | None = None) -> str:
        return prometheus({k: float(v) for k, v in self.counters.items()}, {"hit_rate": self.hit_rate(), "window_hit_rate": self.window.hit_rate()} | (gauges or {}))
