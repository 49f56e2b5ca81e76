"""Hill climbing of the admission window's share by the hit rate."""

from __future__ import annotations


class WindowController:
    """Each tick compares the hit rate since the last one: better goes on, worse turns round with half the step (a
    sixteenth of the first at least, then the first again), equal holds. The share stays in [0, 0.8]."""

    LEAST_LOOKUPS, MOST = 50, 0.8

    def __init__(self, ratio: float = 0.01, step: float = 0.05, tolerance: float = 1e-3) -> None:
        self.ratio, self.first_step, self.step, self.tolerance = ratio, step, step, tolerance
        self.direction = 1
        self.seen = (0, 0)
        self.last_rate: float | None = None

    def tick(self, lookups: int, hits: int) -> float:
        """Totals so far; returns the share to use from now on."""
        n, h = lookups - self.seen[0], hits - self.seen[1]
        if n < self.LEAST_LOOKUPS:
            return self.ratio
        self.seen = (lookups, hits)
        rate = h / n
        if self.last_rate is None:
            self._move()
        elif rate > self.last_rate + self.tolerance:
            self._move()
        elif rate < self.last_rate - self.tolerance:
            self.direction = -self.direction
            floor = self.first_step / 16
            self.step = self.first_step if self.step <= floor else max(floor, self.step / 2)
            self._move()
        self.last_rate = rate
        return self.ratio

    def _move(self) -> None:
        self.ratio = min(self.MOST, max(0.0, self.ratio + self.direction * self.step))
