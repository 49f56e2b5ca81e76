"""The cache as a whole: read-through lookups, nearest-query hits, invalidation, warm-up, and named caches."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from vecframe.cache import keys as K
from vecframe.cache.config import semantic_options, settings
from vecframe.cache.control import Events, Janitor, LoadMemory, MemoryGovernor, SingleFlight, Versions
from vecframe.cache.semantic import SemanticIndex, VectorTable, rerank
from vecframe.cache.stats import CacheStats
from vecframe.cache.tiers import Breaker, Entry, FolderTier, LocalTier, Tier, TieredTier, estimate_size


@dataclass
class CacheResult:
    """A value and where it came from: ``tier`` is l1, l2, stale, semantic or miss."""

    value: Any
    hit: bool
    tier: str
    similarity: float | None = None
    key: str = ""
    elapsed: float = 0.0


class ResultCache:
    """Answers of queries by key, and of searches by the nearest cached query as well. Whatever fails in the cache, the
    query is answered by its producer."""

    def __init__(self, config: dict[str, Any] | None = None, alias: str = "default", clock: Callable[[], float] = time.time) -> None:
        self.config, self.alias, self.clock = settings(config), alias, clock
        c = self.config
        self.events, self.stats = Events(), CacheStats(c["STATS"]["WINDOW"], clock)
        l1 = c["L1"]
        self.local = LocalTier(l1["MAX_BYTES"], l1["MAX_ENTRIES"], l1["SHARDS"], l1["POLICY"], l1["HIGH_WATERMARK"], l1["LOW_WATERMARK"], c["MAX_ENTRY_BYTES"], lambda k: self.events.send("evicted", key=k))
        self.folder = FolderTier(c["L2"]["PATH"], c["L2"]["SERIALIZER"], c["L2"]["COMPRESSOR"], c["L2"]["MIN_BYTES"]) if c["L2"]["PATH"] else None
        breaker = Breaker(c["L2"]["FAILURES"], c["L2"]["COOL_DOWN"])
        self.tier: Tier = TieredTier(self.local, self.folder, breaker) if self.folder else self.local
        self.flights = SingleFlight(c["STAMPEDE"]["TIMEOUT"], self.folder if c["STAMPEDE"]["ENABLED"] else None)
        self.versions = Versions(c["VERSIONING"]["REFRESH"], self.folder, breaker)
        self.loads = LoadMemory()
        self.buckets: dict[str, SemanticIndex] = {}
        self.vectors: dict[tuple[str, str], VectorTable] = {}
        self.governor = MemoryGovernor(self.local, c["JANITOR"]["MEMORY_LIMIT"] or None)
        self.janitor = Janitor(self.governor.tick, c["JANITOR"]["INTERVAL"]) if c["JANITOR"]["ENABLED"] else None

    def close(self) -> None:
        """Stop the housekeeping."""
        if self.janitor is not None:
            self.janitor.stop()

    # --- plain reads

    def ttl(self, value: Any, asked: float | None = None) -> float:
        """Asked for, else the one for empty answers, else the default; spread by the jitter, a millisecond at least."""
        base = asked if asked is not None else self.config["NEGATIVE_TTL"] if _empty(value) else self.config["TTL"]
        spread = self.config["TTL_JITTER"]
        return max(0.001, base * (1 + random.uniform(-spread, spread)))

    def lookup(self, key: str) -> tuple[Any, str] | None:
        """Value and tier; an expired entry still counts within the grace period."""
        try:
            before = dict(self.tier.found_in) if isinstance(self.tier, TieredTier) else None
            e = self.tier.get_entry(key)
        except Exception:  # noqa: BLE001
            return None
        if e is None:
            return None
        now = self.clock()
        where = "l2" if before is not None and self.tier.found_in["l2"] > before["l2"] else "l1"
        if e.fresh(now):
            return e.value, where
        if now < (e.expires or now) + self.config["STALE_WHILE_REVALIDATE"]:
            return e.value, "stale"
        self.tier.delete(key)
        return None

    def store(self, key: str, value: Any, ttl: float | None = None) -> None:
        now = self.clock()
        try:
            kept = self.tier.set_entry(key, Entry(value, estimate_size(value), now, now + self.ttl(value, ttl), now))
        except Exception:  # noqa: BLE001
            kept = False
        if kept:
            self.stats.count("sets")
            self.events.send("set", key=key)

    def read(self, collection: str, op: str, parts: Sequence[Any], produce: Callable[[], Any], ttl: float | None = None, refresh: bool = False) -> CacheResult:
        """Read-through of anything that the parts decide."""
        began = time.perf_counter()
        key = K.query_key(self.alias, collection, self.versions.get(collection), op, *parts)
        found = None if refresh else self.lookup(key)
        if found is not None:
            return self._answer(found[0], True, found[1], key, began)
        value = self.flights.do(key, lambda: self._produced(key, produce, ttl), lambda: (self.lookup(key) or (None,))[0])
        return self._answer(value, False, "miss", key, began)

    def _produced(self, key: str, produce: Callable[[], Any], ttl: float | None) -> Any:
        value = produce()
        self.store(key, value, ttl)
        return value

    def _answer(self, value: Any, hit: bool, tier: str, key: str, began: float, similarity: float | None = None) -> CacheResult:
        elapsed = time.perf_counter() - began
        self.stats.lookup(hit, tier, elapsed * 1000)
        self.events.send("hit" if hit else "miss", key=key, tier=tier)
        return CacheResult(value, hit, tier, similarity, key, elapsed)

    # --- searches

    def search(self, collection: str, vector: Any, field: str, metric: str, ctx: tuple, limit: int, produce: Callable[[int], list[dict[str, Any]]], key_column: str = "id", ttl: float | None = None, semantic: Any = None, refresh: bool = False, keep_vectors: bool = False) -> CacheResult:
        """Exact hit, else the answer of a near enough query reranked against this one, else produced.

        With reranking more is fetched than asked for. A vector column in the answer feeds the rerank and is stripped
        from what is stored unless ``keep_vectors``.
        """
        began = time.perf_counter()
        version = self.versions.get(collection)
        key = K.search_key(self.alias, collection, version, vector, field, metric, ctx)
        options = semantic_options(self.config["SEMANTIC"], semantic)
        single = not isinstance(vector, dict) and len(vector) > 0 and not K.vector_batch(vector)
        near = options["ENABLED"] and single
        found = None if refresh else self.lookup(key)
        if found is not None:
            return self._answer(_best(found[0], limit), True, found[1], key, began)
        bucket = K.bucket_id(self.alias, collection, version, field, metric, ctx)
        if near and not refresh and (hit := self._near(bucket, collection, field, vector, metric, options, limit, key_column)) is not None:
            return self._answer(hit[0], True, "semantic", key, began, hit[1])
        wide = max(limit, int(limit * options["OVERFETCH"])) if near and options["RERANK"] else limit

        def make() -> list[dict[str, Any]]:
            rows = produce(wide)
            return self._hoist(collection, field, rows, key_column, keep_vectors)

        value = self.flights.do(key, lambda: self._produced(key, make, ttl), lambda: (self.lookup(key) or (None,))[0])
        if near:
            index = self.buckets.setdefault(bucket, SemanticIndex(len(vector), metric, options["MAX_VECTORS"]))
            index.add(key, vector)
        return self._answer(_best(value, limit), False, "miss", key, began)

    def _near(self, bucket: str, collection: str, field: str, vector: Sequence[float], metric: str, options: dict[str, Any], limit: int, key_column: str) -> tuple[list[dict[str, Any]], float] | None:
        index = self.buckets.get(bucket)
        match = index.nearest(vector, options["THRESHOLD"]) if index is not None else None
        if match is None:
            return None
        found = self.lookup(str(match[0]))
        if found is None:
            index.remove(match[0])
            return None
        rows = found[0]
        table = self.vectors.get((collection, field))
        if options["RERANK"] and table is not None and rows:
            rows = rerank(rows, vector, table, key_column, limit, metric)
        return _best(rows, limit), match[1]

    def _hoist(self, collection: str, field: str, rows: list[dict[str, Any]], key_column: str, keep: bool) -> list[dict[str, Any]]:
        """Vectors of an answer to the vector table."""
        for r in rows:
            v = r.get(field)
            if v is not None and not isinstance(v, bytes | dict):
                self.vectors.setdefault((collection, field), VectorTable(len(v), self.config["SEMANTIC"]["MAX_VECTORS"])).put(r[key_column], v)
        return rows if keep else [{k: v for k, v in r.items() if k != field} for r in rows]

    # --- upkeep

    def invalidate(self, collection: str, version: int | None = None) -> int:
        """A new version makes all old keys unreachable; near queries and vectors of the collection go as well."""
        if version is None:
            version = self.versions.bump(collection)
        else:
            self.versions.observe(collection, version)
        mark = K.prefix(self.alias, collection)
        self.buckets = {k: v for k, v in self.buckets.items() if not k.startswith(mark)}
        self.vectors = {k: v for k, v in self.vectors.items() if k[0] != collection}
        self.events.send("invalidated", collection=collection, version=version)
        return version

    def clear(self, collection: str | None = None) -> None:
        if collection is None:
            self.tier.clear()
            self.buckets.clear()
            self.vectors.clear()
        else:
            self.invalidate(collection)
            self.tier.delete_prefix(K.prefix(self.alias, collection))

    def warm(self, jobs: Iterable[Callable[[], Any]]) -> tuple[int, list[Exception]]:
        """Run queries for their entries; how many went well, and what failed."""
        done, failed = 0, []
        for job in jobs:
            try:
                job()
                done += 1
            except Exception as e:  # noqa: BLE001 - collected for the caller
                failed.append(e)
        return done, failed

    def report(self) -> dict[str, Any]:
        return self.stats.report() | {f"l1_{k}": v for k, v in self.local.stats().items()} | {"semantic_vectors": sum(map(len, self.buckets.values()))}


def _best(rows: list[dict[str, Any]], limit: int) -> list[dict[str, Any]]:
    """The first ``limit`` rows, of a batch answer those of each query."""
    taken: dict[Any, int] = {}
    out = []
    for r in rows:
        q = r.get("query_id")
        taken[q] = taken.get(q, 0) + 1
        if taken[q] <= limit:
            out.append(r)
    return out


def _empty(value: Any) -> bool:
    """Nothing found: no rows, groups without rows, or a count of zero."""
    if value is None or value == 0:
        return True
    if isinstance(value, list | tuple):
        return all(isinstance(v, list | tuple) and not v for v in value)
    return False


_CACHES: dict[str, ResultCache] = {}


def configure(alias: str = "default", config: dict[str, Any] | None = None) -> ResultCache | None:
    """Make (or replace) a named cache; None if it is disabled."""
    cache = ResultCache(config, alias)
    if (old := _CACHES.pop(alias, None)) is not None:
        old.close()
    if not cache.config["ENABLED"]:
        cache.close()
        return None
    _CACHES[alias] = cache
    return cache


def get_cache(alias: str = "default") -> ResultCache | None:
    return _CACHES.get(alias)


def invalidate(collection: str, alias: str = "default") -> None:
    if (c := _CACHES.get(alias)) is not None:
        c.invalidate(collection)


def clear_all() -> None:
    for c in _CACHES.values():
        c.clear()


def cache_stats() -> dict[str, dict[str, Any]]:
    return {k: c.report() for k, c in _CACHES.items()}
