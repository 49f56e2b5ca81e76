"""Policies, sketch, keys, settings, semantic lookup, tiers, statistics, control, and the cache as a whole."""

from __future__ import annotations

import random
import threading
import time
from collections import OrderedDict

import numpy as np
import pytest

from vecframe.cache import keys as K
from vecframe.cache.config import merged, options, parse_size, settings
from vecframe.cache.control import Events, LoadMemory, MemoryGovernor, SingleFlight, Versions
from vecframe.cache.policies import Policy, WTinyLfu, policy, policy_names, register_policy, replay
from vecframe.cache.registry import ResultCache, configure, get_cache
from vecframe.cache.semantic import SemanticIndex, VectorTable, rerank
from vecframe.cache.sketch import FrequencySketch
from vecframe.cache.stats import CacheStats, RingWindow
from vecframe.cache.tiers import MISSING, Breaker, Entry, FolderTier, LocalTier, NullTier, TieredTier, decode, encode, estimate_size
from vecframe.cache.window import WindowController
from vecframe.errors import CacheBackendError, CacheConfigurationError

NAMES = policy_names()


@pytest.mark.parametrize("name", NAMES)
class TestPolicyContract:
    def test_victims_are_held_and_empty_at_last(self, name):
        p = policy(name, 8, seed=1)
        for i in range(8):
            p.on_admit(i)
        p.on_hit(3)
        gone = set()
        while (v := p.select_victim()) is not None:
            assert v in set(p.keys()) and v not in gone
            p.on_remove(v)
            gone.add(v)
        assert gone == set(range(8)) and not list(p.keys())

    def test_unknown_keys_do_no_harm(self, name):
        p = policy(name, 4)
        p.on_hit("x")
        p.on_remove("x")
        assert p.select_victim() is None
        p.age()
        p.set_capacity(2)
        p.clear()
        assert p.stats()["keys"] == 0

    def test_selecting_changes_nothing(self, name):
        p = policy(name, 4, seed=3)
        for i in range(4):
            p.on_admit(i)
        if name != "random":
            assert p.select_victim() == p.select_victim()
        assert set(p.keys()) == {0, 1, 2, 3}

    def test_capacity_holds_in_a_replay(self, name):
        rng = random.Random(1)
        trace = [rng.randrange(60) for _ in range(3000)]
        assert 0 < replay(name, 10, trace) < len(trace)
        assert replay(name, 60, trace) == len(trace) - len(set(trace))


def _lru(trace, capacity):
    held, hits = OrderedDict(), 0
    for k in trace:
        if k in held:
            hits += 1
            held.move_to_end(k)
        else:
            if len(held) >= capacity:
                held.popitem(last=False)
            held[k] = None
    return hits


def test_lru_is_lru():
    rng = random.Random(2)
    trace = [int(rng.paretovariate(0.8)) % 300 for _ in range(5000)]
    assert replay("lru", 40, trace) == _lru(trace, 40)


def test_zipf_ranking():
    rng = random.Random(7)
    trace = rng.choices(range(2000), [1 / (i + 1) ** 1.1 for i in range(2000)], k=20000)
    rate = {n: replay(n, 100, trace) for n in ("w-tinylfu", "lru", "fifo")}
    assert rate["w-tinylfu"] > rate["lru"] > rate["fifo"]


@pytest.mark.parametrize(("name", "survivors"), [("w-tinylfu", (15, 20)), ("2q", (15, 20)), ("lru", (0, 0))])
def test_scan_resistance(name, survivors):
    p, held = policy(name, 50), set()

    def access(k):
        if k in held:
            p.on_hit(k)
            return
        while len(held) >= 50:
            v = p.select_victim()
            p.on_remove(v)
            held.discard(v)
        p.on_admit(k)
        held.add(k)

    for _ in range(15):
        for k in range(20):
            access(f"hot{k}")
        for k in range(3):
            access(("filler", _, k))
    for k in range(3000):
        access(("scan", k))
    assert survivors[0] <= sum(f"hot{k}" in held for k in range(20)) <= survivors[1]


def test_registry_takes_policies():
    class Mine(Policy):
        def on_admit(self, key, deadline=None): ...
        def on_remove(self, key): ...
        def select_victim(self): ...
        def keys(self):
            return []

    register_policy("mine", Mine)
    assert isinstance(policy("mine", 3), Mine)
    with pytest.raises(CacheConfigurationError):
        policy("no such", 3)


def test_window_ratio_is_clamped():
    p = WTinyLfu(100)
    p.set_ratio(2)
    assert p.ratio == 0.8
    p.set_ratio(-1)
    assert p.ratio == 0


def test_ttl_order():
    p = policy("ttl", 4)
    p.on_admit("a", 30)
    p.on_admit("b", 10)
    p.on_admit("c")
    p.on_admit("b", 40)
    assert p.select_victim() == "a"


def test_sketch():
    s = FrequencySketch(100)
    s.add("a")
    assert s.estimate("a") == 1
    for _ in range(40):
        s.add("b")
    assert s.estimate("b") == 16 and s.estimate("never") <= 1
    s.age()
    assert s.estimate("b") == 7
    s.clear()
    assert s.estimate("b") == 0


def test_keys_tell_differences():
    base = dict(filter_text="a == 1", fields=["x", "y"], limit=10, offset=0, partitions=["p"], consistency="Strong")
    key = lambda **c: K.query_key("default", "docs", 1, "q", K.context(**{**base, **c}))
    assert key() == key(fields=["y", "x"])
    others = [key(filter_text="a == 2"), key(fields=["x"]), key(limit=11), key(offset=1), key(partitions=["q"]), key(consistency=None), K.query_key("default", "docs", 2, "q", K.context(**base))]
    assert len({key(), *others}) == len(others) + 1
    assert K.fingerprint([1.0, 2.0]) == K.fingerprint([1, 2]) != K.fingerprint([2.0, 1.0])
    assert K.fingerprint([[1.0], [2.0]]) != K.fingerprint([1.0, 2.0])
    assert K.fingerprint({2: 0.5, 1: 1.0}) == K.fingerprint({1: 1.0, 2: 0.5})
    assert K.canonical({"b": {2, 1}, "a": [None, True]}) == K.canonical({"a": [None, True], "b": {1, 2}})


def test_settings():
    assert parse_size("256MB") == 256 << 20 and parse_size("1.5k") == 1536 and parse_size(7) == 7
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    for bad in ({"L1": {"LOW_WATERMARK": 0.99}}, {"L1": {"POLICY": "x"}}, {"L1": {"MAX_BYTES": 0, "MAX_ENTRIES": 0}}, {"SEMANTIC": {"THRESHOLD": 2}}, {"SEMANTIC": {"OVERFETCH": 0}}, {"TTL_JITTER": 1}, {"L1": {"MAX_BYTES": "big"}}):
        with pytest.raises(CacheConfigurationError):
            settings(bad)
    s = settings()
    assert options(s) is None and options(s, True)["ttl"] == 300 and options(s, {"ttl": 5}, {"ttl": 7, "enabled": True})["ttl"] == 7
    assert options(s, True, {"enabled": False}) is None and options(settings({"ENABLED": False}), True) is None


def _at_cosine(base, cosine, rng):
    other = rng.standard_normal(len(base))
    other -= other @ base * base
    other /= np.linalg.norm(other)
    return cosine * base + np.sqrt(1 - cosine**2) * other


def test_semantic_index():
    rng = np.random.default_rng(17)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    index = SemanticIndex(64, capacity=2)
    assert index.add("a", base) and not index.add("zero", np.zeros(64)) and not index.add("short", [1.0])
    assert index.nearest(_at_cosine(base, 0.98, rng), 0.97)[0] == "a"
    assert index.nearest(_at_cosine(base, 0.96, rng), 0.97) is None
    index.add("b", -base)
    index.nearest(base, 0.9)
    index.add("c", rng.standard_normal(64))
    assert index.nearest(-base, 0.9) is None and index.nearest(base, 0.9)[0] == "a"
    l2 = SemanticIndex(2, "L2")
    l2.add("x", [3.0, 4.0])
    assert l2.nearest([3.0, 4.1], 0.02)[0] == "x" and l2.nearest([0.0, 0.0], 0.02) is None


def test_rerank():
    rng = np.random.default_rng(3)
    q = rng.standard_normal(16)
    q /= np.linalg.norm(q)
    t = VectorTable(16, 10)
    for i, c in ((1, 0.2), (2, 0.6), (3, 0.95)):
        t.put(i, _at_cosine(q, c, rng))
    rows = [{"id": 1, "score": 0.9}, {"id": 2, "score": 0.8}, {"id": 3, "score": 0.7}]
    assert [r["id"] for r in rerank(rows, q, t, "id", 3)] == [3, 2, 1]
    assert rerank(rows, q, VectorTable(16, 4), "id", 2) == rows[:2]
    raw = VectorTable(4, 4)
    raw.put(1, [9, 9, 0, 0])
    raw.put(2, [1, 0.01, 0, 0])
    assert rerank([{"id": 1, "score": 0}, {"id": 2, "score": 0}], [1, 0, 0, 0], raw, "id", 2, "L2")[0]["id"] == 2


def _tiers(tmp_path):
    return {"local": LocalTier(4 << 20, 500, 2), "folder": FolderTier(str(tmp_path / "f")), "tiered": TieredTier(LocalTier(4 << 20, 500, 2), FolderTier(str(tmp_path / "t")))}


@pytest.mark.parametrize("name", ["local", "folder", "tiered"])
def test_tier_conformance(name, tmp_path):
    t = _tiers(tmp_path)[name]
    assert t.get("a:1") is MISSING
    assert t.set("a:1", None) and t.get("a:1") is None
    assert t.set_many({"a:2": [1, 2], "b:1": {"x": 1}}) == 2
    assert t.get_many(["a:2", "b:1", "zz"]) == {"a:2": [1, 2], "b:1": {"x": 1}}
    t.set("short", 1, ttl=0.02)
    time.sleep(0.04)
    assert t.get("short") is MISSING and t.purge() >= 1
    assert t.touch("a:2", 100) and not t.touch("zz", 1)
    assert t.delete_prefix("a:") == 2 and t.get("a:1") is MISSING and t.get("b:1") == {"x": 1}
    assert t.delete("b:1") and not t.delete("b:1")
    t.set("c", 1)
    t.clear()
    assert t.get("c") is MISSING and t.keys() == []


def test_local_bounds():
    gone = []
    t = LocalTier(10_000, 100, 1, "lru", max_entry=5_000, on_evict=gone.append)
    assert not t.set_entry("big", Entry(0, 6_000))
    for i in range(12):
        t.set_entry(f"k{i}", Entry(0, 1_000))
    assert t.bytes_used <= 9_500 and gone and "k11" in t.keys()
    few = LocalTier(1 << 20, 3, 1, "fifo")
    for i in range(5):
        few.set(f"k{i}", i)
    assert few.keys() == ["k2", "k3", "k4"]
    assert NullTier().set("a", 1) is False


def test_promotion_keeps_deadline(tmp_path):
    low = FolderTier(str(tmp_path))
    t = TieredTier(LocalTier(1 << 20, 10, 1), low)
    low.set_entry("k", Entry("v", 1, 1.0, 5e9))
    assert t.get("k") == "v" and t.first.get_entry("k").expires == 5e9 and t.found_in["l2"] == 1


def test_breaker():
    now = [0.0]
    b = Breaker(2, 30, lambda: now[0])

    def fail():
        raise OSError

    assert b.call(fail, "no") == "no" and b.state == "closed"
    b.call(fail)
    assert b.state == "open" and b.call(lambda: "yes", "no") == "no"
    now[0] = 31
    assert b.state == "half-open" and b.call(lambda: "yes") == "yes" and b.state == "closed"


def test_codecs():
    for s in ("pickle", "json"):
        for c in ("none", "zlib", "zstd"):
            assert decode(encode(["a" * 5000, 1], s, c), s) == ["a" * 5000, 1]
    assert encode(1)[:1] == b"\0" and encode("a" * 9000)[:1] == b"\1"
    with pytest.raises(CacheBackendError):
        decode(b"\x09abc")
    assert estimate_size([0.0] * 768) == 24632 and estimate_size([1] * 10) == 416
    shared = "x" * 1000
    assert estimate_size([shared, shared]) < 3000


def test_statistics():
    now = [1000.0]
    ring = RingWindow(3, lambda: now[0])
    ring.record(True)
    now[0] += 1
    ring.record(False)
    assert ring.totals() == (2, 1)
    now[0] += 2
    assert ring.totals() == (1, 0)
    s = CacheStats(60, lambda: now[0])
    for ms, hit in ((0.04, True), (0.9, True), (2000, False)):
        s.lookup(hit, "l1", ms)
    assert s.percentile(0.5) == 1.0 and s.percentile(0.99) == float("inf") and s.hit_rate() == pytest.approx(2 / 3)
    assert "vecframe_cache_hits_total 2" in s.prometheus()


def test_window_controller():
    w = WindowController(0.1, 0.04)
    assert w.tick(10, 5) == 0.1
    assert w.tick(100, 50) == pytest.approx(0.14)
    assert w.tick(200, 110) == pytest.approx(0.18)
    assert w.tick(300, 150) == pytest.approx(0.16)
    assert w.tick(400, 190) == pytest.approx(0.16)


def test_single_flight():
    flight, calls, out = SingleFlight(2), [], []

    def produce():
        calls.append(1)
        time.sleep(0.1)
        return 42

    ts = [threading.Thread(target=lambda: out.append(flight.do("k", produce))) for _ in range(5)]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert out == [42] * 5 and len(calls) == 1
    with pytest.raises(ValueError):
        flight.do("e", lambda: (_ for _ in ()).throw(ValueError()))


def test_versions(tmp_path):
    folder = FolderTier(str(tmp_path))
    a, b = Versions(0, folder), Versions(0, folder)
    assert a.get("c") == 0 and a.bump("c") == 1 and b.get("c") == 1 and b.bump("c") == 2 and a.get("c") == 2
    a.observe("c", 1)
    assert a.get("c") == 2


def test_governor_and_memory():
    t = LocalTier(1000, 100, 1)
    g = MemoryGovernor(t, 100, lambda: 200)
    for _ in range(5):
        g.tick()
    assert t.max_bytes == 250
    g.rss = lambda: 10
    g.tick()
    assert t.max_bytes == 375
    m = LoadMemory(10, lambda: 0.0)
    m.mark("c")
    assert m.known("c")
    m.forget("c")
    assert not m.known("c")


def test_events_swallow_errors():
    e, got = Events(), []
    e.connect("hit", lambda **k: 1 / 0)
    e.connect("hit", lambda **k: got.append(k))
    e.send("hit", key=1)
    assert got == [{"key": 1}]


class _Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def test_read_through_and_expiry():
    clock = _Clock()
    c, calls = ResultCache({"TTL_JITTER": 0}, clock=clock), []
    produce = lambda: calls.append(1) or [{"id": len(calls)}]
    assert not c.read("docs", "q", ["f"], produce).hit
    assert c.read("docs", "q", ["f"], produce).tier == "l1" and len(calls) == 1
    clock.now += 301
    assert c.read("docs", "q", ["f"], produce).tier == "stale"
    clock.now += 100
    assert not c.read("docs", "q", ["f"], produce).hit and len(calls) == 2
    c.invalidate("docs")
    assert not c.read("docs", "q", ["f"], produce).hit
    assert not c.read("docs", "q", ["f"], produce, refresh=True).hit
    assert c.ttl([]) == 30 and c.ttl([[]]) == 30 and c.ttl(0) == 30 and c.ttl([1]) == 300 and c.ttl([], 7) == 7


def test_semantic_search_through_the_cache():
    rng = np.random.default_rng(5)
    c, asked = ResultCache({"SEMANTIC": {"ENABLED": True, "THRESHOLD": 0.95}}), []
    q = rng.standard_normal(8)
    q /= np.linalg.norm(q)

    def produce(n):
        asked.append(n)
        return [{"id": i, "score": 1 - i / 10, "v": _at_cosine(q, 1 - i / 10, rng).tolist()} for i in range(n)]

    first = c.search("docs", q.tolist(), "v", "COSINE", (), 2, produce)
    assert not first.hit and asked == [6] and [r["id"] for r in first.value] == [0, 1] and "v" not in first.value[0]
    assert c.search("docs", q.tolist(), "v", "COSINE", (), 2, produce).tier == "l1"
    near = c.search("docs", _at_cosine(q, 0.97, rng).tolist(), "v", "COSINE", (), 2, produce)
    assert near.tier == "semantic" and near.similarity == pytest.approx(0.97, abs=1e-3) and len(asked) == 1
    assert not c.search("docs", _at_cosine(q, 0.5, rng).tolist(), "v", "COSINE", (), 2, produce).hit
    assert not c.search("docs", q.tolist(), "v", "COSINE", ("other",), 2, produce).hit
    c.invalidate("docs")
    assert not c.search("docs", _at_cosine(q, 0.97, rng).tolist(), "v", "COSINE", (), 2, produce).hit


def test_named_caches():
    assert configure("x", {"ENABLED": False}) is None and get_cache("x") is None
    assert configure("x") is get_cache("x")
    done, failed = get_cache("x").warm([lambda: 1, lambda: 1 / 0])
    assert done == 1 and isinstance(failed[0], ZeroDivisionError)


def test_overwriting_keeps_a_key_in_its_place():
    t = LocalTier(max_bytes=1 << 20, max_entries=2, shards=1, policy_name="fifo")
    for k in ("a", "b", "a", "c"):
        t.set_entry(k, Entry(k, 10, 0.0, None, 0.0))
    assert sorted(t.keys()) == ["b", "c"] and t.bytes_used == 20
    arc = LocalTier(max_bytes=1 << 20, max_entries=2, shards=1, policy_name="arc")
    for _ in range(3):
        arc.set_entry("a", Entry("a", 10, 0.0, None, 0.0))
    assert arc.keys() == ["a"] and arc.bytes_used == 10 and arc.evictions == 0


def test_the_janitor_ticks_and_stops():
    c = ResultCache({"JANITOR": {"INTERVAL": 0.01}})
    until = time.monotonic() + 5
    while c.janitor.ticks < 2 and time.monotonic() < until:
        time.sleep(0.01)
    assert c.janitor.ticks >= 2
    c.close()
    assert ResultCache({"JANITOR": {"ENABLED": False}}).janitor is None


def test_memory_in_use_falls_again():
    from vecframe.cache.control import resident_bytes

    before = resident_bytes()
    block = bytearray(256 << 20)
    held = resident_bytes()
    del block
    assert held - before > 200 << 20 and resident_bytes() < held - (200 << 20)
