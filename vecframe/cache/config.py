"""Settings of the cache: defaults, sizes in text, deep merge, validation."""

from __future__ import annotations

import copy
import re
from typing import Any

from vecframe.cache.policies import policy_names
from vecframe.errors import CacheConfigurationError

# Fixed values.
DEFAULTS: dict[str, Any] = {
    "ENABLED": True,
    "TTL": 300,
    "TTL_JITTER": 0.1,
    "NEGATIVE_TTL": 30,
    "STALE_WHILE_REVALIDATE": 60,
    "MAX_ENTRY_BYTES": 1 << 20,
    "STRONG_CONSISTENCY": False,
    "L1": {"MAX_BYTES": 256 << 20, "MAX_ENTRIES": 100_000, "SHARDS": 8, "POLICY": "w-tinylfu", "HIGH_WATERMARK": 0.95, "LOW_WATERMARK": 0.80},
    "L2": {"PATH": None, "SERIALIZER": "pickle", "COMPRESSOR": "zlib", "MIN_BYTES": 2048, "FAILURES": 5, "COOL_DOWN": 30},
    "SEMANTIC": {"ENABLED": False, "THRESHOLD": 0.97, "MAX_VECTORS": 20_000, "METRIC": "COSINE", "RERANK": True, "OVERFETCH": 3},
    "STAMPEDE": {"ENABLED": True, "TIMEOUT": 5},
    "VERSIONING": {"REFRESH": 5},
    "JANITOR": {"ENABLED": True, "INTERVAL": 30, "MEMORY_LIMIT": 0},
    "STATS": {"WINDOW": 300},
}
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def parse_size(value: int | str) -> int:
    """Bytes of ``"256MB"`` and the like; units are binary."""
    if isinstance(value, int) and not isinstance(value, bool):
        if value < 0:
            raise CacheConfigurationError(f"{value} is no size")
        return value
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", str(value))
    unit = m.group(2).lower().replace("ib", "b") if m else None
    if not m or unit not in _UNITS:
        raise CacheConfigurationError(f"{value!r} is no size")
    return int(float(m.group(1)) * _UNITS[unit])


def merged(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """``over`` laid over ``base``, dict by dict."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def settings(given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with what is given laid over them; raises if they contradict each other."""
    s = merged(DEFAULTS, given)
    problems = [f"no setting {k}" for k in s if k not in DEFAULTS]
    s["L1"]["MAX_BYTES"] = parse_size(s["L1"]["MAX_BYTES"])
    s["MAX_ENTRY_BYTES"] = parse_size(s["MAX_ENTRY_BYTES"])
    s["JANITOR"]["MEMORY_LIMIT"] = parse_size(s["JANITOR"]["MEMORY_LIMIT"])
    if not 0 < s["L1"]["LOW_WATERMARK"] < s["L1"]["HIGH_WATERMARK"] <= 1:
        problems.append("the low watermark lies below the high one, both in (0, 1]")
    if not s["L1"]["MAX_BYTES"] and not s["L1"]["MAX_ENTRIES"]:
        problems.append("the local tier needs a bound in bytes or entries")
    if s["L1"]["POLICY"] not in policy_names():
        problems.append(f"no policy {s['L1']['POLICY']!r}")
    if s["L1"]["SHARDS"] < 1:
        problems.append("a shard is needed at least")
    if s["SEMANTIC"]["METRIC"] not in ("COSINE", "IP", "L2"):
        problems.append(f"no semantic metric {s['SEMANTIC']['METRIC']!r}")
    elif s["SEMANTIC"]["METRIC"] != "L2" and not 0 <= s["SEMANTIC"]["THRESHOLD"] <= 1:
        problems.append("the similarity threshold lies in [0, 1]")
    if s["SEMANTIC"]["OVERFETCH"] < 1:
        problems.append("overfetch is 1 at least")
    if not 0 <= s["TTL_JITTER"] < 1:
        problems.append("the jitter lies in [0, 1)")
    if s["JANITOR"]["INTERVAL"] <= 0:
        problems.append("the janitor's interval is positive")
    if s["TTL"] is not None and s["TTL"] <= 0:
        problems.append("the ttl is positive")
    if problems:
        raise CacheConfigurationError("; ".join(problems))
    return s


def options(base: dict[str, Any], model: Any = None, query: dict[str, Any] | None = None) -> dict[str, Any] | None:
    """Options of one query: settings, the model's cache option over them, the query's over both; None: not cached."""
    query = dict(query or {})
    if model is False or query.get("enabled") is False or not base["ENABLED"]:
        return None
    if not model and not query.get("enabled"):
        return None
    out = {"ttl": base["TTL"], "semantic": base["SEMANTIC"], "refresh": False}
    if isinstance(model, dict):
        out |= model
    return out | {k: v for k, v in query.items() if k != "enabled"}


def semantic_options(base: dict[str, Any], override: Any) -> dict[str, Any]:
    """The semantic section under an override: True or False, a threshold, or a section."""
    if override is None:
        return base
    if isinstance(override, bool):
        return base | {"ENABLED": override}
    if isinstance(override, int | float):
        return base | {"ENABLED": True, "THRESHOLD": float(override)}
    return merged(base, {"ENABLED": True} | {k.upper(): v for k, v in override.items()})
