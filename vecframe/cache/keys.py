"""Cache keys: a canonical text of everything that decides a result, and digests of it."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Sequence
from typing import Any

PREFIX = "vf"


def canonical(value: Any) -> str:
    """The same text for equal values, whatever the order of sets and dicts."""
    if value is None:
        return "~"
    if isinstance(value, bool):
        return "T" if value else "F"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: (str(type(k)), str(k)))) + "}"
    if isinstance(value, set | frozenset):
        return "{" + ",".join(sorted(canonical(v) for v in value)) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return repr(value)


def digest(*parts: Any) -> str:
    return hashlib.sha1("|".join(canonical(p) for p in parts).encode()).hexdigest()[:24]


def fingerprint(vector: Any) -> str:
    """Digest of a vector, a batch of vectors or a sparse vector at float32 precision."""
    h = hashlib.blake2b(digest_size=16)
    if isinstance(vector, dict):
        h.update(canonical({int(k): float(v) for k, v in vector.items()}).encode())
        return h.hexdigest()
    batch = vector if len(vector) and not isinstance(vector[0], int | float) and hasattr(vector[0], "__len__") else [vector]
    for i, v in enumerate(batch):
        h.update(b"\0" if i else b"")
        h.update(struct.pack(f"<{len(v)}f", *[float(x) for x in v]))
    return h.hexdigest()


def context(filter_text: str = "", fields: Iterable[str] | None = None, limit: int | None = None, offset: int = 0, partitions: Iterable[str] = (), consistency: str | None = None, extra: Any = None) -> tuple:
    return (filter_text, tuple(sorted(fields)) if fields is not None else None, limit, offset, tuple(sorted(partitions)), consistency, extra)


def query_key(alias: str, collection: str, version: int, op: str, *parts: Any) -> str:
    """``op``: q read, c count, s search, h hybrid search."""
    return f"{PREFIX}:{alias}:{collection}:v{version}:{op}:{digest(*parts)}"


def search_key(alias: str, collection: str, version: int, vector: Any, field: str, metric: str, ctx: tuple) -> str:
    return query_key(alias, collection, version, "s", fingerprint(vector), field, metric, ctx)


def bucket_id(alias: str, collection: str, version: int, field: str, metric: str, ctx: tuple) -> str:
    """Searches that differ in their vector only, the limit included, share a bucket."""
    return query_key(alias, collection, version, "b", field, metric, ctx)


def prefix(alias: str, collection: str) -> str:
    return f"{PREFIX}:{alias}:{collection}:"


def version_key(alias: str, collection: str) -> str:
    return f"{PREFIX}:version:{alias}:{collection}"


def vector_batch(vector: Sequence) -> bool:
    return bool(len(vector)) and hasattr(vector[0], "__len__")
