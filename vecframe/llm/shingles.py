"""Vectorised word and shingle hashing over a batch of texts (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

# Odd 64-bit multipliers; any fixed odd values do.
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_M3 = np.uint64(0x165667B19E3779F9)

_ALNUM: np.ndarray | None = None
_POWERS: np.ndarray | None = None


def alnum_table() -> np.ndarray:
    """Boolean per code point: is it a letter or a digit (``str.isalnum``)."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _ALNUM


def _powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of an odd constant modulo 2**64."""
    global _POWERS
    if _POWERS is None or len(_POWERS) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        base = np.full(size, 0x100000001B3, dtype=np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(29))
    h = h * _M2
    h = h ^ (h >> np.uint64(32))
    h = h * _M3
    return h ^ (h >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, each text followed by a NUL, and the offset of every text."""
    joined = "\0".join(texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return cps, offsets


def word_spans(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of letters and digits."""
    inside = alnum_table()[cps]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def word_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span: a polynomial over its code points, independent of its place."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    within = np.arange(total, dtype=np.int64) - np.repeat(first, sizes)
    source = within + np.repeat(starts, sizes)
    terms = (cps[source].astype(np.uint64) + _M1) * _powers(int(sizes.max()))[within]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _M1)


def shingle_sets(texts: list[str], width: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text.

    Returns ``(hashes, doc)``: shingle hashes of ``bits`` bits, ascending within a document, and the index of the
    document each belongs to, ascending. Words are lower-cased runs of letters and digits; a text of
    fewer than ``width`` words has no shingle.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cps, offsets = code_points([t.lower() for t in texts])
    starts, ends = word_spans(cps)
    words = word_hashes(cps, starts, ends)
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = len(words) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        h = mix(h * _M1 + words[i : i + n] + np.uint64(i + 1))
    same = doc[:n] == doc[width - 1 :]
    h, doc = h[same], doc[:n][same]
    h = h >> np.uint64(64 - bits)
    if bits + int(len(texts)).bit_length() <= 64:
        both = np.sort((doc.astype(np.uint64) << np.uint64(bits)) | h)
        keep = np.ones(len(both), dtype=bool)
        keep[1:] = both[1:] != both[:-1]
        both = both[keep]
        return both & np.uint64((1 << bits) - 1), (both >> np.uint64(bits)).astype(np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]
