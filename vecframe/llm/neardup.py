"""Groups of near-duplicate records: a set-similarity join over word shingles.

The shingles of a record are dealt to parts by a hash, ``4 ** c`` of them, where the class ``c`` goes by the size of the
larger set of a pair. Two sets of similarity ``t`` have a part in which they are at least as similar (a ratio of sums
is at most the largest of the ratios). So records are compared part by part: shingles are ordered rarest first, by their
document frequency over the whole table, and two parts of similarity ``t`` share one in their prefixes of
``n - ceil(t n) + 1``. Only prefix shingles that occur in two records or more are joined, and of these only rows that
another row of the key can go with: what is left of both parts from the key on, when the key is the first shingle they
share, must suffice for the overlap they need, and one of the records must be of the class. A round before tells that
from three small numbers a row, so bitmaps and ids are shuffled for few of the shingles shared by chance. A pair passes the
length filter and the bitmap filter (a bitmap of the part, wide for its few shingles, bounds how many can be common),
both before it leaves the task that found it. The few pairs left are verified once each, on the whole sets.

How it is spread: records are dealt to blocks by a hash of their id. A block hands out its distinct shingles by
range of hash, a range counts them over all blocks and hands the frequencies back, in the block's order, so
no table of shingles is ever joined or broadcast. Equal texts are represented by one. A shingle in more than ``GROUP``
records is no key by itself: parts whose common shingles are all that frequent share two in prefixes longer by one,
and every two of them are a key together (by one alone only parts of two shingles or fewer can be similar). All pairs of a
key in up to ``GROUP`` records are tested. Those of a key in more are
first tested against the key's first record only; in a second pass, pairs are tested only between records that no
chain of links joins yet, so a large family of copies costs one test a record and still no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm._common import Stage, hinted
from vecframe.llm.cluster import boruvka
from vecframe.llm.knn import exact_cosines
from vecframe.llm.shingles import mix, shingle_sets
from vecframe.llm.vectors import angles, block, fit_cells, fresh, salt, unit, usable

WIDTH, THRESHOLD, COSINE = 3, 0.5, 0.98
#: Least and most records of a block, and shingles of a range: blocks times ranges would else grow with the square of the rows.
BLOCK_ROWS, RANGE_SHINGLES = (4096, 16384), (1 << 18, 1 << 21)
#: Sets below this size have one part; from there on four times as many whenever the size has grown by four.
WHOLE = 64
#: Bits of a part's shingle bitmap.
BITMAP = 128
#: Records whose keys are shuffled at once.
TURN_ROWS = 5_000_000
#: Document frequency up to which all pairs of a shingle's records are tested.
GROUP = 256
_LOW = np.uint64((1 << 32) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _need(size: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of a set of ``size`` with another at similarity ``t``."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def _sets(texts: list[str], width: int, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per text as hashes of ``32 + range_bits`` bits, ascending within a text."""
    return shingle_sets(texts, width, 32 + range_bits)


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, size: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, size * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype=dtype)


def _planes(x: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane."""
    x = np.ascontiguousarray(x)
    return _zip(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T))


def _numbers(blob: bytes, size: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(_unzip(blob, size * width, np.uint8).reshape(width, size).T).view(dtype).ravel()


def _deal_texts(n_blocks: int):
    """Records packed by block: ids, lengths and texts, compressed, so that texts are shuffled small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            block_of = (salt(ids, 1) % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(block_of, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(block_of[order]) != 0])
            blocks, counts, parts, sizes = [], [], [], []
            for a, b in zip(start, np.r_[start[1:], len(order)], strict=True):
                who = order[a:b]
                raw = [texts[i].encode("utf-8", "surrogatepass") for i in who]
                body = ids[who].astype(np.int64).tobytes() + np.array([len(r) for r in raw], dtype=np.int64).tobytes() + b"".join(raw)
                blocks.append(int(block_of[who[0]]))
                counts.append(len(who))
                sizes.append(len(body))
                parts.append(pa.Codec("zstd", compression_level=6).compress(body, asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(counts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], names=["block", "n", "size", "blob"])

    return run


def _once(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's records, each id once, in the order of ids."""
    ids, texts = [], []
    for n, size, blob in zip(pdf.n, pdf["size"], pdf.blob, strict=True):
        body = pa.decompress(blob, int(size), codec="zstd", asbytes=True)
        ids.append(np.frombuffer(body, dtype=np.int64, count=n))
        at = 16 * n
        for length in np.frombuffer(body, dtype=np.int64, count=n, offset=8 * n).tolist():
            texts.append(body[at : at + length].decode("utf-8", "surrogatepass"))
            at += length
    out = pd.DataFrame({"id": np.concatenate(ids) if ids else np.zeros(0, np.int64), "text": texts})
    return out.sort_values(["id", "text"]).drop_duplicates("id", keep="last").reset_index(drop=True)


def _bitmaps(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    bit = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(BITMAP)))
    out = np.zeros((n, BITMAP // 8), dtype=np.uint8)
    np.bitwise_or.at(out, (doc, (bit >> np.uint64(3)).astype(np.int64)), np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8)))
    return out


def _candidates(rec: np.ndarray, size: np.ndarray, place: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Which pairs (positions a, b of one shingle's group) pass the length, positional and suffix filters."""
    sa, sb = size[a].astype(np.int64), size[b].astype(np.int64)
    need = np.ceil(t / (1 + t) * (sa + sb) - 1e-9)
    ok = np.minimum(sa, sb) >= t * np.maximum(sa, sb) - 1e-9
    ok &= 1 + np.minimum(sa - place[a] - 1, sb - place[b] - 1) + np.minimum(place[a], place[b]) >= need
    keep = np.flatnonzero(ok)
    words = np.ascontiguousarray(bits).view(np.uint64)
    x, y = words[a[keep]], words[b[keep]]
    only_a = np.bitwise_count(x & ~y).sum(axis=1).astype(np.int64)
    only_b = np.bitwise_count(y & ~x).sum(axis=1).astype(np.int64)
    fits = np.minimum(sa[keep] - only_a, sb[keep] - only_b) >= need[keep]
    ok[keep[~fits]] = False
    return ok & (rec[a] != rec[b])


def _group_pairs(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All position pairs within runs of rows (start, size)."""
    later = np.repeat(sizes, sizes) - 1 - (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    own = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a = np.repeat(own, later)
    step = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
    return a, a + 1 + step


#: Key (24 bits of it in its range: what meets by chance is ruled out by the bitmap), record, size of its part, bitmap of the part.
_PACKED = np.dtype([("low", "<u4"), ("id", "<i8"), ("own", "<u4"), ("bits", "u1", (BITMAP // 8,))])
#: Key, size of the part, how many shingles it has in common at most with a part if the key is the first, whether the record is of the key's class.
_ASKED = np.dtype([("low", "<u4"), ("own", "<u4"), ("room", "<u4"), ("top", "u1")])
_KEYED = np.dtype([*_PACKED.descr, *_ASKED.descr[2:]])


def _ranges(h: np.ndarray) -> list[tuple[int, int, int]]:
    """Range, start and end of every run of ascending hashes that lie in one range."""
    r = (h >> np.uint64(32)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    return list(zip(r[start].tolist(), start.tolist(), np.r_[start[1:], len(r)].tolist(), strict=False))


def _spread(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every hash the value of it, of values in the order of the distinct hashes (sorting is quicker here than ``np.unique``)."""
    order = np.argsort(h)
    new = np.r_[True, h[order[1:]] != h[order[:-1]]][: len(h)]
    out = np.empty(len(h), dtype=values.dtype)
    out[order] = values[np.cumsum(new) - 1]
    return out


def _class(size: np.ndarray) -> np.ndarray:
    """Class of a set's size: sets of class ``c`` have ``4 ** c`` parts."""
    return np.ceil(np.log2((np.maximum(size, 1) + 0.5) / WHOLE) / 2).clip(0).astype(np.int64)


def _pack_rows(rows: np.ndarray, kind: np.dtype = _PACKED) -> bytes:
    """Compressed by column, of ascending keys the steps; the bytes of numbers lie apart, so their leading zeros cost nothing."""
    columns = []
    for c in kind.names:
        x = np.diff(rows[c], prepend=np.uint32(0)).astype("<u4") if c == "low" else np.ascontiguousarray(rows[c])
        x = x.view(np.uint8).reshape(len(rows), -1)
        columns.append((x if c == "bits" else x.T).tobytes())
    return _zip(np.frombuffer(b"".join(columns), dtype=np.uint8))


def _unpack_rows(blob: bytes, n: int, kind: np.dtype = _PACKED) -> np.ndarray:
    raw, at = _unzip(blob, n * kind.itemsize, np.uint8), 0
    rows = np.zeros(n, dtype=kind)
    for c in kind.names:
        w = kind[c].itemsize
        x = raw[at : at + n * w]
        rows[c] = x.reshape(n, w) if c == "bits" else np.ascontiguousarray(x.reshape(w, n).T).view(kind[c]).ravel()
        at += n * w
    rows["low"] = np.cumsum(rows["low"], dtype=np.uint32)
    return rows


def _keys(h: np.ndarray, doc: np.ndarray, f: np.ndarray, size: np.ndarray, t: float, group: int, bits: int, drawn: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``bits`` bits under which records are compared, ascending, and their rows (``id``: the record's place).

    ``h``, ``doc``, ``f``: shingles by record, ascending within one, and their document frequencies; ``size`` of every record.
    ``drawn``: with bitmaps.
    """
    least, most = _class(size), _class(np.floor(size / t + 1e-9))
    out_key, out = [np.zeros(0, np.uint64)], [np.zeros(0, _KEYED)]
    for c in range(int(most.max(initial=-1)) + 1):
        mine = ((least <= c) & (c <= most))[doc]
        sh, sd, sf = h[mine], doc[mine], f[mine]
        if not len(sh):
            continue
        parts = 4**c
        part = sd * parts + (mix(sh) % np.uint64(parts)).astype(np.int64)
        # Rarest first; equally rare shingles in the order of their hash.
        order = np.argsort((part << 32) | sf, kind="stable")
        sh, sd, sf, part = sh[order], sd[order], sf[order], part[order]
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[start, len(part)])
        which = np.repeat(np.arange(len(start)), sizes)
        own, place = sizes[which], np.arange(len(sh)) - start[which]
        need = _need(own, t)
        maps = _bitmaps(sh, which, len(start)) if drawn else None
        frequent = sf > group
        first = place < own - need + 1
        single = first & ((sf > 1) & ~frequent)
        tiny = np.flatnonzero(first & frequent & (own * t <= 1 + 1e-9))
        single = np.flatnonzero(single)
        # Of parts all of whose common shingles are frequent, the two rarest of these lie here.
        twice = np.flatnonzero(frequent & (place < own - np.maximum(need, 2) + 2))
        run = np.flatnonzero(np.r_[True, which[twice][1:] != which[twice][:-1]]) if len(twice) else np.zeros(0, np.int64)
        x, y = _group_pairs(run, np.diff(np.r_[run, len(twice)]).astype(np.int64))
        x, y = twice[x], twice[y]
        salted, room = np.uint64(3 * c), own - place
        # Before the second of two shingles there is the first.
        for at, key, left in ((single, sh[single] if not c else mix(sh[single] + salted * _ODD), room[single]), (tiny, mix(sh[tiny] + (salted + np.uint64(1)) * _ODD), room[tiny]), (x, mix(mix(sh[x] + (salted + np.uint64(2)) * _ODD) + sh[y]), room[y] + 1)):
            rows = np.zeros(len(at), dtype=_KEYED)
            rows["id"], rows["own"], rows["room"], rows["top"] = sd[at], own[at], left, least[sd[at]] == c
            if drawn:
                rows["bits"] = maps[which[at]]
            out.append(rows)
            out_key.append(key & np.uint64((1 << bits) - 1))
    key, rows = np.concatenate(out_key), np.concatenate(out)
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    rows["low"] = ((key & _LOW) >> np.uint64(8)).astype(np.uint32)
    return key, rows


def _wanted(rows: np.ndarray, t: float) -> np.ndarray:
    """Which rows (``_ASKED``) have another of their key that they can be similar to, by sizes, room and class; no pairs are formed.

    Rows ``a`` and ``b`` can be similar if the room of both is at least ``t / (1 + t)`` times their sizes' sum: if the
    size of ``b`` is at most the reach of ``a``, and the other way round. So the largest reach of the rows up to a size tells.
    """
    if not len(rows):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((rows["own"], rows["low"]))
    low, own, top = rows["low"][order], rows["own"][order].astype(np.int64), rows["top"][order].astype(bool)
    reach = np.clip(np.floor(rows["room"][order] * ((1 + t) / t) + 1e-6).astype(np.int64) - own, 0, (1 << 31) - 1)
    # Rising from key to key, so that no maximum reaches into the next one.
    base = np.cumsum(np.r_[False, low[1:] != low[:-1]]).astype(np.int64) << 31

    def largest(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and second largest reach of the rows ``who`` whose size is within reach, for every row."""
        most = np.maximum.accumulate(np.r_[-1, (base + reach)[who]])
        second = np.maximum.accumulate(np.r_[-1, np.minimum((base + reach)[who], most[:-1])])
        at = np.searchsorted((base + own)[who], base + reach, side="right")
        return most[at], second[at]

    most, second = largest(np.arange(len(rows)))
    # A row within its own reach is one of those that reach it.
    fits = np.where(reach >= own, second, most) >= base + own
    fits &= top | (largest(np.flatnonzero(top))[0] >= base + own)
    out = np.zeros(len(rows), dtype=bool)
    out[order] = fits
    return out


def _group_rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed rows ordered by shingle, size and id; start and size of every shingle's group."""
    rows = np.concatenate([_unpack_rows(b, n) for b, n in zip(pdf.blob, pdf.n, strict=True)]) if len(pdf) else np.zeros(0, _PACKED)
    rows = rows[np.lexsort((rows["id"], rows["own"], rows["low"]))]
    low = rows["low"]
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
    return rows, first, np.diff(np.r_[first, len(low)]).astype(np.int64)


def _once_each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, the smaller id first, each once."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[first], b[first]


_FOUND = "bucket int, range int, n int, a binary, b binary, blob binary"


def _pack_pairs(got: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> list[tuple]:
    """Pairs packed by a hash of their first record, compressed: rows of ``_FOUND``."""
    a, b = _once_each(*(np.concatenate([np.zeros(0, np.int64), *[g[i] for g in got]]) for i in range(2)))
    bucket = (salt(a, 2) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, a, b = bucket[order], a[order], b[order]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return [(int(bucket[i]), 0, int(j - i), _planes(a[i:j]), _planes(b[i:j]), b"") for i, j in zip(start, np.r_[start[1:], len(bucket)].astype(np.int64), strict=False)]


def _found_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["bucket", "range", "n", "a", "b", "blob"])
    return frame.astype({"bucket": np.int32, "range": np.int32, "n": np.int32})


def _distinct(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket's pairs, from all ranges, each once."""
    a, b = _once_each(*(np.concatenate([_numbers(x, n, np.int64) for x, n in zip(pdf[c], pdf.n, strict=True)]) for c in ("a", "b")))
    return pd.DataFrame({"a": a, "b": b})


def _passing(rows: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs of rows (positions of one key's group) whose parts pass the filters; places are not sent along."""
    used, at = np.unique(np.concatenate((a, b)), return_inverse=True) if len(a) < len(rows) else (np.arange(len(rows)), np.concatenate((a, b)))
    mine = rows[used]
    ok = _candidates(mine["id"], mine["own"], np.zeros(len(mine), np.int64), mine["bits"], at[: len(a)], at[len(a) :], t)
    return rows["id"][a[ok]], rows["id"][b[ok]]


def _first_pairs(pdf: pd.DataFrame, t: float, group: int, buckets: int) -> pd.DataFrame:
    """Candidates of one range: all pairs of rare keys, of frequent ones those with the first record; these keys' rows are handed on."""
    rows, first, sizes = _group_rows(pdf)
    got = []
    small = (sizes > 1) & (sizes <= group)
    # So many pairs at once that they fit in memory.
    first_, sizes_ = first[small], sizes[small]
    turn = np.cumsum(sizes_ * (sizes_ - 1) // 2) >> 20
    edge = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]) if len(turn) else np.zeros(0, np.int64)
    for i, j in zip(edge, np.r_[edge[1:], len(turn)].astype(np.int64), strict=False):
        got.append(_passing(rows, *_group_pairs(first_[i:j], sizes_[i:j]), t))
    many = []
    for g in np.flatnonzero(sizes > group):
        b = np.arange(first[g] + 1, first[g] + sizes[g])
        got.append(_passing(rows, np.full(len(b), first[g]), b, t))
        many.append((-1, int(pdf.range.iloc[0]), int(sizes[g]), b"", b"", _pack_rows(rows[first[g] : first[g] + sizes[g]])))
    return _found_frame(_pack_pairs(got, buckets) + many)


def _cross_pairs(groups: pd.DataFrame, labels: pd.DataFrame, t: float, buckets: int) -> pd.DataFrame:
    """Candidates of the frequent keys of one range between records of different components."""
    known = pd.Series(labels.label.to_numpy(), index=labels.id.to_numpy())
    got = []
    for blob, n in zip(groups.blob, groups.n, strict=True):
        own = _unpack_rows(blob, n)
        rec = own["id"]
        found = known.reindex(rec).to_numpy(dtype=np.float64, na_value=np.nan)
        label = np.where(np.isnan(found), rec, known.reindex(rec).fillna(-1).to_numpy(dtype=np.int64)) if len(known) else rec
        values, counts = np.unique(label, return_counts=True)
        main = values[counts.argmax()]
        others = np.flatnonzero(label != main)
        # All others of another component, so many at once that they fit in memory; of two outside the main one, each pair once.
        step = max(1, (1 << 19) // len(own))
        for i in range(0, len(others), step):
            x, y = np.repeat(others[i : i + step], len(own)), np.tile(np.arange(len(own)), len(others[i : i + step]))
            ask = (label[y] != label[x]) & ((label[y] == main) | (y > x))
            got.append(_passing(own, x[ask], y[ask], t))
    return _found_frame(_pack_pairs(got, buckets))


def _answers(pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """To the rows of one range, block by block: which of them are wanted."""
    rows = np.concatenate([_unpack_rows(b, n, _ASKED) for b, n in zip(pdf.blob, pdf.n, strict=True)])
    edge = np.r_[0, np.cumsum(pdf.n.to_numpy())]
    wanted = _wanted(rows, t)
    return pdf[["block", "range", "n"]].assign(wanted=[_zip(np.packbits(wanted[i:j])) for i, j in zip(edge[:-1], edge[1:], strict=True)])


def content_links(df: DataFrame, n_rows: int, width: int, t: float, group: int = GROUP, turn_rows: int = TURN_ROWS) -> list[Stage]:
    """Links ``(a, b, sim)`` between ids whose texts have similarity ``t`` or more, up to chains of such links.

    ``df``: ``id bigint, text string``, no text twice, each of ``width`` words or more. Beyond ``turn_rows`` records the
    keys' whole rows are shuffled in turns, so that only a share of them is on disk at once.
    """
    turns = max(1, -(-n_rows // turn_rows))
    n_blocks = max(1, -(-n_rows // min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], n_rows // 48))))
    per_range = min(RANGE_SHINGLES[1], max(RANGE_SHINGLES[0], n_rows * 96 // 48))
    range_bits = max(4, math.ceil(math.log2(max(1, n_rows * 96 / per_range))))
    blocks = df.select("id", "text").mapInArrow(_deal_texts(n_blocks), "block int, n int, size bigint, blob binary")

    def hand_out(pdf: pd.DataFrame) -> pd.DataFrame:
        h, _ = _sets(_once(pdf).text.tolist(), width, range_bits)
        h = np.sort(h)
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(h)])
        h = h[start]
        rows = []
        for r, i, j in _ranges(h):
            rows.append((int(pdf.block.iloc[0]), r, j - i, _planes(np.diff(h[i:j] & _LOW, prepend=np.uint64(0)).astype(np.uint32)), _planes(count[i:j].astype(np.uint32))))
        return pd.DataFrame(rows, columns=["block", "range", "n", "low", "count"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.cumsum(_numbers(b, n, np.uint32), dtype=np.uint32) for b, n in zip(pdf.low, pdf.n, strict=True)])
        c = np.concatenate([_numbers(b, n, np.uint32) for b, n in zip(pdf["count"], pdf.n, strict=True)])
        distinct, inverse = np.unique(low, return_inverse=True)
        total = np.bincount(inverse, weights=c, minlength=len(distinct))[inverse].astype(np.uint32)
        edge = np.r_[0, np.cumsum(pdf.n.to_numpy())]
        return pd.DataFrame({"block": pdf.block.to_numpy(), "range": pdf.range.to_numpy(), "n": pdf.n.to_numpy(), "df": [_planes(total[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]})

    def keyed(left: pd.DataFrame, counts: pd.DataFrame, drawn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of a block's records, their rows, and the records' ids."""
        recs = _once(left)
        h, doc = _sets(recs.text.tolist(), width, range_bits)
        counts = counts.sort_values("range")
        freq = np.concatenate([_numbers(b, m, np.uint32) for b, m in zip(counts["df"], counts.n, strict=True)])
        f = _spread(h, freq).astype(np.int64)
        return *_keys(h, doc, f, np.bincount(doc, minlength=len(recs)), t, group, 32 + range_bits, drawn), recs.id.to_numpy()

    def ask(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A block's rows by range of their key, without what tells records apart."""
        if not len(left) or not len(right):
            return pd.DataFrame({"block": np.zeros(0, np.int32), "range": np.zeros(0, np.int32), "n": np.zeros(0, np.int32), "blob": []})
        keys, rows, _ = keyed(left, right, False)
        found = _ranges(keys)
        return pd.DataFrame({"block": np.full(len(found), left.block.iloc[0], np.int32), "range": np.array([r for r, _, _ in found], np.int32), "n": np.array([j - i for _, i, j in found], np.int32), "blob": [_pack_rows(rows[i:j], _ASKED) for _, i, j in found]})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        return _answers(pdf, t)

    def prefixes(turn: int):
        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """A block's rows by range of their key, packed: of the turn's keys, those that are wanted."""
            told = right.wanted.notna()
            if not len(left) or not told.any():
                return pd.DataFrame({"range": np.zeros(0, np.int32), "n": np.zeros(0, np.int32), "blob": []})
            keys, rows, ids = keyed(left, right[~told], True)
            told = right[told].sort_values("range")
            mine = np.concatenate([np.unpackbits(_unzip(b, -(-n // 8), np.uint8), count=n) for b, n in zip(told.wanted, told.n, strict=True)]).astype(bool)
            if turns > 1:
                mine &= mix(keys) % np.uint64(turns) == turn
            keys, rows = keys[mine], rows[mine]
            rows["id"] = ids[rows["id"]]
            found = _ranges(keys)
            return pd.DataFrame({"range": np.array([r for r, _, _ in found], np.int32), "n": np.array([j - i for _, i, j in found], np.int32), "blob": [_pack_rows(rows[i:j]) for _, i, j in found]})

        return run

    def first_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        return _first_pairs(pdf, t, 4 * group, n_blocks)

    handed = blocks.groupBy("block").applyInPandas(hand_out, "block int, range int, n int, low binary, count binary")
    # Each is written, so that what has been shuffled for it is gone before the next.
    counted = Stage(handed.groupBy("range").applyInPandas(count, "block int, range int, n int, df binary"))
    asked = blocks.groupBy("block").cogroup(counted.df.groupBy("block")).applyInPandas(ask, "block int, range int, n int, blob binary")
    answered = Stage(asked.groupBy("range").applyInPandas(answer, "block int, range int, n int, wanted binary"))
    told = counted.df.unionByName(answered.df, allowMissingColumns=True)
    firsts = []
    for turn in range(turns):
        packed = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(prefixes(turn), "range int, n int, blob binary")
        firsts.append(Stage(packed.groupBy("range").applyInPandas(first_pairs, _FOUND)))
    counted.drop()
    answered.drop()
    first = firsts[0].df
    for f in firsts[1:]:
        first = first.unionByName(f.df)

    def verified(pairs: DataFrame) -> Stage:
        found = Stage(pairs.groupBy("bucket").applyInPandas(_distinct, "a bigint, b bigint"))
        likely = _screened(df, found.df, width, t)
        found.drop()
        out = _verified(df, likely.df, width, t)
        likely.drop()
        return out

    links = [verified(first.where("bucket >= 0").select("bucket", "n", "a", "b"))]
    many = first.where("bucket = -1").select("range", "n", "blob")
    if many.limit(1).count():
        forest, cuts = boruvka(links[0].df, (0.0,))
        labels = cuts[0].df if cuts else df.sparkSession.createDataFrame([], "id bigint, label bigint")
        # The records of a range, with what they are linked to so far.
        who = many.mapInPandas(_record_ranges, "range int, id bigint").distinct().join(labels, "id").select("range", "id", "label")

        def cross(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _cross_pairs(left, right, t, n_blocks)

        more = Stage(many.groupBy("range").cogroup(who.groupBy("range")).applyInPandas(cross, _FOUND))
        links.append(verified(more.df.select("bucket", "n", "a", "b")))
        more.drop()
        for s in (*forest, *cuts):
            s.drop()
    for f in firsts:
        f.drop()
    return links


def _record_ranges(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for r, n, blob in zip(pdf.range, pdf.n, pdf.blob, strict=True):
            ids = np.unique(_unpack_rows(blob, n)["id"])
            yield pd.DataFrame({"range": np.full(len(ids), r, np.int32), "id": ids})


def _sketch(h: np.ndarray) -> bytes:
    """A bitmap of a set, of 64 bytes and more for large sets; every four bits of a larger one are a bit of the next smaller."""
    bits = 9 + 2 * int(np.searchsorted((171, 683, 2731), len(h), side="right"))
    out = np.zeros(1 << bits, dtype=np.uint8)
    out[(mix(h) >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) in ``width`` bytes."""
    if bits.shape[1] == width:
        return bits
    return np.packbits(np.unpackbits(bits, axis=1).reshape(len(bits), width * 8, -1).any(axis=2), axis=1)


def _screened(df: DataFrame, pairs: DataFrame, width: int, t: float) -> Stage:
    """Candidate pairs without those that small bitmaps of the whole sets rule out, so that few whole sets are shuffled."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, doc = shingle_sets(batch.column(1).to_pylist(), width)
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edge).astype(np.int32)), pa.array([_sketch(h[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["id", "n", "bits"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            x, y = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            lx, ly = np.array([len(i) for i in x], np.int64), np.array([len(i) for i in y], np.int64)
            common = np.zeros(batch.num_rows, dtype=np.int64)
            for kind in np.unique(lx << 32 | ly):
                at = np.flatnonzero((lx << 32 | ly) == kind)
                small = min(int(lx[at[0]]), int(ly[at[0]]))
                p, q = (_fold(np.frombuffer(b"".join(z[i] for i in at), np.uint8).reshape(len(at), -1), small) for z in (x, y))
                only_p, only_q = (np.bitwise_count(u & ~v).sum(axis=1).astype(np.int64) for u, v in ((p, q), (q, p)))
                common[at] = np.minimum(na[at] - only_p, nb[at] - only_q)
            keep = pa.array(np.flatnonzero(common >= np.ceil(t / (1 + t) * (na + nb) - 1e-9)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    ends = Stage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    drawn = Stage(df.join(hinted(ends), "id", "left_semi").mapInArrow(draw, "id bigint, n int, bits binary").dropDuplicates(["id"]))
    ends.drop()
    left, right = (drawn.df.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits_{k}")) for k in ("a", "b"))
    out = Stage(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "bits_a", "nb", "bits_b").mapInArrow(screen, "a bigint, b bigint"))
    drawn.drop()
    return out


def _verified(df: DataFrame, pairs: DataFrame, width: int, t: float) -> Stage:
    """Of candidate pairs those whose whole sets are similar enough; each pair is looked at once."""

    def pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            h, doc = shingle_sets(texts, width)
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["id", "set"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = np.full(batch.num_rows, -1.0, dtype=np.float32)
            for i, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                both = np.sort(np.concatenate((p, q)))
                common = int((both[1:] == both[:-1]).sum())
                total = len(p) + len(q) - common
                if total and common >= t * total - 1e-9:
                    sim[i] = common / total
            keep = pa.array(np.flatnonzero(sim >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sim).take(keep)], names=["a", "b", "sim"])

    ends = Stage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    sets = Stage(df.join(hinted(ends), "id", "left_semi").mapInArrow(pack_sets, "id bigint, set binary").dropDuplicates(["id"]))
    ends.drop()
    left, right = sets.df.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.df.select(F.col("id").alias("b"), F.col("set").alias("y"))
    out = Stage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint, sim float"))
    sets.drop()
    return out


def embedding_links(df: DataFrame, dim: int, cosine: float, part_rows: int = 8192) -> Stage:
    """Links ``(a, b, sim)`` between blank rows and rows whose vectors have that cosine, up to chains of them.

    ``df``: ``id bigint, v array<float>, asks boolean``. A row lies in the cell of its nearest centre; a blank row is
    compared in all cells whose centre is at most twice the angle of ``cosine`` farther from it than its nearest: by
    the triangle inequality no other cell can hold a row near enough.
    """
    spark = df.sparkSession
    cells = fit_cells(df, "id", "v", dim, per_cell=part_rows)
    # Cells that hold more than a part's rows, going by the sample, are spread over parts by a hash.
    parts = np.maximum(1, np.ceil(cells.shares * cells.rows / part_rows)).astype(np.int64)
    shared = spark.sparkContext.broadcast((cells.centres, parts))
    slack = 2 * math.acos(cosine) + 1e-3

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                x, good = block(rows.column(1), dim)
                keep = np.flatnonzero(good)
                if not len(keep):
                    continue
                x, ids = x[keep], rows.column(0).to_numpy(zero_copy_only=False)[keep]
                asks = rows.column(2).to_numpy(zero_copy_only=False)[keep].astype(bool)
                centres, parts_of = shared.value
                a = angles(unit(x) @ centres.T)
                near = a.argmin(axis=1)
                own = (salt(ids, 0) % parts_of[near].astype(np.uint64)).astype(np.int64)
                # The members of a cell go to one part each, its queries to all of its parts.
                q, c = np.nonzero((a <= a.min(axis=1, keepdims=True) + slack) & asks[:, None])
                times = parts_of[c]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q, c = np.repeat(q, times), np.repeat(c, times)
                who, cell, part = np.r_[np.arange(len(x)), q], np.r_[near, c], np.r_[own, part]
                asking = np.r_[np.zeros(len(x), bool), np.ones(len(q), bool)]
                order = np.lexsort((part, cell))
                who, cell, part, asking = who[order], cell[order], part[order], asking[order]
                start = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(part) != 0)])
                ends = np.r_[start[1:], len(who)]
                columns = [[_planes(ids[who[i:j]].astype(np.int64)) for i, j in zip(start, ends, strict=True)], [_zip(asking[i:j].astype(np.uint8)) for i, j in zip(start, ends, strict=True)], [_planes(x[who[i:j]].ravel()) for i, j in zip(start, ends, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(cell[start].astype(np.int32)), pa.array(part[start].astype(np.int32)), pa.array((ends - start).astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]], names=["cell", "part", "n", "ids", "asking", "x"])

    dealt = df.where(usable("v", dim)).mapInArrow(deal, "cell int, part int, n int, ids binary, asking binary, x binary")

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = np.concatenate([_unzip(b, n, np.uint8) for b, n in zip(pdf.asking, pdf.n, strict=True)]).astype(bool)
        out_a, out_b = [], []
        if ask.any() and not ask.all():
            ids = np.concatenate([_numbers(b, n, np.int64) for b, n in zip(pdf.ids, pdf.n, strict=True)])
            raw = np.concatenate([_numbers(b, n * dim, np.float32).reshape(n, dim) for b, n in zip(pdf.x, pdf.n, strict=True)])
            q_ids, m_ids, q_raw, m_raw = ids[ask], ids[~ask], raw[ask], raw[~ask]
            qs, ms = unit(q_raw), unit(m_raw)
            firsts = np.full(len(m_ids), -1, dtype=np.int64)
            for at in range(0, len(qs), 512):
                s = qs[at : at + 512] @ ms.T
                i, j = np.nonzero(s >= cosine - 1e-5)
                sure = s[i, j] >= cosine + 1e-5
                sure[~sure] = exact_cosines(q_raw[at + i[~sure]], m_raw[j[~sure]]) >= cosine
                i, j = i[sure], j[sure]
                new, where = np.unique(j, return_index=True)
                free = firsts[new] < 0
                firsts[new[free]] = at + i[where[free]]
                # A member is linked to its first query, and its other queries to that one.
                e = np.unique(np.stack((at + i, firsts[j]), axis=1), axis=0)
                out_a.append(q_ids[e[:, 0]])
                out_b.append(q_ids[e[:, 1]])
            hit = np.flatnonzero(firsts >= 0)
            out_a.append(q_ids[firsts[hit]])
            out_b.append(m_ids[hit])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        keep = a != b
        return pd.DataFrame({"a": a[keep], "b": b[keep], "sim": np.ones(int(keep.sum()), np.float32)})

    return Stage(dealt.groupBy("cell", "part").applyInPandas(look, "a bigint, b bigint, sim float"))


def near_duplicates(
    df: DataFrame,
    key: str = "id",
    text: str = "content",
    vector: str | None = "embedding",
    dim: int = 128,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    cosine: float = COSINE,
    version: str | None = "ingested_at",
    group: int = GROUP,
) -> DataFrame:
    """``(id, group_id)`` of the records in groups of two or more; ``group_id`` is the group's smallest id.

    Two records are linked if neither text is blank (null or white space only) and their sets of ``width`` word
    shingles have a Jaccard similarity of ``threshold`` or more, or if one is blank and both vectors are usable
    (``dim`` finite components, not all zero) with a cosine of ``cosine`` or more. Groups are what links join directly
    or through others. Of rows of one id the last by ``version`` counts; rows without an id are left out; texts of
    fewer than ``width`` words have no shingles and are like no text. Extra columns are not read.
    """
    spark = df.sparkSession
    keep = [F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *([F.col(version).alias("ver")] if version else [])]
    columns = df.select(*keep, *([F.col(vector).cast("array<float>").alias("v")] if vector else []))
    rows = fresh(columns, "id", "ver" if version else None)
    words = r"[\p{L}\p{N}]+"
    has_set = F.col("text").rlike(rf"[^\p{{L}}\p{{N}}]+".join([words] * width))
    # Equal texts are represented by one of them; the hash of a text stands for it in narrow rows.
    narrow = rows.where(has_set).select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text", F.length("text")).alias("h2"))
    first = narrow.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("h1", "h2", "rep")
    copies = Stage(narrow.join(hinted(Stage(first)), ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct().withColumn("sim", F.lit(1.0).cast("float")))
    single = rows.where(has_set).select("id", "text").join(hinted(copies).select(F.col("b").alias("id")), "id", "left_anti")
    n_rows = df.count()
    stages = [copies, *content_links(single, n_rows, width, threshold, group)]
    if vector:
        blank = F.col("text").isNull() | ~F.col("text").rlike(r"(?U)\S")
        stages.append(embedding_links(rows.select("id", "v", blank.alias("asks")), dim, cosine))
    links = stages[0].df
    for s in stages[1:]:
        links = links.unionByName(s.df)
    forest, cuts = boruvka(links, (0.0,))
    for s in (*stages, *forest):
        s.drop()
    if not cuts:
        return spark.createDataFrame([], "id bigint, group_id bigint")
    return cuts[0].df.select("id", F.col("label").alias("group_id"))
