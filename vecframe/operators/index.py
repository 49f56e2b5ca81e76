"""Index descriptors, and the indexes themselves: inverted files (flat, scalar- and product-quantised), hashing,
binary buckets, sparse postings.

Codebooks are fitted on a bounded sample (``FIT_ROWS``), every row is indexed. An inverted file is a table with a
``cluster`` column; written partitioned by it, a search reads only the ``nprobe`` nearest clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vecframe.errors import IndexError_
from vecframe.functions import metrics as M
from vecframe.operators import search as S

FIT_ROWS = 16_384
#: Share of an inverted file's lists that a search reads unless told otherwise: scattered vectors need so many for a
#: recall of 0.9 (README).
PROBE_SHARE = 0.6
#: Rows below which AUTOINDEX scans exactly.
AUTO_EXACT = 100_000

# The index types and the defaults of their parameters.
DEFAULTS: dict[str, dict[str, Any]] = {
    "FLAT": {},
    "IVF_FLAT": {"nlist": 128},
    "IVF_SQ8": {"nlist": 128},
    "IVF_PQ": {"nlist": 128, "m": 8, "nbits": 8},
    "HNSW": {"M": 16, "efConstruction": 256},
    "SCANN": {"nlist": 128},
    "DISKANN": {},
    "AUTOINDEX": {},
    "BIN_FLAT": {},
    "BIN_IVF_FLAT": {"nlist": 128},
    "SPARSE_INVERTED_INDEX": {"drop_ratio_build": 0.2},
    "SPARSE_WAND": {"drop_ratio_build": 0.2},
    "STL_SORT": {},
    "Trie": {},
    "INVERTED": {},
}
_BINARY = ("BIN_FLAT", "BIN_IVF_FLAT")
_SPARSE = ("SPARSE_INVERTED_INDEX", "SPARSE_WAND")
SCALAR = ("STL_SORT", "Trie", "INVERTED")


@dataclass(frozen=True)
class IndexSpec:
    """What an index is to be: field, type, metric and parameters."""

    field_name: str
    index_type: str = "AUTOINDEX"
    metric_type: str = ""
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.index_type not in DEFAULTS:
            raise IndexError_(f"no index type {self.index_type!r}")
        metric = self.metric_type or ("HAMMING" if self.index_type in _BINARY else "IP" if self.index_type in _SPARSE else "" if self.index_type in SCALAR else "COSINE")
        object.__setattr__(self, "metric_type", metric)
        object.__setattr__(self, "params", DEFAULTS[self.index_type] | self.params)

    def to_dict(self) -> dict[str, Any]:
        return {"field_name": self.field_name, "index_type": self.index_type, "metric_type": self.metric_type, "params": self.params}


def auto_type(rows: int) -> tuple[str, dict[str, Any]]:
    """Exact below ``AUTO_EXACT`` rows, else an inverted file of about four times the root of the rows."""
    return ("FLAT", {}) if rows < AUTO_EXACT else ("IVF_FLAT", {"nlist": int(4 * math.sqrt(rows))})


def lloyd(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Euclidean k-means centres of a bounded block of rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].astype(np.float64)
    x = x.astype(np.float64)
    for _ in range(rounds):
        near = _nearest_centre(x, centres)
        for c in range(len(centres)):
            mine = x[near == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _fit_sample(df: DataFrame, key: str, vector: str, rows: int, seed: int) -> np.ndarray:
    n = df.count()
    part = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / max(1, n)))) if n > rows else df
    got = part.select(vector).where(F.col(vector).isNotNull()).toArrow().column(0).to_pylist()
    dims = {len(v) for v in got}
    if len(dims) > 1:
        raise IndexError_("vectors differ in their dimension")
    return np.array(got, dtype=np.float64)


@dataclass
class InvertedFile:
    """IVF over a vector column: ``rows`` has key, vector, ``cluster`` and, if quantised, ``code``.

    ``code``: 8-bit codes of the components (SQ8), or of the sub-vectors' nearest codewords (PQ).
    """

    key: str
    vector: str
    centres: np.ndarray
    rows: DataFrame
    low: np.ndarray | None = None
    step: np.ndarray | None = None
    books: np.ndarray | None = None

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, nlist: int = 128, kind: str = "FLAT", m: int = 8, nbits: int = 8, fit_rows: int = FIT_ROWS, seed: int = 1) -> InvertedFile:
        """Rows without a vector are not indexed."""
        sample = _fit_sample(df, key, vector, fit_rows, seed)
        if not len(sample):
            return cls(key, vector, np.zeros((0, 0)), df.select(key, vector).limit(0).withColumn("cluster", F.lit(0)))
        centres = lloyd(sample, nlist, seed=seed)
        low = step = books = None
        if kind == "SQ8":
            low, high = sample.min(axis=0), sample.max(axis=0)
            step = np.maximum((high - low) / 255.0, 1e-12)
        if kind == "PQ":
            dim = sample.shape[1]
            if dim % m:
                raise IndexError_(f"{m} sub-vectors do not divide {dim} components")
            sub = dim // m
            books = np.stack([_padded(lloyd(sample[:, i * sub : (i + 1) * sub], 1 << nbits, seed=seed + i), 1 << nbits) for i in range(m)])
        self = cls(key, vector, centres, df, low, step, books)
        shared = df.sparkSession.sparkContext.broadcast((centres, low, step, books))
        dim = sample.shape[1]
        schema = T.StructType([df.schema[key], df.schema[vector], T.StructField("cluster", T.IntegerType()), T.StructField("code", T.BinaryType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, lo, st, bk = shared.value
            for b in batches:
                fits = np.flatnonzero(b.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
                b = b.take(pa.array(fits))
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                if lo is not None:
                    code = np.clip(np.floor((x - lo) / st), 0, 255).astype(np.uint8)
                elif bk is not None:
                    code = _pq_codes(x, bk)
                else:
                    code = None
                codes = pa.nulls(len(x), pa.binary()) if code is None else pa.array([r.tobytes() for r in code], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_nearest_centre(x, c).astype(np.int32)), codes], names=[key, vector, "cluster", "code"])

        self.rows = df.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(assign, schema)
        return self

    def probes(self, query: Sequence[float], nprobe: int) -> list[int]:
        q = np.asarray(query, dtype=np.float64)
        d = ((self.centres - q) ** 2).sum(axis=1)
        return [int(c) for c in np.argsort(d, kind="stable")[:nprobe]]

    def search(self, query: Sequence[float], k: int, nprobe: int | None = None, metric_name: str = "COSINE", shortlist: int | None = None, where: Any = None) -> DataFrame:
        """``(key, score)`` among the nearest clusters, best first.

        Quantised rows are ranked by their codes first; the ``shortlist`` best are scored exactly (none: only those
        k, with the score of the code). Without ``nprobe`` a ``PROBE_SHARE`` of the clusters is read.
        """
        nprobe = nprobe or math.ceil(PROBE_SHARE * len(self.centres))
        near = self.rows.where(F.col("cluster").isin(*self.probes(query, nprobe)))
        if where is not None:
            near = near.where(where)
        if self.low is None and self.books is None:
            return S.top_k(near, self.key, self.vector, query, k, metric_name)
        m = M.metric(metric_name)
        if m.block is None:
            raise IndexError_(f"{metric_name} has no kernel for codes")
        low, step, books = self.low, self.step, self.books
        q = np.asarray(query, dtype=np.float64)[None, :]

        @F.pandas_udf("double")
        def coded(code):
            if not len(code):
                return code.astype("float64")
            c = np.frombuffer(b"".join(code), dtype=np.uint8).reshape(len(code), -1)
            x = low + (c + 0.5) * step if low is not None else np.concatenate([books[i][c[:, i]] for i in range(len(books))], axis=1)
            import pandas as pd

            return pd.Series(m.block(q, x)[0])

        order = S.ordered("score", m.higher_is_better)
        by_code = near.withColumn("score", coded("code"))
        if shortlist is None:
            return by_code.select(self.key, "score").orderBy(order, self.key).limit(k)
        short = by_code.orderBy(order, self.key).limit(max(k, shortlist)).select(self.key, self.vector)
        return S.top_k(short, self.key, self.vector, query, k, metric_name)


def _padded(book: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate((book, np.repeat(book[:1], size - len(book), axis=0))) if len(book) < size else book


def _pq_codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    sub = books.shape[2]
    return np.stack([_nearest_centre(x[:, i * sub : (i + 1) * sub], books[i]) for i in range(len(books))], axis=1).astype(np.uint8)


def sq8_codes(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(key, component, code)``: 8-bit codes between the smallest and largest value of each component."""
    long = df.select(key, F.posexplode(vector).alias("component", "x")).where(F.col("component") < dim).withColumn("x", F.col("x").cast("double"))
    bounds = long.groupBy("component").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    code = F.when(F.col("high") > F.col("low"), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * 255)).otherwise(F.lit(0))
    return long.join(bounds, "component").select(key, "component", code.cast("int").alias("code"))


def lsh_planes(tables: int, bits: int, dim: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def lsh_top_k(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, tables: int = 16, bits: int = 4, seed: int = 1, metric_name: str = "COSINE") -> DataFrame:
    """Rows that share a signature of random hyperplanes with the query in at least one table, scored exactly."""
    q = np.asarray(query, dtype=np.float64)
    planes = lsh_planes(tables, bits, len(q), seed)
    want = (planes @ q > 0).astype(int)
    hit = F.lit(False)
    for t in range(tables):
        same = F.lit(True)
        for b in range(bits):
            side = M.dot(F.col(vector), S.vector_literal(planes[t, b])) > 0
            same = same & (side if want[t, b] else ~side)
        hit = hit | same
    return S.top_k(df.where(F.col(vector).isNotNull()).where(hit), key, vector, query, k, metric_name)


def binary_top_k(df: DataFrame, key: str, vector: str, query: bytes, k: int, metric_name: str = "HAMMING") -> DataFrame:
    """Exact scan over binary vectors of a multiple of eight bytes (null or of another length: no hit)."""
    words = [int.from_bytes(query[i : i + 8], "big", signed=True) for i in range(0, len(query), 8)]
    fits = df.where(F.octet_length(vector) == len(query))
    score = M.metric(metric_name).column(M.words_of(F.col(vector), len(query)), F.array(*[F.lit(w).cast("long") for w in words]))
    return fits.select(key, score.cast("double").alias("score")).orderBy("score", key).limit(k)


def binary_batch_top_k(df: DataFrame, queries: Sequence[bytes], k: int, key: str, vector: str, metric_name: str = "HAMMING") -> DataFrame:
    """``(query_id, rank, key, score)``: one pass over the rows, k of each query kept a task before they are shuffled."""
    if not queries or len({len(q) for q in queries}) > 1:
        raise IndexError_("binary queries have one length")
    size = len(queries[0])
    m = M.metric(metric_name)
    words = M.words_of(F.col(vector), size)
    of = lambda q: F.array(*[F.lit(int.from_bytes(q[i : i + 8], "big", signed=True)).cast("long") for i in range(0, size, 8)])
    scores = F.array(*[F.struct(F.lit(i).alias("query_id"), m.column(words, of(q)).cast("double").alias("score")) for i, q in enumerate(queries)])
    rows = df.where(F.octet_length(vector) == size).select(key, F.explode(scores).alias("s")).select("s.query_id", key, "s.score").where("score is not null")
    w = Window.partitionBy("query_id").orderBy("score", key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def sampled_bits(size: int, bits: int, tables: int, seed: int = 1) -> list[list[int]]:
    """The places of each table's bits in a vector of ``size`` bytes, from the left."""
    rng = np.random.default_rng(seed)
    return [rng.permutation(size * 8)[:bits].tolist() for _ in range(tables)]


def binary_buckets(df: DataFrame, key: str, vector: str, size: int, bits: int = 12, tables: int = 8, seed: int = 1) -> DataFrame:
    """``(key, vector, bucket)``: one bucket per table, of sampled bits; equal bits share a bucket."""
    words = M.words_of(F.col(vector), size)
    buckets = []
    for t, at in enumerate(sampled_bits(size, bits, tables, seed)):
        value = F.lit(0).cast("long")
        for i, b in enumerate(at):
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.get(words, F.lit(b // 64)), int(63 - b % 64)).bitwiseAND(F.lit(1).cast("long")), i))
        buckets.append(value + F.lit(t << 40))
    return df.where(F.octet_length(vector) == size).select(key, vector, F.explode(F.array(*buckets)).alias("bucket"))


def binary_bucket_top_k(df: DataFrame, key: str, vector: str, query: bytes, k: int, metric_name: str = "HAMMING", bits: int = 4, tables: int = 24, seed: int = 1) -> DataFrame:
    """Rows that share a bucket with the query, scored exactly; near ones share one with high probability."""
    size = len(query)
    asked = df.sparkSession.createDataFrame([(bytearray(query),)], "q binary").withColumn("n", F.lit(0))
    own = binary_buckets(asked, "n", "q", size, bits, tables, seed).select("bucket")
    near = binary_buckets(df, key, vector, size, bits, tables, seed).join(F.broadcast(own), "bucket", "left_semi").select(key, vector).dropDuplicates([key])
    return binary_top_k(near, key, vector, query, k, metric_name)


def postings(df: DataFrame, key: str, vector: str, drop_ratio: float = 0.2) -> DataFrame:
    """``(term, key, weight, most)``: the sparse index; per row the smallest weights are dropped by the ratio.

    ``most`` is the term's largest weight, an upper bound for skipping terms.
    """
    entries = F.map_entries(vector)
    if drop_ratio > 0:
        # Within the row: the smallest weights first, of equal ones the larger term.
        by_weight = F.array_sort(F.transform(entries, lambda e: F.struct(F.abs(e["value"]).alias("a"), (-e["key"]).alias("t"), e["key"].alias("key"), e["value"].alias("value"))))
        gone = F.floor(F.size(vector) * F.lit(drop_ratio)).cast("int")
        entries = F.slice(by_weight, gone + 1, F.greatest(F.size(vector) - gone, F.lit(0)))
    rows = df.where(F.size(vector) > 0).select(key, F.explode(entries).alias("e")).select(F.col("e.key").alias("term"), key, F.col("e.value").alias("weight"))
    most = rows.groupBy("term").agg(F.max(F.abs("weight")).alias("most"))
    return rows.join(most, "term")


def postings_top_k(index: DataFrame, query: dict[int, float], k: int, key: str) -> DataFrame:
    """Best inner products with a sparse query, from its terms' postings only."""
    if not query:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    weights = F.create_map(*[F.lit(x) for i, w in query.items() for x in (int(i), float(w))])
    hit = index.where(F.col("term").isin(*[int(i) for i in query]))
    score = F.sum(F.col("weight").cast("double") * F.element_at(weights, F.col("term")))
    return hit.groupBy(key).agg(score.alias("score")).orderBy(F.desc("score"), key).limit(k)
