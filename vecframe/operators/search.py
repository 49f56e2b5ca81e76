"""Exact vector search: top-k of one or many query vectors, thresholds, sparse vectors, reranking, hydration.

Scans read the key, the vector and the filter's columns only; wide columns are fetched for the hits alone. Ties go to
the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from vecframe.errors import SearchError
from vecframe.functions.metrics import metric

#: Query vectors handled in one pass over the corpus; this bounds what is broadcast. More are handled in turns.
QUERY_BLOCK = 4096


def vector_literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def ordered(score: str, higher: bool) -> Column:
    return F.desc(score) if higher else F.asc(score)


def scored(df: DataFrame, vector: str, query: Sequence[float], metric_name: str, as_: str = "score") -> DataFrame:
    """Rows with a score; rows without one (null vector, zero norm) are left out."""
    m = metric(metric_name)
    return df.withColumn(as_, m.column(F.col(vector), vector_literal(query))).where(F.col(as_).isNotNull() & ~F.isnan(as_))


def top_k(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, metric_name: str = "COSINE", where: Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """``(key, columns..., score)`` of the k best rows, best first (a take-ordered, no full sort)."""
    rows = df if where is None else df.where(where)
    found = scored(rows.select(key, vector, *[c for c in columns if c not in (key, vector)]), vector, query, metric_name)
    return found.select(key, *[c for c in columns if c != key], "score").orderBy(ordered("score", metric(metric_name).higher_is_better), key).limit(k)


def within(df: DataFrame, key: str, vector: str, query: Sequence[float], threshold: float, metric_name: str = "COSINE", columns: Sequence[str] = ()) -> DataFrame:
    """All rows at least as good as a threshold."""
    m = metric(metric_name)
    found = scored(df.select(key, vector, *[c for c in columns if c not in (key, vector)]), vector, query, metric_name)
    good = F.col("score") >= threshold if m.higher_is_better else F.col("score") <= threshold
    return found.where(good).select(key, *[c for c in columns if c != key], "score")


def nearest(df: DataFrame, key: str, vector: str, query: Sequence[float], threshold: float, metric_name: str = "COSINE") -> DataFrame:
    """The one best row if it is at least as good as the threshold."""
    return within(df, key, vector, query, threshold, metric_name).orderBy(ordered("score", metric(metric_name).higher_is_better), key).limit(1)


def query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[list[Any], np.ndarray]]:
    """Keys and vectors of a stated query set, in turns of about ``QUERY_BLOCK`` rows; each turn is fetched by itself,
    so the driver never holds more than one. A query without a vector is left out."""
    rows = queries.select(key, vector).where(F.col(vector).isNotNull())
    turns = -(-rows.count() // QUERY_BLOCK)
    for i in range(turns):
        part = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(turns)) == i) if turns > 1 else rows
        got = part.toArrow()
        ids, vectors = got.column(0).to_pylist(), got.column(1).to_pylist()
        if len({len(v) for v in vectors}) > 1:
            raise SearchError("query vectors differ in their dimension")
        if ids:
            yield ids, np.array(vectors, dtype=np.float64).reshape(len(ids), -1)


def rows_of(batch: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and double rows of the vectors of that dimension in a (key, vector) batch."""
    fits = pa.array(np.flatnonzero(batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim))
    x = batch.column(1).take(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return batch.column(0).take(fits), x


def batch_top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", query_key: str | None = None, query_vector: str | None = None, metric_name: str = "COSINE", exclude_self: bool = False) -> DataFrame:
    """``(query_id, rank, key, score)``: the k best rows of each query of a stated query set.

    The queries go as a matrix to one pass over the corpus, which scores blocks by a matrix product and keeps k rows a
    query and batch, so what is shuffled is bounded by queries and tasks. Queries beyond ``QUERY_BLOCK`` are handled in
    turns of that size.
    """
    m = metric(metric_name)
    if m.block is None:
        raise SearchError(f"{metric_name} has no batch kernel")
    qk, qv = query_key or key, query_vector or vector
    spark = corpus.sparkSession
    qtype = queries.schema[qk].dataType
    arrow_type = to_arrow_type(qtype)
    schema = T.StructType([T.StructField("query_id", qtype), T.StructField(key, corpus.schema[key].dataType), T.StructField("score", T.DoubleType())])
    higher, worst = m.higher_is_better, -np.inf if m.higher_is_better else np.inf

    def run_for(own: list[Any], matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((own, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            for b in batches:
                keys, x = rows_of(b, q.shape[1])
                if not len(x):
                    continue
                s = m.block(q, x)
                s = np.where(np.isnan(s), worst, s)
                if exclude_self:
                    s[np.asarray(own)[:, None] == keys.to_numpy(zero_copy_only=False)[None, :]] = worst
                order = -s if higher else s
                n = min(k, s.shape[1])
                # All rows as good as the k-th, so that ties are left to the merge.
                edge = np.partition(order, n - 1, axis=1)[:, n - 1 : n]
                r, c = np.nonzero((order <= edge) & np.isfinite(order))
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in r.tolist()], type=arrow_type), keys.take(pa.array(c)), pa.array(s[r, c])], names=["query_id", key, "score"])

        return corpus.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)

    hits = None
    for own, matrix in query_blocks(queries, qk, qv):
        part = run_for(own, matrix)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = spark.createDataFrame([], schema)
    # The rounding hides that a product of matrices sums in another order than a row's own product.
    w = Window.partitionBy("query_id").orderBy(ordered("score", higher), key)
    ranked = hits.withColumn("score", F.round("score", 10)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", key, "score")


def sparse_top_k(corpus: DataFrame, query: dict[int, float], k: int, key: str = "id", vector: str = "sparse_embedding") -> DataFrame:
    """The k rows of the largest inner product with a sparse query; rows that share no index are no hits."""
    weights = F.create_map(*[F.lit(x) for i, w in query.items() for x in (int(i), float(w))]) if query else F.create_map().cast("map<int,double>")
    shared = F.filter(F.map_keys(vector), lambda i: F.map_contains_key(weights, i))
    score = F.aggregate(shared, F.lit(0.0), lambda s, i: s + F.element_at(F.col(vector), i).cast("double") * F.element_at(weights, i))
    found = corpus.select(key, vector).where(F.size(shared) > 0).select(key, score.alias("score"))
    return found.orderBy(F.desc("score"), key).limit(k)


def sparse_join(queries: DataFrame, corpus: DataFrame, k: int, query_key: str = "query_id", key: str = "id", vector: str = "sparse_embedding") -> DataFrame:
    """``(query_id, rank, key, score)`` for many sparse queries: postings joined by index, summed per pair."""
    q = queries.select(F.col(query_key).alias("query_id"), F.explode(vector).alias("i", "qw"))
    c = corpus.select(key, F.explode(vector).alias("i", "w"))
    pairs = q.join(c, "i").groupBy("query_id", key).agg(F.sum(F.col("qw").cast("double") * F.col("w").cast("double")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def rerank(candidates: DataFrame, embeddings: DataFrame, query: Sequence[float], limit: int, key: str = "id", vector: str = "embedding", score: str = "distance", metric_name: str = "COSINE", position: str | None = None) -> DataFrame:
    """Candidates rescored against the query; one without an embedding keeps its score.

    If no candidate has an embedding the order given by ``position`` (or the old score) stays.
    """
    m = metric(metric_name)
    have = embeddings.select(F.col(key), m.column(F.col(vector), vector_literal(query)).alias("_new"))
    both = candidates.join(have, key, "left")
    # One row says whether any candidate was rescored.
    some = both.agg((F.count("_new") > 0).alias("_any")).withColumn("_one", F.lit(1))
    out = both.withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one").drop("_one").withColumn("score", F.coalesce("_new", score))
    better = F.col("score") if not m.higher_is_better else -F.col("score")
    old = F.col(position) if position else (-F.col(score) if m.higher_is_better else F.col(score))
    out = out.withColumn("_o", F.when(F.col("_any"), better).otherwise(old.cast("double")))
    return out.orderBy("_o", *([position] if position else []), key).limit(limit).drop("_new", "_any", "_o")


def hydrate(hits: DataFrame, entities: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Hits with the entity's wide columns, fetched for the hits only."""
    return hits.join(entities.select(key, *columns), key, "left")


# --- fusion of several searches --------------------------------------------------------------------------------


def leg(hits: DataFrame, key: str, higher: bool, number: int, k: int) -> DataFrame:
    """Hits of one search as ``(key, leg, rank, score)``; they are at most k, so one window suffices."""
    w = Window.partitionBy(F.lit(number)).orderBy(ordered("score", higher), key)
    return hits.select(key, "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, F.lit(number).alias("leg"), "rank", "score")


def reciprocal_rank_fusion(legs: Sequence[DataFrame], key: str, limit: int, constant: int = 60) -> DataFrame:
    """``(key, score)``: sum of 1 / (constant + rank) over the legs."""
    union = legs[0]
    for x in legs[1:]:
        union = union.unionByName(x)
    fused = union.groupBy(key).agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"))
    return fused.withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), key).limit(limit)


def bounded_score(score: Column, metric_name: str) -> Column:
    """A score mapped to [0, 1], higher being better: cosine (1 + s) / 2, inner product 1/2 + atan(s) / pi,
    squared L2 1 - 2 atan(d) / pi."""
    name = metric_name.upper()
    if name == "COSINE":
        return (1 + score) / 2
    if name == "IP":
        return 0.5 + F.atan(score) / F.pi()
    return 1 - 2 * F.atan(score) / F.pi()


def weighted_fusion(legs: Sequence[tuple[DataFrame, str, float]], key: str, limit: int) -> DataFrame:
    """``(key, score)``: weighted sum of the bounded scores of legs ``(hits, metric, weight)``."""
    union = None
    for hits, name, weight in legs:
        part = hits.select(key, (bounded_score(F.col("score"), name) * F.lit(float(weight))).alias("part"))
        union = part if union is None else union.unionByName(part)
    if union is None:
        raise SearchError("nothing to fuse")
    return union.groupBy(key).agg(F.sum("part").alias("score")).withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), key).limit(limit)
