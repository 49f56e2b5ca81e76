"""Cache analytics over access traces as Spark jobs."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Upper bounds of the latency buckets in milliseconds; beyond the last is overflow.
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)


def sliding_hit_rate(df: DataFrame, ts: str, hit: Column, seconds: int = 300) -> DataFrame:
    """``(second, lookups, hits, hit_rate)`` of each second with lookups, over the ``seconds`` up to it.

    Counts are summed per second first. The frame then runs within chunks of time, each of which is given the seconds
    of the window before it, so no task sees more than a chunk.
    """
    chunk = max(seconds, 3600)
    sec = F.unix_timestamp(F.col(ts).cast("timestamp"))
    per = df.where(F.col(ts).isNotNull()).groupBy(sec.alias("second")).agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("h"))
    own = F.floor(F.col("second") / chunk)
    per = per.withColumn("chunk", F.explode(F.when(F.floor((F.col("second") + seconds - 1) / chunk) > own, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("chunk").orderBy("second").rangeBetween(-(seconds - 1), 0)
    out = per.select("second", "chunk", F.sum("n").over(w).alias("lookups"), F.sum("h").over(w).alias("hits")).where(F.floor(F.col("second") / chunk) == F.col("chunk"))
    return out.select("second", "lookups", "hits", (F.col("hits") / F.col("lookups")).alias("hit_rate"))


def latency_bucket(latency: Column, bounds: Sequence[float] = LATENCY_BOUNDS) -> Column:
    """Number of the first bucket whose bound is not below the latency; ``len(bounds)`` for overflow."""
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(latency <= b, F.lit(i)).otherwise(out)
    return out


def latency_histogram(df: DataFrame, latency: str, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    return df.where(F.col(latency).isNotNull()).groupBy(latency_bucket(F.col(latency), bounds).alias("bucket")).agg(F.count("*").alias("lookups"))


def latency_percentiles(df: DataFrame, latency: str, fractions: Sequence[float], bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """``(fraction, bound)``: upper bound of the bucket at which the running count reaches the fraction of all.

    Overflow is infinite. The window runs over the histogram's few rows.
    """
    hist = latency_histogram(df, latency, bounds)
    w = Window.partitionBy(F.lit(1)).orderBy("bucket")
    run = hist.select("bucket", F.sum("lookups").over(w).alias("run"), F.sum("lookups").over(Window.partitionBy(F.lit(1))).alias("total"))
    upper = F.element_at(F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf"))), F.col("bucket").cast("int") + 1)
    wanted = run.select("bucket", "run", "total", upper.alias("upper"), F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    return wanted.where(F.col("run") >= F.col("total") * F.col("fraction")).groupBy("fraction").agg(F.min("upper").alias("bound"))


def tier_counters(df: DataFrame, tier: str, hit: Column) -> DataFrame:
    """Lookups, hits, misses and hits by tier over the whole life of a cache; one row."""
    of = lambda name: F.sum(F.when(F.col(tier) == name, 1).otherwise(0)).alias(f"{name}_hits" if name != "miss" else "misses")
    return df.agg(F.count("*").alias("lookups"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), of("l1"), of("l2"), of("semantic"), of("miss"))


def lru_hits(df: DataFrame, key: str, order: Sequence[str], capacity: int, block_rows: int = 200_000) -> DataFrame:
    """``(accesses, hits)`` of an LRU cache: an access hits if fewer than ``capacity`` other keys came since the last
    access of its key.

    What such a cache holds at a moment are the ``capacity`` keys used last before it. So the trace is cut into blocks
    of its first order column (a number or a time), each block tells the keys it used last, these are merged from block
    to block, and every block is replayed by itself from what the ones before it left. Null keys are no accesses.
    """
    first = F.col(order[0])
    at = F.unix_micros(first.cast("timestamp")) if df.schema[order[0]].dataType.typeName().startswith("timestamp") else first
    cols = [f"o{i}" for i in range(len(order))]
    trace = df.where(F.col(key).isNotNull() & first.isNotNull()).select(F.col(key).cast("string").alias("k"), at.cast("double").alias("at"), *[F.col(c).alias(n) for c, n in zip(order, cols, strict=True)])
    n_blocks = -(-trace.count() // block_rows)
    edges = sorted(set(trace.approxQuantile("at", [i / n_blocks for i in range(1, n_blocks)], 0.1 / n_blocks))) if n_blocks > 1 else []
    block = F.lit(0)
    for e in edges:
        block = block + (F.col("at") > e).cast("int")
    trace = trace.withColumn("block", block)

    def last_used(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf.sort_values(cols)["k"].iloc[::-1].drop_duplicates().head(capacity)
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "used": [keys.tolist()]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        held: list[str] = []
        out = []
        for number, used in pdf.sort_values("block")[["block", "used"]].itertuples(index=False):
            out.append((int(number), held))
            held = list(dict.fromkeys([*used, *held]))[:capacity]
        return pd.DataFrame(out, columns=["block", "held"])

    # One list of capacity keys per block.
    before = trace.groupBy("block").applyInPandas(last_used, "block int, used array<string>").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(merged, "block int, held array<string>")

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        held = OrderedDict.fromkeys(reversed(list(state.held.iloc[0]))) if len(state) else OrderedDict()
        hits = 0
        for k in rows.sort_values(cols)["k"]:
            if k in held:
                hits += 1
                held.move_to_end(k)
            else:
                held[k] = None
                if len(held) > capacity:
                    held.popitem(last=False)
        return pd.DataFrame({"accesses": [len(rows)], "hits": [hits]})

    per_block = trace.groupBy("block").cogroup(before.groupBy("block")).applyInPandas(run, "accesses bigint, hits bigint")
    return per_block.agg(F.coalesce(F.sum("accesses"), F.lit(0)).alias("accesses"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def simulate(df: DataFrame, key: str, order: Sequence[str], policies: Sequence[str], capacities: Sequence[int], shards: int = 1) -> DataFrame:
    """``(policy, capacity, shard, accesses, hits, hit_rate)``: the trace replayed through each policy.

    Like the cache itself the trace is sharded by a hash of the key; each shard has its part of the capacity and is
    one task per policy and capacity. Ties in ``order`` are broken by the key.
    """
    from vecframe.cache.policies import replay

    trace = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    trace = trace.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int"))
    cols = [f"o{i}" for i in range(len(order))]
    runs = trace.withColumn("run", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(int(c)).alias("capacity")) for p in policies for c in capacities])))

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        policy, capacity, shard = key_
        keys = pdf.sort_values([*cols, "k"])["k"].tolist()
        hits = replay(policy, max(1, int(capacity) // shards), keys)
        return pd.DataFrame({"policy": [policy], "capacity": [capacity], "shard": [shard], "accesses": [len(keys)], "hits": [hits], "hit_rate": [hits / len(keys) if keys else 0.0]})

    flat = runs.select("run.policy", "run.capacity", "shard", "k", *cols)
    return flat.groupBy("policy", "capacity", "shard").applyInPandas(run, "policy string, capacity int, shard int, accesses bigint, hits bigint, hit_rate double")


def frequencies(df: DataFrame, key: str) -> DataFrame:
    """Exact access counts, the truth that a sketch estimates."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("accesses"))


def semantic_hits(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """``(query_id, id, similarity)``: for each vector the most similar one before it (smaller key) at a cosine of at
    least ``threshold``: what a semantic cache would have answered it with.

    Blocks of vectors are compared with all rows by matrix products; each batch yields one row per vector at most.
    Meant for traces of a cache's size; its cost grows with the square of the rows.
    """
    from vecframe.functions.metrics import METRICS
    from vecframe.operators.search import query_blocks, rows_of

    kernel = METRICS["COSINE"].block
    parts = None
    for own, matrix in query_blocks(df, key, vector):
        shared = df.sparkSession.sparkContext.broadcast((np.asarray(own, dtype=np.int64), matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                keys, x = rows_of(b, q.shape[1])
                if not len(x):
                    continue
                k = keys.to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(k, kind="stable")
                k = k[order]
                s = np.round(kernel(q, x[order]), 10)
                s = np.where((k[None, :] < ids[:, None]) & ~np.isnan(s), s, -np.inf)
                best = s.argmax(axis=1)
                v = s[np.arange(len(ids)), best]
                hit = np.flatnonzero(v >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(k[best[hit]]), pa.array(v[hit])], names=["query_id", "id", "similarity"])

        part = df.select(F.col(key).cast("long"), vector).where(F.col(vector).isNotNull()).mapInArrow(run, "query_id bigint, id bigint, similarity double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double")
    best = parts.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("id")).alias("n"))).alias("b"))
    return best.select("query_id", (-F.col("b.n")).alias("id"), F.col("b.similarity").alias("similarity"))


def prometheus(counters: dict[str, float], gauges: dict[str, float], prefix: str = "vecframe_cache") -> str:
    """Counters and gauges in the text exposition format."""
    lines = []
    for kind, values in (("counter", counters), ("gauge", gauges)):
        for name, value in sorted(values.items()):
            full = f"{prefix}_{name}" + ("_total" if kind == "counter" else "")
            lines += [f"# TYPE {full} {kind}", f"{full} {value:g}"]
    return "\n".join(lines) + "\n"
