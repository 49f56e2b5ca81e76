"""Streams: batched upserts into a collection, sliding hit rates, expiring entries, access traces through a policy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from vecframe.sources.storage import Collection

#: State lives in RocksDB: it may exceed memory and survives restarts with the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Timestamps without a zone become UTC instants, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def upsert_into(stream: DataFrame, collection: Collection, checkpoint: str, order: list[Column | str] | None = None, interval: str = "60 seconds", available_now: bool = False) -> StreamingQuery:
    """Each micro-batch is one snapshot of the collection. A batch that is run again after a failure writes the same
    rows under the same keys, so it changes nothing."""

    def write(batch: DataFrame, _number: int) -> None:
        if not batch.isEmpty():
            collection.upsert(batch, order)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def sliding_hit_rate(stream: DataFrame, ts: str, hit: Column, window: str = "300 seconds", slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """``(start, end, lookups, hits, hit_rate)`` per window; rows later than the watermark are dropped."""
    timed = with_event_time(stream, ts, late)
    out = timed.groupBy(F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("lookups"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"))
    return out.select("w.start", "w.end", "lookups", "hits", (F.col("hits") / F.col("lookups")).alias("hit_rate"))


class ExpiringEntries(StatefulProcessor):
    """The entry of each key while it lives. A row within the time to live of the last write hits; within the grace
    period after it, it is stale; later or first, it misses and writes. State goes with the grace period."""

    def __init__(self, ttl_ms: int = 300_000, grace_ms: int = 60_000) -> None:
        self.ttl, self.grace = ttl_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = pd.concat(list(rows)).sort_values("at_ms")
        at = self.written.get()[0] if self.written.exists() else None
        state = []
        for now in got.at_ms:
            if at is not None and now < at + self.ttl:
                state.append("hit")
            elif at is not None and now < at + self.ttl + self.grace:
                state.append("stale")
            else:
                state.append("miss")
                at = int(now)
        if at is not None:
            self.written.update((at,))
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at + self.ttl + self.grace)
        yield pd.DataFrame({"key": [key[0]] * len(got), "at_ms": got.at_ms, "state": state})

    def handleExpiredTimer(self, key: Any, timer_values: Any, expired: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.written.clear()
        yield from ()

    def close(self) -> None:
        """Nothing is held outside the state."""


def entry_states(stream: DataFrame, key: str, ts: str, ttl: float = 300.0, grace: float = 60.0, late: str = "1 minute") -> DataFrame:
    """``(key, at_ms, state)``: whether each access finds a fresh or stale entry, or makes one."""
    timed = with_event_time(stream, ts, late).select(F.col(key).cast("string").alias("key"), F.unix_millis(ts).alias("at_ms"), F.col(ts).alias("ts"))
    return timed.groupBy("key").transformWithStateInPandas(ExpiringEntries(int(ttl * 1000), int(grace * 1000)), "key string, at_ms bigint, state string", "append", "EventTime")


class PolicyTrace(StatefulProcessor):
    """One shard's cache: its policy lives in the state between batches."""

    def __init__(self, policy: str, capacity: int) -> None:
        self.policy_name, self.capacity = policy, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blob = handle.getValueState("cache", "blob binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        import pickle

        from vecframe.cache.policies import policy

        p, held = pickle.loads(self.blob.get()[0]) if self.blob.exists() else (policy(self.policy_name, self.capacity, seed=7), set())
        hits = n = 0
        for k in pd.concat(list(rows)).sort_values(["at_ms", "key"])["key"]:
            n += 1
            if k in held:
                hits += 1
                p.on_hit(k)
                continue
            while len(held) >= p.capacity and (out := p.select_victim()) is not None:
                p.on_remove(out)
                held.discard(out)
            p.on_admit(k)
            held.add(k)
        self.blob.update((pickle.dumps((p, held)),))
        yield pd.DataFrame({"shard": [int(key[0])], "accesses": [n], "hits": [hits]})

    def close(self) -> None:
        """Nothing is held outside the state."""


def trace_through(stream: DataFrame, key: str, ts: str, policy: str, capacity: int, shards: int = 8) -> DataFrame:
    """``(shard, accesses, hits)`` of each micro-batch of an access trace; shards go by a hash of the key."""
    rows = stream.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"))
    return rows.groupBy("shard").transformWithStateInPandas(PolicyTrace(policy, max(1, capacity // shards)), "shard int, accesses bigint, hits bigint", "append", "None")


def replay_table(df: DataFrame, path: str, files: int, order: str) -> tuple[StructType, str]:
    """A table laid out as files in an order, to be read back as a stream (tests, back-fills)."""
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)
    return df.schema, path


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run a stream over what is there now, into a memory table or a function."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (writer.foreachBatch(each) if each else writer.format("memory").queryName(name)).start()
    q.awaitTermination()
    return q
