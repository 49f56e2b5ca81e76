"""What the vector operators share: usable rows, cells around fitted centres, float blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm._common import Stage, hinted

#: Rows that the centres are fitted on, and most centres: what is sent to the driver and to all executors is
#: bounded by these, whatever the table's size.
SAMPLE_ROWS = 16384
MOST_CENTRES = 1024


def fresh(df: DataFrame, key: str, version: str | None, keep_null: bool = False) -> DataFrame:
    """Rows without those that a later ``version`` of their key replaces; ties stay, and null versions come first.

    Only keys that occur more than once take part in the join; they are counted, and the wide rows are shuffled only
    if those are too many to broadcast. Rows without a key are left out unless ``keep_null``.
    """
    if not keep_null:
        df = df.where(F.col(key).isNotNull())
    if version is None:
        return df
    again = hinted(Stage(df.groupBy(F.col(key).alias("_fresh_key")).agg(F.count("*").alias("_fresh_n"), F.max(version).alias("_fresh_last")).where("_fresh_n > 1").drop("_fresh_n")))
    return df.join(again, F.col(key) == F.col("_fresh_key"), "left").where(F.col("_fresh_key").isNull() | F.col(version).eqNullSafe(F.col("_fresh_last"))).drop("_fresh_key", "_fresh_last")


def usable(vector: str, dim: int):
    """Exactly ``dim`` components, none null (finiteness and zeros are tested on the block)."""
    return (F.size(vector) == dim) & ~F.exists(F.col(vector), lambda x: x.isNull())


def once(rows: DataFrame, dim: int) -> tuple[DataFrame, Stage]:
    """Of ``(id, v)`` rows with equal vectors the one of the smallest id; and ``(a, b)``, that id and each other one.

    Two hashes of a vector stand for it in narrow rows. Only usable vectors count as copies.
    """
    hashed = rows.where(usable("v", dim)).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    first = hinted(Stage(hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("h1", "h2", "rep")))
    whole = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: F.abs(x) < float("inf"))
    copies = Stage(hashed.join(first, ["h1", "h2"]).where(F.col("id") != F.col("rep")).where(whole).select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct())
    return hashed.join(first, ["h1", "h2"], "left").where("rep is null or id = rep").select("id", "v"), copies


def block(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Float rows of a list column whose lists all have ``dim`` components, and which of them are usable."""
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    return x, np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; large and tiny rows are scaled by their largest component first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def unpack(blob: pd.Series, dim: int) -> np.ndarray:
    """Rows of raw float32 bytes."""
    return np.frombuffer(b"".join(blob), dtype=np.float32).reshape(-1, dim)


def pack(x: np.ndarray) -> list[bytes]:
    raw, width = np.ascontiguousarray(x, dtype=np.float32).tobytes(), x.shape[1] * 4
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Unit centres of unit rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        sums[found] = np.add.reduceat(x[order], first, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        good = norms > 1e-6
        centres[good] = sums[good] / norms[good, None]
    return centres


@dataclass
class Cells:
    """Centres fitted on a bounded sample, the size of the table they were fitted for, and each centre's share of it."""

    centres: np.ndarray
    rows: int
    shares: np.ndarray


def fit_cells(df: DataFrame, key: str, vector: str, dim: int, per_cell: int, seed: int = 0, sample_rows: int = SAMPLE_ROWS, most: int = MOST_CENTRES) -> Cells:
    """Fit centres, one for about ``per_cell`` rows, on about ``sample_rows`` rows chosen by a hash of the key."""
    n = df.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else df
    rows = sample.where(usable(vector, dim)).select(vector).toArrow().column(0).combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0) if rows.num_chunks else pa.array([], pa.list_(pa.float32()))
    x, good = block(rows, dim)
    x = x[good]
    k = max(1, min(most, -(-n // per_cell), len(x)))
    if not len(x):
        return Cells(np.eye(1, dim, dtype=np.float32), n, np.ones(1))
    u = unit(x)
    centres = spherical_kmeans(u, k, seed=seed)
    near = np.concatenate([(u[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(u), 4096)])
    return Cells(centres, n, np.bincount(near, minlength=len(centres)) / len(u))


def usable_blocks(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 4096) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and raw float rows of the usable vectors of (key, vector) batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            x, good = block(part.column(1), dim)
            keep = np.flatnonzero(good)
            if len(keep):
                yield part.column(0).take(pa.array(keep)), x[keep]


def salt(keys: np.ndarray, seed: int) -> np.ndarray:
    """A hash of integer keys."""
    from vecframe.llm.shingles import mix

    return mix(keys.astype(np.int64).view(np.uint64) + np.array([0x9E3779B97F4A7C15], np.uint64) * np.uint64(seed + 1))
