"""Encoding of whole texts by a byte-level BPE vocabulary, as a tree reduction over pieces of the text.

A text is a concatenation of leaves. A leaf is encoded alone; two neighbours are joined by encoding anew only a
window around their border, which grows until the tokens outside of it provably cannot change. Joining is
associative, so a text of any length is encoded by halves, and decoding concatenates up the same tree.

Why the tokens outside the window stand: the pre-tokeniser scans from left to right, and a match that ends at
``e`` has looked at no character from ``e + LOOK`` on. Matches of the left part that end ``LOOK`` characters before
the border are therefore the same in the whole text. From the last of them the scan goes on over the border until
it starts a match where the right part's own scan also starts one: from there both scans see the same characters.
The BPE merges never cross a match, so the tokens on both sides stand as well.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokeniser pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No match of PATTERN looks at more characters than this beyond its end.
LOOK = 3
#: Characters of a leaf.
LEAF = 4096
#: Characters to the right of the border in the first window.
WINDOW = 64


class Node:
    """The encoding of a stretch of text: tokens, and where its pre-tokens start (character, token)."""

    __slots__ = ("text", "ids", "starts", "at")

    def __init__(self, text: str, ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> None:
        self.text, self.ids, self.starts, self.at = text, ids, starts, at


class Encoder:
    """Encodes texts by the vocabulary in ``path``, or in ``raw`` (base64 token and rank per line)."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, leaf: int = LEAF, window: int = WINDOW, raw: bytes | None = None) -> None:
        import regex
        import tiktoken

        raw = raw if raw is not None else Path(path).read_bytes()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.regex = regex.compile(pattern)
        self.bytes = {v: k for k, v in ranks.items()}
        self.leaf, self.window = max(2, leaf), max(1, window)

    def _pieces(self, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Pre-tokens of ``text[start:end]``; a pre-token alone encodes as it does in its text."""
        for m in self.regex.finditer(text, start, end):
            yield m.span()

    def _leaf(self, text: str) -> Node:
        spans = list(self._pieces(text, 0, len(text)))
        tokens = [self.bpe.encode_ordinary(text[a:b]) for a, b in spans]
        counts = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        ids = np.fromiter((t for x in tokens for t in x), dtype=np.int32, count=int(counts.sum()))
        return Node(text, ids, np.array([a for a, _ in spans], dtype=np.int64), np.cumsum(counts) - counts)

    def join(self, left: Node, right: Node) -> Node:
        if not left.text:
            return right
        if not right.text:
            return left
        text, border = left.text + right.text, len(left.text)
        # Pre-token k ends where k + 1 starts; it stands if that is LOOK before the border.
        k = max(0, bisect_right(left.starts, border - LOOK) - 1)
        start = int(left.starts[k])
        size, sync = self.window, None
        while sync is None:
            end = min(len(text), border + size)
            spans = []
            for a, b in self._pieces(text, start, end):
                if a >= border:
                    j = bisect_left(right.starts, a - border)
                    if j < len(right.starts) and right.starts[j] == a - border:
                        sync = j
                        break
                if end < len(text) and b > end - LOOK:
                    break  # this match may change with what follows: a larger window is needed
                spans.append((a, b))
            else:
                sync = len(right.starts)  # the window reached the end of the text
            size *= 2
        tokens = [self.bpe.encode_ordinary(text[a:b]) for a, b in spans]
        counts = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        middle = np.fromiter((t for x in tokens for t in x), dtype=np.int32, count=int(counts.sum()))
        head = int(left.at[k])
        tail = int(right.at[sync]) if sync < len(right.at) else len(right.ids)
        shift = head + len(middle) - tail
        return Node(
            text,
            np.concatenate((left.ids[:head], middle, right.ids[tail:])),
            np.concatenate((left.starts[:k], np.array([a for a, _ in spans], dtype=np.int64), right.starts[sync:] + border)),
            np.concatenate((left.at[:k], head + np.cumsum(counts) - counts, right.at[sync:] + shift)),
        )

    def tree(self, text: str) -> Node:
        if len(text) <= self.leaf:
            return self._leaf(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def encode(self, text: str | None) -> list[int] | np.ndarray:
        """Token ids; none for a null or empty text. A text of one leaf needs no tree."""
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.bpe.encode_ordinary(text)
        return self.tree(text).ids

    def decode(self, ids) -> str:
        """Bytes of the tokens, concatenated by halves."""

        def join(a: int, b: int) -> bytes:
            if b - a <= self.leaf:
                return b"".join(self.bytes[int(i)] for i in ids[a:b])
            return join(a, (a + b) // 2) + join((a + b) // 2, b)

        return join(0, len(ids)).decode("utf-8")


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, leaf: int, shipped: Broadcast) -> Encoder:
    """One encoder per Python worker and vocabulary, from the bytes the driver shipped."""
    if (path, leaf) not in _ENCODERS:
        _ENCODERS[path, leaf] = Encoder(path, leaf=leaf, raw=shipped.value)
    return _ENCODERS[path, leaf]


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's bytes (under a megabyte or two), read on the driver: executors need no file of theirs."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``(key, ids)`` for each row: the token ids of ``text`` without special tokens.

    A null or empty text has the empty list; a string that looks like a special token is ordinary text. Null keys
    and repeated rows are kept as they are; other columns are not read. One pass over the rows, no shuffle.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    sent = shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, leaf, sent)
        for batch in batches:
            lists = [np.asarray(enc.encode(t), dtype=np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def token_counts(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each text (0 for null), Arrow-batched; for the active session."""
    sent = shipped(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), vocabulary)

    @F.pandas_udf("int")
    def count(s):
        enc = encoder(vocabulary, LEAF, sent)
        return s.map(lambda t: len(enc.encode(t)))

    return count(text)
